"""Quality rules with risk-controlled cutoffs, in DataFrame operations alone.

Each rule rejects a document whose ratio exceeds the rule's cutoff in the document's stratum.  Cutoffs are chosen on
labelled documents: from the loosest on, a tighter one is taken while an exact binomial test shows that it rejects
at most `risk` of the good documents.  A family of tests errs with probability at most `delta`: the sequence of
cutoffs of a rule stops at its first failure, which costs nothing, and rules and strata share delta (Bonferroni).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm._scratch import written

WORD = r"[^\x20\x09-\x0D]+"
#: rule: (ratio, cutoffs from loose to tight)
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03]),
    "duplicate_lines": ("n_dup_lines / n_lines", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "repeated_words": ("n_repeat_words / n_words", [0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05]),
    "capitals": ("n_capitals / word_chars", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "exclamations": ("n_exclamations / n_words", [2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05]),
    "long_words": ("word_chars / n_words", [50.0, 30.0, 20.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0]),
}


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a run of five which the text has twice or more; runs are told apart by 64-bit hashes."""
    n = F.size(words)

    def covered(runs: Column) -> Column:
        order = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(order, lambda z: F.transform(
            F.filter(z, lambda e, j: F.coalesce(F.get(z, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(z, j + 1)["h"] == e["h"], F.lit(False))),
            lambda e: e["i"],
        ))
        reach = _let(F.array_sort(twice), lambda p: F.transform(p, lambda at, k: F.coalesce(F.least(F.get(p, k + 1) - at, F.lit(5)), F.lit(5))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    runs = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    some = _let(runs, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n > 5, some).otherwise(0)


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and counts of each whole text; a null text counts as one without words."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    d = d.withColumn("lines", lines)
    return d.select(
        "doc_id", "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "words")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclamations"),
    ).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def ratio(rule: str) -> Column:
    a, _, b = RULES[rule][0].split()
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def _stirling_error(n: Column) -> Column:
    """log n! - log(sqrt(2 pi n) (n/e)^n): by its series from 16 on, by the factorial below, 0 for 0."""
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / (n * n)) / (n * n)) / (n * n)) / (n * n)) / n
    factorial = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.greatest(n, F.lit(1)), F.lit(16)).cast("long")), F.lit(0.0), lambda a, j: a + F.log(j.cast("double")))
    return F.when(n >= 16, series).when(n <= 0, 0.0).otherwise(factorial - (n + 0.5) * F.log(n) + n - 0.5 * math.log(2 * math.pi))


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x, for x > 0."""
    return x * F.log(x / mean) + mean - x


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with success p, by its exact terms at any size.

    The largest term, that of k, is taken in the saddle-point form of log n!, in which nothing large cancels; the
    smaller ones follow by their ratios, from k down, until they no longer change the sum: twelve standard deviations
    on they are below the precision of a double.  From k = p n on the tail is over one half at least in the limit
    and no test passes: 1 is given.
    """
    k, n, q = k.cast("double"), n.cast("double"), 1 - p
    top = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * q)
    top = F.exp(top) * F.sqrt(n / (2 * math.pi * k * (n - k)))
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p * q)) + 60).cast("long")
    step = lambda a, j: F.struct(
        (a["t"] * (k - j + 1) * q / ((n - k + j) * p)).alias("t"),
        (a["s"] + a["t"] * (k - j + 1) * q / ((n - k + j) * p)).alias("s"),
    )
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(terms, F.lit(1))), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step)["s"]
    return F.when((n <= 0) | (k >= n * p), 1.0).when(k == 0, F.exp(n * math.log1p(-p))).otherwise(top * summed)


def cutoffs(feats: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff, good, rejected: the tightest cutoff of each rule that the labelled documents allow.

    Good documents are those with quality 1 in all rows of a doc_id that pass the base rules.  Two things are shared
    out.  The risk, over rules: a document goes if any rule rejects it, so each may reject risk / rules of a stratum's
    good documents, and all together at most risk.  The error delta, over rules and strata: each such pair is a test
    that may err, and with delta / (rules x strata) each, none does with probability 1 - delta.  A rule without an
    allowed cutoff has no row.  The counts of the labelled documents are written once.
    """
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).filter("q = 1")
    numbers = sorted({x for text, _ in RULES.values() for x in text.split(" / ")})
    held = written(feats.filter("not base_failed").join(good, "doc_id", "left_semi").select("stratum", *numbers))
    hits = [F.array(*[F.sum((ratio(r) > c).cast("long")) for c in RULES[r][1]]) for r in RULES]
    counted = held.groupBy("stratum").agg(F.count("*").alias("good"), F.array(*hits).alias("hits"))
    # a row for each stratum in one task
    counted = counted.withColumn("families", F.count("*").over(Window.partitionBy()) * len(RULES))
    names = F.array(*map(F.lit, RULES))
    values = F.array(*[F.array(*map(F.lit, RULES[r][1])) for r in RULES])
    rows = counted.select("stratum", "good", "families", F.posexplode("hits").alias("r", "of_rule"))
    rows = rows.select("stratum", "good", "families", "r", F.posexplode("of_rule").alias("c", "rejected"))
    rows = rows.withColumn("p", binomial_tail(F.col("rejected"), F.col("good"), risk / len(RULES)))
    upto = Window.partitionBy("stratum", "r").orderBy("c")
    rows = rows.withColumn("ok", F.min((F.col("p") <= F.lit(delta) / F.col("families")).cast("int")).over(upto))
    last = rows.filter("ok = 1").groupBy("stratum", "r").agg(F.max_by(F.struct("c", "good", "rejected"), "c").alias("x"))
    return last.select("stratum", F.get(names, "r").alias("rule"), F.get(F.get(values, "r"), F.col("x.c")).alias("cutoff"), "x.good", "x.rejected")


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, broken (rules that reject it), kept.

    kept is false where base_failed (under 10 words, or over 20% in repeated runs of five) or a rule rejects.  A null
    stratum is one of its own; one without enough labelled documents has no cutoffs.  Rows that share a doc_id are
    judged each on its own text.  An empty table gives none; other columns are left out, whatever their names.
    """
    feats = written(features(docs, stratum))
    chosen = cutoffs(feats, labels, risk, delta)
    wide = chosen.groupBy(F.col("stratum").alias("s2")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"c_{r}") for r in RULES])
    rows = feats.join(written(wide), F.col("stratum").eqNullSafe(F.col("s2")), "left")
    broken = F.array_compact(F.array(*[F.when(ratio(r) > F.col(f"c_{r}"), F.lit(r)) for r in RULES]))
    out = rows.withColumn("broken", broken)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), F.array_join("broken", ",").alias("broken"),
    )
