"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations alone.

Targets are cut into blocks of equally many words; the blocks are seats, given to the sources by the highest
quotients target / (2 seats + 1) and dealt to the shards of the mix, so that each shard has an integer quota of every
source.  Then the seats are filled: a source's documents, in seeded order and from the first again once all are taken,
are a tape that is cut into blocks, and a seat takes the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.llm._scratch import written

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size) with rank, weight and target.

    Weights go round the sources by code point, null last.  The targets share `share` of all sizes by weight; none
    exceeds cap times its source's size, and what would is shared again by weight: that is target = min(cap x size,
    level x weight), with the one level at which the targets reach the sum.
    """
    # a row for each source in one task: what a mix has weights for
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    every = Window.partitionBy()
    below = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(below), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.col("level") <= F.col("most") / F.col("weight")
    ranked = ranked.withColumn("level", F.min(F.when(fits, F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(every)["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return ranked.select("source", "source_size", "rank", "weight", target.alias("target"))


def apportioned(aims: DataFrame, block: int) -> DataFrame:
    """aims with quota, the source's seats of round(sum of targets / block), by highest quotients target / (2 seats + 1).

    It starts from the quotas rounded on their own, which are the apportionment of their own sum, and gives or takes
    the few seats that are missing or too many, again by quotients; of equal ones the first source has priority.
    The seats that a source can gain are at most its share of (missing + sources) and one more.
    """
    every = Window.partitionBy()
    total = F.sum("target").over(every)
    a = aims.withColumn("__seats", F.round(total / block).cast("long"))
    a = a.withColumn("__exact", F.coalesce(F.try_divide(F.col("target") * F.col("__seats"), total), F.lit(0.0)))
    a = a.withColumn("quota", F.floor(F.col("__exact") + 0.5).cast("long"))
    a = a.withColumn("__missing", F.col("__seats") - F.sum("quota").over(every))
    a = a.withColumn("__share", F.coalesce(F.try_divide(F.col("target"), total), F.lit(0.0)))
    reach = F.ceil(F.col("__share") * (F.abs("__missing") + F.count("*").over(every))).cast("long") + 1
    a = a.withColumn("__reach", F.when(F.col("__missing") > 0, reach).otherwise(F.least(reach, F.col("quota"))))
    steps = a.filter("__missing != 0 and __reach > 0").select("rank", "target", "quota", "__missing", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__reach") - 1)).alias("j"))
    gain, loss = F.col("target") / (2 * (F.col("quota") + F.col("j")) + 1), F.col("target") / (2 * (F.col("quota") - F.col("j")) - 1)
    up = F.col("__missing") > 0
    order = Window.orderBy(F.when(up, -gain).otherwise(loss), F.when(up, F.col("rank")).otherwise(-F.col("rank")), "j")
    moved = steps.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= F.abs("__missing"))
    moved = moved.groupBy("rank").agg(F.sum(F.signum("__missing")).cast("long").alias("moved"))
    out = a.join(moved, "rank", "left").withColumn("quota", F.col("quota") + F.coalesce("moved", F.lit(0).cast("long")))
    return out.select(*aims.columns, "quota")


def _seats(quota: Column, first: Column, shard: Column, shards: int) -> Column:
    """Of a source's seats, numbered on from `first` through all sources, those that a shard has."""
    return F.floor((quota + shards - 1 - F.pmod(shard - first, F.lit(shards))) / shards).cast("long")


def shard_quotas(quotas: DataFrame, shards: int = 16) -> DataFrame:
    """quotas (rank, quota and more) with first_seat and shard_quota, an array of the source's seats in shards 0, 1, ...

    Seats are dealt round by round, and a source starts where the one before it ended: in a source the shards' seats
    are at most one apart, and so are the sums of all sources.
    """
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source in one task
    q = quotas.withColumn("first_seat", F.coalesce(F.sum("quota").over(before), F.lit(0).cast("long")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    return q.withColumn("shard_quota", F.transform(every, lambda k: _seats(F.col("quota"), F.col("first_seat"), k, shards)))


def _shard_words(upto: Column, shard: Column, block: int, shards: int) -> Column:
    """Words of a shard among the first `upto` of a source's tape: whole rounds of all shards, and its block in the last."""
    turn = F.pmod(shard - F.col("first_seat"), F.lit(shards)) * block
    return F.floor(upto / (block * shards)).cast("long") * block + F.greatest(F.lit(0).cast("long"), F.least(F.lit(block).cast("long"), upto % (block * shards) - turn))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = 32, seed: int = 7, shards: int = 16) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, quota, taken, shard_words.

    size is the words of the text (null: 0), taken the words that the mix takes of it, repeats counted, and
    shard_words, an array, how many of these go to each shard.  A source's quota x block words, at most cap times its
    size, are the start of its tape: its documents in the order of a seeded MD5 of doc_id, so reruns agree, again and
    again.  No document exceeds cap times its size where cap is an integer.  A source is as near to its target as the
    apportionment brings it, about half a block; one with a target below that may get no seat.  Rows that share a
    doc_id stand next to each other.  null is a source of its own.  An empty table gives none; other columns are left
    out, whatever their names.

    Word counts before a document come in two steps, so that no task holds a source: hash ranges of each source are
    summed, and only rows of one range are put in order together; rows without doc_id have a range for each size.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    none = F.md5(F.lit(f"{seed}:null").cast("binary"))  # rows without doc_id share this place, in the order of their sizes
    side = F.when(F.col("doc_id").isNull(), F.concat(F.lit("1"), F.lpad(F.col("size").cast("string"), 19, "0"))).when(F.col("h") < none, "0").otherwise("2")
    shared = F.when(F.left("h", F.lit(3)) == F.left(none, F.lit(3)), side).otherwise("")
    sized = written(sized.withColumn("h", h).withColumn("range", F.concat(F.left("h", F.lit(3)), shared)))
    sums = written(sized.groupBy("source", "range").agg(F.sum("size").alias("size")))
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = written(shard_quotas(apportioned(targets(sources, weights, share, cap), block), shards))
    q = quotas.withColumn("words", F.least(F.col("quota") * block, F.floor(F.col("source_size") * F.lit(float(cap))).cast("long")))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.select(F.col("source").alias("s2"), F.col("range").alias("r2"), F.coalesce(F.sum("size").over(before), F.lit(0).cast("long")).alias("before"))
    within = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long")))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    rows = rows.join(q.withColumnRenamed("source", "s3"), F.col("source").eqNullSafe(F.col("s3")))
    rows = rows.withColumn("at", F.col("before") + F.col("own"))
    zero = F.lit(0).cast("long")
    # of each pass over the source, where the document begins and ends on the tape as far as it is taken
    passes = F.sequence(zero, F.coalesce(F.floor(F.try_divide(F.col("words"), F.col("source_size"))), zero).cast("long"))
    begin = lambda p: F.least(F.col("words"), p * F.col("source_size") + F.col("at"))
    end = lambda p: F.least(F.col("words"), p * F.col("source_size") + F.col("at") + F.col("size"))
    rows = rows.withColumn("parts", F.filter(F.transform(passes, lambda p: F.struct(begin(p).alias("a"), end(p).alias("b"))), lambda x: x["b"] > x["a"]))
    total = lambda of: F.aggregate("parts", zero, lambda acc, x: acc + of(x))
    every = F.sequence(zero, F.lit(shards - 1).cast("long"))
    words = F.transform(every, lambda k: total(lambda x: _shard_words(x["b"], k, block, shards) - _shard_words(x["a"], k, block, shards)))
    return rows.select("doc_id", "source", "size", "source_size", "target", "quota", total(lambda x: x["b"] - x["a"]).alias("taken"), words.alias("shard_words"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of docs, all its columns, as many times as mix_documents() takes it.

    Texts stay whole: where the last block ends inside a document, the document goes in if at least half of it does.
    Rows that share a doc_id are taken alike, on average.
    """
    d = mix_documents(docs, **settings)
    taken = d.groupBy("doc_id").agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    copies = F.coalesce(F.round(F.try_divide("__taken", "__size")), F.lit(1)).cast("int")
    taken = taken.select(F.col("doc_id").alias("__doc"), copies.alias("__copies")).filter("__copies > 0")
    out = docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
