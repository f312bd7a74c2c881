"""Rank-order profiles against brute force, and their accuracy on documents that were not learned from."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridsmith.llm import language_id
from gridsmith.llm.queries import QUERIES

HARD = ["", None, "1 2 .", "a", "É ß!Ça", "abc", "x\ty", "ÄÖ", "你好 世界 a\0b", "İi ǅ 𝒜b", "don't STOP", "éa", "x" * 5000, "né " * 3000, " a", "a ", "\n"]


def code(s):
    v = 0
    for c in s:
        v = v << 21 | ((0 if c == " " else ord(c)) + 1)
    return v


def grams(text):
    words, word, out = [], "", Counter()
    for c in text or "":
        if c.isalpha():
            word += c.lower()[0]
        elif word:
            words, word = [*words, word], ""
    for w in [*words, word] if word else words:
        p = f" {w} "
        out.update(w)
        out.update(p[i : i + 2] for i in range(len(p) - 1))
        out.update(p[i : i + 3] for i in range(len(p) - 2))
    return {code(k): v for k, v in out.items()}


def profile(counts, size):
    return [k for k, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def brute(learned, texts, size):
    """(lang, score) of each text by the profiles of learned = [(lang, text)]."""
    counts = defaultdict(Counter)
    for lang, text in learned:
        counts[lang].update(grams(text))
    ranks = {lang: {g: i for i, g in enumerate(profile(c, size))} for lang, c in sorted(counts.items()) if c}
    out = []
    for t in texts:
        own = profile(grams(t), size)
        far = {lang: sum(abs(r[g] - i) if g in r else size for i, g in enumerate(own)) for lang, r in ranks.items()}
        best = min(far, key=lambda x: (far[x], x)) if own and far else "und"
        out.append((best, 1 - far[best] / (size * len(own)) if best != "und" else 0.0))
    return out


def drawn(n, seed):
    r, vocab = random.Random(seed), {"aa": "the of and with to in", "bb": "der die und nicht ein zu", "cc": "le la et les des une", "dd": "el los y que con por"}
    out = []
    for i in range(n):
        lang = r.choice(list(vocab))
        out.append((i, " ".join(r.choice(vocab[lang].split()) + r.choice(["", "", "s", "é"]) for _ in range(r.randint(1, 40))), r.choice([lang, lang, lang, None])))
    return out


@pytest.mark.parametrize("most", [2, 256])
def test_counts_and_ranks_are_exact(most, monkeypatch):
    texts = HARD + [t for _, t, _ in drawn(20, 1)]
    for at in range(0, len(texts), most):
        part = texts[at : at + most]
        doc, gram, count = language_id.counted(part)
        for i, t in enumerate(part):
            assert dict(zip(gram[doc == i].tolist(), count[doc == i].tolist(), strict=True)) == grams(t)
        doc, gram, rank = language_id.top(doc, gram, count, 50)
        for i, t in enumerate(part):
            assert gram[doc == i].tolist() == profile(grams(t), 50) and rank[doc == i].tolist() == list(range((doc == i).sum()))


def test_against_brute_force_with_hard_rows(spark, monkeypatch):
    rows = [(i, t, lang, "clash", 1.0, True) for i, t, lang in drawn(200, 2)]
    rows += [(300 + i, t, "aa", "clash", 1.0, True) for i, t in enumerate(HARD)] + [(None, "le la les", "cc", None, None, None), (3, "der die", "bb", None, None, None), (3, "der die", "bb", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double, held_out boolean")
    for size in (40, 1000):
        profiles = language_id.learn_profiles(docs, size)
        got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language_id.identify(docs, profiles, size).collect())
        want = brute([(r[2], r[1]) for r in rows if r[1] is not None and r[2]], [r[1] for r in rows], size)
        assert got == Counter((r[0], lang, round(s, 9)) for r, (lang, s) in zip(rows, want, strict=True))
    assert language_id.identify(docs.limit(0), profiles).count() == 0
    none = language_id.identify(docs, language_id.learn_profiles(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(rows)


def test_profiles_are_exact(spark, monkeypatch):
    docs = spark.createDataFrame(drawn(300, 3), "doc_id long, text string, lang string")
    want = sorted(map(tuple, language_id.learn_profiles(docs, 30).collect()))
    counts = defaultdict(Counter)
    for _, t, lang in drawn(300, 3):
        if lang:
            counts[lang].update(grams(t))
    assert want == sorted((lang, g, i) for lang, c in counts.items() for i, g in enumerate(profile(c, 30)))


def test_a_large_language_is_sampled(spark):
    docs = spark.createDataFrame([(i, "abc" if i % 2 else "xyz", "aa") for i in range(4000)] + [(9000, "efg", "bb")], "doc_id long, text string, lang string")
    rows = language_id.learn_profiles(docs, 5, per_language=100).collect()
    assert {r.lang for r in rows} == {"aa", "bb"} and max(r.rank for r in rows) == 4


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.identify(docs, language_id.learn_profiles(docs, 5), 5, most_languages=20)
    with pytest.raises(ValueError):
        language_id.learn_profiles(docs, 5, most_languages=20)


def test_query_on_documents_that_were_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_language_id"](spark, sf).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.99
    learned = [(r.lang, r.text) for r in truth.values() if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    some = [r for r in got if len(truth[r.doc_id].text or "") < 3000][:150]
    want = brute(learned, [truth[r.doc_id].text for r in some], 1000)
    assert [(r.lang_pred, round(r.score, 9)) for r in some] == [(lang, round(s, 9)) for lang, s in want]
