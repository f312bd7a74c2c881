"""Texts of many megabytes, and tokenizers other than the one that is cut by pieces."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridsmith.llm._bpe import Encoder, default_path
from gridsmith.llm._words import slices
from gridsmith.llm.simhash import fingerprint


def test_fingerprint_of_a_long_text_is_that_of_its_shingles():
    import xxhash

    r = random.Random(1)
    words = [f"w{r.randint(0, 999)}" for _ in range(140_000)]  # more than two slices of hashes
    data = " ".join(words).encode()
    lens = np.array([len(w) for w in words])
    ends = np.cumsum(lens + 1) - 1
    got = fingerprint(data, ends - lens, ends, 4)
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert got == want


def test_words_of_a_text_of_fifty_megabytes():
    text = "word and another\n" * 3_000_000
    assert len(text) > 50_000_000
    got = [(at, int(t.n_words[0])) for at, t in slices(pa.array([None, text, "x"]), 4 << 20) if len(t) == 1 and t.n_words[0] > 1]
    assert got == [(1, 9_000_000)]


@pytest.mark.parametrize("name, pieces", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_any_tokenizer_gives_its_own_ids(name, pieces):
    path = public_tokenizers.path(name) if not pieces else default_path()
    encoder = Encoder(path)
    assert encoder.by_pieces is pieces
    texts = ["Don't stop  the '90s", "", "ÄÖ ½ 你好\n\tx", None]
    whole = Tokenizer.from_file(path)
    for _, some in slices(pa.array(texts)):
        ids, offsets = encoder.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
