"""Token ids of whole texts by the tokenizers library, with a bounded memo of its results.

The tokenizer of word_bpe_49k.json lower-cases, drops white space and cuts what is left into pieces: runs of letters,
single digits, runs of other signs.  Each piece's ids depend on the piece alone, and pieces repeat, so the
library's model is asked once for each and its answer kept.  Pieces of ASCII and Latin-1 letters are found with
numpy; a word with any other letter, an apostrophe or the marks of a special token goes through the library's
normaliser and the pre-tokenizer's pattern.  The tests hold all this against Tokenizer.encode on whole texts.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pandas as pd
import regex
from tokenizers import Tokenizer

from gridsmith.llm._words import LOWER, SPACE, U64, Texts, hashed

#: the pre-tokenizer's own pattern (fixed value)
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: pieces kept by a worker, and bytes of text in work at once: together some 200 MB
MEMO = 350_000
SLICE_BYTES = 3 << 19

_KIND = np.full(256, 3, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_TRAIL = np.zeros(256, bool)
_TRAIL[0x80:0xC0] = True
_TRAIL[[0x97, 0xB7]] = False
_ODD = np.zeros(256, bool)
_ODD[0x80:] = True
_ODD[0x27] = True


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE shows each byte as a letter: printable ones as they are, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _cuts_alike(file: dict) -> bool:
    """Whether a tokenizer's file lower-cases, drops white space and cuts by PIECES, as encode() does on its own."""
    try:
        first, blank, lower = file["normalizer"]["normalizers"]
        split, byte_level = file["pre_tokenizer"]["pretokenizers"]
        return (
            (first["type"], blank["type"], blank["pattern"], blank["content"], lower["type"]) == ("NFC", "Replace", {"Regex": r"\s+"}, " ", "Lowercase")
            and (split["type"], split["pattern"], split["behavior"], split["invert"]) == ("Split", {"Regex": PIECES.pattern}, "Removed", True)
            and (byte_level["type"], byte_level["add_prefix_space"], byte_level["use_regex"]) == ("ByteLevel", False, False)
        )
    except (KeyError, TypeError, ValueError):
        return False


class Encoder:
    """encode(Texts) gives all ids and where each text's begin."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[int, bytes] = {}
        #: whether the file cuts texts as this module does; others go through the library whole
        self.by_pieces = _cuts_alike(json.loads(self.tokenizer.to_str()))

    def _whole(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        out = [np.zeros(0, np.uint32)]
        for i in range(len(texts)):
            got = self.tokenizer.encode_batch([texts.text(i).decode("utf-8", "replace")], add_special_tokens=False)
            out.append(np.array(got[0].ids, np.uint32))
        return np.concatenate(out), np.cumsum([0, *map(len, out[1:])])

    def _shown(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        return self._shown(piece.decode() if piece.isalnum() else piece.decode("latin-1").translate(self.letters))

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        if any(s in word for s in self.special):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
        return b"".join([self._piece(p.encode()) for p in PIECES.findall(self.normalizer.normalize_str(word))])

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all texts, and the offsets of each text's ids among them."""
        if not self.by_pieces:
            return self._whole(texts)
        buf, n = texts.buf, len(texts.buf)
        if not len(texts.starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        lead = np.zeros(n, bool)  # the byte before begins a Latin-1 letter
        np.equal(buf[:-1], 0xC3, out=lead[1:])
        odd = _ODD[buf] & ~((buf == 0xC3) | (lead & _TRAIL[buf]))
        odd[1:] |= (buf[1:] == 0x7C) & (buf[:-1] == 0x3C)
        lower = LOWER[buf]
        lower[lead & (buf >= 0x80) & (buf <= 0x9E)] += 0x20
        kind = _KIND[buf]
        first = kind == 2
        first[1:] |= kind[1:] != kind[:-1]
        first[texts.starts] = True
        first &= kind != 0
        word = np.unique(np.searchsorted(texts.starts, np.flatnonzero(odd), "right") - 1)  # words to give away whole
        for a, b in zip(texts.starts[word].tolist(), texts.ends[word].tolist(), strict=True):
            first[a + 1 : b] = False
            lower[a:b] = buf[a:b]
        starts = np.flatnonzero(first)
        after = np.append(starts[1:], n)
        ends = np.minimum(after, texts.ends[np.searchsorted(texts.starts, starts, "right") - 1])
        hashes = hashed(lower, starts, ends)
        given = np.searchsorted(starts, texts.starts[word])
        hashes[given] ^= U64(0x5851F42D4C957F2D)
        which, distinct = pd.factorize(hashes)
        first_at = np.empty(len(distinct), np.int64)
        first_at[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        whole = np.zeros(len(distinct), bool)
        whole[which[given]] = True
        if len(self.memo) + len(distinct) > MEMO:
            self.memo.clear()
        memo, data = self.memo, lower.tobytes()
        got = [memo.get(h) for h in distinct.tolist()]
        for k in [k for k, x in enumerate(got) if x is None]:
            at = first_at[k]
            piece = data[starts[at] : ends[at]]
            got[k] = memo[int(distinct[k])] = self._word(piece) if whole[k] else self._piece(piece)
        pool = np.frombuffer(b"".join(got), np.uint32)
        lens = np.fromiter(map(len, got), np.int32, len(got)) // 4
        begins = (np.cumsum(lens) - lens).astype(np.int32)
        each = lens[which]
        to = np.cumsum(each)
        at = np.arange(int(to[-1]), dtype=np.int32)
        at += np.repeat(begins[which] - (to - each).astype(np.int32), each)
        return pool[at], np.concatenate([[0], to])[np.searchsorted(starts, texts.offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and path, so that the memo serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
