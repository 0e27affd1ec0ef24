"""Byte-level BPE ids of whole text columns: numpy splits the words, the ``tokenizers`` model encodes each distinct one.

The splitting rule is that of the public byte-level pre-tokenizer: contractions, an optional blank with a run of
letters, numbers or other signs, and runs of white space that leave their last character to the next word.
"""

from __future__ import annotations

import sys

import numpy as np

from casespark.llm.text_arrays import steps
from casespark.llm.word_table import WordTable

#: bytes that are split into words at a time: the arrays of a part take some forty times as much memory
PART_BYTES = 250_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def character_kinds() -> np.ndarray:
    """Kind of every code point."""
    import regex
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    chars = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, chars):
            kinds[ord(run[0][0]):ord(run[0][-1]) + 1] = kind
    return kinds


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class ByteBPE(WordTable):
    """Encoder of whole columns; each distinct word goes through the model once while the table holds it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.model = Tokenizer.from_file(path).model
        self.kinds = character_kinds()
        self.alphabet = byte_alphabet()

    def split(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where the words begin, and the document of each word."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)              # first byte of every character
        c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind, n = self.kinds[c], len(c)
        begin = np.zeros(n + 1, bool)                           # a document begins here
        begin[np.searchsorted(at, offs)] = True
        cut = begin.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~begin[1:n])
        cut[last] = True                                        # the last white-space character before a word
        cut[last[c[last] == 0x20] + 1] = False                  # a blank joins the word
        quote = np.flatnonzero((c[:-1] == 0x27) & cut[:n - 1] & (kind[1:] == _LETTER) & ~begin[1:n])
        one = np.isin(c[quote + 1], [ord(x) for x in "stmd"])
        for q, letters in ((quote[one], 1), (quote[~one], 2)):
            if letters == 2:
                q = q[q + 2 < n]
                pair = c[q + 1].astype(np.int64) * 65536 + c[q + 2]
                q = q[np.isin(pair, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")]) & ~begin[q + 2]]
            cut[q + 1] = False
            cut[q + 1 + letters] = True
        starts = at[np.flatnonzero(cut[:n])]
        return starts, np.searchsorted(offs, starts, "right") - 1

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = ("".join([self.alphabet[b] for b in data[s:e].tobytes()]) for s, e in zip(starts.tolist(), ends.tolist()))
        found = [[t.id for t in self.model.tokenize(w)] for w in words]
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, and the number of ids of each."""
        parts = [self._encode(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]) for lo, hi in steps(offs, PART_BYTES)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else self._encode(data, offs)

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, doc = self.split(data, offs)
        n = len(offs) - 1
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        ids, lengths = self.encode_words(data, starts, np.append(starts[1:], len(data)))
        return ids, np.bincount(doc, lengths, n).astype(np.int64)
