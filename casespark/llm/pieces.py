"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text is a blank marker followed by its characters, blanks written as markers.  No piece has a marker after another
character, so the best path of a text is the best paths of its units (markers and the characters up to the next);
each distinct unit is solved once, all new units of a step together, position by position.  Characters that no piece
covers become byte pieces.  Decoding joins pieces and bytes, turns markers into blanks and drops the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casespark.llm.text_arrays import steps, text_buffers
from casespark.llm.word_table import WordTable

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: bytes of text that are encoded at a time
PART_BYTES = 500_000
LONG_UNIT = 512                                                # longer units are solved one by one


@dataclass
class PieceModel:
    """Pieces by id with log scores; ``bytes_at``: id of byte 0 (the others follow), ``normal``: may be matched."""

    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    bytes_at: int

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """From a SentencePiece file.  A BPE file has merge ranks for scores: rank r becomes the log share of Zipf's law."""
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        raw = np.array([m.get_score(i) for i in ids])
        normal = np.array([not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in ids])
        scores = raw
        if raw.min() < -1000:
            rank = np.zeros(len(raw))
            order = np.flatnonzero(normal)[np.argsort(-raw[normal], kind="stable")]
            rank[order] = np.arange(len(order))
            scores = -np.log((rank + 1) * np.log(len(order) + 1))
        return cls([m.id_to_piece(i) for i in ids], scores, normal, m.piece_to_id("<0x00>"))


class Trie:
    """Double-array trie: from state s, character code c leads to base[s] + c if check there is s."""

    def __init__(self, model: PieceModel):
        words = {w: i for i, w in enumerate(model.pieces) if model.normal[i] and w}
        self.alphabet = sorted({c for w in words for c in w})
        self.codes = {c: k + 1 for k, c in enumerate(self.alphabet)}
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for w, i in words.items():
            node = 0
            for c in w:
                code = self.codes[c]
                if code not in children[node]:
                    children[node][code] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][code]
            ends[node] = i
        self.depth = max(map(len, words), default=1)
        level = [0] * len(children)
        for k, kids in enumerate(children):                     # a child comes after its parent
            for kid in kids.values():
                level[kid] = level[k] + 1
        room = 2 * len(children) + 2 * len(self.alphabet) + 64
        used, base, check, piece = bytearray(room), [0] * room, [-1] * room, [-1] * room
        used[0] = 1
        state, low = {0: 0}, 1                                  # low: where the search for free places begins
        for node in sorted(range(len(children)), key=lambda k: (level[k], -len(children[k]))):
            if not children[node]:
                continue
            codes = sorted(children[node])
            offsets = [c - codes[0] for c in codes[1:]]
            low = used.index(0, low)
            spot, tries = max(low, codes[0]), 0
            while True:
                spot = used.find(0, spot)
                if spot < 0 or spot + codes[-1] - codes[0] >= len(used):
                    spot = spot if spot >= 0 else len(used)
                    grow = len(used) + codes[-1]
                    used += bytearray(grow)
                    base += [0] * grow
                    check += [-1] * grow
                    piece += [-1] * grow
                if not any(used[spot + d] for d in offsets):
                    break
                spot += 1
                tries += 1
            if tries > 64:                                      # crowded below: leave those places to single children
                low = spot if len(codes) > 1 else low
            s = state[node]
            base[s] = spot - codes[0]
            for code in codes:
                at, child = base[s] + code, children[node][code]
                used[at], check[at], piece[at], state[child] = 1, s, ends[child], at
        pad = len(self.alphabet) + 1                            # any code added to any base stays inside
        self.base, self.check, self.piece = (np.array(x + [v] * pad, np.int32) for x, v in ((base, 0), (check, -1), (piece, -1)))


class Unigram(WordTable):
    """Encoder of whole columns."""

    def __init__(self, model: PieceModel, trie: Trie):
        super().__init__()
        self.model, self.trie = model, trie
        self.unknown = float(model.scores[model.normal].min()) - UNKNOWN_PENALTY
        self.code_of = np.zeros(0x110000, np.int32)
        self.code_of[[ord(c) for c in trie.alphabet]] = np.arange(1, len(trie.alphabet) + 1)
        self.splits = not any(MARK in w.lstrip(MARK) for w, ok in zip(model.pieces, model.normal) if ok)

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all marked texts, starts of their units, and the text of each unit."""
        marked = [(MARK + t.replace(" ", MARK)).encode() if t else b"" for t in texts]
        data = np.frombuffer(b"".join(marked), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(m) for m in marked])])
        first = np.zeros(len(data) + 1, bool)
        first[offs] = True
        cut = first[:-1].copy()
        if self.splits and len(data):
            at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            after = np.zeros(len(data) + 3, bool)
            after[at + 3] = True
            cut[at[~after[at]]] = True
        starts = np.flatnonzero(cut)
        return data, starts, np.searchsorted(offs, starts, "right") - 1

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [data[s:e].tobytes().decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist())]
        size = np.array([len(w) for w in words], np.int64)
        found: list[np.ndarray | None] = [None] * len(words)
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= LONG_UNIT]
        lo = 0
        while lo < len(short):
            hi = lo + 1
            while hi < len(short) and (hi - lo) * int(size[short[hi]]) < 200_000:
                hi = min(len(short), hi + 256)
            group = short[lo:hi]
            for k, ids in zip(group, self._together([words[k] for k in group], size[group])):
                found[k] = ids
            lo = hi
        for k in order[len(short):]:
            found[k] = self._alone(words[k])
        return (np.concatenate(found) if found else np.zeros(0, np.int64)).astype(np.int32), np.array([len(f) for f in found], np.int64)

    def _together(self, words: list[str], size: np.ndarray) -> list[np.ndarray]:
        """Best paths of words of ascending length."""
        n, longest = len(words), int(size[-1])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes = np.zeros((n, longest), np.int32)
        fill = np.arange(longest)[None] < size[:, None]
        codes[fill] = self.code_of[chars]
        best = np.full((n, longest + 1), -np.inf)
        best[:, 0] = 0
        step = np.zeros((n, longest + 1), np.int32)             # length of the last piece; 0: unknown character
        piece = np.full((n, longest + 1), -1, np.int32)
        base, check, ends, scores = self.trie.base, self.trie.check, self.trie.piece, self.model.scores
        for i in range(longest):
            rows = np.arange(int(np.searchsorted(size, i, "right")), n)
            score, state = best[rows, i], np.zeros(len(rows), np.int64)
            alone = np.ones(len(rows), bool)
            for k in range(min(self.trie.depth, longest - i)):
                inside = size[rows] > i + k
                code = np.where(inside, codes[rows, i + k], 0)
                to = base[state] + code
                ok = (code > 0) & (check[to] == state)
                if k == 0:
                    covered = ok & (ends[to] >= 0)
                    lost = rows[~covered]
                    value = score[~covered] + self.unknown
                    better = value > best[lost, i + 1]
                    lost = lost[better]
                    best[lost, i + 1], step[lost, i + 1], piece[lost, i + 1] = value[better], 1, -1
                rows, score, state = rows[ok], score[ok], to[ok]
                if not len(rows):
                    break
                ids = ends[state]
                hit = np.flatnonzero(ids >= 0)
                value = score[hit] + scores[ids[hit]]
                at = rows[hit]
                better = value > best[at, i + k + 1]
                at, value, ids = at[better], value[better], ids[hit][better]
                best[at, i + k + 1], step[at, i + k + 1], piece[at, i + k + 1] = value, k + 1, ids
        at, every, last = size.copy(), np.arange(n), []
        while (at > 0).any():                                   # all paths backwards, a piece at a time
            last.append(np.where(at > 0, piece[every, at], -2))
            at = at - np.where(at > 0, np.maximum(step[every, at], 1), 0)
        ids = np.stack(last[::-1], 1)
        lost = (ids == -1).any(1)
        found = np.split(ids[ids >= 0], np.cumsum((ids >= 0).sum(1))[:-1])
        for k in np.flatnonzero(lost).tolist():
            found[k] = self._path(words[k], step[k].tolist(), piece[k].tolist())
        return found

    def _path(self, word: str, step: list[int], piece: list[int]) -> np.ndarray:
        out: list[int] = []
        j = len(word)
        while j > 0:
            if piece[j] >= 0:
                out.append(piece[j])
                j -= step[j]
            else:
                j -= 1
                out.extend(self.model.bytes_at + b for b in reversed(word[j].encode()))
        return np.array(out[::-1], np.int64)

    def _alone(self, word: str) -> np.ndarray:
        base, check, ends = self.trie.base, self.trie.check, self.trie.piece
        codes = self.code_of[[ord(c) for c in word]].tolist()
        n = len(word)
        best, step, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            state, covered = 0, False
            for k in range(i, min(n, i + self.trie.depth)):
                to = int(base[state]) + codes[k]
                if not codes[k] or check[to] != state:
                    break
                state = to
                if ends[to] >= 0:
                    covered = covered or k == i
                    value = best[i] + float(self.model.scores[ends[to]])
                    if value > best[k + 1]:
                        best[k + 1], step[k + 1], piece[k + 1] = value, k + 1 - i, int(ends[to])
            if not covered and best[i] + self.unknown > best[i + 1]:
                best[i + 1], step[i + 1], piece[i + 1] = best[i] + self.unknown, 1, -1
        return self._path(word, step, piece)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        data, starts, doc = self.units(texts)
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        ids, lengths = self.encode_words(data, starts, np.append(starts[1:], len(data)))
        return np.split(ids, np.cumsum(np.bincount(doc, lengths, len(texts)).astype(np.int64))[:-1])


def _plain(path: str) -> tuple[dict, dict]:
    """Model and trie as plain lists and arrays, which need no class of this library to be unpickled."""
    model = PieceModel.load(path)
    return dict(model.__dict__), dict(Trie(model).__dict__)


def _encoder(plain: tuple[dict, dict]) -> Unigram:
    trie = Trie.__new__(Trie)
    trie.__dict__.update(plain[1])
    return Unigram(PieceModel(**plain[0]), trie)


class _Decoder:
    """Texts of id sequences."""

    def __init__(self, model: PieceModel):
        table = [bytes([i - model.bytes_at]) if 0 <= i - model.bytes_at < 256 else w.encode() if model.normal[i] else b""
                 for i, w in enumerate(model.pieces)]
        self.pool = np.frombuffer(b"".join(table), np.uint8)
        self.length = np.array([len(t) for t in table], np.int64)
        self.place = np.cumsum(self.length) - self.length

    def text(self, ids: np.ndarray) -> str:
        size = self.length[ids]
        raw = self.pool[np.repeat(self.place[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _texts_and_ids(encoder: Unigram, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], list[np.ndarray]]]:
    """Ids, whole texts and piece ids of a few documents at a time."""
    for batch in batches:
        _, offs = text_buffers(batch.column(1))
        for lo, hi in steps(offs, PART_BYTES):
            texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            yield batch.column(0).slice(lo, hi - lo), texts, encoder.encode(texts)


def _raw(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<i4").tobytes() for x in ids], pa.binary())


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col, ids`` for every row; ``ids`` holds little-endian 32-bit piece ids.

    A null text is empty and has no ids.  Of paths of equal score the one that is met first stays (the shorter piece at
    the end).  Repeated rows are encoded one by one, texts of any length as a whole; an empty table gives an empty
    result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model_path))       # a vocabulary: about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, texts, ids in _texts_and_ids(_encoder(shared.value), batches):
            yield pa.record_batch([doc, pa.array(texts, pa.string()), _raw(ids)], [id_col, text_col, "ids"])

    return _base(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, `{text_col}` string, ids binary")


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The input with ``out_col``: the text of the ids (control pieces give nothing, broken bytes the replacement sign).

    Without ids the text is empty.  A marker character of the original text comes back as a blank.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(dict(PieceModel.load(model_path).__dict__))
    names = [c for c in encoded.columns if c != out_col]
    types = dict(encoded.dtypes)
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(PieceModel(**shared.value))
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            out = [decoder.text(np.frombuffer(raw or b"", "<i4")) for raw in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*names, out_col])

    return encoded.select(*names).mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in names] + [f"`{out_col}` string"]))


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col, ids, decoded`` for every row: both directions in one pass, so a task holds one table of the
    vocabulary and one worker.  Texts as in ``encode_pieces``, ``decoded`` as in ``decode_pieces``."""
    shared = docs.sparkSession.sparkContext.broadcast(_plain(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        decoder = _Decoder(encoder.model)
        for doc, texts, ids in _texts_and_ids(encoder, batches):
            yield pa.record_batch([doc, pa.array(texts, pa.string()), _raw(ids), pa.array(map(decoder.text, ids), pa.string())],
                                  [id_col, text_col, "ids", "decoded"])

    return _base(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, `{text_col}` string, ids binary, decoded string")
