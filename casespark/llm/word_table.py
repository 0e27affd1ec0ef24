"""Table from word hashes to id sequences, for encoders that work word by word."""

from __future__ import annotations

import numpy as np

from casespark.llm.text_arrays import span_hashes


class WordTable:
    """Ids of the words met so far, in open addressing; it starts anew when it is half full.

    Subclasses give ``ids_of(data, starts, ends)``: ids of distinct words one after another, and how many each has.
    """

    SLOTS = 1 << 20

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)             # 0: free
        self.place = np.zeros(self.SLOTS, np.int32)
        self.length = np.zeros(self.SLOTS, np.int32)
        self.pool, self.used, self.words = np.zeros(1 << 16, np.int32), 0, 0

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slot of every key, or -1 - (the free slot met)."""
        mask = self.SLOTS - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        todo = np.flatnonzero(self.keys[slot] != h)
        while len(todo):
            met = self.keys[slot[todo]]
            free = met == 0
            slot[todo[free]] = -1 - slot[todo[free]]
            todo = todo[~free]
            slot[todo] = (slot[todo] + 1) & mask
            todo = todo[self.keys[slot[todo]] != h[todo]]
        return slot

    def _learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, lengths = self.ids_of(data, starts, ends)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.int32)])
        self.pool[self.used:self.used + len(ids)] = ids
        place = self.used + np.cumsum(lengths) - lengths
        todo = np.arange(len(h))
        while len(todo):                                        # of keys that meet in a free slot one stays, the rest go on
            slot = -1 - self._find(h[todo])
            self.keys[slot], self.place[slot], self.length[slot] = h[todo], place[todo], lengths[todo]
            todo = todo[self.keys[slot] != h[todo]]
        self.used += len(ids)
        self.words += len(h)

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        h = span_hashes(data, starts, ends) | np.uint64(1)      # never 0
        slot = self._find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            new = new[np.unique(h[new], return_index=True)[1]]
            if self.words + len(new) > self.SLOTS // 2:
                new = np.unique(h, return_index=True)[1]
                while len(new) > self.SLOTS // 2:               # a step of very many distinct words
                    self.SLOTS *= 2
                self._clear()
            self._learn(h[new], data, starts[new], ends[new])
            slot = self._find(h)
        lengths = self.length[slot].astype(np.int64)
        before = np.cumsum(lengths) - lengths
        return self.pool[np.repeat(self.place[slot] - before, lengths) + np.arange(int(lengths.sum()))], lengths
