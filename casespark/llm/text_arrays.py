"""Numpy views of text columns inside Arrow tasks: byte arrays, word spans and 64-bit span hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: the white space of all contracts: blank and 0x09-0x0D
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32                                             # A-Z only

#: bytes of text that one numpy step handles (a longer document is a step of its own)
STEP_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
#: for a second, independent hash of the same spans
MORE_CODES = np.random.default_rng(20240301).integers(0, 2**64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = 1 << max(18, (n - 1).bit_length())
        for k, step in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 2**64)))):
            table = np.full(size, step, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of a 64-bit value."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def combine(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + other + np.uint64(0x2545F4914F6CDD1D))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n+1, from 0) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents with at most ``limit`` bytes, or of a single longer document."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word (run of non-separators) in document order."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SEPARATOR[data]
    first = np.zeros(n + 1, bool)                              # a document begins here
    first[offs] = True
    here, before, after = inside[1:-1], inside[:-2], inside[2:]
    starts = np.flatnonzero(here & (~before | first[:-1]))
    ends = np.flatnonzero(here & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _BYTE_CODES) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever they are."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
