"""Words and word shingles of whole Arrow columns, as 64-bit hashes, without a Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 3)
_PLACE = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SHORT = _RNG.integers(1, 2**64, 64, dtype=np.uint64)
#: Space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lowered(column: pa.Array) -> pa.Array:
    """Lower case, letter by letter, so that code points keep their places."""
    return pc.utf8_lower(column.cast(pa.large_string()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and where each row begins.  Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Powers:
    """Powers of the multiplier and of its inverse, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(n, p, np.uint64)], dtype=np.uint64) for p in (_PRIME, inverse))
        return self.up, self.down


def words(raw: np.ndarray, at: np.ndarray, powers: Powers, *, lower: bool = True, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of non-space bytes, their first and end bytes, and where each row's words begin."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    solid = ~breaks[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]
    begins[firsts] = solid[firsts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    lasts = firsts[1:] - 1
    ends[lasts] = solid[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers.get(len(raw) + 1)
    table = _BYTE[_LOWER] if lower else _BYTE
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * up[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start, end, np.searchsorted(start, at)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, in order, and where each row's begin.

    A row of 1 to k - 1 words has one shingle, of all its words; a row without words has none.
    """
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.r_[0, np.cumsum(count)]
    if not out_at[-1]:
        return np.zeros(0, np.uint64), out_at
    full = n >= k
    of = np.repeat(np.arange(len(n)), count)
    first = rows[:-1][of] + (np.arange(out_at[-1]) - out_at[:-1][of])
    padded = np.r_[hashes, np.zeros(k, np.uint64)]
    total = np.zeros(out_at[-1], np.uint64)
    for j in range(k):
        inside = full[of] | (j < n[of])
        total += np.where(inside, padded[first + j], np.uint64(0)) * _PLACE[j]
    total += np.where(full[of], np.uint64(0), _SHORT[np.minimum(n[of], 63)])
    return mix(total), out_at


def slices(column: pa.Array, most: int = 1 << 20):
    """Begin and end of runs of rows with about `most` bytes, at least one row each."""
    _, at = text_bytes(column)
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, len(at) - 1)
        a = b


def row_sets(column: pa.Array, k: int, powers: Powers) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    raw, at = text_bytes(column)
    h, _, _, rows = words(raw, at, powers)
    s, where = shingles(h, rows, k)
    return [np.unique(s[where[i] : where[i + 1]]) for i in range(len(column))]
