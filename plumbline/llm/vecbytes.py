"""Whole columns of text as one run of UTF-8 bytes with offsets, and numpy passes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: [\x20\x09-\x0D], as a table over bytes.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_SEEDED = np.random.default_rng(20240229)
_BYTE = _SEEDED.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def blocks(batch: pa.RecordBatch, column: str, limit: int = 512 << 10, rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most limit bytes of text and so many rows, or one row."""
    i = batch.schema.get_field_index(column)
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(size, before + limit, "right"))))
        yield batch.slice(at, to - at)
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and where each row starts (one more offset at the end); null: empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kept, data = column.buffers()[1:3]
    offsets = np.frombuffer(kept, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of word bytes (all but SPACE, or those in inside); runs end with their row."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[data] if inside is None else inside
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (xor-shift and multiply rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _power(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.cumprod(p))
        if n > 1 << 20:  # longer ones would stay in the memory of each worker
            return tuple(both)
        _powers[base] = tuple(both)
    return _powers[base]


class Hasher:
    """Hashes of any substrings of data, in one step for each: prefix sums of a polynomial mod 2^64."""

    def __init__(self, data: np.ndarray, second: bool = False):
        self.n, base = len(data), _BASE2 if second else _BASE
        up, self.down = _power(self.n + 1, base)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum((_BYTE[::-1] if second else _BYTE)[data] * up[: self.n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per row: the row of each item, and its place within the row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    return row, np.arange(len(row)) - np.repeat(ends - lengths, lengths)


def lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)
