"""Runs of n characters of texts as numbers, in numpy inside Arrow UDFs: exact sets, without a string for every run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Odd constants of a 64-bit mix.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _ranks(chars: np.ndarray, n: int) -> np.ndarray:
    """A number for the n characters (2 or more) from every place on: equal if these are, smaller if these come first."""
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    r, bits = (np.cumsum(seen) - 1)[chars].astype(np.uint64), max(1, int(np.count_nonzero(seen) - 1).bit_length())
    if bits * n <= 64:
        out = np.zeros(chars.size - n + 1, np.uint64)
        for i in range(n):
            out = out << np.uint64(bits) | r[i : i + out.size]
        return out
    wide = 1
    while wide < n:
        # two stretches, which overlap in the last round, tell what they cover; ranks of under 2^32 places fit twice
        step = min(wide, n - wide)
        both = r[: r.size - step] << np.uint64(32) | r[step:]
        wide += step
        r = np.unique(both, return_inverse=True)[1].astype(np.uint64) if wide < n else both
    return r


def least(text: str | None, n: int = 8, k: int = 24) -> tuple[int, list[str]]:
    """How many distinct runs of n characters a text has (a shorter one: itself, if not empty), and the k least."""
    if not text or len(text) < n:
        return (1, [text]) if text else (0, [])
    _, first = np.unique(_ranks(points(text), n), return_index=True)
    return first.size, [text[i : i + n] for i in first[:k].tolist()]


def sample(text: str | None, n: int = 8, k: int = 24) -> list[str]:
    """The k least of least(), without a sort of all runs."""
    if not text or len(text) < n:
        return [text] if text else []
    r, m = _ranks(points(text), n), 4 * k
    low = np.unique(np.partition(r, m)[:m] if m < r.size else r)
    while low.size < k and m < r.size:
        m *= 8
        low = np.unique(np.partition(r, m)[:m] if m < r.size else r)
    at = np.flatnonzero(r <= low[:k][-1])
    _, first = np.unique(r[at], return_index=True)
    return [text[i : i + n] for i in at[first].tolist()]


def common(a: str | None, b: str | None, n: int = 8) -> tuple[int, int, int]:
    """Distinct runs that two texts share, and how many each has."""
    if not a or not b:
        return 0, least(a, n, 0)[0], least(b, n, 0)[0]
    if len(a) < n or len(b) < n:
        # a text that is its own run equals a run of the other only if it is as long
        return int(a == b), least(a, n, 0)[0], least(b, n, 0)[0]
    if a == b:
        size = least(a, n, 0)[0]
        return size, size, size
    x, y = points(a), points(b)
    r = _ranks(np.concatenate([x, y]), n)
    x, y = np.unique(r[: x.size - n + 1]), np.unique(r[x.size :])
    return x.size + y.size - np.union1d(x, y).size, x.size, y.size


def hashes(text: str | None, n: int = 8) -> np.ndarray:
    """64-bit hashes of a text's distinct runs; a shorter text is its own, empty: none."""
    if not text:
        return np.zeros(0, np.int64)
    chars = points(text).astype(np.uint64)
    width = min(n, chars.size)
    h = np.full(chars.size - width + 1, width, np.uint64)
    for i in range(width):
        h = (h + chars[i : i + h.size] + np.uint64(1)) * _STEP
        h = (h ^ h >> np.uint64(29)) * _MIX
        h ^= h >> np.uint64(32)
    return np.unique(h).view(np.int64)


def sets(texts: list[str], n: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Of up to 65,536 texts: whose (rising), and 48 bits of a hash, of every distinct run (as hashes() has them), in order.

    One pass over all characters, where hashes() takes a text at a time; the numbers are others than its.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    h, have = points("".join(texts)).astype(np.uint64) + np.uint64(1), 1
    while True:
        h *= _STEP
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        if have == n:
            break
        step = min(have, n - have)  # two stretches, which overlap in the last round, tell what they cover
        h = h[: max(0, h.size - step)] * _STEP + h[step:]
        have += step
    runs = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(sizes.size, dtype=np.uint64), runs)
    at = np.arange(owner.size) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(runs) + runs, runs)
    both = owner << np.uint64(48) | h[at] >> np.uint64(16)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if short.size:
        own = np.array([hashes(texts[i], n)[0] for i in short.tolist()], np.int64).view(np.uint64)
        both = np.append(both, short.astype(np.uint64) << np.uint64(48) | own >> np.uint64(16))
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])[: both.size]]
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64(2**48 - 1)


def bounded(text: str | None, whole: int, n: int = 8, k: int = 24) -> tuple[int, list[str]]:
    """least() with all runs of a text of up to whole, which is k or more; of others the k least, and whole + 1 as their number."""
    some = sample(text, n, whole + 1)
    return (len(some), some) if len(some) <= whole else (whole + 1, some[:k])


def bounded_of(text: Column, whole: int, n: int = 8, k: int = 24) -> Column:
    """size and sample, see bounded: no list is longer than whole, and long texts have k runs only."""

    @F.pandas_udf("size long, sample array<string>")
    def made(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounded(t, whole, n, k) for t in texts], columns=["size", "sample"])

    return made(text)


def least_of(text: Column, n: int = 8, k: int = 24) -> Column:
    """size and sample: how many distinct runs of n characters, and the k least in order."""

    @F.pandas_udf("size long, sample array<string>")
    def made(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([least(t, n, k) for t in texts], columns=["size", "sample"])

    return made(text)


def sample_of(text: Column, n: int = 8, k: int = 24) -> Column:
    """The k least distinct runs of n characters, in order."""

    @F.pandas_udf("array<string>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([sample(t, n, k) for t in texts])

    return made(text)


def jaccard(a: Column, b: Column, n: int = 8) -> Column:
    """Of the sets of runs of two texts; 0 if one is empty."""

    @F.pandas_udf("double")
    def made(x: pd.Series, y: pd.Series) -> pd.Series:
        counts = (common(s, t, n) for s, t in zip(x, y, strict=True))
        return pd.Series([c / (p + q - c) if p and q else 0.0 for c, p, q in counts], dtype="float64")

    return made(a, b)


def alike(a: list[str | None], b: list[str | None], threshold: float, n: int = 8, size: int = 1 << 20) -> list[float]:
    """Jaccard similarities of pairs of texts' runs, some size characters at a time; 0 if one is empty.

    Runs are told apart by 48 bits of a hash, and by themselves where four runs more or less would bring the pair
    over the threshold or under it.
    """
    out: list[float] = []
    low = held = 0
    for i in range(len(a) + 1):
        one = len(a[i] or "") + len(b[i] or "") if i < len(a) else size
        if i > low and (held + one > size or i - low == 32768):
            owner, h = sets([t or "" for pair in zip(a[low:i], b[low:i], strict=True) for t in pair], n)
            each = np.bincount(owner, minlength=2 * (i - low))
            both = (owner >> 1).astype(np.uint64) << np.uint64(48) | h
            both.sort()
            c = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(48)).astype(np.int64), minlength=i - low)
            p, q = each[::2], each[1::2]
            got = np.where((p > 0) & (q > 0), c / np.maximum(p + q - c, 1), 0.0)
            for k in np.flatnonzero((np.abs(c - threshold / (1 + threshold) * (p + q)) <= 4) & (p > 0) & (q > 0)).tolist():
                x, y, z = common(a[low + k], b[low + k], n)
                got[k] = x / (y + z - x)
            out += got.tolist()
            low, held = i, 0
        held += one
    return out


def likeness(a: Column, b: Column, threshold: float, n: int = 8) -> Column:
    """jaccard of many pairs, see alike: surely on the right side of the threshold."""

    @F.pandas_udf("double")
    def made(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(alike(x.tolist(), y.tolist(), threshold, n), dtype="float64")

    return made(a, b)


def hashed(text: Column, n: int = 8) -> Column:
    """64-bit hashes of a text's distinct runs."""

    @F.pandas_udf("array<long>")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([hashes(t, n) for t in texts])

    return made(text)
