"""Words of whole Arrow batches as 64-bit hashes, without a Python object for each word.

A word's hash is a polynomial over its bytes: one running sum over the batch's bytes gives the hashes of all words by
subtraction. Two different words, or runs of words, agree with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes worked on at once, unless one text is longer.
SLICE = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each input bit reaches all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def table(separators: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it separates words, and its value in a hash, where A-Z may count as a-z."""
    value = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    if fold:
        value[65:91] = value[97:123]
    apart = np.zeros(256, bool)
    apart[np.frombuffer(separators, np.uint8)] = True
    return apart, value


#: Space and tab to carriage return.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: All ASCII but letters and digits.
NOT_WORD = bytes(x for x in range(128) if not chr(x).isalnum())

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE) + 1
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if offsets else np.zeros(n + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray):
    """Runs of texts of about SLICE bytes, as (first, last exclusive)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and where each text's words begin among them. offsets begin with 0."""
    n = len(data)
    inside = ~apart[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    start[firsts] = inside[firsts]
    before = firsts[firsts > 0] - 1
    end[before] = inside[before]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1 if n else s, np.searchsorted(s, offsets)


def hashed(data: np.ndarray, offsets: np.ndarray, how: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a slice, and where each text's words begin among them."""
    apart, value = how
    s, e, at = spans(data, offsets, apart)
    if not len(s):
        return np.zeros(0, np.uint64), at
    up, down = _power(len(data))
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value[data] * up[: len(data)], out=run[1:])
        return _mixed((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)), at


def batches(column: pa.Array, how: tuple[np.ndarray, np.ndarray]):
    """For each slice of a column: its first row, its words' hashes, and where each row's words begin."""
    data, offsets = buffers(column)
    for i, j in slices(offsets):
        lo = offsets[i]
        h, at = hashed(data[lo : offsets[j]], offsets[i : j + 1] - lo, how)
        yield i, h, at


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, whichever text they are in."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            out = out * np.uint64(BASE) + h[i : len(h) - k + 1 + i]
        return _mixed(out + np.uint64(k))


def shingles(h: np.ndarray, at: np.ndarray, k: int):
    """For each text its sorted distinct k-word shingles; the whole sequence where there are fewer words; else empty."""
    every = grams(h, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(every[a : b - k + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            yield x[keep]
        else:
            yield grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)
