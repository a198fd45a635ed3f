"""Words of whole Arrow text columns as numpy arrays: spans and 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = 1 << 21

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Words of `[^\\x20\\x09-\\x0D]+`, and of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing.
PLAIN = byte_class(lambda b: b not in b" \t\n\x0b\x0c\r")
ALNUM = byte_class(lambda b: 48 <= b < 58 or 97 <= b < 123 or b >= 128)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_cache: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) < n:
        m = 1 << max(12, int(n - 1).bit_length())
        _cache["p"], _cache["i"] = _powers(m, BASE), _powers(m, _INVERSE)
    return _cache["p"][:n], _cache["i"][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column.cast(pa.string()) if pa.types.is_large_string(column.type) else column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offs.astype(np.int64)


def slices(offs: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `step` bytes, or a single longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, "right")) - 1)
        yield i, j
        i = j


def _spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in lower-cased data; a word ends with its row."""
    inside = kind[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs - offs[0]] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (first[1:] | ~np.r_[inside[1:], False])) + 1
    return starts, ends


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows offs of lower-cased data: the words' hashes, starts and ends (in data), and each row's first word.

    Works through `step` bytes at a time, cut between words, so that very long rows need no more memory
    than their words.
    """
    lo, hi = int(offs[0]), int(offs[-1])
    hashes, firsts, lasts = [], [], []
    while lo < hi:
        to = min(hi, lo + step)
        while to < hi and kind[data[to]] and kind[data[to - 1]]:  # to the end of the word
            to += 1
        part = data[lo:to]
        inner = offs[(offs >= lo) & (offs <= to)]
        bounds = np.unique(np.r_[lo, inner, to])
        s, e = _spans(part, bounds, kind)
        if len(s):
            p, inverse = powers(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
            hashes.append(mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
            firsts.append(s + lo)
            lasts.append(e + lo)
        lo = to
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    s = np.concatenate(firsts)
    return np.concatenate(hashes), s, np.concatenate(lasts), np.searchsorted(s, offs)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row (rows are not told apart here)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * BASE + hashes[i : i + n]
    return mix64(out)
