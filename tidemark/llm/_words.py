"""Words of Arrow string columns as 64-bit hashes, found with whole-array numpy operations.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. No Python string is made:
a prefix sum of table values times powers of an odd base gives every word's polynomial hash at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 17
U = np.uint64

_rng = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, SEGMENT), _powers(_INVERSE, SEGMENT)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (murmur's constants)."""
    h = h ^ U(salt)
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if n > len(_POW):  # one word is longer than a segment
        return _powers(_BASE, n), _powers(_INVERSE, n)
    return _POW[:n], _INV[:n]


def words(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in data; no word crosses a position in breaks."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    inside = ~np.take(_SPACE, data)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    if breaks is not None and len(breaks):
        cut = breaks[(breaks > 0) & (breaks < n)]
        before[cut] = False
        after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers_to(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(np.take(_VALUE, data) * power, out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverse[starts])


def runs(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Consecutive rows (from, to) of at most limit bytes together; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def cuts(data: np.ndarray, a: int, b: int, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """data[a:b] in pieces of about limit bytes that end at white space."""
    while a < b:
        e = min(a + limit, b)
        if e < b:
            step, back = 4096, e
            found = -1
            while back > a and found < 0:  # the last white space before the limit
                lo = max(a, back - step)
                hit = np.flatnonzero(_SPACE[data[lo:back]])
                found = lo + int(hit[-1]) + 1 if len(hit) else -1
                back = lo
            if found < 0:
                while e < b and not _SPACE[data[e]]:
                    e += 1
            else:
                e = found
        yield a, e
        a = e


def documents(column: pa.Array, spans: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: (first row, row after the last, word hashes, bounds): row first + k has hashes[bounds[k]:bounds[k + 1]].

    With spans, the hashes come as (starts, ends, hashes), with positions in the column's bytes.
    """
    offsets, data = buffers(column)
    for i, j in runs(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= SEGMENT:
            s, e, h = words(data[a:b], offsets[i:j] - a)
            bounds = np.searchsorted(s, offsets[i : j + 1] - a)
            s, e = s + a, e + a
        else:
            parts = [(p, words(data[p:q])) for p, q in cuts(data, a, b)]
            s = np.concatenate([x[0] + p for p, x in parts])
            e = np.concatenate([x[1] + p for p, x in parts])
            h = np.concatenate([x[2] for _, x in parts])
            bounds = np.array([0, len(h)])
        yield i, j, (s, e, h) if spans else h, bounds


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each row, with bounds; a row of 1 to k - 1 words gives one hash of all of them."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    first = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], count) + np.repeat(bounds[:-1], count)
    last = np.repeat(bounds[1:], count)
    acc = np.zeros(len(first), np.uint64)
    for d in range(k):
        at = first + d
        ok = at < last
        acc = np.where(ok, acc * U(0xD6E8FEB86659FD93) + h[np.minimum(at, len(h) - 1)] + U(d + 1), acc)
    return mix(acc, 0x5851F42D4C957F2D), out_bounds
