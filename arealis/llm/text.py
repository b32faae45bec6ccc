"""Views of Arrow text columns as bytes, words and 64-bit hashes.

All functions work on whole Arrow batches with numpy, so tasks never loop over words. A
batch is cut into runs of documents of about ``SLICE`` bytes to bound memory; a longer
document is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_U = np.uint64
#: Odd multipliers of the two polynomial hashes over bytes and of the one over words.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
SPACE = frozenset([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2**64; kept between calls up to a slice's length."""
    kept = _TABLES.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    if n <= SLICE + 1:
        _TABLES[base] = _powers(base, SLICE + 1)
        return _TABLES[base][:n]
    return _powers(base, n)


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each half-open span of ``values``; equal content gives equal hashes."""
    if len(values) > 2 * SLICE and len(starts) and (np.diff(starts) >= 0).all():
        # long inputs go in runs of spans, as hashes don't depend on the place
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
            a, b = int(starts[i]), int(ends[i:j].max())
            if b - a > 2 * SLICE:
                break
            out[i:j] = span_hashes(values[a:b], starts[i:j] - a, ends[i:j] - a, base)
            i = j
        else:
            return out
    # in place where it can be, as these are the largest arrays of a task
    total = np.zeros(len(values) + 1, np.uint64)
    total[1:] = values
    total[1:] += _U(1)
    total[1:] *= powers(base, len(values))
    np.cumsum(total, out=total)
    found = total[ends]
    found -= total[starts]
    del total
    found *= powers(_inverse(base), len(values) + 1)[starts]
    return mix(found)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the borders of its rows (null: no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    borders = offsets.astype(np.int64)
    return data[borders[0] : borders[-1]], borders - borders[0]


def slices(borders: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(borders) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(borders, borders[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def table(keep) -> np.ndarray:
    """A lookup of 256 booleans."""
    return np.array([bool(keep(b)) for b in range(256)])


NOT_SPACE = table(lambda b: b not in SPACE)
#: Digits, small letters and all bytes beyond ASCII.
ALNUM = table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def words(data: np.ndarray, borders: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, and the first word of each row.

    The last array has one entry more than rows, so words of row i are first[i]:first[i+1].
    """
    n = len(data)
    flag = np.zeros(n + 1, bool)
    flag[:n] = inside[data]
    before = np.zeros(n + 1, bool)
    before[1:] = flag[:n]
    before[borders] = False
    starts = np.flatnonzero(flag & ~before)
    after = np.zeros(n + 1, bool)
    after[: n - 1] = flag[1:n]
    edge = borders[borders > 0] - 1
    after[edge] = False
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, borders)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, ignoring row borders; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(hashes, at, at + k, BASES[2])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == w else np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of start .. start + length, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as disjoint spans in order; touching spans become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]
