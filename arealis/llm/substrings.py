"""Repeated runs of words, counted exactly through super-k-mers.

Of each window of WINDOW words the smallest hash of its M-word grams is the minimiser.
Consecutive windows with one minimiser travel as a single packed string to the bucket of
that minimiser; equal windows have equal minimisers, so they meet. There the windows are
sorted and counted, and the spans of those that occur more than once go back to their text.

Copies of a whole text are counted by the text's identity and sent once a task. Windows
so frequent that a small sample shows them again and again are known to every task (a
bounded list) and not sent at all; minimisers that are as frequent in different contexts
(a bounded list too) give way to the window's own hash. Both lists move work, not results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.packs import PACKED, SPANS, Pieces, Sender, buckets, by_bucket, first_copies, gather, identity, spans_batch, unpacked, with_spans
from arealis.llm.store import kept, text_batches
from arealis.llm.text import BASES, NOT_SPACE, grams, merge, mix, ranges, rows_of, sliding_min, slices, span_hashes, utf8, words

WINDOW, M = 35, 4
#: Share of the documents in the sample that finds frequent windows and minimisers.
SAMPLE = 0.02
#: Entries of each list of frequent keys at most, and how often the sample must show one.
FREQUENT, SEEN = 4096, 8


@dataclass
class Words:
    """The words of a run of texts, each followed by one blank."""

    body: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.body, self.starts, self.starts + self.lengths, BASES[0])


def tokens(data: np.ndarray, borders: np.ndarray) -> Words:
    starts, ends, first = words(data, borders, NOT_SPACE)
    lengths = ends - starts
    at = ranges(starts, lengths + 1)
    body = data[np.minimum(at, len(data) - 1)] if len(at) else data[:0]
    new = np.cumsum(lengths + 1) - lengths - 1
    body[new + lengths] = 0x20
    return Words(body, new, lengths, first)


def window_hashes(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Two hashes of each window that starts at one of ``at``."""
    return np.stack([span_hashes(h, at, at + window, BASES[2]), span_hashes(mix(h), at, at + window, BASES[1])], axis=1)


def minimisers(h: np.ndarray, first: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: first window, number of windows and minimiser of each run."""
    low = sliding_min(grams(h, m), window - m + 1)
    row = rows_of(first)
    ok = row[: len(low)] == row[window - 1 : window - 1 + len(low)]
    at = np.flatnonzero(ok)
    if not len(at):
        return at, at, low[:0]
    new = np.append(True, (np.diff(at) != 1) | (low[at[1:]] != low[at[:-1]]) | (row[at[1:]] != row[at[:-1]]))
    heads = np.flatnonzero(new)
    return at[heads], np.diff(np.append(heads, len(at))), low[at[heads]]


@dataclass
class Frequent:
    """Keys that a sample showed often: minimisers, and windows by their two hashes."""

    marks: np.ndarray
    windows: np.ndarray

    def has(self, pairs: np.ndarray) -> np.ndarray:
        if not len(self.windows):
            return np.zeros(len(pairs), bool)
        known = self.windows
        at = np.minimum(np.searchsorted(known[:, 0], pairs[:, 0]), len(known) - 1)
        return (known[at] == pairs).all(axis=1)


def frequent(texts: DataFrame, window: int, m: int) -> Frequent:
    """The most frequent keys of a sample of different texts, FREQUENT of each kind at most."""

    def counter(known: np.ndarray | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, borders = utf8(batch.column("text"))
                for i, j in slices(borders):
                    w = tokens(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
                    h = w.hashes
                    at, n, mark = minimisers(h, w.first, window, m)
                    if known is None:
                        found = np.stack([mark, np.zeros_like(mark)], axis=1)
                    else:
                        ok = np.isin(mark, known)
                        found = window_hashes(h, ranges(at[ok], n[ok]), window)
                    found, n = np.unique(found, axis=0, return_counts=True)
                    a, b = found[:, 0].view(np.int64) if len(found) else n, found[:, 1].view(np.int64) if len(found) else n
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        return count

    sample = kept(texts.sample(SAMPLE, seed=7).dropDuplicates(["id"]), "sample")

    def top(known: np.ndarray | None) -> np.ndarray:
        n = sample.mapInArrow(counter(known), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        found = n.where(F.col("n") >= SEEN).orderBy(F.desc("n"), "a", "b").limit(FREQUENT).collect()
        pairs = np.array([(r["a"], r["b"]) for r in found], np.int64).reshape(-1, 2).view(np.uint64)
        return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]

    marks = np.ascontiguousarray(top(None)[:, 0])
    return Frequent(marks, top(marks) if len(marks) else np.zeros((0, 2), np.uint64))


def _pieces(w: Words, owner: np.ndarray, hot: Frequent, window: int, m: int) -> Pieces:
    h = w.hashes
    at, count, mark = minimisers(h, w.first, window, m)
    if len(hot.marks) and len(at):
        known = hot.marks[np.minimum(np.searchsorted(hot.marks, mark), len(hot.marks) - 1)] == mark
        if known.any():
            single = ranges(at[known], count[known])
            pairs = window_hashes(h, single, window)
            rest = ~hot.has(pairs)
            single, own = single[rest], pairs[rest, 0]
            at = np.concatenate([at[~known], single])
            count = np.concatenate([count[~known], np.ones(len(single), np.int64)])
            mark = np.concatenate([mark[~known], own])
    zero = np.zeros(len(at), np.int64)
    row = np.searchsorted(w.first, at, "right") - 1
    begin = w.starts[at]
    last = at + count + window - 2
    length = w.starts[last] + w.lengths[last] + 1 - begin
    body = np.frombuffer(gather(w.body.tobytes(), begin, length), np.uint8)
    start = (at - w.first[row]).astype(np.int32)
    return Pieces(owner[row], zero, start, length.astype(np.int32), count.astype(np.int32), mark, zero.astype(np.uint8), body)


def _cut(texts: DataFrame, hot: Frequent, window: int, m: int) -> DataFrame:
    n = buckets(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(n)
        for batch, owner in first_copies(batches):
            data, borders = utf8(batch.column("text"))
            for i, j in slices(borders):
                w = tokens(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
                yield from sender.add(_pieces(w, owner[i:j], hot, window, m))
        yield from sender.flush()

    return texts.select("id", "text").mapInArrow(run, PACKED)


def _repeated(p: Pieces, window: int) -> Iterator[pa.RecordBatch]:
    """The spans of a bucket's windows that stand at two places at least."""
    starts, ends, first = words(p.body, p.borders, NOT_SPACE)
    h = span_hashes(p.body, starts, ends, BASES[0])
    n = p.count.astype(np.int64)
    at = ranges(first[:-1], n)
    key = span_hashes(h, at, at + window, BASES[2])
    order = np.argsort(key)
    near = key[order][1:] == key[order][:-1]
    order = order[np.append(near, False) | np.append(False, near)]
    if not len(order):
        return
    piece = np.searchsorted(first, at[order], "right") - 1
    place = p.start[piece] + (at[order] - first[piece])
    a, b = p.owner[piece, 0], p.owner[piece, 1]
    by = np.lexsort((place, b, a, key[order]))
    order, piece, place, a, b = order[by], piece[by], place[by], a[by], b[by]
    # the same place, sent by two tasks that both had a copy of the text, counts once
    own = np.append(True, (place[1:] != place[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (key[order][1:] != key[order][:-1]))
    order, piece, place = order[own], piece[own], place[own]
    group = _equal(p, starts, at[order], key[order], window)
    size = np.bincount(group)[group]
    order, piece, place = order[size > 1], piece[size > 1], place[size > 1]
    by = np.argsort(order)
    order, piece, place = order[by], piece[by], place[by]
    new = np.append(True, (np.diff(order) != 1) | (np.diff(piece) != 0))[: len(order)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(order))[: len(heads)] - 1
    batch = spans_batch(p.owner[piece[heads]], place[heads], place[tails] + window)
    if batch is not None:
        yield batch


def _equal(p: Pieces, starts: np.ndarray, at: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Groups of equal windows, sorted by key, compared word by word: hashes alone decide nothing."""
    borders = pa.py_buffer(np.append(starts, len(p.body)).astype(np.int32))
    # each word with the blank after it
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, borders, pa.py_buffer(np.ascontiguousarray(p.body))])
    word = pc.dictionary_encode(coded).indices.to_numpy()
    same = key[1:] == key[:-1]
    differ = False
    for i in range(0, len(same), 1 << 16):
        k = i + np.flatnonzero(same[i : i + (1 << 16)])
        ok = np.ones(len(k), bool)
        for d in range(window):
            ok &= word[at[k] + d] == word[at[k + 1] + d]
        differ |= not ok.all()
    if differ:  # two different windows with one hash: group by the words themselves
        return np.unique(word[at[:, None] + np.arange(window)], axis=0, return_inverse=True)[1].ravel()
    return np.cumsum(np.append(False, ~same))


def _covered(w: Words, spans: list, copies: list, hot: Frequent, window: int) -> np.ndarray:
    """Which words go: those in found spans, in frequent windows, or in any window of a copy."""
    out = np.zeros(len(w.starts), bool)
    for row, found in enumerate(spans):
        if copies[row] and w.first[row + 1] - w.first[row] >= window:
            out[w.first[row] : w.first[row + 1]] = True
        elif found:
            pairs = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2).astype(np.int64)
            s, e = merge(pairs[:, 0], pairs[:, 1])
            out[w.first[row] + ranges(s, e - s)] = True
    if len(hot.windows):
        h = w.hashes
        n = np.diff(w.first) - window + 1
        at = ranges(w.first[:-1], np.maximum(n, 0))
        at = at[hot.has(window_hashes(h, at, window))]
        s, e = merge(at, at + window)
        out[ranges(s, e - s)] = True
    return out


def deduplicated(docs: DataFrame, window: int = WINDOW, m: int = M) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every document.

    A word goes if a window of ``window`` words that covers it also starts elsewhere, in
    the same or another document; all places lose it, none is spared. Windows are judged on
    the input. ``kept_text`` has the remaining words joined by one blank. Null texts have no
    words. Repeated rows are copies of each other, also with one id. Documents shorter than
    a window keep everything; an empty table gives an empty result; null ids are fine; other
    columns are ignored. A task holds about 100 bytes for each byte of its longest text.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), identity(F.col("text")).alias("id"))
    hot = frequent(texts, window, m)
    spans = by_bucket(_cut(texts, hot, window, m), lambda p: _repeated(p, window), SPANS)
    copies = texts.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, borders in unpacked(batches):
            spans, n = batch.column("spans").to_pylist(), batch.column("copies").to_pylist()
            w = tokens(data, borders)
            gone = _covered(w, spans, n, hot, window)
            at = np.flatnonzero(~gone)
            body = w.body[ranges(w.starts[at], w.lengths[at] + 1)].tobytes()
            ends = np.concatenate([[0], np.cumsum(w.lengths[at] + 1)])
            cut = ends[np.searchsorted(at, w.first)]
            kept_texts = [body[x : max(x, y - 1)] for x, y in zip(cut, cut[1:], strict=False)]
            removed = np.bincount(rows_of(w.first)[gone], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(removed.astype(np.int64)),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept_texts], pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return with_spans(texts, spans, copies).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
