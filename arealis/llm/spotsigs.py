"""Spot signatures: chains of content words that follow common words.

Each occurrence of an anchor (a very common word) gives one signature: the anchor and the
next ``CHAIN`` words that are no anchors. A text's fingerprint is the sorted set of their
32-bit hashes, written in base64. Two fingerprints compare by Jaccard; for a join, sets are
partitioned by their length, so that only neighbouring lengths meet, and pruned by it.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.store import kept, text_batches
from arealis.llm.text import ALNUM, BASES, LOWER, mix, slices, span_hashes, utf8, words

#: Anchors: frequent words of four languages that say nothing about a text's subject.
ANCHORS = (
    "the of is was are that with le les des est un une der die das und ist ein el los del que es por para"
).split()
CHAIN = 2
#: Ranges of ids a shuffle partition, in the pass over neighbours.
RANGES = 4
LOWEST = -(1 << 63)


def _anchor_hashes() -> np.ndarray:
    data = np.frombuffer("".join(ANCHORS).encode(), np.uint8)
    ends = np.cumsum([len(a.encode()) for a in ANCHORS])
    return np.sort(span_hashes(data, np.append(0, ends[:-1]), ends, BASES[0]))


def signatures(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 32-bit signatures of each row, ascending, and where each row's begin.

    Every text with a word has one at least: its start counts as an anchor, and a text of
    anchors alone is one chain. A text without words has none.
    """
    rows = len(borders) - 1
    low = LOWER[data]
    starts, ends, first = words(low, borders, ALNUM)
    h = span_hashes(low, starts, ends, BASES[0])
    known = _anchor_hashes()
    is_anchor = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    row = np.repeat(np.arange(rows), np.diff(first))
    content = np.flatnonzero(~is_anchor)
    chain = np.append(h[content], np.zeros(CHAIN, np.uint64))
    chain_row = np.append(row[content], np.full(CHAIN, -1))

    def chains(lead: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
        code, q = mix(lead + np.uint64(1)), np.searchsorted(content, at)
        for i in range(CHAIN):
            code = mix(code * np.uint64(BASES[1]) + np.where(chain_row[q + i] == of, chain[q + i], np.uint64(0)))
        return code

    anchors = np.flatnonzero(is_anchor)
    some = np.flatnonzero(np.diff(first) > 0)
    code = np.concatenate([chains(h[anchors], anchors, row[anchors]), chains(np.zeros(len(some), np.uint64), first[some], some)])
    key = (np.concatenate([row[anchors], some]).astype(np.uint64) << np.uint64(32)) | (code >> np.uint64(32))
    key = np.unique(key)
    return key.astype(np.uint32), np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(32))


def fingerprint(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype(">u4").tobytes()).decode()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard of the sets of equal rows; two empty sets are alike (1)."""
    (x, i), (y, j) = a, b
    n, m = np.diff(i), np.diff(j)
    rows = np.arange(len(n), dtype=np.uint64) << np.uint64(32)
    kx, ky = np.repeat(rows, n) | x, np.repeat(rows, m) | y
    found = np.searchsorted(ky, kx)
    hit = ky[np.minimum(found, max(0, len(ky) - 1))] == kx if len(ky) else np.zeros(len(kx), bool)
    both = np.bincount(np.repeat(np.arange(len(n)), n)[hit], minlength=len(n))
    union = n + m - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, borders = utf8(pa.array(texts, pa.large_string()))
    found, sizes = [], [0]
    for i, j in slices(borders):
        s, at = signatures(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
        found.append(s)
        sizes.extend(np.diff(at))
    return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum(sizes)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows by descending id, dealt in ranges; the head of a range is also a guest in the one before.

    Texts travel compressed. What the driver gets is one id a range.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts)
    bounds = np.unique(np.array(cuts, np.float64))

    def part_of(key: np.ndarray) -> np.ndarray:
        return len(bounds) - np.searchsorted(bounds, key.astype(np.float64), "right")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(key)), b.column(0)], ["part", "key"])

    heads = {
        r["part"]: r["key"]
        for r in rows.select("key").mapInArrow(numbered, "part long, key long").groupBy("part").agg(F.max("key").alias("key")).collect()
    }
    order = sorted(heads)
    #: the range in which each head is a guest: the one before, and the last one for the first
    guest_in = {heads[p]: order[i - 1] for i, p in enumerate(order)}
    guests = np.array(sorted(guest_in), np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                key = b.column("key").to_numpy(zero_copy_only=False)
                bodies = [press.compress(x.as_py().encode()) for x in b.column("text")]
                tie = [hashlib.blake2b(x, digest_size=8).digest() for x in bodies]
                part = part_of(key)
                extra = np.flatnonzero(np.isin(key, guests))
                at = np.concatenate([np.arange(len(key)), extra])
                where = np.concatenate([part, np.array([guest_in[int(k)] for k in key[extra]], np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), pa.array(np.arange(len(at)) >= len(key)), pa.array(key[at]), b.column("doc_id").take(pa.array(at)),
                     pa.array([tie[k] for k in at], pa.binary()), pa.array([bodies[k] for k in at], pa.binary())],
                    ["part", "guest", "key", "doc_id", "tie", "body"],
                )

    packed = rows.mapInArrow(pack, "part long, guest boolean, key long, doc_id long, tie binary, body binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("key"), "tie")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text, of its edited text, and how like they are.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as
    many of the next document by descending doc_id (after the last one: the first).
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts count as empty; empty fingerprints are alike (1), an empty and a
    filled one are not (0); null ids come last; rows of one id are ordered by content; a
    single document is its own next. An empty table gives an empty result. Other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        pending: tuple[int, int | None, str] | None = None  # range, id and text that wait for the next row
        guest_done = -1
        for batch in batches:
            n = batch.num_rows
            part, guest = batch.column("part").to_pylist(), batch.column("guest").to_pylist()
            ids, bodies = batch.column("doc_id").to_pylist(), batch.column("body")
            for i in range(0, n, 512):
                rows, texts, nexts = [], [], []
                for k in range(i, min(n, i + 512)):
                    if guest[k] and guest_done == part[k]:
                        continue
                    text = press.decompress(bodies[k].as_py()).decode()
                    if pending is not None and pending[0] == part[k]:
                        rows.append(pending[1])
                        texts.append(pending[2])
                        nexts.append(text)
                    pending = None if guest[k] else (part[k], ids[k], text)
                    guest_done = part[k] if guest[k] else guest_done
                if not rows:
                    continue
                cut = [len(t) // 3 for t in texts]
                changed = [t[: len(t) - c] + x[:c] for t, x, c in zip(texts, nexts, cut, strict=True)]
                own, new, following = _of(texts), _of(changed), _of(nexts)
                show = lambda s: [fingerprint(s[0][a:b]) for a, b in zip(s[1], s[1][1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(show(own), pa.string()),
                     pa.array(show(new), pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, following))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return _neighbours(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``sigs``, the distinct signatures of the whole text, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = utf8(batch.column("text"))
            for i, j in slices(borders):
                s, at = signatures(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], ["doc_id", "sigs"])

    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, sigs array<long>")


def near_pairs(docs: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints, and the pairs of classes with Jaccard >= threshold.

    Returns (members: doc_id, class; pairs: class_a < class_b, jaccard); a class is the
    smallest doc_id in it, so copies are never expanded into pairs. Empty sets are one
    class and match nothing else. The sets are partitioned by length: a set meets those of
    its own and the next longer range only, on the rarest of its signatures, as many as a
    match must share one of (prefix); the remaining pairs are pruned by length and by what
    is left after the shared one, then compared exactly.
    """
    sets = kept(fingerprints(docs).withColumn("fp", F.sha2(F.concat_ws(",", "sigs"), 256)), "spots")
    classes = sets.groupBy("fp").agg(F.min("doc_id").alias("class"))
    members = sets.join(classes, "fp").select("doc_id", "class")
    one = sets.groupBy("fp").agg(F.min("doc_id").alias("class"), F.first("sigs").alias("sigs")).where(F.size("sigs") > 0)
    one = kept(one.select("class", "sigs", F.size("sigs").alias("n")), "classes")
    rarity = one.select(F.explode("sigs").alias("sig")).groupBy("sig").count()
    ranked = one.select("class", "n", F.explode("sigs").alias("sig")).join(rarity, "sig")
    place = F.row_number().over(Window.partitionBy("class").orderBy("count", "sig"))
    ranked = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    left = ranked.select("sig", F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"),
                         F.explode(F.array(band, band + 1)).alias("band"))
    right = ranked.select("sig", F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("p_b"), band.alias("band"))
    rest = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b"))
    need = F.ceil(threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    met = left.join(right, ["sig", "band"]).where(
        ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        & (F.col("n_a") >= threshold * F.col("n_b") - 1e-9)
        & (F.least("p_a", "p_b") + rest >= need)
    )
    pairs = met.select("a", "b").distinct()
    got = pairs.join(one.select(F.col("class").alias("a"), F.col("sigs").alias("x")), "a").join(
        one.select(F.col("class").alias("b"), F.col("sigs").alias("y")), "b"
    )
    both = F.size(F.array_intersect("x", "y"))
    out = got.withColumn("jaccard", both / (F.size("x") + F.size("y") - both)).where(F.col("jaccard") >= threshold)
    return members, out.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "jaccard")
