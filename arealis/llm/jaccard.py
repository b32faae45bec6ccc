"""Exact Jaccard join of shingle sets by universe partitioning.

Sets of sizes in one band split the universe of tokens into the same number of segments by
hash. Two sets with Jaccard >= 3/4 differ in at most a third of the smaller one's size, so
of the differences that a set must cover (that third and one more) one segment at least
escapes: it is equal on both sides, or, in segments given two credits, differs in a single
token and meets through its one-deletion neighbourhood. Segments with one credit are taken
in the order of their cost, frequent contents last, as in a prefix filter; how many
segments get two credits is chosen band by band by the cost that a sample shows.

Sets that share a signature are grouped, groups are thinned by parity bitmaps (a lower
bound on the difference, so nothing is lost), and what still hangs together is verified
whole against whole, in blocks when there is much of it. Only spanning links leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.graph import components
from arealis.llm.store import kept, text_batches
from arealis.llm.text import BASES, LOWER, NOT_SPACE, grams, mix, ranges, rows_of, slices, span_hashes, utf8, words

SHINGLE = 5
LOWEST = -(1 << 63)
#: Sets below this size split into single tokens; bands above begin at it times powers of RATIO.
SMALL, RATIO = 64, 4
#: Segments of a band, times its smallest size.
SEGMENTS = 3
#: Shares of the segments that may get two credits.
SHARES = (0.0, 0.125, 0.25)
#: Share of the documents in the sample that finds frequent contents and costs, entries of
#: the list of contents at most, and how often the sample must show one.
SAMPLE, FREQUENT, SEEN = 0.02, 8192, 6
#: Sets of one group, and of one block, that are compared with each other in one task.
GROUP, BLOCK = 2048, 500
#: Shingles of one block.
BLOCK_TOKENS = 1_000_000
#: Postings that a task gathers before it sends them.
POSTINGS = 250_000
_U = np.uint64


def shingles(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each row, ascending, and where each row's begin."""
    low = LOWER[data]
    starts, ends, first = words(low, borders, NOT_SPACE)
    h = span_hashes(low, starts, ends, BASES[0])
    n, rows = np.diff(first), rows_of(first)
    g = grams(h, SHINGLE)
    at = np.flatnonzero(rows[: len(g)] == rows[SHINGLE - 1 : SHINGLE - 1 + len(g)])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    row = np.concatenate([rows[at], short])
    key = np.concatenate([g[at], mix(span_hashes(h, first[short], first[short + 1], BASES[1]))])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
    row, key = row[new], key[new]
    return key, np.searchsorted(row, np.arange(len(borders)))


def nodes(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set (0 for empty ones); equal sets have equal names."""
    out = [int.from_bytes(hashlib.blake2b(tokens[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else 0
           for a, b in zip(first, first[1:], strict=False)]
    return np.array(out, np.int64)


def band_of(size: np.ndarray) -> np.ndarray:
    """0 for small sets, then 1, 2, .. as sizes grow by RATIO."""
    return np.where(size < SMALL, 0, 1 + np.floor(np.log(np.maximum(size, SMALL) / SMALL) / np.log(RATIO) + 1e-9)).astype(np.int64)


def band_start(band: np.ndarray) -> np.ndarray:
    return np.where(band == 0, 1, SMALL * RATIO ** np.maximum(band - 1, 0))


def signatures(tokens: np.ndarray, first: np.ndarray, shares: dict[int, float], costly: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and level of all postings of the sets.

    A set is indexed in its own band, and in the next one if a match can be that large.
    ``costly``: signatures from the most frequent down.
    """
    out_row, out_sig, out_level = [], [], []
    size = np.diff(first)
    own = band_of(size)
    order_of = np.argsort(costly)
    sorted_costly = costly[order_of]
    for level in range(int(own.max(initial=0)) + 2):
        reach = (own == level - 1) & (4 * size >= 3 * band_start(np.array(level)))
        rows = np.flatnonzero(((own == level) | reach) & (size > 0))
        if not len(rows):
            continue
        t = tokens[ranges(first[rows], size[rows])]
        row = np.repeat(rows, size[rows])
        salt = _U((level + 1) * 0x9E37)
        spread = mix(t + salt)
        m = 0 if level == 0 else int(SEGMENTS * band_start(np.array(level)))
        seg = spread >> _U(1) if m == 0 else spread % _U(m)
        order = np.lexsort((seg, row))
        t, row, seg, spread = t[order], row[order], seg[order], spread[order]
        head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (seg[1:] != seg[:-1])))
        count = np.diff(np.append(head, len(t)))
        part = mix(spread ^ salt)
        content = np.add.reduceat(part, head)
        s_row, s_seg = row[head], seg[head]
        name = lambda c, s: mix(c + mix(s + salt) * _U(BASES[1]))  # noqa: E731, B023
        sig = name(content, s_seg)
        need = size // 3 + 1
        double = s_seg < _U(int(shares.get(level, 0.0) * m))
        if double.any():
            credit = np.zeros(len(size), np.int64)
            np.add.at(credit, s_row[double], np.minimum(count[double], 2))
            need = need - credit
            out_row.append(s_row[double])
            out_sig.append(sig[double])
            # the neighbourhood: the segment without one of its tokens
            wide = np.flatnonzero(double & (count > 1))
            each = ranges(head[wide], count[wide])
            of = np.repeat(wide, count[wide])
            out_row.append(s_row[of])
            out_sig.append(name(content[of] - part[each], s_seg[of]))
            out_level += [np.full(int(double.sum()), level), np.full(len(of), level)]
        s_row, sig = s_row[~double], sig[~double]
        cost = np.zeros(len(sig), np.int64)
        if len(costly):
            found = np.minimum(np.searchsorted(sorted_costly, sig), len(costly) - 1)
            hit = sorted_costly[found] == sig
            cost[hit] = len(costly) - order_of[found[hit]]
        order = np.lexsort((sig, cost, s_row))
        s_row, sig = s_row[order], sig[order]
        rank = np.arange(len(s_row)) - np.searchsorted(s_row, s_row)
        take = rank < need[s_row]
        out_row.append(s_row[take])
        out_sig.append(sig[take])
        out_level.append(np.full(int(take.sum()), level))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_row), np.concatenate(out_sig), np.concatenate(out_level)


def bits_of(size: int) -> int:
    """Length of a set's bitmap: a power of two, twice the size at least."""
    return min(1 << 16, max(64, 1 << int(2 * size - 1).bit_length()))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' hash classes: two bitmaps differ in no more bits than the sets in tokens."""
    n = bits_of(len(tokens))
    odd = np.bincount((mix(tokens + _U(1)) & _U(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _fold(maps: list[np.ndarray], length: int) -> np.ndarray:
    out = np.zeros((len(maps), length), np.uint8)
    for i, x in enumerate(maps):
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, length), axis=0) if len(x) > length else x
    return out


class Union:
    """Joined sets of small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _may_link(size: np.ndarray, maps: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning edges of the pairs that sizes and bitmaps don't rule out."""
    order = np.argsort(size, kind="stable")
    size = size[order]
    united, out = Union(len(size)), []
    widths = np.array([len(maps[i]) for i in order])
    done: dict[int, np.ndarray] = {}
    for i in range(len(size)):
        # partners that are no larger, and as large as three quarters
        lo = int(np.searchsorted(size[:i], -(-3 * size[i] // 4)))
        if lo >= i:
            continue
        width = int(widths[lo:i].min())
        if width not in done:
            done[width] = _fold([maps[k][: len(maps[k])] if len(maps[k]) >= width else np.zeros(width, np.uint8) for k in order], width)
        f = done[width]
        differ = _POP[f[lo:i] ^ f[i]].sum(axis=1, dtype=np.int64)
        ok = lo + np.flatnonzero(7 * differ <= size[lo:i] + size[i])
        for k in ok.tolist():
            if united.join(k, i):
                out.append((int(order[k]), int(order[i])))
    return out


def links(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges of the pairs with 100 * intersection >= 75 * union, by counting.

    With ``side``, only pairs of different sides are compared.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    token = np.concatenate([sets[i] for i in order]) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size[order])
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    new = np.append(True, token[1:] != token[:-1])[: len(token)]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    place = np.empty(len(token), np.int64)
    place[by] = np.arange(len(token))
    at = np.concatenate([[0], np.cumsum(size[order])])
    united, out = Union(len(sets)), []
    for i in range(len(sets)):
        p = place[at[i] : at[i + 1]]
        begin = first[group[p]]
        before = p - begin  # owners stand in order, so these are the smaller sets that have the token
        both = np.bincount(owner[ranges(begin, before)], minlength=i)[:i] if i else np.zeros(0, np.int64)
        n = size[order[i]] + size[order[:i]] - both
        ok = (100 * both >= 75 * n) & (n > 0)
        if side is not None and i:
            ok &= side[order[:i]] != side[order[i]]
        for k in np.flatnonzero(ok).tolist():
            if united.join(k, i):
                out.append((int(order[k]), int(order[i])))
    return out


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, borders = utf8(batch.column("text"))
        for i, j in slices(borders):
            tokens, first = shingles(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
            yield batch.slice(i, j - i), tokens, first


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, key (id that sorts null first), node, n_shingles, and the bitmap, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, first in _each(batches):
            maps = [bitmap(tokens[a:b]) if b > a else None for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), part.column("text_hash"), pa.array(nodes(tokens, first)), pa.array(np.diff(first).astype(np.int64)), pa.array(maps, pa.binary())],
                ["doc_id", "key", "text_hash", "node", "n_shingles", "map"],
            )

    return docs.mapInArrow(run, "doc_id long, key long, text_hash long, node long, n_shingles long, map binary")


def _costs(docs: DataFrame) -> tuple[dict[int, float], np.ndarray]:
    """From a sample: the share of segments with two credits by band, and the costly signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, first in _each(batches):
            for share in SHARES:
                _, sig, level = signatures(tokens, first, dict.fromkeys(range(64), share), np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sig), share)), pa.array(level.astype(np.int64)), pa.array(sig.view(np.int64))], ["share", "level", "sig"]
                )

    sample = docs.sample(SAMPLE, seed=7).dropDuplicates(["text"])
    counted = kept(sample.mapInArrow(run, "share double, level long, sig long").groupBy("share", "level", "sig").agg(F.count(F.lit(1)).alias("n")), "costs")
    # a posting costs one, and a pair that meets costs one; pairs grow with the square of the sample
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2) / F.lit(SAMPLE)
    shares: dict[int, tuple[float, float]] = {}
    for r in counted.groupBy("level", "share").agg((F.sum("n") + pairs).alias("cost")).collect():
        if r["level"] and (r["cost"], r["share"]) < shares.get(r["level"], (float("inf"), 0.0)):
            shares[r["level"]] = (r["cost"], r["share"])
    chosen = {k: v[1] for k, v in shares.items()}
    top = counted.where((F.col("share") == 0.0) & (F.col("n") >= SEEN)).orderBy(F.desc("n"), "sig").limit(FREQUENT).collect()
    return chosen, np.array([r["sig"] for r in top], np.int64).view(np.uint64)


def _groups(docs: DataFrame) -> DataFrame:
    """Sets (as arrays of nodes) that share a signature, each different group once."""
    shares, costly = _costs(docs)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 8 * n

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, node = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            to = (sig % _U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(to[order]) != 0))
            blocks = [np.stack([sig[order[a:b]], node[order[a:b]]], axis=1).tobytes() for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[order[heads]].astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "block"])

        for _, tokens, first in _each(batches):
            name = nodes(tokens, first)
            row, sig, _ = signatures(tokens, first, shares, costly)
            fresh = np.array([x not in seen for x in name.tolist()], bool)
            fresh[fresh] = np.isin(np.flatnonzero(fresh), np.unique(name, return_index=True)[1])
            seen.update(name.tolist())
            ok = fresh[row] if len(row) else np.zeros(0, bool)
            held.append((sig[ok], name[row[ok]].view(np.uint64)))
            size += int(ok.sum())
            if size >= POSTINGS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        pairs = np.frombuffer(b"".join(blocks), np.uint64).reshape(-1, 2)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        sig, node = pairs[order, 0], pairs[order, 1].view(np.int64)
        new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
        sig, node = sig[new], node[new]
        heads = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        tails = np.append(heads[1:], len(sig))
        many = tails - heads > 1
        out: dict[bytes, bytes] = {}
        for a, b in zip(heads[many].tolist(), tails[many].tolist(), strict=True):
            cuts = [node[i : min(b, i + GROUP)] for i in range(a, b, GROUP)]
            # a large group: all pairs of its parts, so that each two sets are together somewhere
            for i, x in enumerate(cuts):
                for y in cuts[i + 1 :] if len(cuts) > 1 else [x[:0]]:
                    raw = x.tobytes() + y.tobytes()
                    out[hashlib.blake2b(raw, digest_size=16).digest()] = raw
                    if len(out) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["group", "nodes"])
                        out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["group", "nodes"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    yield from meet(held)
                    held = []
                now = bucket
                held.append(block.as_py())
        if held:
            yield from meet(held)

    posted = docs.mapInArrow(post, "bucket int, block binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    found = posted.mapInArrow(grouped, "group binary, nodes binary")
    return found.groupBy("group").agg(F.first("nodes").alias("nodes"))


def _spread(groups: DataFrame) -> DataFrame:
    """One row a group and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                raw = part.column("nodes").to_pylist()
                count = np.array([len(x) // 8 for x in raw])
                at = pa.array(np.repeat(np.arange(len(raw)), count))
                yield pa.RecordBatch.from_arrays([part.column("group").take(at), pa.array(np.frombuffer(b"".join(raw), np.int64))], ["group", "node"])

    return groups.mapInArrow(run, "group binary, node long")


def _candidates(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets of a group that sizes and bitmaps leave together."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def edges() -> Iterator[tuple[int, int]]:
            if len(held) > 1:
                size = np.array([h[1] for h in held])
                for a, b in _may_link(size, [np.frombuffer(h[2], np.uint8) for h in held]):
                    yield tuple(sorted((held[a][0], held[b][0])))

        out: set[tuple[int, int]] = set()
        for batch in batches:
            for group, node, size, raw in zip(*(batch.column(c).to_pylist() for c in ("group", "node", "n_shingles", "map")), strict=True):
                if group != now:
                    out.update(edges())
                    now, held = group, []
                held.append((node, size, raw))
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
                out.clear()
        out.update(edges())
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    rows = _spread(groups).join(classes.select("node", "n_shingles", "map"), "node")
    return rows.repartition(n, "group").sortWithinPartitions("group").mapInArrow(run, "a long, b long").distinct()


def _verified(docs: DataFrame, together: DataFrame, classes: DataFrame) -> DataFrame:
    """Spanning links (a, b) of the sets that belong to one label of ``together``.

    Labels of much weight are dealt into blocks, and each two blocks are one task.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = together.join(classes.select("node", "n_shingles", F.col("first").alias("key"), F.col("first_hash").alias("text_hash")), "node")
    weight = members.groupBy("label").agg(F.count(F.lit(1)).alias("many"), F.sum("n_shingles").alias("tokens"))
    weight = weight.where("many > 1").withColumn(
        "blocks", F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    )
    members = members.join(weight.select("label", "blocks"), "label")
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(
        "key", "text_hash", "node", "own", F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
        F.concat_ws("/", "label", F.least("own", "other"), F.greatest("own", "other")).alias("pair"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def found() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                name = list(held)
                side = np.array([held[x][0] for x in name])
                pair = now.rsplit("/", 2)
                edges = links([held[x][1] for x in name], side if pair[1] != pair[2] else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name[a] for a, _ in edges], pa.int64()), pa.array([name[b] for _, b in edges], pa.int64())], ["a", "b"]
                )

        for part, tokens, first in _each(batches):
            names = nodes(tokens, first)
            for i, (pair, node, own) in enumerate(zip(*(part.column(c).to_pylist() for c in ("pair", "node", "own")), strict=True)):
                if pair != now:
                    yield from found()
                    now, held = pair, {}
                # rows of one id may have other texts
                if names[i] == node:
                    held[node] = (own, tokens[first[i] : first[i + 1]].copy())
        yield from found()

    # by the text as well, as many rows may have one id or none
    rows = docs.select("key", "text_hash", "text").join(members, ["key", "text_hash"]).drop("text_hash")
    return rows.repartition(n, "task").sortWithinPartitions("pair").mapInArrow(run, "a long, b long")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and text_hash (xxhash64) of every document.

    Sets are the distinct five-word shingles of the whole text, small letters; fewer words
    are one shingle. Two sets link when 100 * intersection >= 75 * union; component_id is
    the smallest doc_id that links reach. Null, empty and blank texts have no shingles and
    link with nothing. Repeated rows and equal sets are one node. A null id is smaller than
    all others and shows as null. An empty table gives an empty result; other columns are
    ignored. Tokens and nodes are 64-bit hashes.
    """
    key = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    rows = docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(LOWEST)).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    text_batches(docs.sparkSession)
    named = kept(_named(rows), "sets")
    classes = named.where("n_shingles > 0").groupBy("node").agg(
        F.min("key").alias("first"), F.min_by("text_hash", "key").alias("first_hash"), F.first("n_shingles").alias("n_shingles"), F.first("map").alias("map")
    )
    classes = kept(classes, "classes")
    near = kept(_candidates(_groups(rows), classes), "near")
    edges = kept(_verified(rows, components(near), classes), "links")
    labels = components(edges)
    least = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = least.join(least.groupBy("label").agg(F.min("first").alias("component")), "label").select("node", "component")
    out = named.select("doc_id", "key", "text_hash", "node", "n_shingles").join(least, "node", "left")
    component = F.coalesce("component", "key")
    return out.select("doc_id", "n_shingles", F.when(component != LOWEST, component).alias("component_id"), "text_hash")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those that link to one of smaller id.

    Of each component the row of smallest doc_id stays (of equal rows, one); documents
    without shingles all stay.
    """
    found = linked(docs.select("doc_id", "text"))
    stay = found.where("component_id <=> doc_id").select("doc_id", "text_hash", (F.col("n_shingles") > 0).alias("some")).distinct()
    names = docs.columns
    own = docs.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(names)})
    i, t = (F.col(f"__c{names.index(c)}") for c in ("doc_id", "text"))
    own = own.withColumn("__hash", F.xxhash64(t.cast("string")))
    met = own.join(stay, i.cast("long").eqNullSafe(stay["doc_id"]) & (F.col("__hash") == stay["text_hash"]))
    # rows without shingles are no copies of each other
    met = met.withColumn("__one", F.when(F.col("some"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    met = met.dropDuplicates(["doc_id", "text_hash", "__one"])
    return met.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(names)])
