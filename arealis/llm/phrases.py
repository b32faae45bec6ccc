"""Phrases whose words stick together, from counts of longest windows only.

Every word starts one window of the longest length: the word and the words that lead it by
one, two, .. places, padded where the piece ends. Only those are counted. ROLLUP over the
window's columns then sums them to the counts of all shorter phrases, as the first k
columns of all windows are all phrases of k words.

Words travel as 64-bit hashes, beside a table of the words that shows whether two share
one (then all is done again with another seed). Windows are counted in the tasks that read
the texts, packed by buckets of their first word, and counted again by bucket. There a
window's last words can be padded, too, once its whole count shows that no phrase they
end is frequent: sums of shorter prefixes stay exact, and few rows are left to roll up.
Windows whose first words a sample finds very frequent are dealt over buckets by more words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.store import kept, text_batches
from arealis.llm.text import BASES, LOWER, SLICE, mix, ranges, slices, span_hashes, table, utf8, words

_U = np.uint64
PAD = 0
#: Windows that a task holds before it packs them, words it remembers to have named, and buckets a shuffle partition.
HELD, SEEN, BUCKETS = 1 << 20, 1 << 21, 4
#: Share of documents looked at for frequent first words.
SAMPLE = 0.01
ENDS = frozenset(b".,;:!?\n\x0b\x0c\r")
INSIDE = table(lambda b: b not in ENDS and b not in (0x20, 0x09))
END = table(lambda b: b in ENDS)


def _cut_long(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders that also cut long rows at ends of pieces, and the row of each stretch."""
    out, rows = [0], []
    for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
        while b - a > SLICE:
            found, at = -1, a + SLICE
            while found < 0 and at < b:
                ends = np.flatnonzero(END[data[at : min(at + SLICE, b)]])
                found, at = (at + int(ends[0]) + 1, at) if len(ends) else (-1, at + SLICE)
            if found < 0 or found >= b:
                break
            out.append(found)
            rows.append(i)
            a = found
        out.append(b)
        rows.append(i)
    return np.array(out, np.int64), np.array(rows, np.int64)


def windows(column: pa.Array, size: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """For runs of texts: row of each word, its window as ``size`` hashes, and the words (bytes, starts, ends, hashes)."""
    data, borders = utf8(column)
    borders, rows = _cut_long(data, borders)
    for i, j in slices(borders):
        part = LOWER[data[borders[i] : borders[j]]]
        own = borders[i : j + 1] - borders[i]
        starts, ends, first = words(part, own, INSIDE)
        if not len(starts):
            continue
        hashes = mix(span_hashes(part, starts, ends, BASES[0]) ^ _U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        hashes[hashes == PAD] = 1
        # a piece is told by its row and the ends before it
        row = np.repeat(np.arange(j - i), np.diff(first))
        piece = np.searchsorted(np.flatnonzero(END[part]), starts) + row
        out = np.zeros((size, len(starts)), _U)
        out[0] = hashes
        for k in range(1, size):
            out[k, :-k] = np.where(piece[k:] == piece[:-k], hashes[k:], PAD)
        yield rows[i + row], out, (part, starts, ends, hashes)


def _prefixes(lang: np.ndarray, window: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the language and the first word, the first two words, and so on."""
    h = lang
    for x in window:
        h = mix(h + x)
        yield h


def _dealt(lang: np.ndarray, window: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many first words deal out each window, and their hash: the fewest that aren't hot."""
    level, deal, still = np.ones(len(lang), np.int64), np.zeros(len(lang), _U), np.ones(len(lang), bool)
    for k, prefix in enumerate(_prefixes(lang, window), 1):
        deal[still], level[still] = prefix[still], k
        if not len(hot):
            break
        still &= np.isin(prefix, hot)
    return level, deal


def _counted(lang: np.ndarray, window: np.ndarray, n: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows as one, in order (of ``first``, of the language, of the words), and one row of each."""
    order = np.lexsort((*window[::-1], lang) if first is None else (*window[::-1], lang, first))
    lang, window, n = lang[order], window[:, order], n[order]
    new = np.ones(len(n), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (window[:, 1:] != window[:, :-1]).any(0)
    at = np.flatnonzero(new)
    return lang[at], window[:, at], np.add.reduceat(n, at) if len(at) else n, order[at]


def _padded(lang: np.ndarray, window: np.ndarray, n: np.ndarray, level: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Counted windows with all words padded that only rare phrases need.

    A phrase of k first words is rare if all its windows are here (``level`` says so) and
    they are fewer than ``least``. What such windows count goes on to the phrase of one word less.
    """
    window, rest, total = window.copy(), n, n
    for k in range(len(window), -1, -1):
        new = np.ones(len(rest), bool)
        new[1:] = (lang[1:] != lang[:-1]) | (window[:k, 1:] != window[:k, :-1]).any(0)
        at = np.flatnonzero(new)
        lang, window, level, rest, total = lang[at], window[:, at], level[at], np.add.reduceat(rest, at), np.add.reduceat(total, at)
        stays = rest > 0
        if k:
            stays &= (window[k - 1] != PAD) & ((total >= least) | (level > k))
        yield lang[stays], window[:, stays], rest[stays]
        rest = np.where(stays, 0, rest)
        if k:
            window[k - 1] = PAD


def _names_hash(names: list[str]) -> np.ndarray:
    """A hash of each language, equal in all tasks."""
    data, borders = utf8(pa.array(names, pa.string()))
    return span_hashes(data, borders[:-1], borders[1:], BASES[1])


def _pack(names: list[str], lang: np.ndarray, window: np.ndarray, n: np.ndarray) -> bytes:
    """Windows by number in the list of their words; compressed."""
    vocabulary, at = np.unique(window, return_inverse=True)
    used, code = np.unique(lang, return_inverse=True)
    head = json.dumps([[names[i] for i in used], len(vocabulary), len(n), len(window)]).encode()
    body = len(head).to_bytes(4, "little") + head + vocabulary.tobytes()
    body += code.astype(np.int32).tobytes() + at.astype(np.int32).tobytes() + n.astype(np.int64).tobytes()
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    size = int.from_bytes(body[:4], "little")
    names, words_, many, length = json.loads(body[4 : 4 + size])
    at = 4 + size
    vocabulary = np.frombuffer(body, _U, words_, at)
    at += 8 * words_
    lang = np.frombuffer(body, np.int32, many, at).astype(np.int64)
    at += 4 * many
    window = vocabulary[np.frombuffer(body, np.int32, many * length, at).reshape(length, many)]
    return names, lang, window, np.frombuffer(body, np.int64, many, at + 4 * many * length)


class _Languages:
    """Numbers of language names, and their hashes."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.hashes = np.zeros(0, _U)

    def of(self, names: list[str]) -> np.ndarray:
        new = [x for x in dict.fromkeys(names) if x not in self.number]
        if new:
            self.number |= {x: i for i, x in enumerate(new, len(self.number))}
            self.hashes = np.concatenate([self.hashes, _names_hash(new)])
        return np.array([self.number[x] for x in names], np.int64)


def _frequent(docs: DataFrame, size: int, seed: int, share: float) -> np.ndarray:
    """Hashes of the first words that more than ``share`` of a sample's windows have.

    They only decide how windows are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Languages()
        for batch in batches:
            lang = known.of(batch.column("lang").to_pylist())
            for row, window, _ in windows(batch.column("text"), size, seed):
                for prefix in list(_prefixes(known.hashes[lang[row]], window))[:-1]:
                    found, n = np.unique(prefix, return_counts=True)
                    some = n > max(1, int(len(row) * share / 4))
                    yield pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(n[some])], ["prefix", "n"])
                # the row of prefix 0 has the number of all windows
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([len(row)])], ["prefix", "n"])

    found = docs.sample(SAMPLE, seed=11).mapInArrow(run, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    # no more than 1 / share of each length can pass it
    most = found.orderBy(F.desc("n"), "prefix").limit(int(size / share) + 1).collect()
    total = next((r["n"] for r in most if r["prefix"] == 0), 0)
    hot = [r["prefix"] for r in most if r["prefix"] != 0 and r["n"] > total * share]
    return np.sort(np.array(hot, np.int64).view(_U))


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """hash and word of all different words, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = []
        seen, many = np.zeros(0, _U), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen
            own, first = np.unique(np.concatenate([h for h, _ in held]), return_index=True)
            if len(seen):
                new = seen[np.minimum(np.searchsorted(seen, own), len(seen) - 1)] != own
                own, first = own[new], first[new]
            text = pa.concat_arrays([w for _, w in held])
            for k in range(0, len(own), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[k : k + 50_000].view(np.int64)), text.take(pa.array(first[k : k + 50_000])).cast(pa.binary())], ["hash", "word"]
                )
            seen = np.sort(np.concatenate([seen, own])) if len(seen) < SEEN else own

        for batch in batches:
            for _, _, (data, starts, ends, hashes) in windows(batch.column("text"), 1, seed):
                own, first = np.unique(hashes, return_index=True)
                length = ends[first] - starts[first]
                text = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(own),
                    [None, pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int64)), pa.py_buffer(data[ranges(starts[first], length)])],
                )
                held.append((own, text))
                many += len(own)
                if many >= HELD:
                    yield from flush()
                    held, many = [], 0
        if held:
            yield from flush()

    found = docs.select("lang", "text").mapInArrow(run, "hash long, word binary").distinct()
    return kept(found.select("hash", F.col("word").cast("string").alias("word")), "words")


def _merged(docs: DataFrame, size: int, seed: int, least: int, parts: int) -> DataFrame:
    """lang, w1 .. (0 where padded) and n of all windows; what no frequent phrase needs is padded."""
    columns = [f"w{k + 1}" for k in range(size)]
    buckets = parts * BUCKETS
    hot = _frequent(docs, size, seed, 1 / (4 * buckets))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Languages()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        many = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lang = np.concatenate([x for x, _ in held])
            window = np.concatenate([x for _, x in held], axis=1)
            held.clear()
            deal = (_dealt(known.hashes[lang], window, hot)[1] % _U(buckets)).astype(np.int64)
            lang, window, n, row = _counted(lang, window, np.ones(len(lang), np.int64), deal)
            edges = np.searchsorted(deal[row], np.arange(buckets + 1))
            names = list(known.number)
            some = np.flatnonzero(np.diff(edges))
            for k in range(0, len(some), 64):
                own = some[k : k + 64]
                blobs = [_pack(names, lang[edges[b] : edges[b + 1]], window[:, edges[b] : edges[b + 1]], n[edges[b] : edges[b + 1]]) for b in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            lang = known.of(batch.column("lang").to_pylist())
            for row, window, _ in windows(batch.column("text"), size, seed):
                held.append((lang[row], window))
                many += len(row)
                if many >= HELD:
                    yield from flush()
                    many = 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Languages()
        now, held, many = None, [], 0

        def one() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The held windows counted."""
            lang, window, n, _ = _counted(
                np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held], axis=1), np.concatenate([x[2] for x in held])
            )
            held[:] = [(lang, window, n)]
            return held[0]

        def bucket() -> Iterator[pa.RecordBatch]:
            lang, window, n = one()
            held.clear()
            names = pa.array(list(known.number), pa.string())
            level = _dealt(known.hashes[lang], window, hot)[0]
            for lang, window, n in _padded(lang, window, n, level, least):
                for a in range(0, len(n), 50_000):
                    b = a + 50_000
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(lang[a:b])), *(pa.array(w[a:b].view(np.int64)) for w in window), pa.array(n[a:b])], ["lang", *columns, "n"]
                    )

        for batch in batches:
            for name, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if name != now and held:
                    yield from bucket()
                    many = 0
                now = name
                names, lang, window, n = _unpack(blob.as_py())
                held.append((known.of(names)[lang], window, n))
                many += len(n)
                if many > 4 * HELD:
                    one()
                    many = 0
        if held:
            yield from bucket()

    blobs = docs.mapInArrow(pack, "bucket int, blob binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    schema = ", ".join(["lang string", *(f"{c} long" for c in columns), "n long"])
    return kept(blobs.mapInArrow(merge, schema), "counts")


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))


def counts(docs: DataFrame, size: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``size`` words with their counts by language, and the words.

    The first table has lang, words (hashes; none: the language's words in all) and f, for
    phrases that occur at least ``least`` times and totals; the second hash and word.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = _texts(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for seed in range(8):
        named = _words(docs, seed)
        if not named.groupBy("hash").count().where("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError("words share a hash under eight seeds")
    merged = _merged(docs, size, seed, least, parts)
    columns = [f"w{k + 1}" for k in range(size)]
    rolled = merged.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # the level's bits are set for the columns that are summed over, the last column lowest
    kinds = [((1 << (size - k)) - 1, columns[:k]) for k in range(size + 1)]
    phrase = F.coalesce(*[F.when(F.col("level") == level, F.array(*own) if own else F.array().cast("array<long>")) for level, own in kinds])
    found = rolled.select("lang", phrase.alias("words"), "f").where("words IS NOT NULL AND NOT array_contains(words, 0L)")
    return kept(found.where(f"f >= {least} OR size(words) = 0"), "phrases"), named


def collocations(docs: DataFrame, size: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of 2 to ``size`` words of each language whose words stick together.

    Returns lang, rank, phrase, a (its count), l and r (of its two parts at the cut that
    scores lowest), n (words of the language) and score, floor(1000000 * a * a / (l * r)).
    Phrases within a longer frequent one that makes up ``inside`` percent of their count go.
    Null languages are ``und``, null and empty texts have no words; repeated rows count each
    time. An empty table gives an empty result; other columns are ignored. Works on counts
    up to 10**15 exactly.
    """
    phrases, named = counts(docs, size, least)
    total = phrases.where("size(words) = 0").select("lang", F.col("f").alias("n"))
    many = phrases.where(f"size(words) > 1 AND f >= {least}").withColumnRenamed("f", "a")
    # longer phrases tell all that they contain
    spans = [(i, j) for i in range(1, size + 1) for j in range(2, size) if i + j <= size + 1]
    within = F.filter(
        F.array(*[F.when((F.size("words") > j) & (F.size("words") >= i + j - 1), F.slice("words", i, j)) for i, j in spans])
        if spans else F.array().cast("array<array<long>>"),
        lambda x: x.isNotNull(),
    )
    longer = many.select("lang", F.explode(within).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    left = many.join(longer, ["lang", "words"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    cut = left.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.withColumns({"first": F.slice("words", F.lit(1), F.col("k")), "rest": F.expr("slice(words, k + 1, size(words) - k)")})
    first = phrases.select("lang", F.col("words").alias("first"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("words").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    best = cut.withColumn("score", score).groupBy("lang", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "words", "a", "cut.l", "cut.r", "cut.score")
    # more than the top only where scores and counts tie, so few words are looked up
    close = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = best.withColumn("place", F.rank().over(close)).where(F.col("place") <= top)
    word = best.select("lang", "words", "a", "l", "r", "score", F.posexplode("words").alias("at", "hash")).join(named, "hash")
    spelled = word.groupBy("lang", "words", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("own"))
    spelled = spelled.withColumn("phrase", F.array_join(F.col("own.word"), " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
