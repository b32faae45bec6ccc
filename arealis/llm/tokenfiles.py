"""Token ids in binary files: fixed width, packed, with tables for random access.

A file holds, little-endian:

* 16 bytes: ``IDPACK01``, width in bits (uint32), ids a block (uint32);
* blocks: 64 ids of w bits are w 64-bit words, so a block starts on a word. The last block
  is filled up with zeros to a multiple of 64 ids;
* block table: byte offset of each block and of the end (uint64);
* document table: doc_id (int64), 1 where it is given (uint8), first id (uint64, one more for the end);
* footer: ids, documents, offset of the block table, of the document table (uint64), ``IDPACK01``.

Documents are dealt by sorted ranges of their id, one file a range. A task names its file
after itself and a random number, and the file counts only if the task's row is in the
manifest that Spark commits: lost and repeated tasks leave files that nothing refers to.
Files are written and read through ``pyarrow.fs``, so the folder may be any it knows.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.store import kept, text_batches
from arealis.llm.text import NOT_SPACE, ranges, slices, table, utf8, words
from arealis.session import shared_dir

MAGIC = b"IDPACK01"
BLOCK = 4096
#: Ids a file, about, and ids unpacked at once.
FILE, RUN = 1 << 26, 1 << 20
#: Bytes of texts whose words are looked up together.
TOGETHER = 1 << 23
_U = np.uint64


def width_of(size: int) -> int:
    """Bits that ids below ``size`` need."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """64 ids a time as ``width`` words of 64 bits; the rest is filled up with zeros."""
    groups = np.zeros((-(-len(ids) // 64), 64), _U)
    groups.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(groups), width), _U)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= groups[:, i] << _U(shift)
        if shift + width > 64:
            out[:, word + 1] |= groups[:, i] >> _U(64 - shift)
    return out.reshape(-1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """All ids of whole groups of 64."""
    words = words.reshape(-1, width)
    out, mask = np.empty((len(words), 64), np.uint32), _U((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = words[:, word] >> _U(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << _U(64 - shift))
        out[:, i] = x & mask
    return out.reshape(-1)


class Writer:
    """Writes documents one after the other; holds a block of ids and the tables."""

    def __init__(self, sink, width: int, block: int = BLOCK):
        if block % 64 or not 1 <= width <= 32:
            raise ValueError("blocks are multiples of 64 ids, widths 1 to 32 bits")
        self.sink, self.width, self.block = sink, width, block
        self.at, self.n, self.rest = 16, 0, np.zeros(0, np.uint32)
        self.blocks: list[int] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        sink.write(MAGIC + struct.pack("<II", width, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError("an id needs more bits than the file's width")
        self.docs.append(doc_id)
        self.starts.append(self.n)
        self.n += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(self.rest) // self.block * self.block
        if whole:
            self._put(self.rest[:whole])
            self.rest = self.rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        each = self.block // 64 * self.width * 8
        data = pack(ids, self.width).tobytes()
        self.blocks += range(self.at, self.at + len(data), each)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        table = np.array([*self.blocks, self.at], "<u8").tobytes()
        docs = np.array([0 if d is None else d for d in self.docs], "<i8").tobytes()
        docs += np.array([d is not None for d in self.docs], np.uint8).tobytes()
        docs += np.array([*self.starts, self.n], "<u8").tobytes()
        end = struct.pack("<QQQQ", self.n, len(self.docs), self.at, self.at + len(table)) + MAGIC
        self.sink.write(table + docs + end)
        self.sink.close()


class Reader:
    """Random access to the ids and documents of one file."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        foot = self._bytes(end - 40, end)
        if foot[32:] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.n, many, blocks, docs = struct.unpack("<QQQQ", foot[:32])
        self.width, self.block = struct.unpack("<II", self._bytes(8, 16))
        self.offsets = np.frombuffer(self._bytes(blocks, docs), "<u8")
        table = self._bytes(docs, end - 40)
        self.ids = np.frombuffer(table, "<i8", many)
        self.given = np.frombuffer(table, np.uint8, many, 8 * many).astype(bool)
        self.starts = np.frombuffer(table[9 * many :], "<u8").astype(np.int64)

    def _bytes(self, start: int, stop: int) -> bytes:
        self.source.seek(start)
        return self.source.read(stop - start)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, from the blocks that hold them."""
        start, stop = max(0, start), min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        words = np.frombuffer(self._bytes(int(self.offsets[first]), int(self.offsets[last])), "<u8")
        return unpack(words, self.width)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        """The ids of the file's document number k."""
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def runs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Documents in runs: number of the first, of the one past the last, and their ids.

        A document longer than a run comes alone, in pieces: each run after the first begins
        with the same number.
        """
        k, many = 0, len(self.ids)
        while k < many:
            j = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + RUN, "right")) - 1)
            j = min(j, many)
            a, b = int(self.starts[k]), int(self.starts[j])
            for at in range(a, max(b, a + 1), RUN):
                yield k, j, self.read(at, min(b, at + RUN))
            k = j


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


_TOKENIZERS: dict[int, object] = {}


def tokenizer(source: str):
    """The tokenizer of this JSON text, built once a Python worker."""
    key = hash(source)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[key] = Tokenizer.from_str(source)
    return _TOKENIZERS[key]


#: Different words whose ids a Python worker remembers, and bytes of those that it doesn't.
WORDS, LONG = 1 << 20, 256
_IDS: dict[int, dict[bytes, bytes]] = {}
#: Marks that end a word of ASCII before them, and what stands before them.
MARK = table(lambda b: b in b",.;:!?")
BEFORE = table(lambda b: chr(b).isalnum() and b < 0x80)
#: Words that are one unit to this kind of tokenizer: letters that stay letters in any form and case.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
LAST = "</w>"


class Lookup:
    """The ids of words, as bytes, each word encoded once."""

    def __init__(self, source: str):
        self.own, self.known = tokenizer(source), _IDS.setdefault(hash(source), {})
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(LAST)]] = True

    def of(self, names: list[bytes]) -> list[bytes]:
        if len(self.known) > WORDS:
            self.known.clear()
        new = [w for w in names if w not in self.known]
        texts = [w.decode() for w in new]
        # a plain word's last id says that it is the last, if the vocabulary has such marks
        plain = [i for i, t in enumerate(texts) if PLAIN.fullmatch(t)] if self.last.any() else []
        self._together([new[i] for i in plain], [texts[i] for i in plain])
        rest = [i for i, w in enumerate(new) if w not in self.known]
        for k in range(0, len(rest), 10_000):
            some = rest[k : k + 10_000]
            out = self.own.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)
            self.known.update((new[i], np.array(e.ids, "<u4").tobytes()) for i, e in zip(some, out, strict=True))
        found = [self.known[w] for w in names]
        for i in rest:
            if len(new[i]) > LONG:
                del self.known[new[i]]
        return found

    def _together(self, names: list[bytes], texts: list[str]) -> None:
        """Words encoded as one text each five hundred, and told apart by their last ids."""
        runs = [(k, min(k + 500, len(names))) for k in range(0, len(names), 500)]
        for (a, b), e in zip(runs, self.own.encode_batch_fast([" ".join(texts[a:b]) for a, b in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            # as many last ids as words, or each word is encoded by itself
            if len(ends) == b - a and ends[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.known.update((w, data[i:j]) for w, i, j in zip(names[a:b], at, at[1:], strict=False))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of more text, so that a frequent word is looked up seldom."""
    held, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.nbytes
        if held and (batch is None or size >= TOGETHER):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0


def encoded(texts: pa.Array, lookup: Lookup) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first row, row past the last, ids of all, and the number of ids of each.

    White space of ASCII ends words under this kind of tokenizer, and a mark after a letter or
    digit begins one: no normalisation, special token or merge reaches across them (the
    tests compare with whole texts). So each different word is encoded once. A text may
    be of any length, its longest word is what the tokenizer takes at once.
    """
    data, borders = utf8(texts)
    for i, j in slices(borders, TOGETHER):
        part, edges = data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
        starts, ends, _ = words(part, edges, NOT_SPACE)
        cut = np.zeros(len(part) + 1, bool)
        cut[1:-1] = MARK[part[1:]] & BEFORE[part[:-1]]
        cut[edges] = False
        cuts = np.flatnonzero(cut)
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        offsets = np.append(0, np.cumsum(ends - starts))
        flat = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(part[NOT_SPACE[part]])]
        )
        found = flat.dictionary_encode()
        own = lookup.of(found.dictionary.to_pylist())
        length = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids, at = np.frombuffer(b"".join(own), "<u4"), found.indices.to_numpy()
        many = np.append(0, np.cumsum(length[at]))
        start = np.cumsum(length) - length
        yield i, j, ids[ranges(start[at], length[at])], np.diff(many[np.searchsorted(starts, edges)])


def tokenized(docs: DataFrame, path: str, end: int | None = 2) -> tuple[DataFrame, int]:
    """doc_id, n (ids), crc (of the ids) and ids (16 bits each, or 32) of every text, and the width.

    ``path`` is a tokenizer's JSON file on the driver; its text goes to the tasks. Some
    megabytes is its proven size: a larger one is refused.
    """
    spark = docs.sparkSession
    text_batches(spark)
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if len(source) > 1 << 26:
        raise ValueError("a tokenizer of over 64 MB isn't sent to tasks")
    size = max(tokenizer(source).get_vocab_size(with_added_tokens=True), 0 if end is None else end + 1)
    width = width_of(size)
    sent = spark.sparkContext.broadcast(source)

    kind = np.dtype("<u2" if width <= 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value)
        for batch in _joined(batches):
            for i, j, ids, n in encoded(batch.column("text"), lookup):
                if end is not None:
                    ids = np.insert(ids, np.cumsum(n), end)
                    n = n + 1
                borders = np.append(0, np.cumsum(n)).tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in itertools.pairwise(borders)]
                packed = ids.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(n), pa.array(crc, pa.int64()), pa.array([packed[a:b].tobytes() for a, b in itertools.pairwise(borders)], pa.binary())],
                    ["doc_id", "n", "crc", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept(rows.mapInArrow(run, "doc_id long, n long, crc long, ids binary"), "ids"), width


def written(rows: DataFrame, width: int, folder: str, block: int = BLOCK) -> DataFrame:
    """Write tokenized rows in ascending doc_id and return the manifest.

    One row a file: part, path, n_ids, n_docs and base (ids in all files before). Null ids
    come first; rows of one id are ordered by the CRC and number of their ids, and dealt over
    several files where one can't hold them.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE))
    keys = ["doc_id", "crc", "n", "salt"]
    kind = np.dtype("<u2" if width <= 16 else "<u4")
    store, root = _open(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, part, path = None, 0, ""
        for batch in batches:
            for doc, ids, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "part")), strict=True):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                    own, at = _open(path)
                    writer = Writer(own.open_output_stream(at), width, block)
                writer.add(doc, np.frombuffer(ids, kind))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "n_ids": writer.n, "n_docs": len(writer.docs)}])

    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ordered = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = ordered.select("doc_id", "ids", F.spark_partition_id().cast("long").alias("part"))
    files = kept(ordered.mapInArrow(run, "part long, path string, n_ids long, n_docs long"), "files")
    base, out = 0, []
    for r in sorted(files.collect(), key=lambda r: r["part"]):
        out.append((r["part"], r["path"], r["n_ids"], r["n_docs"], base))
        base += r["n_ids"]
    return spark.createDataFrame(out, "part long, path string, n_ids long, n_docs long, base long").repartition(max(1, len(out)))


def contents(files: DataFrame) -> DataFrame:
    """From the files of a manifest: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The CRC is of all ids of the document as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base")), strict=True):
                own, at = _open(path)
                with own.open_input_file(at) as source:
                    yield from rows(Reader(source), base)

    def rows(file: Reader, base: int) -> Iterator[pa.RecordBatch]:
        crc = np.zeros(len(file.ids), np.int64)
        for k, j, ids in file.runs():
            data = memoryview(ids.astype("<u4").tobytes())
            if j == k + 1:
                crc[k] = zlib.crc32(data, int(crc[k]))
                continue
            place = ((file.starts[k : j + 1] - file.starts[k]) * 4).tolist()
            crc[k:j] = [zlib.crc32(data[a:b]) for a, b in zip(place, place[1:], strict=False)]
        for a in range(0, len(crc), 10_000):
            b = min(a + 10_000, len(crc))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(file.ids[a:b], pa.int64(), mask=~file.given[a:b]),
                    pa.array(file.starts[a:b] + base),
                    pa.array(np.diff(file.starts[a : b + 1])),
                    pa.array(crc[a:b]),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end: int | None = 2, folder: str | None = None) -> DataFrame:
    """Encode every whole text, write the files and return their manifest.

    A null text is an empty one: the end id alone. Repeated rows and rows of one id or of
    none are documents of their own, null ids first. Texts may have any length. An
    empty table has no files; other columns are ignored. ``folder`` is one below the
    shared folder if none is given.
    """
    rows, width = tokenized(docs, path, end)
    return written(rows, width, folder or f"{shared_dir(docs.sparkSession)}/llm-token-files-{uuid.uuid4().hex}")
