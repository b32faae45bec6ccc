"""Language identification with string kernels.

A text is the set of its character n-grams (n = 1 .. 4, over small letters, other
characters as one blank), hashed into a fixed number of columns per n. The kernel of two
texts is the sum over n of the cosine of their sets: the blended presence spectrum.
Landmarks (a bounded sample of the training texts) give the Nyström map; one-versus-rest
kernel ridge regression is solved on it once, on the driver, from bounded matrices. Scoring
multiplies a batch's presence matrix by the landmarks' and the result by the coefficients.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arealis.llm.store import text_batches
from arealis.llm.text import BASES, mix, slices, utf8

#: Columns of the presence matrix by length of the n-gram.
WIDTHS = {1: 1 << 9, 2: 1 << 12, 3: 1 << 13, 4: 1 << 13}
#: Training texts a language, about, and of all languages; landmarks likewise. Each language has a text.
SAMPLE, SAMPLES = 400, 12_800
LANDMARKS, MARKS = 32, 1024
#: Rows of presence that are unpacked at once.
UNPACKED = 256
#: A text is of no learned language if it has less than this share of both the usual score of
#: its best language and the usual part of pairs of characters that the language's texts have.
LITTLE = 0.5
PAIRS = slice(WIDTHS[1], WIDTHS[1] + WIDTHS[2])
RIDGE = 0.1
UNKNOWN = "und"
_BATCH = 96


def _letters() -> np.ndarray:
    """For each code point its small letter, or 32 if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x32000):
        c = chr(cp)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letters())
    return _LETTERS[0]


def presence(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit sets, block by n (each block's rows have length 1), and the letters a row."""
    rows = len(borders) - 1
    width = sum(WIDTHS.values())
    out = np.zeros((rows, width), np.float32)
    # code points of all rows at once; where each row begins is counted from its bytes
    lead = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    chars = letters()[np.minimum(points, 0x10FFFF)]
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(before[borders]))
    is_letter = chars != 32
    n_letters = np.bincount(row[is_letter], minlength=rows)
    # one blank after each word of a row; what stands in other rows plays no part
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (row[1:] == row[:-1])
    chars, row = chars[keep].astype(np.uint64), row[keep]
    at = 0
    code = np.zeros(len(chars), np.uint64)
    for n, columns in WIDTHS.items():
        code = mix(code[: len(chars) - n + 1] * np.uint64(BASES[0]) + chars[n - 1 :]) if len(chars) >= n else code[:0]
        same = row[: len(code)] == row[n - 1 :] if len(code) else np.zeros(0, bool)
        col = (code >> np.uint64(64 - columns.bit_length() + 1)).astype(np.int64)
        block = out[:, at : at + columns]
        flat = np.zeros(rows * columns, bool)
        flat[(row[: len(code)] * columns + col)[same]] = True
        block[:] = flat.reshape(rows, columns)
        size = block.sum(axis=1, keepdims=True)
        np.divide(block, np.sqrt(size), out=block, where=size > 0)
        at += columns
    return out, n_letters


@dataclass
class Model:
    """Landmark rows, the coefficients of each language on the kernel against them, and what its texts are like.

    ``pairs`` are the columns of pairs of characters that its training texts have; ``usual``
    is the median score and the median part of such pairs of its texts.
    """

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    usual: np.ndarray

    def known(self, x: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Whether each row has enough in common with its best language."""
        best = scores.argmax(axis=1)
        few = scores.max(axis=1) < LITTLE * self.usual[0, best]
        out = np.ones(len(x), bool)
        at = np.flatnonzero(few)
        out[at] = covered(x[at], self.pairs[best[at]]) >= LITTLE * self.usual[1, best[at]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks.T) @ self.weights


def covered(x: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The part of each row's pairs of characters that are in the same row of ``pairs``; 1 without pairs."""
    own = x[:, PAIRS] > 0
    many = own.sum(axis=1)
    return np.where(many > 0, (own & pairs).sum(axis=1) / np.maximum(many, 1), 1.0)


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows as one bit a column, so the driver gets a bounded number of bytes a row."""
    for batch in batches:
        data, borders = utf8(batch.column("text"))
        for i, j in slices(borders):
            x, n = presence(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
            bits = np.packbits(x > 0, axis=1)
            ok = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").slice(i, j - i).take(pa.array(ok)), batch.column("pick").slice(i, j - i).take(pa.array(ok)),
                 pa.array([bits[k].tobytes() for k in ok], pa.binary())],
                ["lang", "pick", "bits"],
            )


def _unit(bits: list[bytes]) -> np.ndarray:
    x = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
    at = 0
    for columns in WIDTHS.values():
        block = x[:, at : at + columns]
        size = block.sum(axis=1, keepdims=True)
        np.divide(block, np.sqrt(size), out=block, where=size > 0)
        at += columns
    return x


def _measured(bits: list[bytes], marks: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kernel of packed rows against the landmarks, and how far ``pairs`` cover them; some rows at a time."""
    kernel, part = np.empty((len(bits), len(marks))), np.empty(len(bits))
    for i in range(0, len(bits), UNPACKED):
        x = _unit(bits[i : i + UNPACKED])
        kernel[i : i + UNPACKED], part[i : i + UNPACKED] = x @ marks.T, covered(x, pairs[i : i + UNPACKED])
    return kernel, part


def fit(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """Train on (text, lang). Null texts, null labels and texts without letters teach nothing.

    The sample is bounded: about ``sample`` different texts of each language, fewer where all
    languages would have more than ``SAMPLES``, those whose hash is smallest; copies count
    once. Every language has at least one, so all labels can be predicted. Landmarks are
    ``landmarks`` a language and ``MARKS`` in all. A fifth of the texts only tells which scores
    a language's texts usually have. Ties and the order of rows don't matter.
    """
    spark = labelled.sparkSession
    rows = labelled.select(
        F.col("lang").cast("string").alias("lang"),
        F.col("text").cast("string").alias("text"),
    ).where("lang is not null and text is not null")
    text_batches(spark)
    rows = rows.withColumn("pick", F.shiftrightunsigned(F.xxhash64("text"), 1))
    # a label a row: what the model itself has to hold; texts without a letter can't be a label's only one
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("pick"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("pick").alias("n"), F.min(lettered).alias("least")).where("least IS NOT NULL").collect()
    if not counts:
        none = np.zeros((0, sum(WIDTHS.values())), np.float32)
        return Model([], none, np.zeros((0, 0), np.float32), none[:, PAIRS] > 0, np.zeros((2, 0)))
    # the share of all hash values that gives the wanted number of texts
    wanted = min(sample, SAMPLES / len(counts))
    most = 2**63 - 1
    upto = [max(r["least"], min(most, int(wanted / max(1, r["n"]) * most))) for r in counts]
    # as an Arrow table, which the JVM reads: a list of rows starts Python workers that nothing else uses
    shares = pa.table({"lang": pa.array([r["lang"] for r in counts], pa.string()), "upto": pa.array(upto, pa.int64())})
    chosen = rows.join(F.broadcast(spark.createDataFrame(shares)), "lang").where("pick <= upto")
    chosen = chosen.groupBy("lang", "pick").agg(F.first("text").alias("text"))
    got = sorted(chosen.mapInArrow(_packed, "lang string, pick long, bits binary").collect(), key=lambda r: (r["pick"], r["lang"]))
    languages = sorted({r["lang"] for r in got})
    number = {x: k for k, x in enumerate(languages)}
    label = np.array([number[r["lang"]] for r in got])
    bits = [bytes(r["bits"]) for r in got]
    # the n-th text of each language, for all n
    order = np.argsort(label, kind="stable")
    nth = np.empty(len(label), np.int64)
    nth[order] = np.arange(len(label)) - np.searchsorted(label[order], label[order])
    first = np.lexsort((np.arange(len(label)), nth))
    marks = np.sort(first[: min(MARKS, int((nth < landmarks).sum()))])
    z = _unit([bits[i] for i in marks])
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6 * value.max()))
    # a fifth is kept from training, none of a language of few texts
    aside = (nth % 5 == 4) & ~np.isin(np.arange(len(label)), marks)
    pairs = np.zeros((len(languages), WIDTHS[2]), bool)
    for k in range(len(languages)):
        texts = [bits[i] for i in np.flatnonzero((label == k) & ~aside)]
        either = np.bitwise_or.reduce(np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1), axis=0)
        pairs[k] = np.unpackbits(either)[PAIRS]
    kernel, part = _measured(bits, z, pairs[label])
    phi = kernel @ root
    own, at = phi[~aside], label[~aside]
    # each language weighs the same, however many texts it has
    weight = 1.0 / np.bincount(at, minlength=len(languages))[at]
    total = np.zeros((phi.shape[1], len(languages)))
    np.add.at(total.T, at, own * weight[:, None])
    gram = own.T @ (own * weight[:, None])
    right = 2 * total - (own * weight[:, None]).sum(0)[:, None]
    alpha = np.linalg.solve(gram + RIDGE / len(own) * np.eye(len(marks)), right)
    seen = aside if aside.any() else np.ones(len(label), bool)
    scores = np.einsum("ij,ji->i", phi[seen], alpha[:, label[seen]])
    usual = np.empty((2, len(languages)))
    for k in range(len(languages)):
        own = label[seen] == k
        own = own if own.any() else np.ones(len(own), bool)
        usual[:, k] = np.median(scores[own]), np.median(part[seen][own])
    return Model(languages, z, (root @ alpha).astype(np.float32), pairs, usual)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` and ``score`` for each row, from its whole text alone.

    ``score`` is the softmax share of the best language, between 0 and 1. Null texts and
    texts without a letter get ``und`` and 0, as does every text if nothing was learned.
    ``known`` is false for them, and for texts that have little in common with any learned
    language: both their score and the part of their character pairs that the best language's training
    texts have are below half of what is usual there.
    """
    text_batches(docs.sparkSession)
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("known")).schema
    # the text goes to Python once, whether it is kept or not
    held = text in keep and docs.schema[text].dataType == StringType()
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if held else [F.col(f"`{text}`").cast("string").alias("__text")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            data, borders = utf8(batch.column(text if held else "__text"))
            best = np.full(batch.num_rows, len(m.languages))
            score = np.zeros(batch.num_rows)
            known = np.zeros(batch.num_rows, bool)
            for i0, j0 in slices(borders):
                for i in range(i0, j0 if m.languages else i0, _BATCH):
                    j = min(j0, i + _BATCH)
                    x, n = presence(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
                    s = m.scores(x).astype(np.float64)
                    e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                    best[i:j] = np.where(n > 0, s.argmax(axis=1), len(m.languages))
                    known[i:j] = (n > 0) & m.known(x, s)
                    score[i:j] = np.where(n > 0, (e / e.sum(axis=1, keepdims=True)).max(axis=1), 0.0)
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(list(names[best]), pa.string()), pa.array(score), pa.array(known)], [*keep, "lang_pred", "score", "known"]
            )

    return source.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and known of every document; the held-out ones don't train.

    A null id is not held out. Repeated rows are each predicted. An empty table gives an
    empty result. Other columns are ignored.
    """
    own = docs.select("doc_id", "text", "lang")
    model = fit(own.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = predict(own.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
    return out


def filtered(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose language is one of those learned (see ``predict``)."""
    names = docs.columns
    model = fit(docs.select("text", "lang"))
    hidden = docs.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(names)})
    out = predict(hidden, model, hidden.columns, f"__c{names.index('text')}")
    return out.where("known").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)])
