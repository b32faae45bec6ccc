"""Contiguous shards of nearly equal size from global prefix sums.

Rows are dealt by ranges of their id and sorted, as one narrow row each. The totals of the
ranges (two numbers a range) go to the driver and come back as offsets; running sums inside
the ranges complete the global prefix sums. A row belongs to the shard in whose equal share
of all bytes the middle of the row falls, so each cut is off by half a row at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arealis.llm.store import kept

#: Ranges a shuffle partition; more of them even out the tasks of the running sums.
RANGES = 4


def sized(docs: DataFrame) -> DataFrame:
    """One narrow row per document: id, UTF-8 bytes of the text plus 1, and its CRC."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def _ranges(docs: DataFrame) -> DataFrame:
    """Sorted ranges: each row has its range (part) and its place in the whole order (at).

    The salt deals rows of one id over neighbouring ranges when one range can't hold them.
    """
    spark = docs.sparkSession
    parts = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(sized(docs).withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "sizes")
    keys = ["doc_id", "text_crc32", "size", "salt"]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return kept(
        ordered.select(
            "doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
        ),
        "ranges",
    )


def _lookup(values: dict[int, int], key: str) -> F.Column:
    """The value of a small map by key."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, int(v))]
    return F.create_map(*pairs)[F.col(key)] if pairs else F.lit(0)


def by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards 0 .. shards-1, contiguous in doc_id, of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text and 1 more; null text: 1), text_crc32
    (unsigned; null as empty), law (``bytes``), shard, slot (0, 1, .. in each shard) and
    grown_shard (null under this law). Null ids come first; rows of one id are ordered by
    content, and repeated rows each get a slot. A row larger than a whole share leaves
    other shards empty. An empty table gives an empty result. Other columns are ignored.
    """
    ordered = _ranges(docs)
    totals = ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    byte_at, row_at, total, rows = {}, {}, 0, 0
    for t in sorted(totals, key=lambda r: r["part"]):
        byte_at[t["part"]], row_at[t["part"]] = total, rows
        total, rows = total + t["bytes"], rows + t["n"]
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = _lookup(byte_at, "part") + F.sum("size").over(inside)
    # twice the middle of the row against twice the total, in integers
    twice = F.col("end") * 2 - F.col("size")
    placed = (
        ordered.withColumn("row", _lookup(row_at, "part") + F.count(F.lit(1)).over(inside) - 1)
        .withColumn("end", end)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(twice / F.lit(2 * max(total, 1) / shards))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    placed = kept(placed, "placed")
    first = {r["shard"]: r["row"] for r in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - _lookup(first, "shard")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
