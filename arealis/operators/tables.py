"""Row filters, equi joins, key handling and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions import values as v


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where any of the columns is null."""
    return df.dropna(subset=list(cols))


def null_implausible(
    df: DataFrame, col: str, limit: float, seen: Observation | None = None
) -> DataFrame:
    """Null values above the limit, keep the rows, and count what was nulled."""
    if seen is not None:
        df = df.observe(seen, F.count_if(F.col(col) > limit).alias("nulled"))
    return df.withColumn(col, v.null_implausible(F.col(col), limit))


def keep_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    return df.select(*(c for c in cols if c in df.columns))


def rename_select(df: DataFrame, mapping: Mapping[str, str], casts: Mapping[str, str] | None = None) -> DataFrame:
    """Final projection: old name to new name, with optional casts by new name."""
    casts = casts or {}
    return df.select(
        *(
            (F.col(old).cast(casts[new]) if new in casts else F.col(old)).alias(new)
            for old, new in mapping.items()
        )
    )


def of_kind(df: DataFrame, kinds: Sequence[str], geom: str = "geom") -> DataFrame:
    return df.where(g.is_kind(geom, tuple(kinds)))


def exclude_value(df: DataFrame, col: str, value: object) -> DataFrame:
    """Drop one category and keep nulls."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def mask_by_coverage(
    df: DataFrame, covered: Column, zero_filled: Sequence[str], others: Sequence[str]
) -> DataFrame:
    """Outside the covered area everything is null; inside, only counts become 0."""
    filled = {c: F.when(covered, F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))) for c in zero_filled}
    return df.withColumns({**filled, **{c: F.when(covered, F.col(c)) for c in others}})


def round_for_display(df: DataFrame, cols: Sequence[str], digits: int, text: Sequence[str] = ()) -> DataFrame:
    """Half-even rounding; the ``text`` columns become strings with "no data" for null."""
    rounded = {c: v.round_half_even(F.col(c), digits) for c in cols}
    shown = {c: v.text_or(rounded.get(c, F.col(c))) for c in text}
    return df.withColumns({**rounded, **shown})


def clip_to_box(
    df: DataFrame, bbox: tuple[float, float, float, float], geom: str = "geom"
) -> DataFrame:
    """Layer cut to a rectangle; rows left without any shape are dropped.

    Polygons keep the rings that have area inside, lines the stretches inside (one part a
    segment), points stay where they lie inside or on the border.
    """
    xmin, ymin, xmax, ymax = (float(b) for b in bbox)
    col = F.col(geom)
    meets = (col["xmin"] <= xmax) & (col["xmax"] >= xmin) & (col["ymin"] <= ymax) & (col["ymax"] >= ymin)
    within = (col["xmin"] >= xmin) & (col["xmax"] <= xmax) & (col["ymin"] >= ymin) & (col["ymax"] <= ymax)
    cut = (
        F.when(within | g.is_kind(geom, ("Point",)), col)
        .when(g.is_kind(geom, g.LINE_KINDS), g.clip_line(geom, bbox))
        .when(g.is_kind(geom, g.POINT_KINDS), g.clip_points(geom, bbox))
        .otherwise(g.clip_polygon(geom, bbox))
    )
    return df.where(meets).withColumn(geom, cut).where(F.col(geom).isNotNull())


# --- joins on keys -----------------------------------------------------------


def attach(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join."""
    return left.join(right, key, "left")


def join_common(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Chained inner join on one key; each side is shuffled once at most."""
    return reduce(lambda a, b: a.join(b, key), frames)


def join_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with one key column."""
    return left.join(right, key, "full")


def join_keep_right(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "right")


def complete_on(dim: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Every dimension key once, with nulls where there are no facts."""
    return dim.select(key).join(facts, key, "left")


def align_columns(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns side by side over the union of keys."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


# --- one row per key, sets ---------------------------------------------------


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key.

    An aggregate rather than a window: it combines before the shuffle, so a key
    with very many rows does not fill one task.
    """
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def merge_tiles(tiles: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of tiles; an object found in several tiles is kept from the first."""
    numbered = [t.withColumn("_tile", F.lit(i)) for i, t in enumerate(tiles)]
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    # doubles inside one tile: the content decides, so a task run again picks the same row
    told = united.withColumn("_content", F.xxhash64(*(c for c in united.columns if c != "_tile")))
    return first_per_key(told, key, ["_tile", "_content"]).drop("_tile", "_content")


def union_tiles(tiles: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiles)


def tile_bbox(
    spark: SparkSession, bbox: tuple[float, float, float, float], nx: int, ny: int
) -> DataFrame:
    """Sub-boxes of a box, column by column."""
    xmin, ymin, xmax, ymax = (float(b) for b in bbox)
    tile = F.col("id")
    i, j = F.floor(tile / ny), tile % ny

    def at(low: float, high: float, k: Column, n: int) -> Column:
        return F.lit(low) + k * F.lit((high - low) / n)

    return spark.range(nx * ny).select(
        tile.alias("tile"),
        at(xmin, xmax, i, nx).alias("xmin"),
        at(ymin, ymax, j, ny).alias("ymin"),
        at(xmin, xmax, i + 1, nx).alias("xmax"),
        at(ymin, ymax, j + 1, ny).alias("ymax"),
    )


def code_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Codes in both vintages, with the share of each side they make up."""
    marked = (
        a.select(key).distinct().withColumn("_in_a", F.lit(1))
        .join(b.select(key).distinct().withColumn("_in_b", F.lit(1)), key, "full")
    )
    in_a, in_b = F.count("_in_a"), F.count("_in_b")
    both = F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull())
    return marked.agg(
        in_a.alias("codes_a"),
        in_b.alias("codes_b"),
        both.alias("common"),
        F.try_divide(both.cast("double"), in_a).alias("share_a"),
        F.try_divide(both.cast("double"), in_b).alias("share_b"),
    )


def common_codes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def code_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Codes only in the old vintage (retired) and only in the new one (new)."""
    old, new = a.select(key).distinct(), b.select(key).distinct()
    retired = old.exceptAll(new).withColumn("change", F.lit("retired"))
    return retired.unionByName(new.exceptAll(old).withColumn("change", F.lit("new")))
