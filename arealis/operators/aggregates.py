"""Aggregations per area and over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions import values as v
from arealis.operators import gridjoin
from arealis.operators.quantiles import exact_quantiles


def area_stats(df: DataFrame, key: str, specs: Mapping[str, Column]) -> DataFrame:
    """Named aggregates per key."""
    return df.groupBy(key).agg(*(c.alias(name) for name, c in specs.items()))


def weighted_mean(value: Column, weight: Column, null_policy: str = "zero") -> Column:
    """Weighted mean as an aggregate.

    By default a null value adds nothing above the line but its weight still
    counts below it, so it acts as 0 and an all-null group gives 0. With
    ``null_policy="skip"`` the weights of null values are left out as well.
    """
    if null_policy == "skip":
        return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))
    if null_policy != "zero":
        raise ValueError("null_policy is 'zero' or 'skip'")
    return F.try_divide(F.coalesce(F.sum(value * weight), F.lit(0.0)), F.sum(weight))


def area_weighted_mean(
    source: DataFrame,
    areas: gridjoin.Areas,
    cols: Sequence[str],
    key: str,
    id_cols: Sequence[str],
    null_policy: str = "zero",
    settings: gridjoin.JoinSettings = gridjoin.DEFAULT,
) -> DataFrame:
    """Mean and maximum of polygon attributes per area, weighted by overlap area.

    ``mesh_block_count`` counts pieces: pairs of polygons sharing some area.
    """
    slim = source.select(*id_cols, *cols, "geom")
    pieces = gridjoin.overlay_area(slim, areas, key, list(id_cols), settings=settings)
    weight = F.col("piece_area")
    aggs = []
    for c in cols:
        value = v.null_nan(F.col(c).cast("double"))
        aggs.append(weighted_mean(value, weight, null_policy).alias(c))
        aggs.append(F.max(v.null_nan(F.col(c).cast("double"))).alias(f"{c}_max"))
    return pieces.groupBy(key).agg(*aggs, F.count(F.lit(1)).alias("mesh_block_count"))


def area_weighted_means(
    layers: Mapping[str, tuple[DataFrame, Sequence[str]]],
    areas: gridjoin.Areas,
    key: str,
    id_cols: Sequence[str],
    null_policy: str = "zero",
    settings: gridjoin.JoinSettings = gridjoin.DEFAULT,
) -> DataFrame:
    """``area_weighted_mean`` of several layers by one overlay and one group-by.

    ``layers`` is name -> (source, columns). Columns are ``<name>_<column>``,
    ``<name>_<column>_max`` and ``<name>_pieces``, all null where an area has no piece of the layer.
    """
    slim = {name: source.select(*id_cols, *cols, "geom") for name, (source, cols) in layers.items()}
    pieces = gridjoin.overlay_layers(slim, areas, key, id_cols, settings=settings)
    aggs = []
    for name, (_, cols) in layers.items():
        here = F.col("layer_name") == name
        weight = F.when(here, F.col("piece_area"))
        for c in (f"{name}_{c}" for c in cols):
            value = v.null_nan(F.col(c).cast("double"))
            aggs.append(weighted_mean(value, weight, null_policy).alias(c))
            aggs.append(F.max(value).alias(f"{c}_max"))
        many = F.count(F.when(here, 1))
        aggs.append(F.when(many > 0, many).alias(f"{name}_pieces"))
    return pieces.groupBy(key).agg(*aggs)


def rollup_weighted(
    pred: DataFrame, weights: DataFrame, key: str, parent: str, value: str, weight: str = "area"
) -> DataFrame:
    """Child values to their parent, weighted by child area. Children without parent are dropped."""
    joined = pred.select(key, value).join(weights.select(key, parent, weight), key, "left")
    known = joined.where(F.col(parent).isNotNull())
    return known.groupBy(parent).agg(
        F.try_divide(
            F.coalesce(F.sum(F.col(value) * F.col(weight)), F.lit(0.0)), F.sum(weight)
        ).alias(value)
    )


def shannon_diversity(df: DataFrame, key: str, species: str, out: str = "diversity") -> DataFrame:
    """-sum(p ln p) over the species of each key, null where none is named."""
    counts = df.groupBy(key, species).agg(F.count(species).alias("_c"))
    c = F.col("_c")
    n = F.sum(c)
    entropy = F.log(n) - F.sum(F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))) / n
    return counts.groupBy(key).agg(
        F.when(n > 0, F.greatest(entropy, F.lit(0.0))).alias(out)
    )


def share_matching(
    df: DataFrame, key: str, cond: Column, among: Column, out: str = "share"
) -> DataFrame:
    """Share of the rows ``among`` which ``cond`` holds; null where there are none."""
    hit = F.when(among, F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)))
    return df.groupBy(key).agg(F.avg(hit).alias(out))


def distinct_count(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    agg = F.approx_count_distinct(col) if approximate else F.count_distinct(F.col(col))
    return df.agg(agg.alias("distinct_values"))


def is_missing(df: DataFrame, col: str) -> Column:
    """Null, or NaN in a column of floating point numbers."""
    c = F.col(col)
    if df.schema[col].dataType.typeName() in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, columns without any left out, most first."""
    cols = list(cols or df.columns)
    counted = df.agg(*(F.count_if(is_missing(df, c)).alias(c) for c in cols))
    long = counted.unpivot([], cols, "column_name", "missing")
    return long.where(F.col("missing") > 0).orderBy(F.desc("missing"), "column_name")


def completeness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with all columns present, as count and share, and the share of missing cells."""
    present = None
    for c in cols:
        ok = ~is_missing(df, c)
        present = ok if present is None else present & ok
    cells = sum((is_missing(df, c).cast("int") for c in cols[1:]), is_missing(df, cols[0]).cast("int"))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(present).alias("complete_rows"),
        F.avg(present.cast("double")).alias("complete_share"),
        (F.sum(cells).cast("double") / (F.count(F.lit(1)) * len(cols))).alias("missing_share"),
    )


def describe_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    items = []
    for c in cols:
        x = v.null_nan(F.col(c).cast("double"))
        q = [F.lit(n).cast("double") for n in quartiles[c]]
        items.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                q[0].alias("q25"),
                q[1].alias("q50"),
                q[2].alias("q75"),
                F.max(x).alias("max"),
            )
        )
    return df.agg(F.array(*items).alias("rows")).select(F.inline("rows"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, over the rows where both are present.

    NaN counts as missing. A column that is constant over those rows, or has fewer than two
    of them, has no correlation: null, on the diagonal too.
    """
    clean = df.select(*[v.null_nan(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])

    def r(i: int, j: int) -> F.Column:
        x, y = F.col(f"c{i}"), F.col(f"c{j}")
        if i == j:
            return F.when(F.stddev_pop(x) > 0, F.lit(1.0))
        # covar_pop skips incomplete pairs, the deviations have to be told to
        spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        found = F.try_divide(F.covar_pop(x, y), spread)
        return F.when(found.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), found)))

    n = range(len(cols))
    once = clean.agg(*[r(i, j).alias(f"r{i}_{j}") for i in n for j in n if i <= j])
    rows = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{min(i, j)}_{max(i, j)}").alias("r"))
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]
    return once.select(F.inline(F.array(*rows)))


def target_correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """The target's column of the matrix, strongest positive first."""
    full = correlation_matrix(df, [*cols, target])
    wanted = (F.col("column_b") == target) & (F.col("column_a") != target)
    return full.where(wanted).select(F.col("column_a").alias("feature"), "r").orderBy(F.desc("r"), "feature")


def linear_trend(df: DataFrame, x: str, y: str, n: int = 50) -> DataFrame:
    """Least-squares line and ``n`` evenly spaced points on it."""
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.where(cx.isNotNull() & cy.isNotNull())
    line = both.agg(
        F.regr_slope(cy, cx).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"),
        F.min(cx).alias("_lo"),
        F.max(cx).alias("_hi"),
    )
    spot = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / F.lit(float(n - 1))
    return (
        line.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("x", spot)
        .select(
            F.col("point").cast("long").alias("point"),
            "slope",
            "intercept",
            "x",
            (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"),
        )
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins, the last one closed, with the median beside them."""
    x = v.null_nan(F.col(col).cast("double"))
    values = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    edges = values.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("e")).scalar()
    width = (F.col("_e.hi") - F.col("_e.lo")) / F.lit(float(bins))
    raw = F.floor((F.col("_x") - F.col("_e.lo")) / F.when(width > 0, width))
    bin_no = F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("long")
    counted = (
        values.withColumn("_e", edges)
        .groupBy(bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("_e").alias("_e"))
    )
    median = exact_quantiles(df, [col], [0.5])[col][0]
    return counted.select(
        "bin",
        (F.col("_e.lo") + width * F.col("bin")).alias("bin_start"),
        (F.col("_e.lo") + width * (F.col("bin") + 1)).alias("bin_end"),
        "n",
        F.lit(median).cast("double").alias("median"),
    )


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return grouped.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def layer_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum, middle, maximum and mean of each mapped column."""
    items = []
    for c in cols:
        x = v.null_nan(F.col(c).cast("double"))
        items.append(
            F.struct(
                F.lit(c).alias("layer"),
                F.min(x).alias("low"),
                ((F.min(x) + F.max(x)) / 2).alias("mid"),
                F.max(x).alias("high"),
                F.avg(x).alias("mean"),
            )
        )
    return df.agg(F.array(*items).alias("rows")).select(F.inline("rows"))


def total_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.agg(
        F.min(f"{geom}.xmin").alias("xmin"),
        F.min(f"{geom}.ymin").alias("ymin"),
        F.max(f"{geom}.xmax").alias("xmax"),
        F.max(f"{geom}.ymax").alias("ymax"),
    )


def dissolve(df: DataFrame, key: str, col: str, geom: str = "geom") -> DataFrame:
    """The outline of the shapes under each key, one row an edge, with the mean of a value.

    Columns: key, the mean, x0, y0, x1, y1 (the inside lies to the left) and ``times``.
    Edges that two shapes share run both ways and cancel, so no inner edge is left;
    an edge that shapes lying on each other have in common counts as often (``times``).
    Vertices must be equal to match. Edges are grouped over all tasks, so the grain is the
    same for a shed and for a state; ``sum(times * (x0 * y1 - x1 * y0)) / 2`` is the area.
    """
    known = df.where(F.col(key).isNotNull())
    value = known.groupBy(key).agg(F.avg(col).alias(col))
    shapes = known.where(g.is_kind(geom, g.POLYGON_KINDS))
    edge = shapes.select(key, F.explode(g.segments(geom)).alias("e")).select(key, "e.*").where("x0 <> x1 OR y0 <> y1")
    back = "(x0 > x1 OR (x0 = x1 AND y0 > y1))"
    ways = edge.selectExpr(
        f"`{key}`", f"if({back}, -1L, 1L) AS _way",
        *(f"if({back}, {c}{1 - i}, {c}{i}) AS _{c}{i}" for c in "xy" for i in (0, 1)),
    )
    net = ways.groupBy(key, "_x0", "_y0", "_x1", "_y1").agg(F.sum("_way").alias("_net")).where("_net <> 0")
    outline = net.selectExpr(
        f"`{key}`", *(f"if(_net > 0, _{c}{i}, _{c}{1 - i}) AS {c}{i}" for i in (0, 1) for c in "xy"), "abs(_net) AS times"
    )
    return outline.join(value, key).select(key, col, "x0", "y0", "x1", "y1", "times")


def with_faults(df: DataFrame, geom: str = "geom") -> DataFrame:
    """The rows with ``_open``, ``_short``, ``_crossed`` and ``_outside``: what is wrong with a shape.

    Crossings are those of any two sides, also of two rings; ``_outside`` tells a hole that
    leaves its shell. Other kinds than polygons have none of it.
    """
    no = F.lit(False)
    return df.withColumns(
        {
            "_open": F.coalesce(g.has_open_ring(geom), no),
            "_short": F.coalesce(g.has_short_ring(geom), no),
            "_crossed": F.coalesce(g.crosses_itself(geom), no),
            "_outside": F.coalesce(g.has_hole_outside(geom), no),
        }
    )


def geometry_report(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Shapes per kind, with counts of the faults a repair can and cannot mend."""
    marked = with_faults(df.where(F.col(geom).isNotNull()).select(F.col(f"{geom}.kind").alias("kind"), geom), geom)
    return marked.groupBy("kind").agg(
        F.count(F.lit(1)).alias("shapes"),
        F.expr("count_if(NOT (_open OR _short OR _crossed OR _outside)) AS valid"),
        F.count_if(F.col("_open")).alias("open_rings"),
        F.count_if(F.col("_short")).alias("short_rings"),
        F.count_if(F.col("_crossed")).alias("self_crossing"),
        F.count_if(F.col("_outside")).alias("holes_outside"),
    )


def repair(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Safe repairs, and a ``quarantined`` flag on shapes they cannot mend."""
    mended = with_faults(df.withColumn(geom, g.repair_rings(geom)), geom)
    bad = F.col("_short") | F.col("_crossed") | F.col("_outside")
    return mended.withColumn("quarantined", bad).drop("_open", "_short", "_crossed", "_outside")
