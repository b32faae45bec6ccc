"""Exact quantiles and global ranks without gathering a column in one task."""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arealis.session import scratch_path

# Short columns, by cells, are left to the built-in percentile.
_DIRECT_CELLS = 4_000_000
# Once a value range holds this few rows they are sorted as one list.
_DIRECT_ROWS = 200_000
# How far a proposed range reaches to either side of a rank, as a share of the rows,
# and the accuracy of the sketch that proposes it: finer than the reach, no finer than that needs.
_SLACK = 1 / 1024
_ACCURACY = 4_000


@dataclass(frozen=True)
class _Target:
    """A rank being closed in on: the range it lies in and what is known of that range."""

    col: str
    rank: int
    rows: int
    low: float
    high: float
    below: int = 0
    halve: bool = False

    def within(self) -> str:
        return f"`{self.col}` BETWEEN {_text(self.low)} AND {_text(self.high)}"

    def shares(self) -> list[float]:
        """Where a narrower range lies, as shares of the rows in this one."""
        share = (self.rank - self.below) / self.rows
        return [min(max(share + d, 0.0), 1.0) for d in (-_SLACK, _SLACK)]


def _text(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)".replace("inf", "Infinity")


def _middle(low: float, high: float) -> float:
    """The double halfway between two others in number order, so 64 steps reach any value."""

    def place(x: float) -> int:
        bits = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
        return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)

    at = (place(low) + place(high)) // 2
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(at)))[0], at)


def _closer(old: _Target, ends: Sequence[float], below: int, rows: int) -> _Target:
    """The target after a count of its proposed range.

    A sketch that misses the rank or gains nothing gives way to halving, which cannot
    fail: it leaves half as many possible values every time.
    """
    if below <= old.rank < below + rows:
        stuck = rows == old.rows
        return replace(old, low=ends[0], high=ends[1], below=below, rows=rows, halve=stuck)
    if old.halve:
        rest = old.rows - rows
        above = math.nextafter(ends[1], math.inf)
        return replace(old, low=above, below=below + rows, rows=rest)
    return replace(old, halve=True)


def _proposals(numbers: DataFrame, pending: Sequence[_Target]) -> list[Sequence[float]]:
    """Two ends of a narrower range for every target; those in the same range share a sketch."""
    sketched: dict[str, list[float]] = {}
    for t in pending:
        if not t.halve:
            sketched.setdefault(f"if({t.within()}, `{t.col}`, NULL)", []).extend(t.shares())
    asked = [f"percentile_approx({x}, array({', '.join(f'{p!r}D' for p in ps)}), {_ACCURACY})" for x, ps in sketched.items()]
    # The constant keeps this an aggregate when nothing is sketched.
    got = dict(zip(sketched, numbers.selectExpr("count(1)", *asked).first()[1:], strict=True)) if asked else {}
    ends = {x: iter(zip(v[::2], v[1::2], strict=True)) for x, v in got.items()}
    return [(t.low, _middle(t.low, t.high)) if t.halve else next(ends[f"if({t.within()}, `{t.col}`, NULL)"]) for t in pending]


def _at_ranks(
    numbers: DataFrame,
    wanted: Sequence[tuple[str, int]],
    known: dict[str, tuple[int, float, float]],
) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of several columns.

    Each round takes two passes for all ranks together: a sketch proposes a narrow
    range around each rank, then a count tells exactly how many values lie below and
    inside it. A range of one value is the answer however often it occurs; one of few
    rows is sorted; any other is narrowed again.
    """
    found: dict[tuple[str, int], float] = {}
    short: list[_Target] = []
    pending = [_Target(c, r, *known[c]) for c, r in wanted]
    while pending:
        ranges = _proposals(numbers, pending)
        tallies = numbers.selectExpr(
            *(
                f"struct(count_if(`{t.col}` < {_text(q[0])}),"
                f" count_if(`{t.col}` BETWEEN {_text(q[0])} AND {_text(q[1])}))"
                for t, q in zip(pending, ranges, strict=True)
            )
        ).first()
        moved = [_closer(t, q, *n) for t, q, n in zip(pending, ranges, tallies, strict=True)]
        pending = []
        for t in moved:
            if t.low == t.high:
                found[t.col, t.rank] = t.low
            elif t.rows <= _DIRECT_ROWS:
                short.append(t)
            else:
                pending.append(t)
    if short:
        items = ", ".join(
            f"named_struct('t', {i}, 'v', if({t.within()}, `{t.col}`, NULL))"
            for i, t in enumerate(short)
        )
        lists = (
            numbers.where(" OR ".join({t.within(): None for t in short}))
            .selectExpr(f"inline(array({items}))")
            .where("v IS NOT NULL")
            .groupBy("t")
            .agg(F.sort_array(F.collect_list("v")).alias("vs"))
        )
        spots = ", ".join(str(t.rank - t.below) for t in short)
        for row in lists.selectExpr("t", f"get(vs, array({spots})[t]) AS v").collect():
            found[short[row.t].col, short[row.t].rank] = row.v
    return found


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], shares: Sequence[float]
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column, nulls and NaN skipped.

    Short tables take one built-in ``percentile`` job. Longer ones are narrowed by
    counting, as ``percentile`` would hold every distinct value in one task.
    """
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols]
    numbers = df.select(*clean)
    facts = numbers.agg(*(F.struct(F.count(c), F.min(c), F.max(c)) for c in cols)).first()
    known = {c: tuple(f) for c, f in zip(cols, facts, strict=True)}
    counts = {c: k[0] for c, k in known.items()}
    if sum(counts.values()) <= _DIRECT_CELLS:
        spots = F.array(*(F.lit(float(s)) for s in shares))
        got = numbers.agg(*(F.percentile(c, spots).alias(c) for c in cols)).first()
        return {c: list(got[c]) if got[c] is not None else [None] * len(shares) for c in cols}
    spots = {(c, s): s * (counts[c] - 1) for c in cols for s in shares if counts[c]}
    wanted = {(c, r) for (c, _), x in spots.items() for r in (math.floor(x), math.ceil(x))}
    found = _at_ranks(numbers, sorted(wanted), known)

    def value(c: str, share: float) -> float | None:
        if not counts[c]:
            return None
        spot = spots[c, share]
        below, above = found[c, math.floor(spot)], found[c, math.ceil(spot)]
        # to the last bit what the built-in gives for short tables
        return below if below == above else (math.ceil(spot) - spot) * below + (spot - math.floor(spot)) * above

    return {c: [value(c, s) for s in shares] for c in cols}


def medians_without(df: DataFrame, cols: Sequence[str], part: str, parts: int) -> list[dict[str, float | None]]:
    """For each part, 0 to ``parts`` - 1, the exact medians of the rows outside it, nulls and NaN skipped.

    One sketch of all rows proposes a narrow range around each column's median, and one
    count by part tells which ranks of which parts lie at its ends or between; the rows between are
    sorted as one list a part. What the range misses, as parts differ, is closed in on by itself.
    """
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{j}") for j, c in enumerate(cols)]
    numbers = df.select(*clean, F.col(part).alias("part")).where("part IS NOT NULL")
    names = [f"c{j}" for j in range(len(cols))]
    if not names:
        return [{} for _ in range(parts)]
    facts = numbers.groupBy("part").agg(*(F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in names)).collect()
    other = {(i, c): [r[c] for r in facts if r["part"] != i and r[c]["n"]] for i in range(parts) for c in names}
    rows = {k: sum(x["n"] for x in own) for k, own in other.items()}
    found: dict[tuple[int, str, int], float] = {}
    ranks = {k: sorted({(n - 1) // 2, n // 2}) for k, n in rows.items() if n}
    if sum(rows.values()) <= _DIRECT_CELLS:
        aggs = {f"m{i}_{c}": F.percentile(F.when(F.col("part") != i, F.col(c)), 0.5) for i, c in ranks}
        got = numbers.agg(*(a.alias(n) for n, a in aggs.items())).first() if aggs else {}
        return [{col: got[f"m{i}_{c}"] if (i, c) in ranks else None for c, col in zip(names, cols, strict=True)} for i in range(parts)]
    ends = numbers.agg(*(F.percentile_approx(c, [0.5 - _SLACK, 0.5 + _SLACK], _ACCURACY).alias(c) for c in names)).first()
    ends = {c: tuple(ends[c]) for c in names if ends[c] is not None}
    tally = []
    for c, (low, high) in ends.items():
        x = F.col(c)
        upto = [x < low, x <= low, x < high, x <= high]
        tally.append(F.array(*map(F.count_if, upto)).alias(c))
    counts = numbers.groupBy("part").agg(*tally).collect()
    rest: list[tuple[int, str, int]] = []
    short: dict[tuple[int, str], list[_Target]] = {}
    for (i, c), own in ranks.items():
        low, high = ends[c]
        below, least, inner, most = (sum(r[c][at] for r in counts if r["part"] != i) for at in range(4))
        for rank in own:
            if below <= rank < least:
                found[i, c, rank] = low
            elif inner <= rank < most:
                found[i, c, rank] = high
            elif least <= rank < inner and inner - least <= _DIRECT_ROWS:
                ends_in = math.nextafter(low, math.inf), math.nextafter(high, -math.inf)
                short.setdefault((i, c), []).append(_Target(c, rank, inner - least, *ends_in, least))
            else:
                rest.append((i, c, rank))
    if short:
        items = ", ".join(f"named_struct('t', {j}, 'v', if(part <=> {i} OR NOT {ts[0].within()}, NULL, `{c}`))" for j, ((i, c), ts) in enumerate(short.items()))
        near = numbers.where(" OR ".join({ts[0].within(): None for ts in short.values()})).selectExpr(f"inline(array({items}))").where("v IS NOT NULL")
        lists = near.groupBy("t").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        spots = ", ".join(f"array({', '.join(str(t.rank - t.below) for t in ts)})" for ts in short.values())
        sought = list(short.items())
        for row in lists.selectExpr("t", f"transform(array({spots})[t], s -> get(vs, s)) AS v").collect():
            (i, c), ts = sought[row.t]
            found |= {(i, c, t.rank): v for t, v in zip(ts, row.v, strict=True)}
    for i in sorted({x[0] for x in rest}):
        own = [x[1:] for x in rest if x[0] == i]
        known = {c: (rows[i, c], min(x["low"] for x in other[i, c]), max(x["high"] for x in other[i, c])) for c, _ in own}
        found |= {(i, c, rank): v for (c, rank), v in _at_ranks(numbers.where(F.col("part") != i), own, known).items()}

    def value(i: int, c: str) -> float | None:
        if (i, c) not in ranks:
            return None
        below, above = (found[i, c, ranks[i, c][k]] for k in (0, -1))
        return below if below == above else 0.5 * below + 0.5 * above

    return [{col: value(i, c) for c, col in zip(names, cols, strict=True)} for i in range(parts)]


def running_totals(df: DataFrame, order: Sequence[Column], weights: Mapping[str, Column]) -> DataFrame:
    """Per output name, the sum of its weight over all rows sorted before each row.

    A window over the whole table would sort it in one task. Here rows are dealt by ranges
    of ``order`` and written once, sorted; windows run inside the ranges, and each range is
    shifted by the totals of those before it, two short rows a range on the driver. Use
    it on grouped tables: rows equal in ``order`` come in any order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    rows = df.withColumns({f"_w_{n}": w for n, w in weights.items()}).repartitionByRange(parts, *order)
    rows = rows.sortWithinPartitions(*order).withColumns(
        {"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    )
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    heads = rows.groupBy("_range").agg(*(F.sum(f"_w_{n}").alias(n) for n in weights)).orderBy("_range").collect()
    before, at = [], {n: 0 for n in weights}
    for h in heads:
        before.append((h["_range"], *at.values()))
        at = {n: at[n] + h[n] for n in weights}
    kinds = {n: rows.schema[f"_w_{n}"].dataType.simpleString() for n in weights}
    shifts = spark.createDataFrame(before, "_range int, " + ", ".join(f"_b_{n} {k}" for n, k in kinds.items()))
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = {n: F.col(f"_b_{n}") + F.coalesce(F.sum(f"_w_{n}").over(within), F.lit(0)) for n in weights}
    # one row a range, so the broadcast is as small as the list above
    return rows.join(F.broadcast(shifts), "_range").withColumns(sums).select(*df.columns, *weights)


def average_rank(df: DataFrame, col: str, out: str = "rank", cast: str | None = "int") -> DataFrame:
    """Descending rank with ties averaged, truncated to a whole number by default.

    Ranks are worked out once per distinct value, so ties never pile up in a task, and
    come back by one left join: a value with very many rows is hot on the left side only,
    which Spark's skew join splits. Null has no rank.
    """
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counted, [F.desc(col)], {"_ahead": F.col("_n")})
    rank: Column = F.col("_ahead") + (F.col("_n") + 1) / F.lit(2.0)
    if cast:
        rank = rank.cast(cast)
    return df.join(placed.select(col, rank.alias(out)), col, "left").select(*df.columns, out)
