"""Ranks, running sums and exact quantiles of groups too large for a task.

A group's distinct values are cut into pieces at approximate quantiles (a mergeable sketch, only to balance the pieces); pieces are counted,
each starts where the counts before it end, and inside a piece a window finishes the sums. Results are exact whatever the sketch says:
equal values are one row and lie in one piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

PIECES = 64


def _beside(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows of `a` with those of `b` whose `on` are the same, null being like null."""
    if not on:
        return a.crossJoin(F.broadcast(b))  # one row
    other = b.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in b.columns if c not in on))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return a.join(other, same, how).drop(*(f"_on_{c}" for c in on))


def running(per: DataFrame, by: list[str], value: str, sums: list[str], pieces: int = PIECES) -> DataFrame:
    """`per` (one row for each distinct value of a group, no nulls) with `<s>_before` for each of `sums`: its sum over the smaller values of the group."""
    edges = F.array(*(F.lit(i / pieces) for i in range(1, pieces)))
    cuts = per.groupBy(*by).agg(F.percentile_approx(value, edges, 1000).alias("_cuts"))
    placed = _beside(per, cuts, by).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    # at most `pieces` rows a group
    totals = placed.groupBy(*by, "_piece").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_piece", *(F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_from_{s}") for s in sums))
    inside = Window.partitionBy(*by, "_piece").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = _beside(placed.select("*", *(F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums)), starts, [*by, "_piece"])
    return out.select(*per.columns, *((F.col(f"_from_{s}") + F.col(f"_in_{s}")).alias(f"{s}_before") for s in sums))


def counted(df: DataFrame, by: list[str], value: str, pieces: int = PIECES) -> DataFrame:
    """by, value, n, n_before: each distinct value (nulls left out), how many rows have it and how many of the group a smaller one."""
    return running(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), by, value, ["n"], pieces)


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """`df` with the rank of its value in its group, ties at their mean; null values have none."""
    c = counted(df, by, value).select(*by, F.col(value).alias("_v"), (F.col("n_before") + (F.col("n") + 1) / 2).alias(out))
    same = reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"_on_{b}")) for b in by), F.col(value) == F.col("_v"))
    return df.join(c.withColumnsRenamed({b: f"_on_{b}" for b in by}), same, "left").drop("_v", *(f"_on_{b}" for b in by))


#: Of groups with this many rows or more only the rows near a wanted quantile are sorted out: `NEAR` of the group on each side of it, ten times the sketch's error.
LARGE, SKETCH, NEAR = 100_000, 10_000, 0.001


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], out: str = "q", pieces: int = PIECES) -> DataFrame:
    """One row a group: `out`, its exact quantiles, interpolated as `percentile` does. Groups without a value are absent.

    A sketch tells between which values each quantile of a large group lies; rows outside of these stretches are only counted, so what is shuffled
    and sorted is a small part of a large group. A sketch off by more than its bound stops the query, it can't change the result."""
    x = F.col(value)
    rows = df.where(x.isNotNull()).select(*by, value)
    marks = [m for p in probs for m in (max(p - NEAR, 0.0), min(p + NEAR, 1.0))]
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.percentile_approx(value, F.array(*map(F.lit, marks)), SKETCH).alias("_m"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    lows = [F.when(F.col("_all") < LARGE, F.col("_min")).when(F.lit(p - NEAR <= 0), F.col("_min")).otherwise(F.col("_m")[2 * i]) for i, p in enumerate(probs)]
    highs = [F.when(F.col("_all") < LARGE, F.col("_max")).when(F.lit(p + NEAR >= 1), F.col("_max")).otherwise(F.col("_m")[2 * i + 1]) for i, p in enumerate(probs)]
    # a row a group, read three times below: the rows behind it are read once
    bounds = written(sketch.select(*by, "_all", *(c.alias(f"_{k}{i}") for k, cs in (("low", lows), ("high", highs)) for i, c in enumerate(cs))), "bounds")
    told = _beside(rows, bounds, by)
    inside = reduce(Column.__or__, ((x >= F.col(f"_low{i}")) & (x <= F.col(f"_high{i}")) for i in range(len(probs))))
    # how many stretches lie wholly below a row: rows outside of all are counted by that number, with the smallest of them as their place
    place = F.struct(*(F.when(x < F.col(f"_low{i}"), 0).when(x > F.col(f"_high{i}"), 2).otherwise(1).alias(f"s{i}") for i in range(len(probs))))
    per = told.groupBy(*by, place.alias("_place"), F.when(inside, x).alias("_in")).agg(F.min(value).alias(value), F.count(F.lit(1)).alias("n")).drop("_place", "_in")
    c = running(per, by, value, ["n"], pieces)
    rows = _beside(c, bounds.select(*by, "_all"), by)
    held = lambda rank: (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
    at = [(F.col("_all") - 1) * p for p in probs]
    kept = _beside(rows, bounds.drop("_all"), by)
    sure = lambda i: F.when((x >= F.col(f"_low{i}")) & (x <= F.col(f"_high{i}")), x).otherwise(F.raise_error(F.lit("a quantile lies outside of its sketch's bounds")))
    found = kept.groupBy(*by).agg(F.max("_all").alias("_all"), *(F.max(F.when(held(f(h)), sure(i))).alias(f"_{k}{i}") for i, h in enumerate(at) for k, f in (("a", F.floor), ("b", F.ceil))))
    each = [F.when(F.floor(h) == F.ceil(h), F.col(f"_a{i}").cast("double")).otherwise((F.ceil(h) - h) * F.col(f"_a{i}") + (h - F.floor(h)) * F.col(f"_b{i}")) for i, h in enumerate(at)]
    return found.select(*by, F.array(*each).alias(out))


def numbered(df: DataFrame, by: list[str], ident: list[str], seed: int | Column, out: str) -> DataFrame:
    """`df` with each row's number (from 1) in its group, in the order of a hash of `ident`: the hash's leading bits are the pieces. Rows alike in `ident` are numbered in no fixed order."""
    d = df.withColumn("_h", F.xxhash64(*ident, F.lit(seed))).withColumn("_piece", F.shiftright("_h", 58))
    totals = d.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    inside = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy("_h", *ident))
    return _beside(d.withColumn("_i", inside), starts, [*by, "_piece"]).withColumn(out, F.col("_from") + F.col("_i")).drop("_h", "_piece", "_i", "_from")


def largest(df: DataFrame, by: list[str], value: str, k: int, pieces: int = PIECES) -> DataFrame:
    """The k rows of each group with the largest values, in no fixed choice among equal ones: of each piece first (rows are dealt by where they lie, so equal
    ones don't meet in one), then of those left (pieces x k rows a group)."""
    salted = df.withColumn("_piece", F.pmod(F.spark_partition_id(), F.lit(pieces)))
    first = salted.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(F.desc_nulls_last(value)))).where(F.col("_i") <= k)
    return first.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(value)))).where(F.col("_i") <= k).drop("_i", "_piece")
