"""Aggregations: strategy returns, summaries, compounding, weighted means, pivots, dominance votes, breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles


def strategy_returns(rows: DataFrame, at: str, ret: str, cost: float) -> DataFrame:
    """Per date: mean net and gross return, hit rate and number of the selected rows."""
    return rows.groupBy(at).agg(
        F.avg(F.col(ret) - cost).alias("net_return"), F.avg(ret).alias("gross_return"), F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.count(F.lit(1)).alias("selected")
    )


def fold_summary(rows: DataFrame, fold: str, at: str, ret: str) -> DataFrame:
    return rows.groupBy(fold).agg(F.count_distinct(at).alias("dates"), F.count(F.lit(1)).alias("selections"), F.avg(ret).alias("mean_return"))


def month_ends(df: DataFrame, entity: str, at: str, price: str, dollar_volume: Column) -> DataFrame:
    """entity, month, px (last), first and last day, median dollar volume; months whose last row is not the market's last session are left out."""
    month = F.trunc(at, "month")
    g = df.groupBy(entity, month.alias("month")).agg(F.max_by(price, at).alias("px"), F.min(at).alias("first_day"), F.max(at).alias("last_day"), F.median(dollar_volume).alias("dollar_volume"))
    last = df.groupBy(month.alias("month")).agg(F.max(at).alias("_last"))
    return g.join(F.broadcast(last), "month").where(F.col("last_day") == F.col("_last")).drop("_last")


def compound(df: DataFrame, by: list, ret: str) -> DataFrame:
    """Compounded return per group."""
    return df.groupBy(*by).agg((F.product(1 + F.col(ret)) - 1).alias(ret))


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return df.where(both).groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def breakpoints(df: DataFrame, period: str, value: str, subset: Column, q: float) -> DataFrame:
    """Percentile of a subset per month, as it applies in the next month."""
    return df.groupBy(period).agg(F.percentile(F.when(subset, F.col(value)), F.lit(q)).alias("breakpoint")).select(F.add_months(period, 1).alias(period), "breakpoint")


def wide(df: DataFrame, by: list[str], pivot: str, values: list, value: str) -> DataFrame:
    """Pivot over stated values, one pass."""
    return df.groupBy(*by).pivot(pivot, values).agg(F.first(value))


def coverage(df: DataFrame, by: list, at: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def dominant(df: DataFrame, by: list[str], kind: str, absorbed: dict[str, str] | None = None, times: int = 2, unknown: str = "UNKNOWN") -> DataFrame:
    """The kind of a group's rows if it is the only one or counts at least `times` all others together; `absorbed` kinds first join another that is present."""
    if absorbed:
        have = F.collect_set(kind).over(Window.partitionBy(*by))
        value = F.col(kind)
        for a, b in absorbed.items():
            value = F.when((F.col(kind) == a) & F.array_contains(have, b), b).otherwise(value)
        df = df.withColumn(kind, value)
    c = df.where(F.col(kind).isNotNull()).groupBy(*by, kind).agg(F.count(F.lit(1)).alias("_n"))
    g = c.groupBy(*by).agg(F.max(F.struct("_n", kind)).alias("_best"), F.sum("_n").alias("_all"))
    return g.select(*by, F.when(F.col("_best._n") >= times * (F.col("_all") - F.col("_best._n")), F.col(f"_best.{kind}")).otherwise(unknown).alias(kind))


def outcome_mix(df: DataFrame, by: list[str], outcome: str, kinds: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.when(F.col(outcome) == k, 1.0).otherwise(0.0)).alias(f"share_{k}") for k in kinds))


def breakdown(df: DataFrame, slices: dict[str, Column], year: Column, value: str) -> DataFrame:
    """One row per slice: all rows, each year, and each named mask; rows are given their labels."""
    labels = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("year "), year.cast("string")), *(F.when(m, F.lit(n)) for n, m in slices.items())))
    rows = df.select(F.explode(labels).alias("slice"), value)
    sums = rows.groupBy("slice").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.sum(value).alias("total"))
    # a slice may hold all rows, so its median isn't one task's
    middle = quantiles(rows, ["slice"], value, [0.5], "_q").select("slice", F.col("_q")[0].alias("median"))
    return sums.join(middle, "slice", "left").select("slice", "n", "mean", "median", "win_rate", "total")


def trade_stats(df: DataFrame, by: list[str], pnl: str, at: str) -> DataFrame:
    """Win rate, profit factor, mean, and the deepest fall of the running sum below its peak."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    run = df.withColumn("_sum", F.sum(pnl).over(w)).withColumn("_fall", F.greatest(F.max("_sum").over(w), F.lit(0.0)) - F.col("_sum"))
    loss = -F.sum(F.when(F.col(pnl) < 0, F.col(pnl)).otherwise(0.0))
    return run.groupBy(*by).agg(F.count(pnl).alias("n"), F.avg(F.when(F.col(pnl) > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.when(loss > 0, F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)) / loss).alias("profit_factor"), F.avg(pnl).alias("mean"), F.max("_fall").alias("max_drawdown"))


def registry_rollup(entries: DataFrame) -> DataFrame:
    """Per trial of (trial, seq, kind, variants): variants declared (each declaration counts one at least), last state, notes, and the running count of all variants."""
    g = entries.groupBy("trial").agg(
        F.sum(F.when(F.col("kind") == "declare", F.greatest(F.lit(1), F.coalesce("variants", F.lit(1)))).otherwise(0)).alias("variants"),
        F.max_by(F.when(F.col("kind") != "note", F.col("kind")), F.when(F.col("kind") != "note", F.col("seq"))).alias("state"), F.sum(F.when(F.col("kind") == "note", 1).otherwise(0)).alias("notes"), F.min("seq").alias("first_seq"),
    )
    return g.withColumn("variants_so_far", F.sum("variants").over(Window.orderBy("first_seq").rowsBetween(Window.unboundedPreceding, 0)))  # a registry is short


def growth_curves(df: DataFrame, entity: str, at: str, ret: str) -> DataFrame:
    """Running compounded growth."""
    w = Window.partitionBy(entity).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(entity, at, F.exp(F.sum(F.log1p(ret)).over(w)).alias("growth"))


def row_digests(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per group the number of rows and an order-free digest of them."""
    first = F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256), 1, 8), 16, 10).cast("long")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("lines"), F.bit_xor(first).alias("digest"))
