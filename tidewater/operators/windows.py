"""Generic panel windows: running extremes, fills, streaks, trailing event sums, betas, ranks, turnover, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_quantile
from .ordered import quantiles
from .rolling import rolled


def running_drawdown(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """peak so far, and how far below it each row is."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", F.when(F.col("peak") != 0, (F.col("peak") - F.col(value)) / F.col("peak")))


def turn_of_month(df: DataFrame, by: list[str], date: str = "dt", last: int = 1, first: int = 3) -> DataFrame:
    """Flags the `first` first and `last` last rows of each month."""
    month = [*by, F.year(date), F.month(date)]
    return df.withColumn("from_start", F.row_number().over(Window.partitionBy(*month).orderBy(date))).withColumn(
        "from_end", F.row_number().over(Window.partitionBy(*month).orderBy(F.desc(date)))
    ).withColumn("turn_of_month", (F.col("from_start") <= first) | (F.col("from_end") <= last))


def forward_fill(value: str, by: list[str], order: list[str], limit: int | None = None) -> Column:
    """Last value that is not null, from at most `limit` rows before."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(start, 0))


def prior_stats(value: str, by: list[str], order: list[str], least: int = 4) -> tuple[Column, Column]:
    """Mean and sample deviation of all earlier values; null under `least` of them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    enough = F.count(value).over(w) >= least
    return F.when(enough, F.avg(value).over(w)), F.when(enough, F.stddev_samp(value).over(w))


def streak(df: DataFrame, hit: Column, by: list[str], order: list[str], most: int = 8) -> DataFrame:
    """`streak`: hits in a row up to here, at most `most`."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("streak", F.least(F.sum(F.col("_hit").cast("int")).over(inside), F.lit(most))).drop("_hit", "_island")


def trailing_event_sums(keys: DataFrame, events: DataFrame, by: list[str], at: str, sums: list[str], back: int) -> DataFrame:
    """`keys` rows with the sums of the events of the same `by` whose `at` lies in [key - back, key] (0 without any).

    Keys and events are unioned and summed over a range frame: linear, where an inequality join would be quadratic."""
    tagged = keys.withColumn("_key", F.lit(1)).unionByName(events.withColumn("_key", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-back, 0)
    for c in sums:
        tagged = tagged.withColumn(f"{c}_sum", F.coalesce(F.sum(F.when(F.col("_key") == 0, F.col(c))).over(w), F.lit(0)))
    return tagged.where("_key = 1").drop("_key", *sums)


def shifted(value: Column, function, by: list[str], order: list[str], n: int, least: int) -> Column:
    """A rolling aggregate of the n rows before, null under `least` values."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-n, -1)
    return F.when(F.count(value).over(w) >= least, function(value).over(w))


def rolling_beta(df: DataFrame, y: str, x: str, by: str = "symbol", order: str = "dt", n: int = 252, least: int = 120) -> DataFrame:
    """`df` with `beta` of y on x over the n rows before, among those that have both; null under `least` of them or where x does not move."""
    return rolled(df, {"beta": ("beta", n, least, 1, y, x)}, by, order)


def group_zscore(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    deviation = F.stddev_samp(value).over(w)
    return F.when(deviation > 0, (F.col(value) - F.avg(value).over(w)) / deviation)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean; null values have none."""
    known = F.col(value).isNotNull()
    w = Window.partitionBy(*by, known)
    return F.when(known, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, known, value)) - 1) / 2)


def kth(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k-th row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") == k).drop("_n")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).withColumnRenamed("_n", "position")


def previous_period_universe(df: DataFrame, entity: str, period: str, size: Column, n: int) -> DataFrame:
    """(entity, period) membership: the n largest by median `size` in a period are members in the next period that has rows."""
    medians = df.groupBy(entity, period).agg(F.median(size).alias("_m"))
    ranked = medians.withColumn("_r", F.row_number().over(Window.partitionBy(period).orderBy(F.desc("_m"), entity))).where(F.col("_r") <= n)
    following = df.select(period).distinct().withColumn("_next", F.lead(period).over(Window.orderBy(period)))  # one row a period
    return ranked.join(F.broadcast(following), period).where("_next is not null").select(entity, F.col("_next").alias(period))


def winsorize(df: DataFrame, value: str, by: list[str], low: float = 0.005, high: float = 0.995, large: bool | None = None) -> DataFrame:
    """Clip to exact quantiles of the group. `large` groups (the default without any grouping) are counted in pieces; of others a task holds the distinct values."""
    if large if large is not None else not by:
        cut = quantiles(df, by, value, [low, high], "_q")
    else:
        cut = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    met = df.join(cut, by) if by else df.crossJoin(F.broadcast(cut))
    return met.withColumn(value, F.greatest(F.least(F.col(value), F.col("_q")[1]), F.col("_q")[0])).drop("_q")


def turnover(weights: DataFrame, period: str, entity: str, weight: str) -> DataFrame:
    """Sum of |w(t) - w(t-1)| over the names of either period; the first period counts in full. One row a period."""
    # each weight takes part in its own period and, as the one before, in the next: one shuffle on (period, entity)
    order = weights.select(period).distinct().withColumn("_next", F.lead(period).over(Window.orderBy(period)))
    now = weights.select(period, entity, F.col(weight).alias("_w"))
    before = weights.join(F.broadcast(order), period).where("_next is not null").select(F.col("_next").alias(period), entity, (-F.col(weight)).alias("_w"))
    return now.unionByName(before).groupBy(period, entity).agg(F.sum("_w").alias("_d")).groupBy(period).agg(F.sum(F.abs("_d")).alias("turnover"))


def drift_turnover(weights: DataFrame, period: str, entity: str, weight: str, ret: str) -> DataFrame:
    """As `turnover`, against the weights that the period before has drifted to by its returns (w (1 + r), scaled to sum to 1 again)."""
    order = weights.select(period).distinct().withColumn("_next", F.lead(period).over(Window.orderBy(period)))
    grown = weights.withColumn("_g", F.col(weight) * (1 + F.coalesce(F.col(ret), F.lit(0.0))))
    total = grown.groupBy(period).agg(F.sum("_g").alias("_all"))
    drifted = grown.join(total, period).join(order, period).where("_next is not null").select(F.col("_next").alias(period), entity, (-F.try_divide("_g", "_all")).alias("_w"))
    both = weights.select(period, entity, F.col(weight).alias("_w")).unionByName(drifted)
    return both.groupBy(period, entity).agg(F.sum("_w").alias("_d")).groupBy(period).agg(F.sum(F.abs("_d")).alias("turnover"))


def set_turnover(members: DataFrame, period: str, entity: str) -> DataFrame:
    """Names that came or went since the period before, over the names there are; periods without one before them are left out."""
    order = members.select(period).distinct().withColumn("_next", F.lead(period).over(Window.orderBy(period)))
    now = members.select(period, entity, F.lit(1).alias("_now"), F.lit(0).alias("_was")).distinct()
    was = members.join(order, period).where("_next is not null").select(F.col("_next").alias(period), entity, F.lit(0).alias("_now"), F.lit(1).alias("_was")).distinct()
    each = now.unionByName(was).groupBy(period, entity).agg(F.max("_now").alias("_now"), F.max("_was").alias("_was"))
    g = each.groupBy(period).agg(F.sum(F.abs(F.col("_now") - F.col("_was"))).alias("_changed"), F.sum("_now").alias("_n"), F.sum("_was").alias("_b"))
    return g.where("_b > 0").select(period, (F.col("_changed") / F.col("_n")).alias("turnover"))


def normal_targets(df: DataFrame, value: str, period: str) -> DataFrame:
    """`target`: the standard normal quantile of the average-tie rank over n + 1 within the period, and `weight`: 1 / n; null values have neither."""
    part = Window.partitionBy(period)
    n = F.count(value).over(part)
    return df.withColumn("_r", average_rank(value, [period])).withColumn("target", normal_quantile(F.col("_r") / (n + 1))).withColumn("weight", F.when(F.col(value).isNotNull(), 1 / n)).drop("_r")


def fixed_bands(value: Column, edges: list[float]) -> Column:
    """Band number of right-closed bands (edges[i], edges[i + 1]]; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((value > edges[i]) & (value <= edges[i + 1]), i).otherwise(out)
    return out


def onsets(df: DataFrame, state: str, by: list[str], order: list[str]) -> DataFrame:
    """`onset`: the state holds here and did not on the row before."""
    was = F.coalesce(F.lag(state).over(Window.partitionBy(*by).orderBy(*order)), F.lit(False))
    return df.withColumn("onset", F.coalesce(F.col(state), F.lit(False)) & ~was)


def latest_version(df: DataFrame, keys: list[str], known_at: str, as_of: Column) -> DataFrame:
    """Per key the row last known at or before `as_of`; of rows known at one moment always the same one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(known_at), F.xxhash64(*df.columns))
    return df.where(F.col(known_at) <= as_of).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def compound_returns(df: DataFrame, ret: str, by: list[str], order: list[str], months: str, n: int = 12) -> DataFrame:
    """cum_1..cum_n: compounded returns of the k rows before, null unless the n rows before are n consecutive months."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = F.col(months) - F.lag(months, n).over(w) == n
    product, out = F.lit(1.0), df
    for k in range(1, n + 1):
        product = product * (1 + F.lag(ret, k).over(w))
        out = out.withColumn(f"cum_{k}", F.when(whole, product - 1))
    return out


def state_position(df: DataFrame, state: Column, inside: str, outside: str, by: list[str], order: list[str], switch_cost: float = 0.0) -> DataFrame:
    """Rows with `held` (the state of the row before), and `ret`: column `inside` while held, else `outside`, less `switch_cost` on rows that
    change sides. Rows without a state before them or without either return go; the first row left counts as a change."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("held", F.lag(state).over(w)).where(F.col("held").isNotNull() & F.col(inside).isNotNull() & F.col(outside).isNotNull())
    switch = ~F.lag("held").over(w).eqNullSafe(F.col("held"))
    return rows.withColumn("switch", switch).withColumn("ret", F.when(F.col("held"), F.col(inside)).otherwise(F.col(outside)) - F.when(F.col("switch"), switch_cost).otherwise(0.0))


def percentile_bands(df: DataFrame, value: str, q: int, by: list[str]) -> DataFrame:
    """`band` 0..q-1 of a value between its own percentiles (interpolated; an edge belongs to the band under it), null values null. The
    edges are those of the distinct rows of `by` and the value, so that a busy period weighs once."""
    known = df.where(F.col(value).isNotNull())
    base = known.select(*by, value).distinct() if by else known.select(value)
    edges = quantiles(base, [], value, [i / q for i in range(1, q)], "_edges")
    return df.crossJoin(F.broadcast(edges)).withColumn("band", F.when(F.col(value).isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col(value))))).drop("_edges")
