"""Trading-cost estimators over bars and cost scenarios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip


def corwin_schultz(bars: DataFrame) -> DataFrame:
    """Spread from two days' highs and lows, today's range moved by an overnight gap; never below 0."""
    w = Window.partitionBy("symbol").orderBy("dt")
    p = bars.withColumn("h1", F.lag("high").over(w)).withColumn("l1", F.lag("low").over(w)).withColumn("c1", F.lag("close").over(w)).where("c1 is not null")
    shift = F.greatest(F.lit(0.0), F.col("c1") - F.col("high")) - F.greatest(F.lit(0.0), F.col("low") - F.col("c1"))
    g = p.withColumn("h", F.col("high") + shift).withColumn("l", F.col("low") + shift).where("l > 0 and l1 > 0 and h > 0")
    k = 3 - 2 * math.sqrt(2)
    beta = F.pow(F.log(F.col("h1") / F.col("l1")), F.lit(2)) + F.pow(F.log(F.col("h") / F.col("l")), F.lit(2))
    gamma = F.pow(F.log(F.greatest("h1", "h") / F.least("l1", "l")), F.lit(2))
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    return g.select("symbol", "dt", F.greatest(F.lit(0.0), 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))).alias("spread"))


def monthly_spread(spreads: DataFrame, low: float = 1.0, high: float = 1000.0) -> DataFrame:
    """Median per symbol and month in basis points, clipped."""
    return spreads.groupBy("symbol", F.trunc("dt", "month").alias("month")).agg(clip(F.median("spread") * 10_000, low, high).alias("spread_bp"))


def anchored_half_spread(monthly: DataFrame, large: DataFrame) -> DataFrame:
    """2 bp times a symbol's monthly spread over the large caps' monthly median, clipped to [1, 150] bp."""
    base = monthly.join(large, "symbol", "left_semi").groupBy("month").agg(F.median("spread_bp").alias("_base"))
    return monthly.join(F.broadcast(base), "month").select("symbol", "month", clip(2 * F.col("spread_bp") / F.col("_base"), 1.0, 150.0).alias("half_spread_bp"))


def liquidity_half_spread(adv: Column, price: Column) -> Column:
    """Half-spread in bp from dollar volume, with a floor of half a cent."""
    return clip(F.greatest(2 * F.sqrt(F.lit(212e6)) / F.sqrt(F.greatest(adv, F.lit(1e5))), F.lit(10_000 * 0.005) / F.greatest(price, F.lit(1.0))), 1.0, 150.0)


def edge_spread(bars: DataFrame, by: list[str], order: str) -> DataFrame:
    """Spread of each group from its open, high, low and close prices (the published EDGE estimator): two grouped passes over lagged log prices."""
    w = Window.partitionBy(*by).orderBy(order)
    o, h, l, c = (F.log(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    df = bars.select(*by, order, o.alias("o"), h.alias("h"), l.alias("l"), c.alias("c"), ((h + l) / 2).alias("m"))
    for x in "hlcm":
        df = df.withColumn(f"{x}1", F.lag(x).over(w))
    df = df.where("c1 is not null").withColumn("tau", ((F.col("h") != F.col("l")) | (F.col("l") != F.col("c1"))).cast("double"))
    df = df.withColumn("r1", F.col("m") - F.col("o")).withColumn("r2", F.col("o") - F.col("m1")).withColumn("r3", F.col("m") - F.col("c1")).withColumn("r4", F.col("c1") - F.col("m1")).withColumn("r5", F.col("o") - F.col("c1"))
    f = lambda x: F.col("tau") * x.cast("double")
    df = df.withColumn("po1", f(F.col("o") != F.col("h"))).withColumn("po2", f(F.col("o") != F.col("l"))).withColumn("pc1", f(F.col("c1") != F.col("h1"))).withColumn("pc2", f(F.col("c1") != F.col("l1")))
    means = df.groupBy(*by).agg(F.avg("tau").alias("pt"), (F.avg("po1") + F.avg("po2")).alias("po"), (F.avg("pc1") + F.avg("pc2")).alias("pc"), *(F.avg(x).alias(f"m{x}") for x in ("r1", "r3", "r5")), F.count(F.lit(1)).alias("n"))
    d = df.join(means, by).where("pt > 0 and po > 0 and pc > 0")
    d1, d3, d5 = (F.col(x) - F.col("tau") * F.col(f"m{x}") / F.col("pt") for x in ("r1", "r3", "r5"))
    x1 = -4 / F.col("po") * d1 * F.col("r2") - 4 / F.col("pc") * d3 * F.col("r4")
    x2 = -4 / F.col("po") * d1 * F.col("r5") - 4 / F.col("pc") * d5 * F.col("r4")
    g = d.groupBy(*by).agg(F.avg(x1).alias("e1"), F.avg(x2).alias("e2"), F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2"), F.first("n").alias("n"))
    total = F.col("v1") + F.col("v2")
    square = F.when(total > 0, (F.col("v2") * F.col("e1") + F.col("v1") * F.col("e2")) / total).otherwise((F.col("e1") + F.col("e2")) / 2)
    return g.select(*by, "n", F.sqrt(F.greatest(square, F.lit(0.0))).alias("spread"))


def cost_scenarios(trades: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each trade (spread, vol, participation) under each scenario (name, spread_mult, impact_mult, fee, borrow): cost and its parts. `scenarios` is a handful of rows."""
    s, i = F.col("spread") * F.col("spread_mult"), 2 * F.col("vol") * F.sqrt("participation") * F.col("impact_mult")
    return trades.crossJoin(F.broadcast(scenarios)).withColumn("spread_cost", s).withColumn("impact_cost", i).withColumn("total_cost", s + i + F.col("fee") + F.col("borrow"))


def drag_grid(spreads: DataFrame, holds: list[int]) -> DataFrame:
    """Yearly cost of paying `spread` every h sessions, for each h."""
    return spreads.withColumn("hold", F.explode(F.array(*map(F.lit, holds)))).withColumn("drag", F.col("spread") * 252 / F.col("hold"))
