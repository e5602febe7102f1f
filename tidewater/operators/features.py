"""The point-in-time feature layer and the forward label layer over daily bars.

A feature on a row reads that row and earlier ones of its symbol, a label reads later ones only. All features share one
partitioning and order, so the whole layer is one shuffle and one sort; its moving averages and extremes are one grouped-map pass behind them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .rolling import rolled


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("dt")


def last_rows(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def over_positive(a: Column, b: Column) -> Column:
    """a / b where b > 0, else null."""
    return F.when(b > 0, a / b)


def price_features(bars: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Lag returns, moving averages, ranges, realised volatility, true range and momentum. Averages of closes allow short
    histories; volatility needs 20 returns, ATR 14 true ranges (a true range needs a previous close). The extremes of a year are on
    the adjusted basis, the prior extremes of 20 bars on that of the quotes, against which breaks are judged. Columns to `keep` stay beside them."""
    w = by_symbol()
    factor = F.when(F.col("close") != 0, F.col("adj_close") / F.col("close"))
    df = bars.withColumn("_prev", F.lag("adj_close").over(w)).withColumn("_pc", F.lag("close").over(w)).withColumn("bar_num", F.row_number().over(w))
    df = df.withColumn("ret_1d", over_positive(F.col("adj_close"), F.col("_prev")) - 1)
    df = df.withColumn("gap_pct", over_positive(F.col("open"), F.col("_pc")) - 1)
    df = df.withColumn("range_pct", over_positive(F.col("high") - F.col("low"), F.col("low")))
    df = df.withColumn("_tr", F.when(F.col("_pc").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc")))))
    df = df.withColumn("_ah", F.col("high") * factor).withColumn("_al", F.col("low") * factor)
    for n in (5, 21, 63, 126):
        df = df.withColumn(f"mom_{n}", over_positive(F.col("adj_close"), F.lag("adj_close", n).over(w)) - 1)
    df = df.withColumn("_volume", F.col("volume").cast("double")).withColumn("_square", F.col("ret_1d") * F.col("ret_1d")).drop("_prev", "_pc")
    df = rolled(df, {
        **{f"sma_{n}": ("avg", n, 1, 0, "adj_close") for n in (20, 50, 200)}, "avg_vol_20": ("avg", 20, 1, 0, "_volume"), "high_252": ("max", 252, 1, 0, "_ah"), "low_252": ("min", 252, 1, 0, "_al"),
        "prior_high_20": ("max", 20, 1, 1, "high"), "prior_low_20": ("min", 20, 1, 1, "low"), "_mean": ("avg", 20, 20, 0, "ret_1d"), "_mean_square": ("avg", 20, 20, 0, "_square"), "atr_14": ("avg", 14, 14, 0, "_tr"),
    })
    df = df.withColumn("_v", F.col("_mean_square") - F.col("_mean") * F.col("_mean"))
    df = df.withColumn("vol_20", F.when(F.col("_v") > 0, F.sqrt("_v") * F.sqrt(F.lit(252.0))))
    return df.select(
        "symbol", "dt", "bar_num", "open", "high", "low", "close", "adj_close", "volume", "ret_1d", "gap_pct", "range_pct", "sma_20", "sma_50", "sma_200",
        over_positive(F.col("volume"), F.col("avg_vol_20")).alias("rel_volume"),
        (over_positive(F.col("adj_close"), F.col("high_252")) - 1).alias("dist_high_252"), (over_positive(F.col("adj_close"), F.col("low_252")) - 1).alias("dist_low_252"),
        "prior_high_20", "prior_low_20", "vol_20", "atr_14", over_positive(F.col("atr_14"), F.col("close")).alias("atr_pct"),
        "mom_5", "mom_21", "mom_63", "mom_126",
        F.when(F.col("adj_close") > F.col("sma_200"), 1).otherwise(0).alias("above_sma_200"), F.when(F.col("sma_50") > F.col("sma_200"), 1).otherwise(0).alias("sma_50_over_200"),
        *((over_positive(F.col("adj_close"), F.col(f"sma_{n}")) - 1).alias(f"dist_sma_{n}") for n in (20, 50, 200)), *keep,
    )


def percent_ranks(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Cross-sectional percent rank of each column within `by`, nulls first."""
    for c in columns:
        df = df.withColumn(f"{c}_rank", F.percent_rank().over(Window.partitionBy(*by).orderBy(F.asc_nulls_first(c))))
    return df


def quantile_bucket(value: str, by: list[str], q: int, tie: list[str]) -> Column:
    """Bucket 0..q-1 of the first-come rank (ties by `tie`) with linearly spaced edges; null values get null."""
    known = F.col(value).isNotNull()
    w = Window.partitionBy(*by, known).orderBy(value, *tie)
    r, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(*by, known))
    return F.when(known, F.when(n == 1, 0).otherwise(F.greatest(F.lit(0), F.ceil((r - 1) * q / (n - 1)) - 1))).cast("int")


def forward_labels(bars: DataFrame, cost: float = 0.0014, keep: Iterable[str] = ()) -> DataFrame:
    """Returns after 1, 5 and 21 own sessions from the close and from the next open, net of `cost`; worst and best of the next 5 on
    the basis of the quotes, and (`_adj`) on the adjusted one, which a split or dividend inside the 5 sessions does not move. Columns to
    `keep` stay beside them: features of bars that keep their labels come without a join, over the same shuffle and sort."""
    w = by_symbol()
    adj_open = F.when(F.col("close") != 0, F.col("open") * F.col("adj_close") / F.col("close"))
    df = bars.withColumn("_o", F.lead(adj_open, 1).over(w))
    f = F.when(F.col("close") != 0, F.col("adj_close") / F.col("close"))
    next5 = w.rowsBetween(1, 5)
    df = df.withColumns({"_h": F.max("high").over(next5), "_l": F.min("low").over(next5), "_ha": F.max(F.col("high") * f).over(next5), "_la": F.min(F.col("low") * f).over(next5)})
    out = df
    for n in (1, 5, 21):
        ahead = F.lead("adj_close", n).over(w)
        out = out.withColumn(f"fwd_{n}", over_positive(ahead, F.col("adj_close")) - 1).withColumn(f"open_fwd_{n}", over_positive(ahead, F.col("_o")) - 1)
    return out.select(
        "symbol", "dt", "fwd_1", "fwd_5", "fwd_21", (F.col("fwd_5") - cost).alias("net_5"), F.when(F.col("fwd_5").isNotNull(), (F.col("fwd_5") - cost > 0).cast("int")).alias("win_5"),
        "open_fwd_1", "open_fwd_5", "open_fwd_21", (over_positive(F.col("_l"), F.col("adj_close")) - 1).alias("mae_5"), (over_positive(F.col("_h"), F.col("adj_close")) - 1).alias("mfe_5"),
        (over_positive(F.col("_la"), F.col("adj_close")) - 1).alias("mae_5_adj"), (over_positive(F.col("_ha"), F.col("adj_close")) - 1).alias("mfe_5_adj"), *keep,
    )


def abnormal_return(bars: DataFrame, benchmark: DataFrame, hold: int = 5) -> DataFrame:
    """symbol, dt, fwd, abnormal: from the next own session's open to the close `hold` own sessions on, and that less the benchmark's
    return from its next open to its close `hold` of its sessions on. `benchmark` has dt, open, close, adj_close: one row a day."""
    def forward(df: DataFrame, w: WindowSpec) -> Column:
        adj_open = over_positive(F.col("open") * F.col("adj_close"), F.col("close"))
        return over_positive(F.lead("adj_close", hold).over(w), F.lead(adj_open, 1).over(w)) - 1

    bench = benchmark.select("dt", forward(benchmark, Window.orderBy("dt")).alias("_b"))  # a date-level series
    return bars.withColumn("fwd", forward(bars, by_symbol())).join(bench, "dt", "left").select("symbol", "dt", "fwd", (F.col("fwd") - F.col("_b")).alias("abnormal"))


def calendar(bars: DataFrame) -> DataFrame:
    """dt, day_index (dense from 0), year, month, dow, of observed days. One row a day: small whatever the panel's width."""
    w = Window.orderBy("dt")
    return bars.select("dt").distinct().select("dt", (F.row_number().over(w) - 1).alias("day_index"), F.year("dt").alias("year"), F.month("dt").alias("month"), (F.dayofweek("dt") - 1).alias("dow"))


def usable_rows(panel: DataFrame) -> DataFrame:
    """Rows with enough history and every model input."""
    return panel.where("bar_num > 200 and vol_20 is not null and atr_14 is not null and mom_126 is not null and sma_200 is not null and ret_1d is not null")


def ranked_predictions(df: DataFrame, probability: str, by: list[str], tie: list[str], n: int) -> DataFrame:
    """position of each prediction in its group (a model and date) by falling probability, how many candidates the group has, and whether it is among the first n."""
    w = Window.partitionBy(*by)
    position = F.row_number().over(w.orderBy(F.desc_nulls_last(probability), *tie))
    return df.withColumn("position", position).withColumn("candidates", F.count(F.lit(1)).over(w)).withColumn("selected", F.col("position") <= n)
