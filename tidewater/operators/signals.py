"""Boolean signals over daily bars: a registry of name -> function of a frame of building blocks, giving a Column.

Recursive means (ema, Wilder's rsi) have no built-in window; one grouped-map pass per symbol adds them, and another
the moving averages and extremes. Everything else is window expressions over the same partitioning. A comparison with null is false.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .rolling import rolled


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("dt")


def recursive_means(bars: DataFrame) -> DataFrame:
    """ema_12, ema_26, ema_200, macd and its 9-ema, rsi_14 on the adjusted close: one linear pass per symbol in date order."""
    new = ["ema_12", "ema_26", "ema_200", "macd", "macd_signal", "rsi_14"]
    schema = StructType([*bars.schema.fields])
    for c in new:
        schema = schema.add(c, DoubleType())

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt")
        x = g["adj_close"]

        def ema(s: pd.Series, span: int) -> pd.Series:
            return s.ewm(span=span, adjust=False, min_periods=span).mean()

        move = x.diff()
        gain = move.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        loss = (-move).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        macd = ema(x, 12) - ema(x, 26)
        return g.assign(ema_12=ema(x, 12), ema_26=ema(x, 26), ema_200=ema(x, 200), macd=macd, macd_signal=ema(macd, 9), rsi_14=100 - 100 / (1 + gain / loss.where(loss != 0)))

    return bars.groupBy("symbol").applyInPandas(run, schema)


def blocks(bars: DataFrame, needed: set[str] | None = None, more: dict[str, tuple] | None = None) -> DataFrame:
    """Building blocks as columns. The true range of a first row is its high minus its low. `more`: further moving columns, as `rolled` takes them."""
    a, c, h, low, o, v = (F.col(x) for x in ("adj_close", "close", "high", "low", "open", "volume"))
    pc = F.lag("close").over(by_symbol())
    df = bars.withColumn("prev_close", pc).withColumn("prev_open", F.lag("open").over(by_symbol())).withColumn("prev_high", F.lag("high").over(by_symbol())).withColumn("prev_low", F.lag("low").over(by_symbol()))
    df = df.withColumn("adj_ret", F.try_divide(a, F.lag("adj_close").over(by_symbol())) - 1).withColumn("tr", F.greatest(h - low, F.abs(h - pc), F.abs(low - pc)))
    # each column that is asked for costs a moving window, so only what `needed` names is made
    wants = {
        **{f"sma{n}": ("avg", n, n, 0, "adj_close") for n in (20, 50, 100, 200)}, "sd20": ("sd", 20, 20, 0, "adj_close"), "atr14": ("avg", 14, 14, 0, "tr"), "vol20": ("avg", 20, 20, 0, "_volume"),
        **{f"top{n}": ("max", n, n, 1, "high") for n in (20, 55, 252)}, "low20": ("min", 20, 20, 0, "low"), "_high14": ("max", 14, 14, 0, "high"), "_low14": ("min", 14, 14, 0, "low"),
    }
    wants |= more or {}
    wants = {n: w for n, w in wants.items() if needed is None or n in needed}
    df = rolled(df.withColumn("_volume", v.cast("double")), wants) if wants else df.withColumn("_volume", v)
    df = df.withColumn("adj_low", low * F.when(c != 0, a / c))
    if needed is None or {"_high14", "_low14"} <= needed:
        spread = F.col("_high14") - F.col("_low14")
        df = df.withColumn("k14", F.when(spread != 0, 100 * (c - F.col("_low14")) / spread)).drop("_high14", "_low14")
    df = df.drop("_volume")
    rng = F.when(h - low != 0, h - low)
    return df.withColumn("body", F.abs(c - o)).withColumn("rng", rng).withColumn("upper", h - F.greatest(c, o)).withColumn("lower", F.least(c, o) - low)


def before(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_symbol())


def crosses_above(x: Column, y: Column) -> Column:
    return (x > y) & (before(x) <= before(y))


def crosses_below(x: Column, y: Column) -> Column:
    return (x < y) & (before(x) >= before(y))


_c = F.col


def _band(k: float) -> Column:
    return _c("sma20") + k * _c("sd20")


def _up(n: int = 0) -> Column:
    return (_c("close") > _c("open")) if not n else before(_c("close"), n) > before(_c("open"), n)


def _down(n: int = 0) -> Column:
    return (_c("close") < _c("open")) if not n else before(_c("close"), n) < before(_c("open"), n)


REGISTRY: dict[str, Callable[[], Column]] = {
    "golden_cross_50_200": lambda: crosses_above(_c("sma50"), _c("sma200")),
    "golden_cross_20_100": lambda: crosses_above(_c("sma20"), _c("sma100")),
    "death_cross_50_200": lambda: crosses_below(_c("sma50"), _c("sma200")),
    "above_sma_200": lambda: _c("adj_close") > _c("sma200"),
    "above_sma_50": lambda: _c("adj_close") > _c("sma50"),
    "cross_above_sma_50": lambda: crosses_above(_c("adj_close"), _c("sma50")),
    "cross_above_sma_20": lambda: crosses_above(_c("adj_close"), _c("sma20")),
    "ma_ribbon_aligned": lambda: (_c("sma20") > _c("sma50")) & (_c("sma50") > _c("sma200")),
    "ema_cross_12_26": lambda: crosses_above(_c("ema_12"), _c("ema_26")),
    "rsi_oversold_30": lambda: crosses_below(_c("rsi_14"), F.lit(30.0)),
    "rsi_oversold_20": lambda: crosses_below(_c("rsi_14"), F.lit(20.0)),
    "rsi_overbought_70": lambda: crosses_above(_c("rsi_14"), F.lit(70.0)),
    "rsi_cross_50": lambda: crosses_above(_c("rsi_14"), F.lit(50.0)),
    "macd_cross_up": lambda: crosses_above(_c("macd"), _c("macd_signal")),
    "macd_hist_positive": lambda: crosses_above(_c("macd") - _c("macd_signal"), F.lit(0.0)),
    "stochastic_oversold": lambda: crosses_below(_c("k14"), F.lit(20.0)),
    "bollinger_lower_touch": lambda: _c("adj_close") < _band(-2),
    "bollinger_upper_break": lambda: crosses_above(_c("adj_close"), _band(2)),
    "donchian_break_20": lambda: _c("close") > _c("top20"),
    "donchian_break_55": lambda: _c("close") > _c("top55"),
    "new_52w_high": lambda: _c("close") > _c("top252"),
    "resistance_break_volume": lambda: (_c("close") > _c("top20")) & (_c("volume") > 1.5 * _c("vol20")),
    "support_bounce": lambda: (_c("close") <= 1.02 * _c("low20")) & (_c("adj_close") > _c("sma200")),
    "pullback_to_sma50": lambda: (_c("adj_low") <= _c("sma50")) & (_c("sma50") < _c("adj_close")) & (_c("sma50") > _c("sma200")),
    "bullish_engulfing": lambda: _down(1) & _up() & (_c("close") >= _c("prev_open")) & (_c("open") <= _c("prev_close")),
    "bearish_engulfing": lambda: _up(1) & _down() & (_c("close") <= _c("prev_open")) & (_c("open") >= _c("prev_close")),
    "hammer": lambda: (_c("lower") > 2 * _c("body")) & (_c("upper") < _c("body")) & (_c("rng") > 0),
    "shooting_star": lambda: (_c("upper") > 2 * _c("body")) & (_c("lower") < _c("body")) & (_c("rng") > 0),
    "doji": lambda: _c("body") <= 0.1 * _c("rng"),
    "morning_star": lambda: _down(2) & (before(_c("body")) <= 0.3 * before(_c("rng"))) & _up() & (_c("close") > before(_c("close"), 2)),
    "three_white_soldiers": lambda: _up() & _up(1) & _up(2) & (_c("close") > before(_c("close"))) & (before(_c("close")) > before(_c("close"), 2)),
    "inside_bar": lambda: (_c("high") < _c("prev_high")) & (_c("low") > _c("prev_low")),
    "outside_bar_up": lambda: (_c("high") > _c("prev_high")) & (_c("low") < _c("prev_low")) & _up(),
    "gap_up_2pct": lambda: F.try_divide(_c("open"), _c("prev_close")) - 1 > 0.02,
    "gap_down_2pct": lambda: F.try_divide(_c("open"), _c("prev_close")) - 1 < -0.02,
    "volume_spike_up": lambda: (_c("volume") > 2 * _c("vol20")) & _up(),
    "volume_dryup": lambda: _c("volume") < 0.5 * _c("vol20"),
    "three_down_days": lambda: (_c("adj_close") < before(_c("adj_close"))) & (before(_c("adj_close")) < before(_c("adj_close"), 2)) & (before(_c("adj_close"), 2) < before(_c("adj_close"), 3)),
    "big_down_day": lambda: _c("adj_ret") < -0.03,
    "extreme_below_sma20": lambda: _c("adj_close") < _band(-2),
    "oversold_in_uptrend": lambda: (_c("rsi_14") < 35) & (_c("adj_close") > _c("sma200")),
}

RECURSIVE = {"ema_cross_12_26", "rsi_oversold_30", "rsi_oversold_20", "rsi_overbought_70", "rsi_cross_50", "macd_cross_up", "macd_hist_positive", "oversold_in_uptrend"}


def moving(names: list[str]) -> set[str]:
    """The moving columns of `blocks` that these signals read."""
    told = " ".join(str(REGISTRY[n]()) for n in names)
    return set(re.findall(r"\b(?:sma\d+|sd20|atr14|vol20|top\d+|low20)\b", told)) | ({"_high14", "_low14"} if "k14" in told else set())


def compute(bars: DataFrame, names: list[str] | None = None, custom: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """`bars` with one boolean column per signal; `custom` adds signals of the caller's own. The grouped-map pass runs only if a recursive one is asked."""
    registry = REGISTRY | (custom or {})
    names = names or list(registry)
    df = recursive_means(bars) if any(n in RECURSIVE or n in (custom or {}) for n in names) else bars
    df = blocks(df, None if custom else moving(names))
    return df.select(*bars.columns, *(F.coalesce(registry[n](), F.lit(False)).alias(n) for n in names))


def long_form(bars: DataFrame, names: list[str] | None = None, custom: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """symbol, dt, signal: one row for each signal that holds."""
    registry = REGISTRY | (custom or {})
    names = names or list(registry)
    wide = compute(bars, names, custom)
    hits = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))
    return wide.select("symbol", "dt", F.explode(hits).alias("signal"))


def squeeze(bars: DataFrame) -> DataFrame:
    """bollinger_squeeze: band width at or under the 10th percentile of its last 120 values."""
    df = blocks(bars, {"sd20", "sma20"}).withColumn("width", F.try_divide(4 * F.col("sd20"), F.col("sma20")))
    w = by_symbol().rowsBetween(-119, 0)
    cut = F.when(F.count("width").over(w) == 120, F.percentile("width", F.lit(0.1)).over(w))
    return df.select(*bars.columns, F.coalesce(F.col("width") <= cut, F.lit(False)).alias("bollinger_squeeze"))


def confluence(bars: DataFrame) -> DataFrame:
    """Four daily conditions and their six pairs."""
    df = blocks(recursive_means(bars), {"sma50", "_support"}, {"_support": ("min", 55, 55, 6, "low")})
    support = F.col("_support")
    conditions = {
        "uptrend": (F.col("ema_200") > before(F.col("ema_200"), 20)) & (F.col("sma50") > F.col("ema_200")),
        "ema_pullback": (F.col("low") <= 1.01 * F.col("ema_200")) & (F.col("ema_200") <= F.col("close")),
        "rsi_low": F.col("rsi_14") < 30,
        "near_support": support.isNotNull() & (F.abs(F.try_divide(F.col("close"), support) - 1) <= 0.03),
    }
    df = df.select(*bars.columns, *(F.coalesce(x, F.lit(False)).alias(n) for n, x in conditions.items()))
    names = list(conditions)
    return df.select("*", *((F.col(a) & F.col(b)).alias(f"{a}_and_{b}") for i, a in enumerate(names) for b in names[i + 1 :]))


# ---------------------------------------------------------------- rules inside one session of 7 bars


def in_session() -> WindowSpec:
    return Window.partitionBy("symbol", "session").orderBy("bar")


def whole_session() -> WindowSpec:
    return Window.partitionBy("symbol", "session")


def complete_sessions(bars: DataFrame, size: int = 7) -> DataFrame:
    return bars.withColumn("_n", F.count(F.lit(1)).over(whole_session())).where(F.col("_n") == size).drop("_n")


def intraday_rules(bars: DataFrame, closes: DataFrame | None = None) -> DataFrame:
    """symbol, session, rule, bar: the first bar of a session at which each rule holds.

    Rules read bars by their place in the session, up to the one they fire on, and the close of the symbol's session before (or `closes`:
    symbol, session, prev_close). Each rule needs a session long enough that bars follow; none but the last-hour rule looks at how many."""
    session = in_session()
    sofar = session.rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(sofar)
    df = bars.withColumn("place", F.row_number().over(session) - 1).withColumn("n", F.count(F.lit(1)).over(whole_session()))
    df = df.withColumn("vwap", F.when((F.col("volume") != 0) & (volume > 0), F.sum(typical * F.col("volume")).over(sofar) / volume)).withColumn("mean_range", F.avg(F.col("high") - F.col("low")).over(sofar))
    first = lambda c: F.first(c).over(sofar)
    df = df.withColumns({"o0": first("open"), "h0": first("high"), "l0": first("low"), "prior_volume": F.avg("volume").over(session.rowsBetween(Window.unboundedPreceding, -1))})
    if closes is None:
        closes = bars.groupBy("symbol", "session").agg(F.max_by("close", "bar").alias("_c"))
        closes = closes.select("symbol", "session", F.lag("_c").over(Window.partitionBy("symbol").orderBy("session")).alias("prev_close"))
    df = df.join(closes, ["symbol", "session"], "left")
    df = df.withColumn("below", F.coalesce(F.col("close") < F.col("vwap"), F.lit(False)))
    i, c, n = F.col("place"), F.col("close"), F.col("n")
    inner = (i >= 1) & (i <= n - 2)
    gap = F.when(F.col("prev_close") > 0, F.col("o0") / F.col("prev_close") - 1)
    rules = {
        "opening_range_break_up": (n >= 3) & (i == 1) & (c > F.col("h0")),
        "opening_range_break_down": (n >= 3) & (i == 1) & (c < F.col("l0")),
        "first_hour_high_break": (n >= 4) & (i >= 2) & (c > F.col("h0")),
        "vwap_reversion_long": (n >= 4) & inner & (F.col("mean_range") > 0) & (c < F.col("vwap") - 0.5 * F.col("mean_range")),
        "vwap_reclaim": (n >= 4) & inner & F.lag("below").over(session) & ~F.col("below"),
        "gap_up_fade": (n >= 3) & (i == 0) & (gap > 0.01),
        "gap_down_fill": (n >= 3) & (i == 0) & (gap < -0.01),
        "midday_reversal": (n >= 5) & (i == 2) & (c < F.col("o0")),
        "afternoon_momentum": (n >= 5) & (i == 2) & (c > F.col("o0")),
        "power_hour_long": (n >= 6) & (i == n - 2) & (c > F.col("o0")),
        "inside_session_squeeze": (n >= 5) & (i == 2) & (F.col("h0") > F.col("l0")) & (F.col("high") - F.col("low") < 0.5 * (F.col("h0") - F.col("l0"))),
        "volume_climax_long": (n >= 4) & inner & (F.col("prior_volume") > 0) & (F.col("volume") > 2 * F.col("prior_volume")) & (c < F.col("open")),
    }
    wide = df.select("symbol", "session", "bar", *(x.alias(r) for r, x in rules.items()))
    hits = wide.groupBy("symbol", "session").agg(*(F.min(F.when(F.col(r), F.col("bar"))).alias(r) for r in rules))
    pairs = F.array_compact(F.array(*(F.when(F.col(r).isNotNull(), F.struct(F.lit(r).alias("rule"), F.col(r).alias("bar"))) for r in rules)))
    return hits.select("symbol", "session", F.explode(pairs).alias("x")).select("symbol", "session", "x.rule", "x.bar")
