"""First-touch outcomes, holding returns, fills, and event and portfolio returns."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .joins import session_of
from .rolling import Met, met


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("dt")


def first_touch(bars: DataFrame, stop_atr: float = 2.0, target_atr: float = 3.0, horizon: int = 60, signals: DataFrame | None = None) -> DataFrame:
    """Per row (rows with a signal only, if `signals` gives symbol and dt): entry at the next open, stop and target in ATRs,
    first touched of the next `horizon` bars. A bar that touches both counts as stopped; a gap fills at the open; else the
    close of the last bar. symbol, dt, entry, outcome (stop, target, timeout, open if the data end first), days, gross.

    The outcome depends on the row alone, so it is found once per row, over a bounded number of bars."""
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close").over(by_symbol())), F.abs(F.col("low") - F.lag("close").over(by_symbol())))
    f = F.when(F.col("close") != 0, F.col("adj_close") / F.col("close"))
    df = bars.select("symbol", "dt", "adj_close", *((F.col(x) * f).alias(x[0]) for x in ("open", "high", "low")), (tr * f).alias("_tr"))
    atr = by_symbol().rowsBetween(-13, 0)
    df = df.withColumn("atr", F.when(F.count("_tr").over(atr) == 14, F.avg("_tr").over(atr)))
    if signals is not None:
        asks = signals.select("symbol", "dt").where("dt is not null").distinct()
        facts = df.select("symbol", "dt", *(F.col(c).cast("double").alias(c) for c in ("o", "h", "l", "adj_close", "atr")))
        schema = StructType([*asks.schema.fields]).add("entry", "double").add("outcome", "string").add("days", "integer").add("gross", "double")
        return met(asks, facts, functools.partial(_touches, stop_atr, target_atr, horizon), schema)
    df = df.withColumn("path", F.collect_list(F.struct("o", "h", "l", F.col("adj_close").alias("c"))).over(by_symbol().rowsBetween(1, horizon)))
    df = df.where("atr is not null and size(path) > 0").withColumn("entry", F.col("path")[0]["o"])
    df = df.withColumn("stop", F.col("entry") - stop_atr * F.col("atr")).withColumn("target", F.col("entry") + target_atr * F.col("atr"))
    touched = F.transform("path", lambda b: (b["l"] <= F.col("stop")) | (b["h"] >= F.col("target")))
    df = df.withColumn("days", F.array_position(touched, True)).withColumn("bar", F.when(F.col("days") > 0, F.try_element_at("path", F.col("days").cast("int"))))
    stopped = F.col("bar.l") <= F.col("stop")
    last = F.element_at("path", -1)["c"]
    outcome = F.when(F.col("days") > 0, F.when(stopped, "stop").otherwise("target")).when(F.size("path") == horizon, "timeout").otherwise("open")
    exit_ = F.when(F.col("days") > 0, F.when(stopped, F.least("stop", "bar.o")).otherwise(F.greatest("target", "bar.o"))).otherwise(last)
    return df.select("symbol", "dt", "entry", outcome.alias("outcome"), F.when(F.col("days") > 0, F.col("days")).otherwise(F.size("path")).cast("int").alias("days"), (exit_ / F.col("entry") - 1).alias("gross"))


def _touches(stop_atr: float, target_atr: float, horizon: int, m: Met) -> pa.RecordBatch:
    """`first_touch` of a batch of rows with a signal, looking at the k-th bar behind all of them at once. Nulls are NaN here, and touch nothing."""
    day = m.ask("dt", 0)
    at = m.find("dt", day)
    o, h, low, c, atr, dt = (np.append(m.fact(x, none), none) for x, none in (("o", np.nan), ("h", np.nan), ("l", np.nan), ("adj_close", np.nan), ("atr", np.nan), ("dt", 0)))
    fits = (at < m.high) & (dt[at] == day) & (at + 1 < m.high)
    fits &= ~np.isnan(atr[np.where(fits, at, -1)])
    at, end = at[fits], m.high[fits]
    size = np.minimum(end - at - 1, horizon)
    entry = o[at + 1]
    stop, target = entry - stop_atr * atr[at], entry + target_atr * atr[at]
    days = np.zeros(len(at), np.int64)
    for k in range(1, horizon + 1):
        bar = np.where((days == 0) & (k <= size), at + k, -1)
        with np.errstate(invalid="ignore"):
            days = np.where((bar >= 0) & ((low[bar] <= stop) | (h[bar] >= target)), k, days)
    touched = days > 0
    bar = np.where(touched, at + days, -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        stopped = low[bar] <= stop
        exit_ = np.where(touched, np.where(stopped, np.fmin(stop, o[bar]), np.fmax(target, o[bar])), c[at + size])
        gross = exit_ / entry - 1
    outcome = np.where(touched, np.where(stopped, "stop", "target"), np.where(size == horizon, "timeout", "open"))
    rows = m.asks.filter(pa.array(fits))
    plain = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
    out = [plain(entry), pa.array(outcome.tolist(), pa.string()), pa.array(np.where(touched, days, size).astype(np.int32), pa.int32()), plain(gross)]
    return pa.RecordBatch.from_arrays([rows.column("symbol"), rows.column("dt"), *out], names=["symbol", "dt", "entry", "outcome", "days", "gross"])


def touch_grid(trades: DataFrame, stops: list[float], targets: list[float]) -> DataFrame:
    """Outcome of each trade (keys, entry, unit, path of o/h/l/c) for each pair of multiples: grid of returns, ties to the stop."""
    grid = F.explode(F.array(*(F.struct(F.lit(s).alias("stop_m"), F.lit(t).alias("target_m")) for s in stops for t in targets)))
    df = trades.withColumn("_g", grid).select("*", "_g.*").drop("_g")
    stop, target = F.col("entry") * (1 - F.col("stop_m") * F.col("unit")), F.col("entry") * (1 + F.col("target_m") * F.col("unit"))
    df = df.withColumn("_s", stop).withColumn("_t", target)
    hit = F.array_position(F.transform("path", lambda b: (b["low"] <= F.col("_s")) | (b["high"] >= F.col("_t"))), True)
    df = df.withColumn("_k", hit).withColumn("_b", F.when(F.col("_k") > 0, F.try_element_at("path", F.col("_k").cast("int"))))
    price = F.when(F.col("_k") > 0, F.when(F.col("_b.low") <= F.col("_s"), F.least("_s", "_b.open")).otherwise(F.greatest("_t", "_b.open"))).otherwise(F.element_at("path", -1)["close"])
    return df.withColumn("ret", price / F.col("entry") - 1).drop("_s", "_t", "_k", "_b")


def structural_exit(path: Column, entry: Column, unit: Column, target: Column | None = None, moves: str = "") -> Column:
    """(exit, kind) of a trade whose stop lies `unit` (a share of the entry) under the entry: kind is stop, target or close. A bar that
    reaches both is stopped; gaps fill at the open. After a bar the stop moves to the entry once the best high is `unit` above it
    (`moves` = "breakeven"), or to `unit` of the entry under the best high ("trailing")."""
    none = F.lit(None).cast("double")
    goal = none if target is None else target
    start = F.struct((entry * (1 - unit)).alias("stop"), entry.cast("double").alias("best"), none.alias("exit"), F.lit(None).cast("string").alias("kind"), none.alias("last"))

    def step(s: Column, b: Column) -> Column:
        stopped, reached = b["low"] <= s["stop"], F.coalesce(b["high"] >= goal, F.lit(False))
        price = F.when(stopped, F.least(s["stop"], b["open"])).when(reached, F.greatest(goal, b["open"]))
        kind = F.when(stopped, "stop").when(reached, "target")
        best = F.greatest(s["best"], b["high"])
        stop = s["stop"]
        if moves == "breakeven":
            stop = F.when(best >= entry * (1 + unit), F.greatest(stop, entry)).otherwise(stop)
        elif moves == "trailing":
            stop = F.greatest(stop, best - entry * unit)
        done = s["exit"].isNotNull()
        return F.struct(stop.cast("double").alias("stop"), best.cast("double").alias("best"), F.when(done, s["exit"]).otherwise(price).cast("double").alias("exit"), F.when(done, s["kind"]).otherwise(kind).alias("kind"), b["close"].cast("double").alias("last"))

    return F.aggregate(path, start, step, lambda s: F.struct(F.coalesce(s["exit"], s["last"]).alias("exit"), F.coalesce(s["kind"], F.lit("close")).alias("kind")))


def structural_exits(bars: DataFrame, units: DataFrame) -> DataFrame:
    """symbol, session, bar, style, gross, kind: a signal on each bar of a session, filled at the next bar's open and left by four styles:
    at the nearer resistance above the entry (the session's high so far, the high of the session before), at the session's average price
    by volume, with a stop that moves to the entry, with a trailing stop. `units`: symbol, session, unit (the stop's distance).
    A session's last bar has no fill and no row."""
    s = Window.partitionBy("symbol", "session").orderBy("bar")
    sofar = s.rowsBetween(Window.unboundedPreceding, 0)
    highs = bars.groupBy("symbol", "session").agg(F.max("high").alias("_h"))
    highs = highs.select("symbol", "session", F.lag("_h").over(Window.partitionBy("symbol").orderBy("session")).alias("prev_high"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumns({
        "path": F.collect_list(F.struct("open", "high", "low", "close")).over(s.rowsBetween(1, Window.unboundedFollowing)), "run_high": F.max("high").over(sofar),
        "vwap": F.try_divide(F.sum(typical * F.col("volume")).over(sofar), F.sum("volume").over(sofar)),
    }).where("size(path) > 0").join(highs, ["symbol", "session"]).join(units, ["symbol", "session"]).withColumn("entry", F.col("path")[0]["open"])
    above = lambda c: F.when(F.col(c) > F.col("entry"), F.col(c))
    levels = {"resistance": (F.least(above("run_high"), above("prev_high")), ""), "vwap": (above("vwap"), ""), "breakeven": (None, "breakeven"), "trailing": (None, "trailing")}
    exits = F.array(*(F.struct(F.lit(name).alias("style"), structural_exit(F.col("path"), F.col("entry"), F.col("unit"), goal, moves).alias("x")) for name, (goal, moves) in levels.items()))
    out = df.where("unit is not null").select("symbol", "session", "bar", "entry", F.explode(exits).alias("e"))
    return out.select("symbol", "session", "bar", "e.style", (F.try_divide("e.x.exit", "entry") - 1).alias("gross"), "e.x.kind")


def trailing_exit(path: Column, entry: Column, width: Column) -> Column:
    """Exit price with a stop `width` under the best high so far, raised after each bar; the last close if never touched."""
    start = F.struct((entry - width).alias("stop"), F.lit(None).cast("double").alias("exit"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, b: Column) -> Column:
        out = F.when(s["exit"].isNotNull(), s["exit"]).when(b["low"] <= s["stop"], F.least(s["stop"], b["open"]))
        return F.struct(F.greatest(s["stop"], b["high"] - width).alias("stop"), out.cast("double").alias("exit"), b["close"].cast("double").alias("last"))

    return F.aggregate(path, start, step, lambda s: F.coalesce(s["exit"], s["last"]))


def session_hold(bars: DataFrame, fired: DataFrame, half_spread: float = 0.0005) -> DataFrame:
    """Each firing (symbol, session, rule, bar): next bar's open to the session's last close, net of two half-spreads, and its
    excess over the same (symbol, bar)'s mean without condition."""
    s = Window.partitionBy("symbol", "session").orderBy("bar")
    last = F.last("close").over(s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = bars.select("symbol", "session", "bar", (F.try_divide(last, F.lead("open").over(s)) - 1).alias("ret")).where("ret is not null")
    usual = held.groupBy("symbol", "bar").agg(F.avg("ret").alias("usual"))
    return fired.join(held, ["symbol", "session", "bar"]).join(usual, ["symbol", "bar"]).select("symbol", "session", "rule", "bar", "ret", (F.col("ret") - 2 * half_spread).alias("net"), (F.col("ret") - F.col("usual")).alias("excess"))


def passive_fill(bars: DataFrame, half_spread: float = 0.001) -> DataFrame:
    """Per bar: whether a bid half a spread under its close is filled by a later low of the session, and the returns of taking and of waiting."""
    s = Window.partitionBy("symbol", "session").orderBy("bar")
    rest = s.rowsBetween(1, Window.unboundedFollowing)
    bid, last = F.col("close") * (1 - half_spread), F.last("close").over(s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = F.coalesce(F.min("low").over(rest) <= bid, F.lit(False))
    return bars.select("symbol", "session", "bar", filled.alias("filled"), (last / (F.col("close") * (1 + half_spread)) - 1).alias("taker"), F.when(filled, last / bid - 1).alias("passive"))


def overnight_split(bars: DataFrame) -> DataFrame:
    """night (previous adjusted close to adjusted open), day (open to close), hold."""
    adj_open = F.when(F.col("close") != 0, F.col("open") * F.col("adj_close") / F.col("close"))
    prev = F.lag("adj_close").over(by_symbol())
    return bars.select("symbol", "dt", (F.try_divide(adj_open, prev) - 1).alias("night"), (F.try_divide("adj_close", adj_open) - 1).alias("day"), (F.try_divide("adj_close", prev) - 1).alias("hold"))


def first_last_momentum(bars: DataFrame, cost: float = 0.0002) -> DataFrame:
    """Per session: the first bar's direction traded over the last bar."""
    g = bars.groupBy("symbol", "session").agg(F.max(F.when(F.col("bar") == 0, F.col("close") / F.col("open") - 1)).alias("first"), F.max(F.when(F.col("bar") == F.col("bars_in_session") - 1, F.col("close") / F.col("open") - 1)).alias("last"))
    return g.where("first is not null and last is not null").withColumn("net", F.signum("first") * F.col("last") - F.when(F.col("first") != 0, cost).otherwise(0.0))


def weekly_reversal(bars: DataFrame, calendar: DataFrame, every: int = 5, start: int = 25, names: int = 3) -> DataFrame:
    """Every `every` sessions: the `names` largest losers and winners of the last `every` rows, by the open-to-open return that follows."""
    adj_open = F.try_divide(F.col("open") * F.col("adj_close"), "close")
    df = bars.withColumn("_o", adj_open).withColumn("past", F.try_divide("adj_close", F.lag("adj_close", every).over(by_symbol())) - 1)
    df = df.withColumn("fwd", F.try_divide(F.lead("_o", every + 1).over(by_symbol()), F.lead("_o", 1).over(by_symbol())) - 1).join(F.broadcast(calendar.select("dt", "day_index")), "dt")
    df = df.where((F.col("day_index") >= start) & ((F.col("day_index") - start) % every == 0) & F.col("past").isNotNull() & F.col("fwd").isNotNull())
    lo = F.row_number().over(Window.partitionBy("dt").orderBy("past", "symbol"))
    hi = F.row_number().over(Window.partitionBy("dt").orderBy(F.desc("past"), "symbol"))
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    return df.groupBy("dt").agg(F.avg(F.when(F.col("_lo") <= names, F.col("fwd"))).alias("losers"), F.avg(F.when(F.col("_hi") <= names, F.col("fwd"))).alias("winners"), F.count(F.lit(1)).alias("n"))


def rotation_weights(bars: DataFrame, k: int = 3) -> DataFrame:
    """month, symbol, weight: the k best by return over months -12..-1, held in the month that follows."""
    month = F.trunc("dt", "month")
    ends = bars.groupBy("symbol", month.alias("month")).agg(F.max_by("adj_close", "dt").alias("px"))
    w = Window.partitionBy("symbol").orderBy("month")
    mom = ends.withColumn("mom", F.try_divide(F.lag("px", 1).over(w), F.lag("px", 12).over(w)) - 1).where("mom is not null")
    ranked = mom.withColumn("_n", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("mom"), "symbol"))).where(F.col("_n") <= k)
    return ranked.select(F.add_months("month", 1).alias("month"), "symbol", F.lit(1.0 / k).alias("weight"))


def event_window_returns(events: DataFrame, bars: DataFrame, calendar: DataFrame, benchmark: DataFrame, offset: int, hold: int, sign: int = 1, cost: float = 0.001) -> DataFrame:
    """Per event (symbol, effective): entry at the last session before `effective` plus `offset`, return over `hold` sessions less
    the benchmark's, times `sign`, less `cost`. A missing price leaves a null return; the row stays."""
    days = calendar.select("dt", "day_index")
    last = session_of(events.select("symbol", "effective").distinct(), calendar, "effective", "_i", ahead=False)
    last = last.select("symbol", "effective", (F.col("_i") + offset).alias("entry_index"))
    px = bars.join(F.broadcast(days), "dt").select("symbol", "day_index", "adj_close")
    bm = benchmark.join(F.broadcast(days), "dt").select("day_index", F.col("adj_close").alias("bm"))
    a = last.join(px.select("symbol", F.col("day_index").alias("entry_index"), F.col("adj_close").alias("p0")), ["symbol", "entry_index"], "left")
    a = a.withColumn("exit_index", F.col("entry_index") + hold).join(px.select("symbol", F.col("day_index").alias("exit_index"), F.col("adj_close").alias("p1")), ["symbol", "exit_index"], "left")
    a = a.join(bm.select(F.col("day_index").alias("entry_index"), F.col("bm").alias("b0")), "entry_index", "left").join(bm.select(F.col("day_index").alias("exit_index"), F.col("bm").alias("b1")), "exit_index", "left")
    return a.select("symbol", "effective", (sign * (F.try_divide("p1", "p0") - F.try_divide("b1", "b0")) - cost).alias("abnormal"))


def decile_portfolios(df: DataFrame, period: str, score: str, weight: str, ret: str, subset: Column, q: int = 10, least: int = 10) -> DataFrame:
    """Value-weighted return of each bucket and of top minus bottom; bucket edges are percentiles of the subset, periods with fewer than `least` of it are left out."""
    cut = df.where(subset & F.col(score).isNotNull()).groupBy(period).agg(F.percentile(score, F.array(*(F.lit(i / q) for i in range(1, q)))).alias("_cuts"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    b = df.join(cut, period).where(F.col(score).isNotNull()).withColumn("bucket", F.size(F.filter("_cuts", lambda c: c < F.col(score))) + 1)
    g = b.groupBy(period, "bucket").agg((F.sum(F.col(weight) * F.col(ret)) / F.sum(weight)).alias("ret"))
    spread = g.groupBy(period).agg((F.max(F.when(F.col("bucket") == q, F.col("ret"))) - F.max(F.when(F.col("bucket") == 1, F.col("ret")))).alias("ret")).select(period, F.lit(0).alias("bucket"), "ret")
    return g.unionByName(spread)


def calendar_time(events: DataFrame, bars: DataFrame, calendar: DataFrame, first: int = 2, last: int = 61, half_spread: float = 0.0025) -> DataFrame:
    """Equal-weight mean return a day over all events (symbol, day0) whose sessions first..last cover it; the first day counts from
    its open and the first and last pay half a spread. Missing returns count as 0."""
    days = F.broadcast(calendar.select("dt", "day_index"))
    entry = events.join(days.withColumnRenamed("dt", "day0"), "day0").select("symbol", F.col("day_index").alias("d0"))
    adj_open = F.when(F.col("close") != 0, F.col("open") * F.col("adj_close") / F.col("close"))
    px = bars.select("symbol", "dt", (F.try_divide("adj_close", F.lag("adj_close").over(by_symbol())) - 1).alias("_r"), (F.try_divide("adj_close", adj_open) - 1).alias("_r1")).join(days, "dt")
    facts = px.select("symbol", "dt", F.col("day_index").cast("long").alias("day_index"), F.col("_r").cast("double").alias("_r"), F.col("_r1").cast("double").alias("_r1"))
    # events meet the sessions that they cover in tasks, and leave them as sums a day
    sums = met(entry.select("symbol", F.col("d0").cast("long").alias("d0")), facts, functools.partial(_held_sums, first, last, half_spread), "dt date, total double, known long, n long", order="day_index")
    n = F.sum("known")
    return sums.groupBy("dt").agg(F.when(n > 0, F.sum("total") / n).alias("ret"), F.sum("n").alias("positions"))


def _held_sums(first: int, last: int, half_spread: float, m: Met) -> pa.RecordBatch:
    """dt, total, known, n: the returns of a batch of events on each day, how many are known, and how many events cover it."""
    d0 = m.ask("d0", -(1 << 31))
    low, high = m.find("day_index", d0 + first), m.find("day_index", d0 + last, True)
    size = high - low
    start = np.repeat(np.cumsum(size) - size, size)
    k = np.arange(len(start)) - start  # the number of each covered row in its event
    at = np.repeat(low, size) + k
    opens, closes = k == 0, k == np.repeat(size, size) - 1
    r = np.where(opens, m.fact("_r1")[at], m.fact("_r", 0.0)[at]) - half_spread * (opens.astype(np.int64) + closes)
    known = np.where(opens, m.facts["_r1"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[at], True)
    days, day = np.unique(m.fact("dt", 0)[at], return_inverse=True)
    sums = [np.bincount(day, x, len(days)) for x in (np.where(known, r, 0.0), known, np.ones(len(at)))]
    columns = [pa.array(days.astype(np.int32), pa.int32()).cast(pa.date32()), pa.array(sums[0]), *(pa.array(x.astype(np.int64)) for x in sums[1:])]
    return pa.RecordBatch.from_arrays(columns, names=["dt", "total", "known", "n"])
