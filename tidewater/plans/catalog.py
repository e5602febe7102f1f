"""Registered queries of the panel operators, each with the same result said in SQL where SQL can say it.

Doubles are rounded to six places on both sides, since sums may be added in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, costs, features, inference, joins, outcomes, quality, signals, windows
from ..sources.adapters import CUSTOMER_SYMBOL_SQL, DAILY_SQL, SESSION_SQL, customer_symbol, daily_bars, session_bars, table, trading_days
from ..sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n.split('.')[-1]}" for n in names)


_W = "over (partition by symbol order by dt rows between {} preceding and current row)"


def _sma(n: int, x: str = "adj_close") -> str:
    return f"avg({x}) {_W.format(n - 1)}"


FEATURES_SQL = f"""{DAILY_SQL},
f1 as (select *, lag(adj_close) over w as prev, lag("close") over w as pc, row_number() over w as bar_num,
  high * adj_close / nullif("close", 0) as _x, adj_close / nullif("close", 0) as f from bars window w as (partition by symbol order by dt)),
f2 as (select *, case when prev > 0 then adj_close / prev end - 1 as ret_1d, case when pc > 0 then open / pc end - 1 as gap_pct,
  case when low > 0 then (high - low) / low end as range_pct,
  case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr, high * f as ah, low * f as al from f1),
f3 as (select *, {_sma(20)} as sma_20, {_sma(50)} as sma_50, {_sma(200)} as sma_200, {_sma(20, 'cast(volume as double)')} as av,
  max(ah) {_W.format(251)} as h252, min(al) {_W.format(251)} as l252,
  max(high) over (partition by symbol order by dt rows between 20 preceding and 1 preceding) as prior_high_20,
  min(low) over (partition by symbol order by dt rows between 20 preceding and 1 preceding) as prior_low_20,
  case when count(ret_1d) {_W.format(19)} = 20 then avg(ret_1d * ret_1d) {_W.format(19)} - power(avg(ret_1d) {_W.format(19)}, 2) end as v,
  case when count(tr) {_W.format(13)} = 14 then avg(tr) {_W.format(13)} end as atr_14,
  lag(adj_close, 5) over w as l5, lag(adj_close, 21) over w as l21, lag(adj_close, 63) over w as l63, lag(adj_close, 126) over w as l126
  from f2 window w as (partition by symbol order by dt)),
features as (select symbol, dt, bar_num, open, high, low, "close", adj_close, volume, ret_1d, gap_pct, range_pct, sma_20, sma_50, sma_200,
  case when av > 0 then volume / av end as rel_volume, case when h252 > 0 then adj_close / h252 end - 1 as dist_high_252,
  case when l252 > 0 then adj_close / l252 end - 1 as dist_low_252, prior_high_20, prior_low_20,
  case when v > 0 then sqrt(v) * sqrt(252.0) end as vol_20, atr_14, case when "close" > 0 then atr_14 / "close" end as atr_pct,
  case when l5 > 0 then adj_close / l5 end - 1 as mom_5, case when l21 > 0 then adj_close / l21 end - 1 as mom_21,
  case when l63 > 0 then adj_close / l63 end - 1 as mom_63, case when l126 > 0 then adj_close / l126 end - 1 as mom_126,
  case when adj_close > sma_200 then 1 else 0 end as above_sma_200, case when sma_50 > sma_200 then 1 else 0 end as sma_50_over_200,
  case when sma_20 > 0 then adj_close / sma_20 end - 1 as dist_sma_20, case when sma_50 > 0 then adj_close / sma_50 end - 1 as dist_sma_50,
  case when sma_200 > 0 then adj_close / sma_200 end - 1 as dist_sma_200 from f3)"""

_FEATURES = ["open", "high", "low", '"close"', "adj_close", "ret_1d", "gap_pct", "range_pct", "sma_20", "sma_50", "sma_200", "rel_volume", "dist_high_252", "dist_low_252", "prior_high_20", "prior_low_20", "vol_20", "atr_14", "atr_pct", "mom_5", "mom_21", "mom_63", "mom_126", "dist_sma_20", "dist_sma_50", "dist_sma_200"]


@query(f'with {DAILY_SQL} select symbol, dt, {r("open", "high", "low")}, round("close", 6) as "close", {r("adj_close")}, volume from bars')
def a_daily_bars(spark, sf_dir):
    return rounded(daily_bars(spark, sf_dir))


@query(f'with {SESSION_SQL} select symbol, session, bar, {r("open", "high", "low")}, round("close", 6) as "close", volume, bars_in_session from hourly')
def a_session_bars(spark, sf_dir):
    return rounded(session_bars(spark, sf_dir))


@query(f"with {FEATURES_SQL} select symbol, dt, bar_num, volume, above_sma_200, sma_50_over_200, " + ", ".join(f"round({c}, 6) as {c}" for c in _FEATURES) + " from features")
def e_feature_layer(spark, sf_dir):
    return rounded(features.price_features(daily_bars(spark, sf_dir)).withColumn("bar_num", F.col("bar_num").cast("long")))


_RANKED = """ranked as (select *, percent_rank() over (partition by dt order by mom_21 nulls first) as mom_21_rank,
  percent_rank() over (partition by dt order by vol_20 nulls first) as vol_20_rank from features)"""


@query(f"with {FEATURES_SQL}, {_RANKED} select symbol, dt, round(mom_21_rank, 6) as mom_21_rank, round(vol_20_rank, 6) as vol_20_rank from ranked")
def e_cross_section_ranks(spark, sf_dir):
    f = features.price_features(daily_bars(spark, sf_dir))
    return rounded(features.percent_ranks(f, ["mom_21", "vol_20"], ["dt"]).select("symbol", "dt", "mom_21_rank", "vol_20_rank"))


@query(f"""with {FEATURES_SQL}, n as (select symbol, dt, mom_21, row_number() over (partition by dt, mom_21 is not null order by mom_21, symbol) as i, count(*) over (partition by dt, mom_21 is not null) as n from features)
select symbol, dt, cast(case when mom_21 is null then null when n = 1 then 0 else greatest(0, ceil((i - 1) * 5.0 / (n - 1)) - 1) end as integer) as bucket from n""")
def e_quantile_buckets(spark, sf_dir):
    f = features.price_features(daily_bars(spark, sf_dir))
    return f.select("symbol", "dt", features.quantile_bucket("mom_21", ["dt"], 5, ["symbol"]).alias("bucket"))


LABELS_SQL = f"""{DAILY_SQL},
l1 as (select *, lead(open * adj_close / nullif("close", 0), 1) over w as o, max(high) over n5 as h, min(low) over n5 as lo,
  max(high * (adj_close / nullif("close", 0))) over n5 as ha, min(low * (adj_close / nullif("close", 0))) over n5 as la,
  lead(adj_close, 1) over w as a1, lead(adj_close, 5) over w as a5, lead(adj_close, 21) over w as a21 from bars window w as (partition by symbol order by dt), n5 as (partition by symbol order by dt rows between 1 following and 5 following)),
labels as (select symbol, dt, case when adj_close > 0 then a1 / adj_close end - 1 as fwd_1, case when adj_close > 0 then a5 / adj_close end - 1 as fwd_5, case when adj_close > 0 then a21 / adj_close end - 1 as fwd_21,
  case when o > 0 then a1 / o end - 1 as open_fwd_1, case when o > 0 then a5 / o end - 1 as open_fwd_5, case when o > 0 then a21 / o end - 1 as open_fwd_21,
  case when adj_close > 0 then lo / adj_close end - 1 as mae_5, case when adj_close > 0 then h / adj_close end - 1 as mfe_5,
  case when adj_close > 0 then la / adj_close end - 1 as mae_5_adj, case when adj_close > 0 then ha / adj_close end - 1 as mfe_5_adj from l1)"""


@query(f"with {LABELS_SQL} select symbol, dt, {r('fwd_1', 'fwd_5', 'fwd_21', 'open_fwd_1', 'open_fwd_5', 'open_fwd_21', 'mae_5', 'mfe_5', 'mae_5_adj', 'mfe_5_adj')}, round(fwd_5 - 0.0014::double, 6) as net_5, cast(fwd_5 - 0.0014::double > 0 as integer) as win_5 from labels")
def f_forward_labels(spark, sf_dir):
    return rounded(features.forward_labels(daily_bars(spark, sf_dir)))


@query(f"""with {FEATURES_SQL}, {LABELS_SQL.split('),', 2)[-1] if False else LABELS_SQL[len(DAILY_SQL) + 2:]},
p as (select f.dt, f.symbol, percent_rank() over (partition by f.dt order by f.mom_21) as rk, l.fwd_5 from features f join labels l using (symbol, dt) where f.mom_21 is not null and l.fwd_5 is not null)
select dt, round(avg(fwd_5 - 0.0014::double), 6) as net_return, round(avg(fwd_5), 6) as gross_return, round(avg(case when fwd_5 > 0 then 1.0 else 0.0 end), 6) as hit_rate, count(*) as selected from p where rk >= 0.9 group by dt""")
def d_top_decile_returns(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    rows = features.price_features(bars).select("symbol", "dt", "mom_21").join(features.forward_labels(bars).select("symbol", "dt", "fwd_5"), ["symbol", "dt"])
    rows = features.percent_ranks(rows.where("mom_21 is not null and fwd_5 is not null"), ["mom_21"], ["dt"])
    return rounded(aggregates.strategy_returns(rows.where("mom_21_rank >= 0.9"), "dt", "fwd_5", 0.0014))


@query("""with d as (select distinct cast(l_shipdate as date) as dt from lineitem)
select dt, row_number() over (order by dt) - 1 as day_index, cast(year(dt) as integer) as year, cast(month(dt) as integer) as month, cast(dayofweek(dt) as integer) as dow from d""")
def e_calendar(spark, sf_dir):
    return features.calendar(daily_bars(spark, sf_dir)).withColumn("day_index", F.col("day_index").cast("long"))


@query(f"""with {DAILY_SQL}, p as (select symbol, dt, adj_close, max(adj_close) over (partition by symbol order by dt) as peak from bars) select symbol, dt, {r('peak')}, round((peak - adj_close) / peak, 6) as drawdown from p""")
def e_running_drawdown(spark, sf_dir):
    return rounded(windows.running_drawdown(daily_bars(spark, sf_dir), "adj_close", ["symbol"], ["dt"]).select("symbol", "dt", "peak", "drawdown"))


@query(f"""with {DAILY_SQL}, t as (select symbol, dt, row_number() over (partition by symbol, year(dt), month(dt) order by dt) as from_start, row_number() over (partition by symbol, year(dt), month(dt) order by dt desc) as from_end from bars)
select *, from_start <= 3 or from_end <= 1 as turn_of_month from t""")
def e_turn_of_month(spark, sf_dir):
    return windows.turn_of_month(daily_bars(spark, sf_dir), ["symbol"]).select("symbol", "dt", F.col("from_start").cast("long").alias("from_start"), F.col("from_end").cast("long").alias("from_end"), "turn_of_month")


@query(f"""with {DAILY_SQL}, x as (select symbol, dt, case when volume >= 30 then adj_close end as v, volume from bars)
select symbol, dt, round(last_value(v ignore nulls) over (partition by symbol order by dt), 6) as filled, round(last_value(v ignore nulls) over (partition by symbol order by dt rows between 5 preceding and current row), 6) as filled_5 from x""")
def e_forward_fill(spark, sf_dir):
    df = daily_bars(spark, sf_dir).withColumn("v", F.when(F.col("volume") >= 30, F.col("adj_close")))
    return rounded(df.select("symbol", "dt", windows.forward_fill("v", ["symbol"], ["dt"]).alias("filled"), windows.forward_fill("v", ["symbol"], ["dt"], 5).alias("filled_5")))


@query(f"""with {DAILY_SQL}, x as (select symbol, dt, adj_close, count(adj_close) over w as n, avg(adj_close) over w as m, stddev_samp(adj_close) over w as s from bars window w as (partition by symbol order by dt rows between unbounded preceding and 1 preceding))
select symbol, dt, round(case when n >= 4 then m end, 6) as prior_mean, round(case when n >= 4 then s end, 6) as prior_sd from x""")
def e_prior_stats(spark, sf_dir):
    mean, sd = windows.prior_stats("adj_close", ["symbol"], ["dt"])
    return rounded(daily_bars(spark, sf_dir).select("symbol", "dt", mean.alias("prior_mean"), sd.alias("prior_sd")))


@query(f"""with {DAILY_SQL}, x as (select symbol, dt, coalesce("close" > open, false) as hit from bars), y as (select *, sum(case when hit then 0 else 1 end) over (partition by symbol order by dt) as island from x)
select symbol, dt, cast(least(sum(cast(hit as integer)) over (partition by symbol, island order by dt), 8) as bigint) as streak from y""")
def e_streaks(spark, sf_dir):
    return windows.streak(daily_bars(spark, sf_dir), F.col("close") > F.col("open"), ["symbol"], ["dt"]).select("symbol", "dt", "streak")


@query(f"""with {DAILY_SQL}, d as (select dt, row_number() over (order by dt) - 1 as day_index from (select distinct dt from bars)),
e as (select {CUSTOMER_SYMBOL_SQL} as symbol, day_index, cast(floor(o_totalprice) as bigint) as amount, 1 as events from orders join d on cast(o_orderdate as date) = d.dt)
select b.symbol, b.dt, d.day_index, cast(coalesce(sum(e.amount), 0) as bigint) as amount_sum, cast(coalesce(sum(e.events), 0) as bigint) as events_sum from bars b join d using (dt) left join e on e.symbol = b.symbol and e.day_index between d.day_index - 90 and d.day_index group by 1, 2, 3""")
def e_trailing_event_sums(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    days = F.broadcast(features.calendar(bars).select("dt", "day_index"))
    events = table(spark, sf_dir, "orders").select(customer_symbol(F.col("o_custkey")).alias("symbol"), F.to_date("o_orderdate").alias("dt"), F.floor("o_totalprice").cast("long").alias("amount"), F.lit(1).alias("events")).join(days, "dt").drop("dt")
    return windows.trailing_event_sums(bars.select("symbol", "dt").join(days, "dt"), events, ["symbol"], "day_index", ["amount", "events"], 90).select("symbol", "dt", F.col("day_index").cast("long").alias("day_index"), "amount_sum", "events_sum")


@query(f"""with {DAILY_SQL}, x as (select symbol, dt, count(volume) over w as n, avg(volume) over w as m, max("close") over w as hi from bars window w as (partition by symbol order by dt rows between 20 preceding and 1 preceding))
select symbol, dt, round(case when n >= 15 then m end, 6) as adv_20, round(case when n >= 15 then hi end, 6) as max_20 from x""")
def e_shifted_rolling(spark, sf_dir):
    k = (["symbol"], ["dt"], 20, 15)
    return rounded(daily_bars(spark, sf_dir).select("symbol", "dt", windows.shifted(F.col("volume"), F.avg, *k).alias("adv_20"), windows.shifted(F.col("close"), F.max, *k).alias("max_20")))


_RET = "ret as (select symbol, dt, adj_close / lag(adj_close) over (partition by symbol order by dt) - 1 as ret from bars)"


def returns(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return bars.withColumn("ret", F.try_divide("adj_close", F.lag("adj_close").over(features.by_symbol())) - 1)


@query(f"""with {DAILY_SQL}, {_RET}, m as (select dt, avg(ret) as mkt from ret group by dt), j as (select symbol, dt, case when ret is not null and mkt is not null then ret end as y, case when ret is not null and mkt is not null then mkt end as x from ret join m using (dt)),
b as (select symbol, dt, count(x) over w as n, covar_samp(y, x) over w as c, var_samp(x) over w as v from j window w as (partition by symbol order by dt rows between 252 preceding and 1 preceding))
select symbol, dt, round(case when n >= 120 and v > 0 then c / v end, 4) as beta from b""")
def e_rolling_beta(spark, sf_dir):
    df = returns(spark, sf_dir)
    market = df.groupBy("dt").agg(F.avg("ret").alias("mkt"))
    df = df.join(F.broadcast(market), "dt").select("symbol", "dt", "ret", "mkt")
    return rounded(windows.rolling_beta(df, "ret", "mkt").select("symbol", "dt", "beta"), 4)


@query(f"""with {DAILY_SQL}, {_RET}, z as (select symbol, dt, ret, avg(ret) over (partition by dt) as m, stddev_samp(ret) over (partition by dt) as s, rank() over (partition by dt, ret is not null order by ret) + (count(*) over (partition by dt, ret is not null, ret) - 1) / 2.0 as rk from ret)
select symbol, dt, round(case when s > 0 then (ret - m) / s end, 6) as z, round(case when ret is not null then rk end, 6) as rank_avg from z""")
def e_zscore_and_average_rank(spark, sf_dir):
    df = returns(spark, sf_dir)
    return rounded(df.select("symbol", "dt", windows.group_zscore("ret", ["dt"]).alias("z"), windows.average_rank("ret", ["dt"]).cast("double").alias("rank_avg")))


@query(f"""with {DAILY_SQL}, {_RET}, q as (select dt, quantile_cont(ret, 0.1) as lo, quantile_cont(ret, 0.9) as hi from ret group by dt) select symbol, dt, round(greatest(least(ret, hi), lo), 6) as ret from ret join q using (dt) where ret is not null""")
def e_winsorize(spark, sf_dir):
    return rounded(windows.winsorize(returns(spark, sf_dir).where("ret is not null").select("symbol", "dt", "ret"), "ret", ["dt"], 0.1, 0.9).select("symbol", "dt", "ret"))


_MEMBERS = """med as (select symbol, date_trunc('month', dt) as month, median("close" * volume) as m from bars group by 1, 2),
top as (select symbol, month, row_number() over (partition by month order by m desc, symbol) as n from med),
nxt as (select month, lead(month) over (order by month) as next_month from (select distinct month from med)),
members as (select symbol, cast(next_month as date) as month from top join nxt using (month) where n <= 5 and next_month is not null)"""


@query(f"with {DAILY_SQL}, {_MEMBERS} select symbol, month from members")
def e_previous_month_universe(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).withColumn("month", F.trunc("dt", "month"))
    return windows.previous_period_universe(bars, "symbol", "month", F.col("close") * F.col("volume"), 5)


@query(f"""with {DAILY_SQL}, {_MEMBERS}, both_ as (select month, symbol, 0.2::double as w from members union all select n.next_month, m.symbol, -0.2::double from members m join (select month, lead(month) over (order by month) as next_month from (select distinct month from members)) n using (month) where n.next_month is not null)
select month, round(sum(abs(d)), 6) as turnover from (select month, symbol, sum(w) as d from both_ group by 1, 2) group by month""")
def e_turnover(spark, sf_dir):
    members = e_previous_month_universe(spark, sf_dir).withColumn("w", F.lit(0.2))
    return rounded(windows.turnover(members, "month", "symbol", "w"))


@query(f"""with {DAILY_SQL} select symbol, dt, cast(case when "close" > 0 and "close" <= 103 then 0 when "close" > 103 and "close" <= 106 then 1 when "close" > 106 and "close" <= 112 then 2 end as integer) as band from bars""")
def e_fixed_bands(spark, sf_dir):
    return daily_bars(spark, sf_dir).select("symbol", "dt", windows.fixed_bands(F.col("close"), [0, 103, 106, 112]).alias("band"))


@query(f"""with {FEATURES_SQL} select symbol, dt from (select symbol, dt, above_sma_200 = 1 as s, coalesce(lag(above_sma_200 = 1) over (partition by symbol order by dt), false) as was from features) where s and not was""")
def e_state_onsets(spark, sf_dir):
    f = features.price_features(daily_bars(spark, sf_dir)).withColumn("s", F.col("above_sma_200") == 1)
    return windows.onsets(f, "s", ["symbol"], ["dt"]).where("onset").select("symbol", "dt")


@query(f"""with {DAILY_SQL}, {_RET}, m as (select symbol, cast(date_trunc('month', dt) as date) as month, product(1 + ret) - 1 as ret from ret where ret is not null group by 1, 2),
x as (select symbol, month, year(month) * 12 + month(month) as mi, ret from m),
y as (select *, mi - lag(mi, 3) over w = 3 as whole, lag(ret, 1) over w as r1, lag(ret, 2) over w as r2, lag(ret, 3) over w as r3 from x window w as (partition by symbol order by month))
select symbol, month, round(case when whole then (1 + r1) - 1 end, 6) as cum_1, round(case when whole then (1 + r1) * (1 + r2) - 1 end, 6) as cum_2, round(case when whole then (1 + r1) * (1 + r2) * (1 + r3) - 1 end, 6) as cum_3 from y""")
def e_past_month_returns(spark, sf_dir):
    m = aggregates.compound(returns(spark, sf_dir).where("ret is not null"), ["symbol", F.trunc("dt", "month").alias("month")], "ret")
    m = m.withColumn("mi", F.year("month") * 12 + F.month("month"))
    return rounded(windows.compound_returns(m, "ret", ["symbol"], ["month"], "mi", 3).select("symbol", "month", "cum_1", "cum_2", "cum_3"))


_EVENTS = f"ev as (select {CUSTOMER_SYMBOL_SQL} as symbol, cast(o_orderdate as date) as known, max(o_totalprice) as amount from orders group by 1, 2)"


def events_of(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(customer_symbol(F.col("o_custkey")).alias("symbol"), F.to_date("o_orderdate").alias("known")).agg(F.max("o_totalprice").alias("amount"))


@query(f"with {DAILY_SQL}, {_EVENTS} select b.symbol, b.dt, e.known as asof_at, round(e.amount, 6) as amount from bars b asof left join ev e on b.symbol = e.symbol and b.dt >= e.known")
def c_asof_join(spark, sf_dir):
    return rounded(joins.asof(daily_bars(spark, sf_dir).select("symbol", "dt"), events_of(spark, sf_dir), ["symbol"], "dt", "known", ["amount"]))


@query(f"""with {DAILY_SQL}, {_EVENTS}, l as (select symbol, known as since, known + interval 30 day as until, amount from ev)
select b.symbol, b.dt, cast(l.since as date) as since, round(l.amount, 6) as amount from bars b join l on b.symbol = l.symbol and b.dt between l.since and l.until""")
def c_interval_join(spark, sf_dir):
    links = events_of(spark, sf_dir).select("symbol", F.col("known").alias("since"), F.date_add("known", 30).alias("until"), "amount")
    return rounded(joins.interval_join(daily_bars(spark, sf_dir).select("symbol", "dt"), links, ["symbol"], "dt", "since", "until").select("symbol", "dt", "since", "amount"))


@query(f"""with {DAILY_SQL}, {_EVENTS}, l as (select symbol, known, amount from ev) select distinct b.symbol, b.dt from bars b join l on b.symbol = l.symbol and b.dt between l.known - interval 10 day and l.known + interval 15 day""")
def c_rows_around_events(spark, sf_dir):
    ev = events_of(spark, sf_dir)
    return joins.rows_around(daily_bars(spark, sf_dir).select("symbol", "dt"), ev, ["symbol"], "dt", "known", 10, 15)


@query(f"""with {_EVENTS}, a as (select symbol, known as ann from ev), x as (select a.symbol, a.ann, e.known as note, e.amount, row_number() over (partition by a.symbol, a.ann order by e.known desc, e.amount) as n from a join ev e on a.symbol = e.symbol and e.known >= a.ann - interval 90 day and e.known < a.ann)
select symbol, ann, note, round(amount, 6) as amount from x where n = 1""")
def c_latest_before(spark, sf_dir):
    ev = events_of(spark, sf_dir)
    a = ev.select("symbol", F.col("known").alias("ann"))
    return rounded(joins.latest_before(a, ev.withColumnRenamed("known", "note"), ["symbol"], "ann", "note", 90, "amount"))


@query(f"""with {_EVENTS}, o as (select symbol, known as offer, lead(known) over (partition by symbol order by known) as nxt from ev)
select e.symbol, e.known as follow_up, o.offer from ev e join o on e.symbol = o.symbol and e.known >= o.offer and (o.nxt is null or e.known < o.nxt) and date_diff('day', o.offer, e.known) <= 365""")
def c_nearest_owner(spark, sf_dir):
    ev = events_of(spark, sf_dir)
    return joins.nearest_owner(ev.select("symbol", F.col("known").alias("follow_up")), ev.select("symbol", F.col("known").alias("offer")), ["symbol"], "follow_up", "offer")


@query(f"""with {_EVENTS}, t as (select symbol, known as entry, known + interval 20 day as exit_ from ev), rt as (select cast(l_shipdate as date) as dt, sum(cast(l_linenumber as bigint)) as rate from lineitem group by 1)
select t.symbol, t.entry, cast(t.exit_ as date) as exit_at, coalesce(cast(sum(rt.rate) as bigint), 0) as rate_sum from t left join rt on rt.dt > t.entry and rt.dt <= t.exit_ group by 1, 2, 3""")
def c_interval_sums(spark, sf_dir):
    trades = events_of(spark, sf_dir).select("symbol", F.col("known").alias("entry"), F.date_add("known", 20).alias("exit_at"))
    rates = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("dt")).agg(F.sum(F.col("l_linenumber").cast("long")).alias("rate"))
    return joins.interval_sums(trades, rates, "entry", "exit_at", "dt", "rate")


@query("""select c_custkey, s_suppkey from (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as n from customer) c join (select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) as n from supplier) s on c.c_nationkey = s.s_nationkey and s.n = 1""")
def c_best_match(spark, sf_dir):
    best = joins.best_match(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", "s_suppkey")
    return table(spark, sf_dir, "customer").join(best, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey")


@query("""select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0) and o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def c_anti_and_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    bad = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.semi(joins.anti(o, bad, ["o_custkey"]), returned, ["o_orderkey"]).select("o_orderkey")


@query(f"""with {DAILY_SQL}, c as (select symbol, cast(date_trunc('month', dt) as date) as month, median((high - low) / "close") as cost from bars group by 1, 2) select symbol, month, round(lag(cost) over (partition by symbol order by month), 6) as cost from c""")
def c_lagged_month_cost(spark, sf_dir):
    c = daily_bars(spark, sf_dir).groupBy("symbol", F.trunc("dt", "month").alias("month")).agg(F.median((F.col("high") - F.col("low")) / F.col("close")).alias("cost"))
    return rounded(joins.lagged_period(c, "symbol", "month", "cost"))


@query(f"""with {DAILY_SQL}, {_EVENTS}, s as (select known as dt, count(*) as n from ev group by 1), d as (select distinct dt from bars) select d.dt, coalesce(n, 0) as n from d left join s using (dt)""")
def c_calendar_densify(spark, sf_dir):
    series = events_of(spark, sf_dir).groupBy(F.col("known").alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    return joins.densify(series, features.calendar(daily_bars(spark, sf_dir)), "dt", ["n"])


@query(f"""with {DAILY_SQL}, x as (select *, lag(adj_close) over w as pa, lag(dt) over w as pd from bars window w as (partition by symbol order by dt))
select symbol, dt, 'price_order' as issue, 'error' as severity from x where high < low or high < greatest(open, "close") or low > least(open, "close")
union all select symbol, dt, 'zero_volume', 'warn' from x where volume = 0 union all select symbol, dt, 'extreme_move', 'warn' from x where abs(adj_close / pa - 1) > 0.35
union all select symbol, dt, 'calendar_gap', 'warn' from x where date_diff('day', pd, dt) > 10""")
def g_bar_issues(spark, sf_dir):
    return quality.bar_issues(daily_bars(spark, sf_dir))


@query(f"""with {DAILY_SQL}, a as (select distinct symbol || '-' || volume as key from bars where dt < date '1998-01-01'), b as (select distinct symbol || '-' || volume as key from bars where dt >= date '1998-01-01')
select key, 'added' as change from b where key not in (select key from a) union all select key, 'removed' from a where key not in (select key from b)""")
def g_snapshot_diff(spark, sf_dir):
    keyed = daily_bars(spark, sf_dir).select("dt", F.concat_ws("-", "symbol", "volume").alias("key"))
    return quality.snapshot_diff(keyed.where("dt < date '1998-01-01'").select("key").distinct(), keyed.where("dt >= date '1998-01-01'").select("key").distinct(), "key")


@query(f"""with {DAILY_SQL} select symbol, dt, case when volume > 60 then 'large' else 'late' end as reason from bars where (symbol = 'S00001' and volume > 60) or (symbol = 'S00002' and dt >= date '2000-01-01') and symbol = 'S00002'
and true""".replace("case when volume > 60 then 'large' else 'late' end", "case when symbol = 'S00001' then 'early' else 'late' end").replace("symbol = 'S00001' and volume > 60", "symbol = 'S00001' and dt <= date '1996-06-30'"))
def g_quarantine(spark, sf_dir):
    rules = spark.createDataFrame([("S00001", None, "1996-06-30", "early"), ("S00002", "2000-01-01", None, "late")], "symbol string, since string, until string, reason string")
    rules = rules.withColumn("since", F.to_date("since")).withColumn("until", F.to_date("until"))
    return quality.quarantine(daily_bars(spark, sf_dir), rules)[1].select("symbol", "dt", "reason")


@query(f"""with {DAILY_SQL}, l as (select symbol, volume, dt, row_number() over (partition by symbol order by dt) as line from bars), p as (select symbol, line, sha256(symbol || '|' || dt || '|' || volume) as h from l)
select symbol, count(*) as lines, bit_xor(cast('0x' || substr(h, 1, 8) as bigint)) as digest from p group by symbol""")
def g_row_digests(spark, sf_dir):
    return aggregates.row_digests(daily_bars(spark, sf_dir), ["symbol"], ["symbol", "dt", "volume"])


@query(f"""with {DAILY_SQL}, n as (select symbol, dt, "close" * case when volume % 97 = 0 then 1.01 else 1.0 end as c from bars where volume % 31 <> 0)
select b.symbol, b.dt, case when n.symbol is null then 'left_only' else 'close' end as problem from bars b left join n using (symbol, dt) where n.symbol is null or abs(b."close" - n.c) > 1e-9 * greatest(1.0, abs(n.c))""")
def g_reconcile(spark, sf_dir):
    a = daily_bars(spark, sf_dir).select("symbol", "dt", "close", "volume")
    b = a.where("volume % 31 <> 0").withColumn("close", F.col("close") * F.when(F.col("volume") % 97 == 0, 1.01).otherwise(1.0))
    return quality.reconcile(a, b, ["symbol", "dt"], ["close"])


_SQL_SIGNALS = [n for n in signals.REGISTRY if n not in signals.RECURSIVE]


def _full(f: str, x: str, n: int) -> str:
    return f"case when count({x}) {_W.format(n - 1)} = {n} then {f}({x}) {_W.format(n - 1)} end"


def _prior(f: str, x: str, n: int) -> str:
    w = f"over (partition by symbol order by dt rows between {n} preceding and 1 preceding)"
    return f"case when count({x}) {w} = {n} then {f}({x}) {w} end"


def _l(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over (partition by symbol order by dt)"


def _above(x: str, y: str) -> str:
    return f"({x} > {y} and {_l(x)} <= {_l(y)})"


def _below(x: str, y: str) -> str:
    return f"({x} < {y} and {_l(x)} >= {_l(y)})"


_BLOCKS_SQL = f"""{DAILY_SQL},
s1 as (select *, {_l('c')} as pc, {_l('open')} as po, {_l('high')} as ph, {_l('low')} as pl, adj_close / {_l('adj_close')} - 1 as ar, {', '.join(f'{_full("avg", "adj_close", n)} as sma{n}' for n in (20, 50, 100, 200))},
  {_full('stddev_samp', 'adj_close', 20)} as sd, {_full('avg', 'cast(volume as double)', 20)} as vol20, {', '.join(f'{_prior("max", "high", n)} as top{n}' for n in (20, 55, 252))}, {_full('min', 'low', 20)} as low20,
  low * (adj_close / nullif(c, 0)) as alow, {_full('max', 'high', 14)} as h14, {_full('min', 'low', 14)} as l14, abs(c - open) as body, nullif(high - low, 0) as rng, high - greatest(c, open) as upper_, least(c, open) - low as lower_
  from (select *, "close" as c from bars)),
s2 as (select *, case when h14 - l14 <> 0 then 100 * (c - l14) / (h14 - l14) end as k14, sma20 - 2 * sd as bl, sma20 + 2 * sd as bu from s1)"""

_RULES_SQL = {
    "golden_cross_50_200": _above("sma50", "sma200"), "golden_cross_20_100": _above("sma20", "sma100"), "death_cross_50_200": _below("sma50", "sma200"), "above_sma_200": "adj_close > sma200",
    "above_sma_50": "adj_close > sma50", "cross_above_sma_50": _above("adj_close", "sma50"), "cross_above_sma_20": _above("adj_close", "sma20"), "ma_ribbon_aligned": "sma20 > sma50 and sma50 > sma200",
    "stochastic_oversold": _below("k14", "cast(20.0 as double)"), "bollinger_lower_touch": "adj_close < bl", "bollinger_upper_break": _above("adj_close", "bu"), "donchian_break_20": "c > top20", "donchian_break_55": "c > top55",
    "new_52w_high": "c > top252", "resistance_break_volume": "c > top20 and volume > 1.5 * vol20", "support_bounce": "c <= 1.02::double * low20 and adj_close > sma200", "pullback_to_sma50": "alow <= sma50 and sma50 < adj_close and sma50 > sma200",
    "bullish_engulfing": "pc < po and c > open and c >= po and open <= pc", "bearish_engulfing": "pc > po and c < open and c <= po and open >= pc", "hammer": "lower_ > 2 * body and upper_ < body and rng > 0",
    "shooting_star": "upper_ > 2 * body and lower_ < body and rng > 0", "doji": "body <= 0.1::double * rng", "morning_star": f"{_l('c', 2)} < {_l('open', 2)} and {_l('body')} <= 0.3::double * {_l('rng')} and c > open and c > {_l('c', 2)}",
    "three_white_soldiers": f"c > open and pc > po and {_l('c', 2)} > {_l('open', 2)} and c > pc and pc > {_l('c', 2)}", "inside_bar": "high < ph and low > pl", "outside_bar_up": "high > ph and low < pl and c > open",
    "gap_up_2pct": "open / pc - 1 > 0.02::double", "gap_down_2pct": "open / pc - 1 < -0.02::double", "volume_spike_up": "volume > 2 * vol20 and c > open", "volume_dryup": "volume < 0.5::double * vol20",
    "three_down_days": f"adj_close < {_l('adj_close')} and {_l('adj_close')} < {_l('adj_close', 2)} and {_l('adj_close', 2)} < {_l('adj_close', 3)}", "big_down_day": "ar < -0.03::double", "extreme_below_sma20": "adj_close < bl",
}


@query(f"with {_BLOCKS_SQL}, s3 as (select symbol, dt, " + ", ".join(f"coalesce({x}, false) as {n}" for n, x in _RULES_SQL.items()) + " from s2) select symbol, dt, signal from (unpivot s3 on " + ", ".join(_RULES_SQL) + " into name signal value hit) where hit")
def f_window_signals(spark, sf_dir):
    return signals.long_form(daily_bars(spark, sf_dir), list(_RULES_SQL))


# the recursions of the exponential means, row by row; a mean counts once it has seen as many values as it spans
_MEANS_SQL = f"""recursive {DAILY_SQL},
nb as (select symbol, dt, adj_close as x, row_number() over w as n, adj_close - lag(adj_close) over w as mv, case when count(*) over (w rows between 199 preceding and current row) = 200 then avg(adj_close) over (w rows between 199 preceding and current row) end as sma200
  from bars window w as (partition by symbol order by dt)),
e as (select symbol, n, x as e12, x as e26, null::double as g, null::double as l, null::double as sg from nb where n = 1
  union all select b.symbol, b.n, e12 + (b.x - e12) * 2 / 13, e26 + (b.x - e26) * 2 / 27, case when b.n = 2 then greatest(mv, 0) else g + (greatest(mv, 0) - g) / 14 end, case when b.n = 2 then greatest(-mv, 0) else l + (greatest(-mv, 0) - l) / 14 end,
    case when b.n = 26 then e12 + (b.x - e12) * 2 / 13 - e26 - (b.x - e26) * 2 / 27 when b.n > 26 then sg + (e12 + (b.x - e12) * 2 / 13 - e26 - (b.x - e26) * 2 / 27 - sg) * 2 / 10 end
  from e join nb b on b.symbol = e.symbol and b.n = e.n + 1),
m as (select symbol, dt, x, sma200, case when n >= 12 then e12 end as e12, case when n >= 26 then e26 end as e26, case when n >= 26 then e12 - e26 end as macd, case when n >= 34 then sg end as sg, case when n >= 15 and l <> 0 then 100 - 100 / (1 + g / l) end as rsi from e join nb using (symbol, n)),
p as (select *, lag(e12) over w as pe12, lag(e26) over w as pe26, lag(macd) over w as pmacd, lag(sg) over w as psg, lag(rsi) over w as prsi from m window w as (partition by symbol order by dt))"""
_RECURSIVE_SQL = {
    "ema_cross_12_26": "e12 > e26 and pe12 <= pe26", "macd_cross_up": "macd > sg and pmacd <= psg", "macd_hist_positive": "macd - sg > 0 and pmacd - psg <= 0", "oversold_in_uptrend": "rsi < 35 and x > sma200",
    "rsi_cross_50": "rsi > 50 and prsi <= 50", "rsi_overbought_70": "rsi > 70 and prsi <= 70", "rsi_oversold_20": "rsi < 20 and prsi >= 20", "rsi_oversold_30": "rsi < 30 and prsi >= 30",
}


@query(f"with {_MEANS_SQL} " + " union all ".join(f"select symbol, dt, '{n}' as signal from p where {x}" for n, x in _RECURSIVE_SQL.items()))
def f_recursive_signals(spark, sf_dir):
    return signals.long_form(daily_bars(spark, sf_dir), sorted(signals.RECURSIVE))


@query()
def f_confluence(spark, sf_dir):
    df = signals.confluence(daily_bars(spark, sf_dir))
    return df.drop("open", "high", "low", "close", "adj_close", "volume")


@query(f"""with {_BLOCKS_SQL}, w as (select symbol, dt, 4 * sd / sma20 as width from s2), q as (select *, case when count(width) {_W.format(119)} = 120 then quantile_cont(width, 0.1) {_W.format(119)} end as cut from w) select symbol, dt from q where width <= cut""")
def f_bollinger_squeeze(spark, sf_dir):
    return signals.squeeze(daily_bars(spark, sf_dir)).where("bollinger_squeeze").select("symbol", "dt")


_S = "over (partition by symbol, session order by bar rows between unbounded preceding and current row)"
_INTRADAY_RULES = {
    "opening_range_break_up": "n >= 3 and i = 1 and c > h0", "opening_range_break_down": "n >= 3 and i = 1 and c < l0", "first_hour_high_break": "n >= 4 and i >= 2 and c > h0",
    "vwap_reversion_long": "n >= 4 and i between 1 and n - 2 and mr > 0 and c < vwap - 0.5::double * mr", "vwap_reclaim": "n >= 4 and i between 1 and n - 2 and was_below and not below",
    "gap_up_fade": "n >= 3 and i = 0 and gap > 0.01::double", "gap_down_fill": "n >= 3 and i = 0 and gap < -0.01::double", "midday_reversal": "n >= 5 and i = 2 and c < o0", "afternoon_momentum": "n >= 5 and i = 2 and c > o0",
    "power_hour_long": "n >= 6 and i = n - 2 and c > o0", "inside_session_squeeze": "n >= 5 and i = 2 and h0 > l0 and high - low < 0.5::double * (h0 - l0)",
    "volume_climax_long": "n >= 4 and i between 1 and n - 2 and pv > 0 and volume > 2 * pv and c < open",
}
_INTRADAY_SQL = f"""{SESSION_SQL},
i1 as (select *, "close" as c, count(*) over (partition by symbol, session) as n, row_number() over w - 1 as i, case when volume <> 0 then sum((high + low + "close") / 3 * volume) {_S} / nullif(sum(volume) {_S}, 0) end as vwap, avg(high - low) {_S} as mr,
  avg(volume) over (partition by symbol, session order by bar rows between unbounded preceding and 1 preceding) as pv, first_value(open) over w as o0, first_value(high) over w as h0, first_value(low) over w as l0 from hourly window w as (partition by symbol, session order by bar)),
i2 as (select symbol, session, lag(lc) over (partition by symbol order by session) as prev_close from (select symbol, session, arg_max("close", bar) as lc from hourly group by 1, 2)),
i3 as (select *, coalesce(c < vwap, false) as below, case when prev_close > 0 then o0 / prev_close end - 1 as gap from i1 join i2 using (symbol, session)),
i4 as (select *, lag(below) over (partition by symbol, session order by bar) as was_below from i3),
fired as (""" + " union all ".join(f"select symbol, session, '{n}' as rule, min(bar) as bar from i4 where {x} group by 1, 2" for n, x in _INTRADAY_RULES.items()) + ")"


@query(f"with {_INTRADAY_SQL} select * from fired")
def f_intraday_rules(spark, sf_dir):
    return signals.intraday_rules(session_bars(spark, sf_dir))


@query(f"""with {_INTRADAY_SQL}, hold as (select symbol, session, bar, last_value("close") over (partition by symbol, session order by bar rows between unbounded preceding and unbounded following) / lead(open) over (partition by symbol, session order by bar) - 1 as ret from hourly),
us as (select symbol, bar, avg(ret) as usual from hold where ret is not null group by 1, 2)
select f.symbol, f.session, f.rule, f.bar, round(h.ret, 6) as ret, round(h.ret - 2 * 0.0005::double, 6) as net, round(h.ret - us.usual, 6) as excess from fired f join hold h using (symbol, session, bar) join us using (symbol, bar) where h.ret is not null""")
def f_session_hold(spark, sf_dir):
    bars = session_bars(spark, sf_dir)
    return rounded(outcomes.session_hold(bars, signals.intraday_rules(bars)))


@query(f"""with {SESSION_SQL}, p as (select symbol, session, bar, "close" as c, min(low) over (partition by symbol, session order by bar rows between 1 following and unbounded following) as later, last_value("close") over (partition by symbol, session order by bar rows between unbounded preceding and unbounded following) as lc from hourly)
select symbol, session, bar, coalesce(later <= c * (1 - 0.001::double), false) as filled, round(lc / (c * (1 + 0.001::double)) - 1, 6) as taker, round(case when later <= c * (1 - 0.001::double) then lc / (c * (1 - 0.001::double)) - 1 end, 6) as passive from p""")
def f_passive_fill(spark, sf_dir):
    return rounded(outcomes.passive_fill(session_bars(spark, sf_dir)))


@query(f"""with {DAILY_SQL}, x as (select symbol, dt, adj_close, open * adj_close / nullif("close", 0) as ao, lag(adj_close) over (partition by symbol order by dt) as p from bars)
select symbol, dt, round(ao / p - 1, 6) as night, round(adj_close / ao - 1, 6) as day, round(adj_close / p - 1, 6) as hold from x""")
def f_overnight_split(spark, sf_dir):
    return rounded(outcomes.overnight_split(daily_bars(spark, sf_dir)))


@query(f"""with {SESSION_SQL}, g as (select symbol, session, max(case when bar = 0 then "close" / open - 1 end) as first, max(case when bar = bars_in_session - 1 then "close" / open - 1 end) as last from hourly group by 1, 2)
select symbol, session, {r('first', 'last')}, round(sign(first) * last - case when first <> 0 then 0.0002::double else 0.0 end, 6) as net from g where first is not null and last is not null""")
def f_first_last_momentum(spark, sf_dir):
    return rounded(outcomes.first_last_momentum(session_bars(spark, sf_dir)))


@query(f"""with {DAILY_SQL}, d as (select dt, row_number() over (order by dt) - 1 as day_index from (select distinct dt from bars)),
x as (select symbol, dt, adj_close / lag(adj_close, 5) over w - 1 as past, lead(open * adj_close / "close", 6) over w / lead(open * adj_close / "close", 1) over w - 1 as fwd from bars window w as (partition by symbol order by dt)),
y as (select x.*, row_number() over (partition by x.dt order by past, symbol) as lo, row_number() over (partition by x.dt order by past desc, symbol) as hi from x join d using (dt) where day_index >= 25 and (day_index - 25) % 5 = 0 and past is not null and fwd is not null)
select dt, round(avg(case when lo <= 3 then fwd end), 6) as losers, round(avg(case when hi <= 3 then fwd end), 6) as winners, count(*) as n from y group by dt""")
def f_weekly_reversal(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return rounded(outcomes.weekly_reversal(bars, features.calendar(bars)))


@query(f"""with {DAILY_SQL}, m as (select symbol, cast(date_trunc('month', dt) as date) as month, arg_max(adj_close, dt) as px from bars group by 1, 2), x as (select symbol, month, lag(px, 1) over w / lag(px, 12) over w - 1 as mom from m window w as (partition by symbol order by month))
select cast(month + interval 1 month as date) as month, symbol, round(1.0 / 3, 6) as weight from (select *, row_number() over (partition by month order by mom desc, symbol) as n from x where mom is not null) where n <= 3""")
def f_rotation_weights(spark, sf_dir):
    return rounded(outcomes.rotation_weights(daily_bars(spark, sf_dir)))


@query(f"""with {_BLOCKS_SQL}, x as (select symbol, dt, adj_close as c, adj_close / nullif("close", 0) as f, open, high, low, row_number() over w as n, greatest(high - low, abs(high - lag("close") over w), abs(low - lag("close") over w)) as tr from bars window w as (partition by symbol order by dt)),
a as (select symbol, dt, n, c, open * f as o, high * f as h, low * f as l, case when count(tr * f) {_W.format(13)} = 14 then avg(tr * f) {_W.format(13)} end as atr from x), sig as (select symbol, dt from s2 where {_RULES_SQL["donchian_break_20"]}),
t as (select a.symbol, a.dt, a.n, a.atr, e.o as entry, e.o - 2 * a.atr as stop, e.o + 3 * a.atr as target from a join sig using (symbol, dt) join a e on e.symbol = a.symbol and e.n = a.n + 1 where a.atr is not null),
p as (select t.*, b.n - t.n as k, b.o as bo, b.l <= stop as hs, b.h >= target as ht, b.c as bc from t join a b on b.symbol = t.symbol and b.n between t.n + 1 and t.n + 60),
g as (select symbol, dt, any_value(entry) as entry, any_value(stop) as stop, any_value(target) as target, min(k) filter (hs or ht) as k, arg_min(hs, k) filter (hs or ht) as hs, arg_min(bo, k) filter (hs or ht) as bo, arg_max(bc, k) as last, max(k) as size from p group by 1, 2)
select symbol, dt, round(entry, 6) as entry, case when k is not null then if(hs, 'stop', 'target') when size = 60 then 'timeout' else 'open' end as outcome, cast(coalesce(k, size) as integer) as days, round(case when k is not null then if(hs, least(stop, bo), greatest(target, bo)) else last end / entry - 1, 6) as gross from g""")
def f_first_touch(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return rounded(outcomes.first_touch(bars, signals=signals.long_form(bars, ["donchian_break_20"])))


@query(f"""with {DAILY_SQL}, d as (select dt, row_number() over (order by dt) - 1 as day_index from (select distinct dt from bars)), {_EVENTS}, e as (select distinct symbol, known from ev),
z as (select e.symbol, d.day_index as d0 from e join d on e.known = d.dt), px as (select b.symbol, b.dt, d.day_index, adj_close / lag(adj_close) over (partition by symbol order by b.dt) - 1 as rr, adj_close / (open * adj_close / nullif("close", 0)) - 1 as r1 from bars b join d using (dt)),
h as (select z.symbol, z.d0, px.*, row_number() over (partition by z.symbol, z.d0 order by px.day_index) as n, count(*) over (partition by z.symbol, z.d0) as size from z join px on px.symbol = z.symbol and px.day_index between z.d0 + 2 and z.d0 + 61)
select dt, round(avg(case when n = 1 then r1 else coalesce(rr, 0) end - 0.0025::double * (case when n = 1 then 1 else 0 end + case when n = size then 1 else 0 end)), 6) as ret, count(*) as positions from h group by dt""")
def f_calendar_time_portfolio(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    ev = events_of(spark, sf_dir).select("symbol", F.col("known").alias("day0")).distinct()
    return rounded(outcomes.calendar_time(ev, bars, written(features.calendar(trading_days(spark, sf_dir)), "sessions")))


@query("""with q as (select o_orderpriority as period, o_totalprice as score, c_acctbal as weight, o_totalprice / 100000 as ret, c_mktsegment = 'BUILDING' as sub from orders join customer on o_custkey = c_custkey where c_acctbal > 0),
c as (select period, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cuts, count(*) as n from q where sub group by period),
b as (select q.*, len(list_filter(cuts, lambda x: x < score)) + 1 as bucket from q join c using (period) where n >= 10),
g as (select period, cast(bucket as integer) as bucket, sum(weight * ret) / sum(weight) as ret from b group by 1, 2)
select period, bucket, round(ret, 6) as ret from g union all select period, 0, round(max(case when bucket = 10 then ret end) - max(case when bucket = 1 then ret end), 6) from g group by period""")
def f_breakpoint_deciles(spark, sf_dir):
    q = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_acctbal > 0")
    q = q.select(F.col("o_orderpriority").alias("period"), F.col("o_totalprice").alias("score"), F.col("c_acctbal").alias("weight"), (F.col("o_totalprice") / 100000).alias("ret"), "c_mktsegment")
    return rounded(outcomes.decile_portfolios(q, "period", "score", "weight", "ret", F.col("c_mktsegment") == "BUILDING"))


_TRADES = f"{DAILY_SQL}, {_RET}, tr as (select symbol, dt, ret, case when hash_ then 'a' else 'b' end as signal from (select *, cast('0x' || substr(md5(symbol || dt), 1, 4) as bigint) % 2 = 0 as hash_ from ret) where ret is not null)"


def trades_of(spark, sf_dir):
    pick = F.conv(F.substring(F.md5(F.concat(F.col("symbol"), F.col("dt").cast("string"))), 1, 4), 16, 10).cast("long") % 2 == 0
    return returns(spark, sf_dir).where("ret is not null").select("symbol", "dt", "ret", F.when(pick, "a").otherwise("b").alias("signal"))


@query(f"""with {_TRADES}, c as (select signal, dt, sum(ret) as s, count(*) as c from tr group by 1, 2), g as (select signal, sum(c) as n, count(*) as clusters, sum(s) / sum(c) as mean from c group by signal),
v as (select g.signal, sum((c.s - g.mean * c.c) * (c.s - g.mean * c.c)) as ss from c join g using (signal) group by g.signal)
select signal, cast(n as bigint) as n, clusters, round(mean, 6) as mean, round(sqrt(ss * clusters / (clusters - 1)) / n, 6) as se, round(mean / (sqrt(ss * clusters / (clusters - 1)) / n), 4) as t from g join v using (signal)""")
def h_clustered_mean(spark, sf_dir):
    out = inference.clustered_mean(trades_of(spark, sf_dir), "ret", ["dt"], ["signal"])
    return out.select("signal", "n", "clusters", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


@query(f"""with {_TRADES}, q as (select signal, quantile_cont(ret, 0.005) as lo, quantile_cont(ret, 0.995) as hi from tr group by 1), t as (select signal, avg(ret) as trimmed_mean from tr join q using (signal) where ret between lo and hi group by 1),
a as (select signal, dt, abs(sum(ret)) as a from tr group by 1, 2), s as (select signal, sum(case when n <= 5 then a end) / sum(a) as top5_share from (select *, row_number() over (partition by signal order by a desc, dt) as n from a) group by 1)
select signal, {r('trimmed_mean', 'top5_share')} from t join s using (signal)""")
def h_concentration(spark, sf_dir):
    return rounded(inference.concentration(trades_of(spark, sf_dir), "ret", "dt", ["signal"]))


@query(f"""with {_TRADES}, d as (select signal, dt, avg(ret) as ret from tr group by 1, 2), e as (select *, ret - avg(ret) over (partition by signal) as e, count(*) over (partition by signal) as n from d),
l as (select signal, n, e * e + """ + " + ".join(f"2 * (1 - {k} / 6.0) * coalesce(e * lag(e, {k}) over (partition by signal order by dt), 0)" for k in range(1, 6)) + """ as term, ret from e)
select signal, count(*) as n, round(avg(ret), 6) as mean, round(sqrt(greatest(sum(term), 0)) / count(*), 6) as se, round(avg(ret) / (sqrt(greatest(sum(term), 0)) / count(*)), 4) as t from l group by signal""")
def h_newey_west(spark, sf_dir):
    d = trades_of(spark, sf_dir).groupBy("signal", "dt").agg(F.avg("ret").alias("ret"))
    out = inference.newey_west(d, "ret", "dt", ["signal"], 5)
    return out.select("signal", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


@query(f"""with {DAILY_SQL}, x as (select dt, adj_close / lag(adj_close) over w - 1 as a, volume as b from bars window w as (partition by symbol order by dt)), k as (select dt, rank() over (partition by dt order by a) + (count(*) over (partition by dt, a) - 1) / 2.0 as ra, rank() over (partition by dt order by b) + (count(*) over (partition by dt, b) - 1) / 2.0 as rb from x where a is not null and b is not null)
select dt, round(case when stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then corr(ra, rb) end, 6) as ic, count(*) as names from k group by dt having count(*) >= 10""")
def h_rank_ic(spark, sf_dir):
    return rounded(inference.rank_ic(returns(spark, sf_dir).withColumn("v", F.col("volume").cast("double")), "ret", "v", "dt", 10))


@query(f"""with {_TRADES}, x as (select *, row_number() over (partition by symbol order by dt) as n from tr), g as (select symbol, count(ret) as n, avg(ret) as m, stddev_samp(ret) as s from x where (n - 1) % 5 = 0 group by 1) select symbol, n, round(m / s * sqrt(252.0 / 5), 6) as sharpe, round(m / s * sqrt(n), 6) as t from g""")
def h_non_overlapping_sharpe(spark, sf_dir):
    return rounded(inference.sharpe(trades_of(spark, sf_dir), "ret", "dt", ["symbol"], 5))


@query(f"""with {_TRADES}, g as (select symbol, 1.0 / (1 + abs(avg(ret) / (stddev_samp(ret) / sqrt(count(*))))) as p from tr group by 1), k as (select *, row_number() over (order by p) as i, count(*) over () as m from g)
select symbol, {r('p')}, p <= 0.5::double * i / m as significant, round(least(1.0, p * m), 6) as bonferroni, round(least(1.0, min(p * m / i) over (order by i rows between current row and unbounded following)), 6) as bh_p from k""")
def h_multiple_testing(spark, sf_dir):
    g = trades_of(spark, sf_dir).groupBy("symbol").agg((1 / (1 + F.abs(F.avg("ret") / (F.stddev_samp("ret") / F.sqrt(F.count(F.lit(1))))))).alias("p"))
    return rounded(inference.bh_flags(g, "p", [], 0.5))


@query(f"""with {_TRADES}, a as (select dt, avg(ret) as x from tr where signal = 'a' group by 1), b as (select dt, avg(ret) as y from tr where signal = 'b' group by 1), d as (select x - y as d from a join b using (dt)) select count(d) as n, round(avg(d), 6) as mean, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) as t from d""")
def h_paired_difference(spark, sf_dir):
    t = trades_of(spark, sf_dir)
    return rounded(inference.paired_difference(t.where("signal = 'a'"), t.where("signal = 'b'"), "dt", "ret"))


@query(f"""with {_TRADES}, d as (select dt, avg(case when signal = 'a' then ret end) as a, avg(case when signal = 'b' then ret end) as b from tr group by 1), g as (select count(*) as n, corr(a, b) as r, avg(a) / stddev_samp(a) as x, avg(b) / stddev_samp(b) as y from d where a is not null and b is not null)
select n, round(x, 6) as sharpe_a, round(y, 6) as sharpe_b, round((x - y) / sqrt((2 - 2 * r + 0.5 * (x * x + y * y - 2 * x * y * r * r)) / n), 4) as z from g""")
def h_sharpe_difference(spark, sf_dir):
    d = trades_of(spark, sf_dir).groupBy("dt").agg(F.avg(F.when(F.col("signal") == "a", F.col("ret"))).alias("a"), F.avg(F.when(F.col("signal") == "b", F.col("ret"))).alias("b")).where("a is not null and b is not null")
    out = inference.sharpe_difference(d, "a", "b")
    return out.select("n", F.round("sharpe_a", 6).alias("sharpe_a"), F.round("sharpe_b", 6).alias("sharpe_b"), F.round("z", 4).alias("z"))


@query()
def h_leaderboard(spark, sf_dir):
    g = trades_of(spark, sf_dir).groupBy("symbol", "signal").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sharpe"), F.count(F.lit(1)).alias("n"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    return rounded(inference.leaderboard(g.withColumn("trials", F.lit(40))))


@query()
def h_iid_bootstrap(spark, sf_dir):
    d = trades_of(spark, sf_dir).groupBy("signal", F.trunc("dt", "month").alias("month")).agg(F.avg("ret").alias("ret"))
    return rounded(inference.iid_bootstrap_p(d, "ret", ["signal"], ["month"]))


@query()
def h_reality_check(spark, sf_dir):
    d = trades_of(spark, sf_dir).groupBy("dt").agg(F.coalesce(F.avg(F.when(F.col("signal") == "a", F.col("ret"))), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.when(F.col("signal") == "b", F.col("ret"))), F.lit(0.0)).alias("b"))
    return rounded(inference.reality_check(d, ["a", "b"], "dt"))


@query(f"""with {DAILY_SQL}, {_RET}, x as (select b.symbol, b.dt, r.ret, ln(volume) as size, substr(b.symbol, 6, 1) as sector from bars b join ret r using (symbol, dt)), k as (select *, ret is not null and size is not null as ok from x), n as (select *, count(*) filter (ok) over (partition by dt) as names from k),
d as (select *, ret - avg(case when ok then ret end) over (partition by dt, sector) as yd, size - avg(case when ok then size end) over (partition by dt, sector) as xd from n), b as (select dt, sum(case when ok then xd * yd end) / nullif(sum(case when ok then xd * xd end), 0) as b from d group by dt)
select symbol, d.dt, round(case when ok and names >= 12 then yd - coalesce(b, 0) * xd end, 6) as residual from d join b on d.dt = b.dt""")
def h_residualize(spark, sf_dir):
    df = returns(spark, sf_dir).withColumn("size", F.log("volume")).withColumn("sector", F.col("symbol").substr(6, 1)).select("symbol", "dt", "ret", "size", "sector")
    return rounded(inference.residualize(df, "ret", ["size"], "sector", "dt", 12).select("symbol", "dt", "residual"))


@query(f"""with {DAILY_SQL}, p as (select *, lag(high) over w as h1, lag(low) over w as l1, lag("close") over w as c1 from bars window w as (partition by symbol order by dt)),
g as (select symbol, dt, high - greatest(0, low - c1) + greatest(0, c1 - high) as h, low - greatest(0, low - c1) + greatest(0, c1 - high) as l, h1, l1 from p where c1 is not null),
b as (select symbol, dt, power(ln(h1 / l1), 2) + power(ln(h / l), 2) as beta, power(ln(greatest(h1, h) / least(l1, l)), 2) as gamma from g where l > 0 and l1 > 0 and h > 0),
a as (select symbol, dt, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0)) - sqrt(gamma / (3 - 2 * sqrt(2.0))) as alpha from b)
select symbol, dt, round(greatest(0, 2 * (exp(alpha) - 1) / (1 + exp(alpha))), 6) as spread from a""")
def i_corwin_schultz(spark, sf_dir):
    return rounded(costs.corwin_schultz(daily_bars(spark, sf_dir)))


@query(f"""with {DAILY_SQL}, x as (select symbol, dt, avg("close" * volume) {_W.format(19)} as adv, "close" as c from bars)
select symbol, dt, round(greatest(least(greatest(2 * sqrt(212e6) / sqrt(greatest(adv, 1e5)), 10000 * 0.005::double / greatest(c, 1)), 150.0), 1.0), 6) as half_spread_bp from x""")
def i_liquidity_half_spread(spark, sf_dir):
    adv = F.avg(F.col("close") * F.col("volume")).over(features.last_rows(20))
    return rounded(daily_bars(spark, sf_dir).withColumn("adv", adv).select("symbol", "dt", costs.liquidity_half_spread(F.col("adv"), F.col("close")).alias("half_spread_bp")))


from . import catalog_files, catalog_filings, catalog_more, catalog_reports, catalog_rules  # noqa: E402, F401  (they add their queries to the registry above)
