"""Registered queries over reports, sorts, exits, state positions and the pooled evaluation of models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import aggregates, costs, events, features, inference, joins, modelling, outcomes, pit, quality, signals, windows
from ..sources import readers
from ..sources.adapters import CUSTOMER_SYMBOL_SQL, DAILY_SQL, SESSION_SQL, customer_symbol, daily_bars, session_bars, table, trading_days
from ..sources.shared import written
from .catalog import _RET, _TRADES, FEATURES_SQL, LABELS_SQL, query, returns, rounded, trades_of

_MARKET = """market as (select dt, avg(open) as open, avg("close") as c, avg(adj_close) as a from bars group by dt),
m1 as (select dt, case when lead(case when c > 0 then open * a / c end, 1) over (order by dt) > 0 then lead(a, 5) over (order by dt) / lead(case when c > 0 then open * a / c end, 1) over (order by dt) end - 1 as b from market)"""


@query(f"""with {DAILY_SQL}, {_MARKET}, x as (select symbol, dt, lead(adj_close, 5) over w as a5, lead(case when "close" > 0 then open * adj_close / "close" end, 1) over w as o from bars window w as (partition by symbol order by dt))
select symbol, x.dt, round(case when o > 0 then a5 / o end - 1, 6) as fwd, round(case when o > 0 then a5 / o end - 1 - b, 6) as abnormal from x left join m1 on x.dt = m1.dt""")
def f_abnormal_return(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    market = bars.groupBy("dt").agg(*(F.avg(c).alias(c) for c in ("open", "close", "adj_close")))
    return rounded(features.abnormal_return(bars, market, 5))


@query(f"""with {DAILY_SQL}, {_RET}, s as (select b.symbol, b.dt, r.ret, 0.0001::double as rf, b.adj_close > avg(b.adj_close) over (partition by b.symbol order by b.dt rows between 19 preceding and current row) as state from bars b join ret r using (symbol, dt)),
h as (select *, lag(state) over (partition by symbol order by dt) as held from s), k as (select * from h where held is not null and ret is not null),
w as (select *, coalesce(lag(held) over (partition by symbol order by dt) <> held, true) as switch from k)
select symbol, dt, held, switch, round(case when held then ret else rf end - case when switch then 0.001::double else 0 end, 6) as ret from w""")
def e_state_position(spark, sf_dir):
    df = returns(spark, sf_dir).withColumn("rf", F.lit(0.0001)).withColumn("sma", F.avg("adj_close").over(features.last_rows(20)))
    return rounded(windows.state_position(df, F.col("adj_close") > F.col("sma"), "ret", "rf", ["symbol"], ["dt"], 0.001).select("symbol", "dt", "held", "switch", "ret"))


@query(f"""with {DAILY_SQL}, d as (select dt, avg("close") as level from bars group by dt), e as (select quantile_cont(level, [1 / 3.0, 2 / 3.0]) as cuts from d)
select dt, cast(len(list_filter(cuts, lambda x: x < level)) as integer) as band from d, e""")
def e_percentile_bands(spark, sf_dir):
    d = daily_bars(spark, sf_dir).groupBy("dt").agg(F.avg("close").alias("level"))
    return windows.percentile_bands(d, "level", 3, ["dt"]).select("dt", "band")


@query()
def f_structural_exits(spark, sf_dir):
    bars = session_bars(spark, sf_dir)
    unit = bars.groupBy("symbol", "session").agg(F.avg((F.col("high") - F.col("low")) / F.col("close")).alias("r"))
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(-20, -1)
    unit = unit.select("symbol", "session", F.when(F.count("r").over(w) >= 5, F.avg("r").over(w)).alias("unit"))
    return rounded(outcomes.structural_exits(bars, unit))


@query(f"""with {FEATURES_SQL}, {LABELS_SQL[len(DAILY_SQL) + 2 :]}, n as (select f.dt, l.fwd_5, row_number() over (partition by f.dt order by f.mom_21, f.symbol) as i, count(*) over (partition by f.dt) as n from features f join labels l using (symbol, dt) where f.mom_21 is not null),
m as (select case when n = 1 then 0 else greatest(0, ceil((i - 1) * 5.0 / (n - 1)) - 1) end as bucket, avg(fwd_5) as m from n where fwd_5 is not null group by 1), a as (select list(m order by bucket) as l from m)
select round(l[len(l)] - l[1], 6) as spread, len(list_filter(range(2, len(l) + 1), lambda k: l[k] < l[k - 1])) = 0 or len(list_filter(range(2, len(l) + 1), lambda k: l[k] > l[k - 1])) = 0 as monotone from a""")
def h_bucket_spread(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    f = features.price_features(bars).where("mom_21 is not null").select("symbol", "dt", "mom_21").join(features.forward_labels(bars).select("symbol", "dt", "fwd_5"), ["symbol", "dt"])
    f = f.withColumn("bucket", features.quantile_bucket("mom_21", ["dt"], 5, ["symbol"]))
    return rounded(inference.bucket_spread(f, "bucket", "fwd_5", []).select("spread", "monotone"))


def _tercile(x: str) -> str:
    return f"case when count(*) over (partition by dt) = 1 then 0 else greatest(0, ceil((row_number() over (partition by dt order by {x}, symbol) - 1) * 3.0 / (count(*) over (partition by dt) - 1)) - 1) end"


@query(f"""with {FEATURES_SQL}, {LABELS_SQL[len(DAILY_SQL) + 2 :]}, k as (select symbol, dt, mom_21, rel_volume, fwd_5 from features join labels using (symbol, dt) where mom_21 is not null and rel_volume is not null and fwd_5 is not null),
c as (select fwd_5, {_tercile("mom_21")} as a, {_tercile("rel_volume")} as b from k)
select cast(a as integer) as bucket, {", ".join(f"round(avg(case when b = {i} then fwd_5 end), 6) as cell_{i}" for i in range(3))}, count(*) as n, round(avg(case when b = 0 then fwd_5 end) - avg(case when b = 2 then fwd_5 end), 6) as low_minus_high from c group by 1""")
def h_double_sort(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    f = features.price_features(bars).select("symbol", "dt", "mom_21", "rel_volume").join(features.forward_labels(bars).select("symbol", "dt", "fwd_5"), ["symbol", "dt"])
    return rounded(inference.double_sort(f, "mom_21", "rel_volume", "fwd_5", ["dt"], ["symbol"]))


@query(f"""with {_TRADES}, s as (select signal, dt, count(*) as n, sum(ret) as s, sum(ret - 0.0002::double) as e from tr group by 1, 2)
select signal, cast(sum(n) as bigint) as trades, count(*) as sessions, round(sum(s) / sum(n), 6) as ret_tw, round(avg(s / n), 6) as ret_sw, round(sum(e) / sum(n), 6) as net_tw, round(avg(e / n), 6) as net_sw, round(avg(s / n) / (stddev_samp(s / n) / sqrt(count(*))), 4) as t from s group by signal""")
def h_weighted_means(spark, sf_dir):
    out = inference.weighted_means(trades_of(spark, sf_dir).withColumn("net", F.col("ret") - 0.0002), "dt", ["ret", "net"], ["signal"])
    return rounded(out.drop("p", "t")).join(out.select("signal", F.round("t", 4).alias("t")), "signal")


@query(f"""with {_TRADES}, m as (select symbol, dt, 100 * ret as x, row_number() over (order by 100 * ret desc) as i, year(dt) as y, date_trunc('month', dt) as mo from tr),
s as (select 'all' as slice, x, y, mo from m union all select 'drop_top_5', x, y, mo from m where i > 5 union all select 'year_' || y, x, y, mo from m),
g as (select slice, count(*) as events, avg(x) as mean, median(x) as median, avg(case when x > 0 then 1.0 else 0.0 end) as win_rate, quantile_cont(x, 0.1) as p10, min(x) as worst, stddev_samp(x) as sd, sum(case when x > 0 then x end) as gain, sum(x) as total, max(y) - min(y) + 1 as years from s group by slice),
t as (select slice, sum(x) as top from (select slice, x, row_number() over (partition by slice order by x desc) as k from s) where k <= 5 group by slice),
c as (select slice, mo, sum(x) as cs, count(*) as cn from s group by 1, 2), v as (select c.slice, count(*) as clusters, sum(power(cs - mean * cn, 2)) as ss from c join g using (slice) group by 1)
select slice, events, {", ".join(f"round({c}, 6) as {c}" for c in ("mean", "median", "win_rate", "p10", "worst", "sd"))}, round(top / gain, 6) as top_share, round(mean / (sqrt(ss * clusters / (clusters - 1)) / events), 4) as t, clusters, round(total / case when slice like 'year%' then 1 else years end, 4) as per_year
from g join t using (slice) join v using (slice)""")
def h_event_table(spark, sf_dir):
    out = inference.event_table(trades_of(spark, sf_dir).withColumn("x", 100 * F.col("ret")), "x", "dt")
    return rounded(out.select(*(c for c in out.columns if c not in ("t", "per_year")), F.round("t", 4).alias("t"), F.round("per_year", 4).alias("per_year")))


@query(f"""with {DAILY_SQL}, n as (select symbol, dt, adj_close as nav, 0.5::double * adj_close as mv from bars), r as (select *, nav / lag(nav) over (partition by symbol order by dt) - 1 as r, nav / max(nav) over (partition by symbol order by dt) - 1 as fall from n),
m as (select symbol, date_trunc('month', dt) as mo, product(1 + r) - 1 as e from r where r is not null group by 1, 2), e as (select *, e - avg(e) over (partition by symbol) as d, count(*) over (partition by symbol) as n from m),
l as (select *, least(24, floor(4 * power(n / 100.0, 2 / 9.0))) as lags from e), q as (select *, d * d + {" + ".join(f"case when lags >= {k} then 2 * (1 - {k} / (lags + 1)) * coalesce(d * lag(d, {k}) over (partition by symbol order by mo), 0) else 0 end" for k in range(1, 9))} as term from l),
g as (select symbol, count(*) as months, avg(e) as mean, sqrt(greatest(sum(term), 0)) / count(*) as se, stddev_samp(e) as sd from q group by 1), h as (select symbol, min(fall) as dd, avg(mv / nav) as cap from r group by 1)
select symbol, months, round(mean, 6) as mean_monthly_excess, round(case when se > 0 then mean / se end, 4) as t_nw, round(mean / sd * sqrt(12), 6) as sharpe, round(dd, 6) as max_drawdown, round(cap, 6) as capacity_used from g join h using (symbol)""")
def h_nav_report(spark, sf_dir):
    nav = daily_bars(spark, sf_dir).select("symbol", F.col("dt").alias("day"), F.col("adj_close").alias("nav"), (0.5 * F.col("adj_close")).alias("market_value"))
    out = inference.nav_report(nav, ["symbol"])
    return rounded(out.drop("t_nw")).join(out.select("symbol", F.round("t_nw", 4).alias("t_nw")), "symbol")


def _scored(spark, sf_dir):
    """Two models' made-up probabilities over the forward returns, so that evaluation itself can be said in SQL."""
    pick = lambda salt: F.conv(F.substring(F.md5(F.concat(F.col("symbol"), F.col("dt").cast("string"), F.lit(salt))), 1, 4), 16, 10).cast("long") / 65536
    rows = features.forward_labels(daily_bars(spark, sf_dir)).where("fwd_5 is not null").select("symbol", "dt", "fwd_5", F.col("win_5").cast("double").alias("label"), F.year("dt").cast("long").alias("fold"))
    return rows.select("*", F.lit("hash").alias("model"), F.round(pick("a"), 3).alias("probability")).unionByName(rows.select("*", F.lit("mixed").alias("model"), F.round(0.5 * pick("b") + 0.5 * F.col("label"), 3).alias("probability")))


_SCORED = f"""{LABELS_SQL}, rows_ as (select symbol, dt, fwd_5, cast(cast(fwd_5 - 0.0014::double > 0 as integer) as double) as label, year(dt) as fold from labels where fwd_5 is not null),
scored as (select *, 'hash' as model, round(cast('0x' || substr(md5(symbol || dt || 'a'), 1, 4) as bigint) / 65536.0::double, 3) as probability from rows_ union all select *, 'mixed', round(0.5::double * (cast('0x' || substr(md5(symbol || dt || 'b'), 1, 4) as bigint) / 65536.0::double) + 0.5::double * label, 3) from rows_),
k as (select *, row_number() over (partition by model, fold order by probability desc, symbol, dt) as i, count(*) over (partition by model, fold) as n, rank() over (partition by model, fold order by probability) + (count(*) over (partition by model, fold, probability) - 1) / 2.0 as rk from scored),
w as (select model, fold, count(*) as n, avg(label) as base_rate, avg(case when cast(probability >= 0.5 as integer) = label then 1.0 else 0.0 end) as accuracy, avg(power(probability - label, 2)) as brier, avg(fwd_5) as all_, count(distinct dt) as dates_available,
  case when sum(label) > 0 and sum(1 - label) > 0 then (sum(rk * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)) end as auc from k group by 1, 2),
top as (select * from k where i <= greatest(1, floor(0.1 * n))), nv as (select model, fold, avg(fwd_5) as top_naive, avg(label) as precision, stddev_samp(fwd_5) as sd, count(*) as top_n from top group by 1, 2),
pd as (select model, fold, dt, avg(fwd_5) as m, count(*) as c, row_number() over (partition by model, fold order by dt) as i, row_number() over (partition by model, fold order by count(*) desc, dt) as busy from top group by 1, 2, 3),
dd as (select model, fold, count(*) as dates, avg(m) as top_mean, avg(case when m > 0 then 1.0 else 0.0 end) as dates_up, median(c) as median_picks, max(c) as most_picks, sum(case when busy <= 10 then c end) / sum(c) as concentration, count(*) / 5.0 as n_effective,
  avg(case when (i - 1) % 5 = 0 then m end) as em, stddev_samp(case when (i - 1) % 5 = 0 then m end) as es, count(case when (i - 1) % 5 = 0 then m end) as en from pd group by 1, 2),
ev as (select model, fold, n, base_rate, accuracy, accuracy - greatest(base_rate, 1 - base_rate) as lift, brier, dates_available, auc, top_naive, precision, top_n, dates, top_mean, dates_up, median_picks, most_picks, concentration, n_effective,
  (top_mean - all_) * 10000 as edge_bps, dates / dates_available as dates_traded, case when en > 2 and es > 0 then em / es * sqrt(252.0 / 5) end as sharpe, case when en > 2 and es > 0 then em / es * sqrt(en) end as t, case when sd > 0 then top_naive / sd * sqrt(252.0 / 5) end as sharpe_naive
  from w join nv using (model, fold) join dd using (model, fold))"""
_EVALUATED = ["base_rate", "accuracy", "lift", "brier", "auc", "top_naive", "precision", "top_mean", "dates_up", "median_picks", "concentration", "n_effective", "dates_traded", "sharpe", "t", "sharpe_naive"]


@query(f"""with {_SCORED} select model, fold, n, dates_available, top_n, dates, most_picks, {", ".join(f"round({c}, 5) as {c}" for c in _EVALUATED)}, round(edge_bps, 2) as edge_bps from ev""")
def m_evaluate(spark, sf_dir):
    out = modelling.evaluate(_scored(spark, sf_dir), "fwd_5", ["model", "fold"])
    return out.select("model", "fold", "n", "dates_available", "top_n", "dates", "most_picks", *(F.round(c, 5).alias(c) for c in _EVALUATED), F.round("edge_bps", 2).alias("edge_bps"))


@query(f"""with {_SCORED} select model, count(*) as folds, round(avg(auc), 5) as auc, round(stddev_samp(auc), 5) as auc_sd, round(avg(top_mean), 5) as top_mean, round(stddev_samp(top_mean), 5) as top_mean_sd, round(avg(lift), 5) as lift, round(avg(sharpe), 4) as sharpe, round(avg(t), 4) as t, round(sum(n_effective), 4) as n_effective, cast(sum(top_n) as bigint) as top_n, count(*) filter (where top_mean > 0) as folds_up from ev group by model""")
def m_pooled(spark, sf_dir):
    p = modelling.pooled(modelling.evaluate(_scored(spark, sf_dir), "fwd_5", ["model", "fold"]), ["model"])
    return p.select("model", "folds", *(F.round(c, 5).alias(c) for c in ("auc", "auc_sd", "top_mean", "top_mean_sd", "lift")), *(F.round(c, 4).alias(c) for c in ("sharpe", "t", "n_effective")), "top_n", "folds_up")


@query()
def m_permutation_importance(spark, sf_dir):
    """On the last fold's rows, with few rounds of trees; the operator's defaults are those of production."""
    bars = daily_bars(spark, sf_dir)
    inputs = ["mom_21", "vol_20", "atr_pct", "dist_sma_20"]
    f = features.usable_rows(features.price_features(bars)).select("symbol", "dt", *inputs)
    # rows are written once, not once a fold: the last fold is known from their days
    rows = written(f.join(features.forward_labels(bars).select("symbol", "dt", "win_5"), ["symbol", "dt"]), "usable")
    folds = written(modelling.walk_forward(features.calendar(trading_days(spark, sf_dir))), "folds")
    last = modelling.split(rows.select("dt").distinct(), folds).agg(F.max("fold")).first()[0]
    mine = modelling.split(rows, folds.where(F.col("fold") == last))
    out = modelling.permutation_importance(mine.where("role = 'train'"), mine.where("role = 'test' and win_5 is not null"), inputs, "win_5", "trees", 3, 1, {"maxIter": 10})
    return rounded(out, 5)


@query(f"""with {DAILY_SQL}, c as (select dt, row_number() over (order by dt) - 1 as i from (select distinct dt from bars)), o as (select o_orderkey, cast(o_orderdate as date) as d from orders),
n as (select o_orderkey, min(c.i) as i from o left join c on c.dt > o.d group by 1) select n.o_orderkey, c.dt as tradeable from n left join c on c.i = n.i + 2""")
def c_next_session(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return pit.next_session(o, features.calendar(daily_bars(spark, sf_dir)), "d", "tradeable", strict=True, sessions=2).select("o_orderkey", "tradeable")


@query(f"""with {DAILY_SQL}, x as (select symbol, dt, volume % 7 as v, lag(volume % 7) over (partition by symbol order by dt) as b from bars where dt > date '1997-01-01'), o as (select symbol, arg_max(volume % 7, dt) as v from bars where dt <= date '1997-01-01' group by 1)
select x.symbol, x.dt, cast(x.v as bigint) as v from x left join o using (symbol) where coalesce(x.b, o.v) is null or coalesce(x.b, o.v) <> x.v""")
def g_changes(spark, sf_dir):
    df = daily_bars(spark, sf_dir).select("symbol", "dt", (F.col("volume") % 7).alias("v"))
    cut = F.lit("1997-01-01").cast("date")
    return quality.changes(df.where(F.col("dt") <= cut), df.where(F.col("dt") > F.date_sub(cut, 60)), ["symbol"], ["v"], "dt")


@query(f"""with {SESSION_SQL} select symbol, session, bar, round("close", 6) as "close" from hourly where bars_in_session = 7""")
def b_complete_sessions(spark, sf_dir):
    return rounded(signals.complete_sessions(session_bars(spark, sf_dir)).select("symbol", "session", "bar", "close"))


@query(f"""with {FEATURES_SQL} select symbol, dt, bar_num from features where bar_num > 200 and vol_20 is not null and atr_14 is not null and mom_126 is not null and sma_200 is not null and ret_1d is not null""")
def b_usable_rows(spark, sf_dir):
    return features.usable_rows(features.price_features(daily_bars(spark, sf_dir))).select("symbol", "dt", F.col("bar_num").cast("long").alias("bar_num"))


@query(f"""select {CUSTOMER_SYMBOL_SQL} as symbol, o_orderkey, row_number() over (partition by {CUSTOMER_SYMBOL_SQL} order by o_orderkey) as k from orders qualify k = 3""")
def e_kth_firing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(customer_symbol(F.col("o_custkey")).alias("symbol"), "o_orderkey")
    return windows.kth(o, ["symbol"], ["o_orderkey"], 3).select("symbol", "o_orderkey", F.lit(3).cast("long").alias("k"))


@query("""select o_orderkey, round(case when o_orderkey % 2 = 0 and b <= a and b > 0 and b >= 0.9::double * a then b end, 6) as bid, round(case when o_orderkey % 2 = 0 and b <= a and b > 0 and b >= 0.9::double * a then a end, 6) as ask, round(nullif(abs(b), 0), 6) as price, list_has_any(list_transform(string_split(o_orderpriority, '-'), lambda x: trim(x)), ['URGENT', 'HIGH']) as urgent
from (select *, o_totalprice / 1000 - 100 as b, (o_totalprice / 1000 - 100) * (1 + (o_orderkey % 7) / 37.0::double) + (case when o_orderkey % 2 = 0 then 0 else -1e9 end) as a from orders)""")
def b_quotes_and_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("b", F.col("o_totalprice") / 1000 - 100)
    o = o.withColumn("a", F.col("b") * (1 + (F.col("o_orderkey") % 7) / F.lit(37.0)) + F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(-1e9))
    bid, ask = events.valid_quote(F.col("b"), F.col("a"))
    urgent = events.item_overlap(F.replace("o_orderpriority", F.lit("-"), F.lit(",")), ["URGENT", "HIGH"])
    return rounded(o.select("o_orderkey", bid.alias("bid"), ask.alias("ask"), events.signed_price(F.col("b")).alias("price"), urgent.alias("urgent")))


@query("""select o_orderpriority, count(*) as n, avg(case when o_orderstatus = 'F' then 1.0::double else 0.0::double end) as "share_F", avg(case when o_orderstatus = 'O' then 1.0::double else 0.0::double end) as "share_O" from orders group by 1""")
def d_outcome_mix(spark, sf_dir):
    return aggregates.outcome_mix(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"])


@query(f"""with {DAILY_SQL}, s as (select symbol, cast(date_trunc('month', dt) as date) as month, greatest(least(median((high - low) / "close") * 10000, 1000), 1) as bp from bars group by 1, 2), l as (select symbol from bars group by 1 having sum(volume) % 2 = 0),
b as (select month, median(bp) as base from s join l using (symbol) group by 1) select symbol, s.month, round(greatest(least(2 * bp / base, 150), 1), 6) as half_spread_bp from s join b on s.month = b.month""")
def i_anchored_half_spread(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    monthly = costs.monthly_spread(bars.withColumn("spread", (F.col("high") - F.col("low")) / F.col("close")))
    return rounded(costs.anchored_half_spread(monthly, bars.groupBy("symbol").agg(F.sum("volume").alias("v")).where("v % 2 = 0").select("symbol")))


@query(f"""with {_TRADES}, f as (select min(dt) as d0 from tr), x as (select signal, floor(date_diff('day', d0, dt) / 14.0) as block, ret from tr, f), c as (select signal, block, sum(ret) as s, count(*) as n from x group by 1, 2), g as (select signal, sum(s) / sum(n) as m, sum(n) as n, count(*) as k from c group by 1)
select signal, cast(g.n as bigint) as n, k as clusters, round(m, 6) as mean, round(sqrt(sum(power(s - m * c.n, 2)) * k / (k - 1)) / g.n, 6) as se from c join g using (signal) group by signal, g.n, k, m""")
def h_block_clustered_mean(spark, sf_dir):
    t = trades_of(spark, sf_dir)
    first = t.agg(F.min("dt").alias("d0"))
    blocks = t.crossJoin(F.broadcast(first)).withColumn("block", inference.time_block("dt", F.col("d0"), 5))
    return rounded(inference.clustered_mean(blocks, "ret", ["block"], ["signal"]).select("signal", "n", "clusters", "mean", "se"))


@query(f"""with {DAILY_SQL} select (select count(distinct l_suppkey) from lineitem) as source_symbols, (select count(distinct symbol) from bars where dt >= date '1999-12-01') as built_symbols""")
def g_staleness(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    return quality.stale_symbols(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "symbol"), bars.where("dt >= date '1999-12-01'"))


@query("""select c_custkey, 'c_acctbal' as column, 'negative balance' as message, 'warn' as severity from customer where c_acctbal < 0 union all select c_custkey, 'c_mktsegment', 'unknown segment', 'error' from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')""")
def g_validate_rows(spark, sf_dir):
    rules = [("c_acctbal", "negative balance", "warn", F.col("c_acctbal") < 0), ("c_mktsegment", "unknown segment", "error", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))]
    return quality.validate_rows(table(spark, sf_dir, "customer"), "c_custkey", rules)


@query(f"""with {FEATURES_SQL} select symbol, dt, cast(0.51 as double) as always_long, cast(case when mom_21 > 0 then 0.60 else 0.40 end as double) as momentum_rule from features""")
def m_baselines(spark, sf_dir):
    return modelling.baselines(features.price_features(daily_bars(spark, sf_dir)), "mom_21").select("symbol", "dt", "always_long", "momentum_rule")


_FUNDAMENTALS = """fu as (select o_custkey as k, o_totalprice / 100 - 800 as income, o_totalprice - 150000 as equity, o_totalprice as assets, o_totalprice - o_orderkey % 1000 * 100 as assets_lag, o_totalprice / 200 as cash_flow, o_totalprice / 10 as gross_profit,
  cast(case when o_orderkey % 3 = 0 then o_orderkey % 100 end as double) as s1, cast(case when o_orderkey % 3 < 2 then o_orderkey % 90 end as double) as s2, cast(o_orderkey % 80 as double) as s3, o_orderkey from orders)"""


@query(f"""with {_FUNDAMENTALS}, c as (select *, (87 / 7.3::double) * coalesce(s1, s2, s3) as cap from fu)
select o_orderkey, round(case when cap > 0 then income / cap end, 6) as ep, round(case when cap > 0 then equity / cap end, 6) as bp, round(case when equity > 0 then income / equity end, 6) as roe, round(-(case when assets > 0 then (income - cash_flow) / assets end), 6) as accruals,
  round(-(case when assets_lag > 0 then assets / assets_lag end - 1), 6) as asset_growth, round(case when assets > 0 then gross_profit / assets end, 6) as profitability from c""")
def m_fundamental_ratios(spark, sf_dir):
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    shares = {"shares_cover": F.when(k % 3 == 0, k % 100), "shares_balance": F.when(k % 3 < 2, k % 90), "shares_weighted": k % 80}
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", (p / 100 - 800).alias("income"), (p - 150000).alias("equity"), p.alias("assets"), (p - k % 1000 * 100).alias("assets_lag"), (p / 200).alias("cash_flow"), (p / 10).alias("gross_profit"),
        *(x.cast("double").alias(c) for c, x in shares.items()),
    )
    return rounded(modelling.fundamental_ratios(df, F.lit(87 / 7.3)).select("o_orderkey", "ep", "bp", "roe", "accruals", "asset_growth", "profitability"))


@query(f"""with {DAILY_SQL}, adv as (select symbol, dt, avg(volume) over (partition by symbol order by dt rows between 19 preceding and current row) as adv from bars), r as (select {CUSTOMER_SYMBOL_SQL} as symbol, cast(o_orderdate as date) as d, max(o_orderkey % 5000) as short from orders group by 1, 2), q as (select *, lag(short) over (partition by symbol order by d) as before from r)
select a.symbol, a.dt, round(case when adv > 0 then -short / (adv * 21) end, 6) as short_level, round(case when before > 0 then -(short / before - 1) end, 6) as short_change, round(case when adv > 0 then -short / adv end, 6) as days_to_cover from adv a asof left join q on a.symbol = q.symbol and a.dt >= q.d""")
def m_short_interest(spark, sf_dir):
    panel = daily_bars(spark, sf_dir).select("symbol", "dt", F.avg("volume").over(features.last_rows(20)).alias("adv_shares"))
    reports = table(spark, sf_dir, "orders").groupBy(customer_symbol(F.col("o_custkey")).alias("symbol"), F.to_date("o_orderdate").alias("tradeable_from")).agg(F.max(F.col("o_orderkey") % 5000).alias("short"))
    return rounded(events.short_interest_signals(panel, reports).select("symbol", "dt", "short_level", "short_change", "days_to_cover"))


@query(f"""with {DAILY_SQL}, d as (select dt, row_number() over (order by dt) - 1 as i from (select distinct dt from bars)), k as (select symbol, i, "close" * 1000 as adv from bars join d using (dt)), t as (select {CUSTOMER_SYMBOL_SQL} as symbol, i, sum(case when o_orderkey % 2 = 0 then o_totalprice else 0 end) as b, sum(case when o_orderkey % 2 = 1 then o_totalprice else 0 end) as s from orders join d on cast(o_orderdate as date) = d.dt group by 1, 2)
select k.symbol, k.i as day_index, round(coalesce(sum(b - s), 0) / (any_value(adv) * 90), 4) as net_buying from k left join t on t.symbol = k.symbol and t.i between k.i - 90 and k.i group by 1, 2""")
def m_insider_signal(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    days = F.broadcast(features.calendar(bars).select("dt", F.col("day_index").cast("long").alias("day_index")))
    keys = bars.join(days, "dt").select("symbol", "day_index", (F.col("close") * 1000).alias("adv"))
    o = table(spark, sf_dir, "orders").select(customer_symbol(F.col("o_custkey")).alias("symbol"), F.to_date("o_orderdate").alias("dt"), "o_totalprice", (F.col("o_orderkey") % 2 == 0).alias("buy")).join(days, "dt")
    trades = o.groupBy("symbol", "day_index").agg(F.sum(F.when(F.col("buy"), F.col("o_totalprice")).otherwise(0)).alias("bought"), F.sum(F.when(~F.col("buy"), F.col("o_totalprice")).otherwise(0)).alias("sold"))
    return events.insider_signal(keys, trades, 90).select("symbol", "day_index", F.round("net_buying", 4).alias("net_buying"))


@query("""select o_orderkey, cast(case when cast(o_orderdate as date) < date '2017-09-05' then 3 when cast(o_orderdate as date) < date '2024-05-28' then 2 else 1 end as integer) as settles, year(o_orderdate - interval 3 month) || 'Q' || quarter(o_orderdate - interval 3 month) as previous, cast(o_orderdate as date) as parsed,
  case when o_orderkey % 5 > 0 then greatest(o_orderkey % 5, o_custkey) end as largest, ['one', 'twenty-one', '7', 'no number'][o_orderkey % 4 + 1] as word, [1, 21, 7, null][o_orderkey % 4 + 1] as number from orders""")
def j_scalars(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format(day, "dd-MMM-yyyy")).when(k % 3 == 1, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "MMMM d, yyyy"))
    word = F.element_at(F.array(*map(F.lit, ("one", "twenty-one", "7", "no number"))), (k % 4 + 1).cast("int"))
    return o.select(
        "o_orderkey", scalar.settlement_days(day).alias("settles"), scalar.previous_quarter(day).alias("previous"), scalar.parse_date(text, "dd-MMM-yyyy", "yyyyMMdd", "MMMM d, yyyy").alias("parsed"),
        scalar.poisoned(F.greatest, F.when(k % 5 > 0, k % 5), F.col("o_custkey")).alias("largest"), word.alias("word"), scalar.number_word(word).alias("number"),
    )


@query(f"""with o as (select {CUSTOMER_SYMBOL_SQL} as deal, o_orderkey as k, cast(case when o_orderkey % 3 = 0 then o_orderdate end as date) as ext, case when o_orderkey % 4 = 0 then o_totalprice end as fp, o_orderkey % 97 = 0 as term from orders)
select deal, arg_max(ext, k) filter (ext is not null) as extended_to, count(ext) as extensions, round(arg_min(fp, k) filter (fp is not null), 6) as final_price, min(k) filter (term) as terminated_on from o group by 1""")
def k_consolidated(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        customer_symbol(F.col("o_custkey")).alias("deal"), k.alias("at"), F.when(k % 3 == 0, F.to_date("o_orderdate")).alias("extended_to"), F.when(k % 4 == 0, F.col("o_totalprice")).alias("final_price"),
        F.lit(None).cast("double").alias("proration"), (k % 97 == 0).alias("terminated"),
    )
    return rounded(events.consolidated(o, "deal", "at").drop("proration"))


@query(f"""with {DAILY_SQL}, g as (select symbol from bars group by 1 having sum(volume) % 3 = 0) select symbol, dt, volume from bars where symbol in (select symbol from g)""")
def a_bars_of_kind(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    kinds = bars.groupBy("symbol").agg(F.when(F.sum("volume") % 3 == 0, "stock").otherwise("fund").alias("kind"))
    return readers.bars_of_kind(bars, kinds).select("symbol", "dt", "volume")


@query("""select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25""")
def o_top_rows(spark, sf_dir):
    """A report of the 25 largest."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("all"))
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select("c_custkey", "c_acctbal")


@query(f"""with {SESSION_SQL}, n as (select symbol, session, bar, open, "close" as c, row_number() over (partition by bar order by volume, symbol, session) as i, count(*) over (partition by bar) as n from hourly),
x as (select symbol, session, bar, cast(case when n = 1 then 0 else greatest(0, ceil((i - 1) * 10.0 / (n - 1)) - 1) end as integer) as decile, c < open - 0.3 as treated from n)
select symbol, session, bar, decile from x where not treated and (bar, decile) in (select (bar, decile) from x where treated)""")
def c_matched_controls(spark, sf_dir):
    rows = session_bars(spark, sf_dir).withColumn("decile", features.quantile_bucket("volume", ["bar"], 10, ["symbol", "session"]))
    return joins.matched_controls(rows, F.col("close") < F.col("open") - 0.3, ["bar", "decile"]).select("symbol", "session", "bar", "decile")


_MONTH_WEIGHTS = f"""{DAILY_SQL}, {_RET}, mw as (select b.symbol, cast(date_trunc('month', b.dt) as date) as month, sum(b.volume) as v, product(1 + coalesce(r.ret, 0)) - 1 as g from bars b join ret r using (symbol, dt) group by 1, 2), w as (select symbol, month, v / sum(v) over (partition by month) as w, g from mw), nx as (select month, lead(month) over (order by month) as nxt from (select distinct month from w))"""


def _month_weights(spark, sf_dir):
    m = returns(spark, sf_dir).groupBy("symbol", F.trunc("dt", "month").alias("month")).agg(F.sum("volume").alias("v"), (F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("g"))
    return m.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("month")))


@query(f"""with {_MONTH_WEIGHTS}, d as (select symbol, nxt as month, w * (1 + g) / sum(w * (1 + g)) over (partition by month) as w from w join nx using (month) where nxt is not null), u as (select month, symbol, w from w union all select month, symbol, -w from d)
select month, round(sum(abs(x)), 6) as turnover from (select month, symbol, sum(w) as x from u group by 1, 2) group by month""")
def e_drift_turnover(spark, sf_dir):
    return rounded(windows.drift_turnover(_month_weights(spark, sf_dir), "month", "symbol", "w", "g"))


@query(f"""with {_MONTH_WEIGHTS}, m as (select symbol, month from w where v_ok(symbol, month)), p as (select symbol, nxt as month from m join nx using (month) where nxt is not null),
u as (select month, symbol, max(a) as a, max(b) as b from (select month, symbol, 1 as a, 0 as b from m union all select month, symbol, 0, 1 from p) group by 1, 2)
select month, round(sum(abs(a - b)) / sum(a), 6) as turnover from u group by month having sum(b) > 0""".replace("v_ok(symbol, month)", "w > 0.009::double"))
def e_set_turnover(spark, sf_dir):
    return rounded(windows.set_turnover(_month_weights(spark, sf_dir).where("w > 0.009D"), "month", "symbol"))


@query()
def e_normal_targets(spark, sf_dir):
    return rounded(windows.normal_targets(_month_weights(spark, sf_dir).select("symbol", "month", "g"), "g", "month").select("symbol", "month", "target", "weight"))


@query("""select event_id, cast(ts - interval 5 hour as date) as session, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' as json from events""")
def j_sessions_and_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", scalar.session_date(F.col("ts"), "Etc/GMT+5").alias("session"), scalar.canonical_json(["user_id", "event_id", "event_type"]).alias("json"))
