"""Registered queries over rules of what is known when, reports of a value series, robust scores and break-even costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, features, inference, pit, quality
from ..sources.adapters import DAILY_SQL, customer_symbol, daily_bars, symbol_sql, table
from .catalog import _TRADES, query, rounded, trades_of
from .catalog_reports import _SCORED, _scored


@query(f"""with {_TRADES}, x as (select t.*, b."close" as price from tr t join bars b using (symbol, dt)), c as (select signal, dt, sum(ret) as s, count(*) as c from x group by 1, 2), g as (select signal, sum(c) as n, count(*) as k, sum(s) / sum(c) as m from c group by signal),
v as (select signal, g.n, m, sqrt(sum(power(s - m * c.c, 2)) * k / (k - 1)) / g.n as se from c join g using (signal) group by signal, g.n, m, k), f as (select signal, median(0.01::double / price) as floor_ from x group by 1)
select signal, round(m * 1e4, 4) as gross_bp, round(m / se, 4) as t_gross, round((m - 1.96::double * se) * 1e4, 4) as lower95_bp, round(floor_ * 1e4, 4) as one_cent_floor_bp, round((1.959963984540054::double + 0.8416212335729143::double) * se * 1e4, 4) as mde_bp,
case when m / se < 1.96 then 'no gross edge' when m - 1.96::double * se < floor_ then 'below the one-cent floor' else 'clears the floor' end as verdict from v join f using (signal)""")
def h_break_even(spark, sf_dir):
    t = trades_of(spark, sf_dir).join(daily_bars(spark, sf_dir).select("symbol", "dt", F.col("close").alias("price")), ["symbol", "dt"])
    return rounded(inference.break_even_report(t, "ret", ["dt"], "price", ["signal"]), 4)


@query(f"""with {_SCORED.split('w as (select model, fold')[0].rstrip().rstrip(',')}, r as (select model, symbol, dt, row_number() over (partition by model, dt order by probability desc, symbol) as position, count(*) over (partition by model, dt) as candidates from scored)
select model, symbol, dt, position, candidates, position <= 10 as selected from r""")
def e_model_ranks(spark, sf_dir):
    return features.ranked_predictions(_scored(spark, sf_dir), "probability", ["model", "dt"], ["symbol"], 10).select("model", "symbol", "dt", F.col("position").cast("long").alias("position"), "candidates", "selected")


@query(f"""with {DAILY_SQL}, c as (select distinct dt from bars), o as (select o_orderkey, o_orderdate + to_seconds(o_orderkey * 977 % 86400) as ts, cast(o_orderdate as date) as d, o_orderkey % 86400 as s from orders),
m as (select distinct date_trunc('month', d) as mo, (date_trunc('month', d) + interval 2 month) as until from o), me as (select mo, max(dt) as last_ from m join c on c.dt < until group by 1), mf as (select mo, min(dt) as first_ from m join c on c.dt >= mo group by 1),
n as (select o_orderkey, min(c.dt) as nxt from o left join c on c.dt > o.d group by 1), f as (select o_orderkey, min(c.dt) as day from o join c on (c.dt > o.d or (c.dt = o.d and hour(ts) < 16)) group by 1)
select o_orderkey, d + interval 16 hour as at_close, nxt + interval 570 minute as next_open, case when d in (select dt from c) and hour(ts) * 60 + minute(ts) between 1 and 959 then date_trunc('minute', ts) else nxt + interval 570 minute end as announced,
last_ + interval 16 hour as month_after, first_ + interval 570 minute as month_open, f.day as acts_on from o join n using (o_orderkey) left join me on me.mo = date_trunc('month', d) left join mf on mf.mo = date_trunc('month', d) left join f using (o_orderkey)""")
def j_known_at(spark, sf_dir):
    """Every fifth second of the day is taken by some order, before, during and after the session."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.timestamp_seconds(F.unix_timestamp("o_orderdate") + k * 977 % 86_400).alias("ts"))
    days = features.calendar(daily_bars(spark, sf_dir))
    for kind in ("at_close", "next_open", "announced", "month_after", "month_open"):
        o = pit.known_at(o, days, "ts", kind, kind)
    return pit.acts_on(o, days, "ts", "acts_on").drop("ts")


@query(f"""with {_TRADES}, q as (select quantile_cont(ret, 0.005) as lo, quantile_cont(ret, 0.995) as hi from tr), f as (select min(dt) as d0 from tr),
bad as (select distinct symbol from (select symbol, case when volume % 50 = 7 then 5 * adj_close else adj_close end / lag(case when volume % 50 = 7 then 5 * adj_close else adj_close end) over (partition by symbol order by dt) - 1 as m, open, "close" as c from bars) where m > 3 or m < -0.9 or abs(open / c - 1) > 0.5),
s as (select signal, 'raw' as version, symbol, dt, ret from tr union all select signal, 'clean', symbol, dt, ret from tr where symbol not in (select symbol from bad) union all select signal, 'trimmed', symbol, dt, greatest(least(ret, hi), lo) from tr, q),
c as (select signal, version, floor(date_diff('day', d0, dt) / 14.0) as b, sum(ret) as s, count(*) as c from s, f group by 1, 2, 3), g as (select signal, version, sum(c) as n, count(*) as k, sum(s) / sum(c) as m from c group by 1, 2),
v as (select signal, version, m, k, g.n, sqrt(sum(power(s - m * c.c, 2)) * k / nullif(k - 1, 0)) / g.n as se from c join g using (signal, version) group by signal, version, m, k, g.n),
t5 as (select signal, sum(a) / sum(all_) as share from (select signal, case when row_number() over (partition by signal order by abs(ret) desc) <= 5 then abs(ret) else 0 end as a, abs(ret) as all_ from tr) group by 1)
select signal, cast(max(case when version = 'raw' then n end) as bigint) as trades, {", ".join(f"round(max(case when version = '{v}' then m end), 6) as mean_{v}, round(max(case when version = '{v}' then m / nullif(se, 0) end), 4) as t_{v}" for v in ("raw", "clean", "trimmed"))},
max(case when version = 'trimmed' then k end) as blocks, round(max(share), 6) as top5_share from v join t5 using (signal) group by signal""")
def g_robust_scores(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    bad = quality.severe_symbols(bars.withColumn("adj_close", F.when(F.col("volume") % 50 == 7, 5 * F.col("adj_close")).otherwise(F.col("adj_close"))))
    out = inference.robust_scores(trades_of(spark, sf_dir), bad, "ret", "signal", hold=5)
    return out.select("signal", "trades", "blocks", *(F.round(f"{c}_{v}", n).alias(f"{c}_{v}") for c, n in (("mean", 6), ("t", 4)) for v in ("raw", "clean", "trimmed")), F.round("top5_share", 6).alias("top5_share"))


_U = "e * (a00 + a01 * x)"


@query(f"""with {DAILY_SQL}, mk as (select dt, avg("close" / open - 1) as x from bars group by 1), r as (select symbol, b.dt, adj_close / lag(adj_close) over (partition by symbol order by b.dt) - 1 as y, x from bars b join mk on b.dt = mk.dt), k as (select * from r where y is not null),
s as (select symbol, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy, sum(y * y) as syy, covar_samp(y, x) / var_samp(x) as beta from k group by 1 having count(*) > 30),
d as (select symbol, covar_samp(y, x) / nullif(var_samp(x), 0) as down_beta from k where x < 0 group by 1),
e as (select k.symbol, dt, x, y - (sy - beta * sx) / n - beta * x as e, sxx / (n * sxx - sx * sx) as a00, -sx / (n * sxx - sx * sx) as a01 from k join s using (symbol)),
u as (select symbol, e, {_U} as u, {", ".join(f"lag({_U}, {i}) over (partition by symbol order by dt) as u{i}" for i in range(1, 6))} from e),
v as (select symbol, sum(u * u) {" ".join(f"+ 2 * {1 - i / 6}::double * sum(coalesce(u * u{i}, 0))" for i in range(1, 6))} as var_, sum(e * e) as sse from u group by 1)
select symbol, n, round((sy - beta * sx) / n * 252, 5) as alpha_annual, round((sy - beta * sx) / n / sqrt(var_), 4) as alpha_t, round(beta, 6) as beta, round(down_beta, 5) as down_beta, round(1 - sse / (syy - sy * sy / n), 6) as r2 from s join v using (symbol) left join d using (symbol)""")
def h_nav_factors(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    market = bars.groupBy("dt").agg(F.avg(F.col("close") / F.col("open") - 1).alias("market"))
    nav = bars.select("symbol", F.col("dt").alias("day"), F.col("adj_close").alias("nav")).join(market.withColumnRenamed("dt", "day"), "day")
    out = inference.nav_factors(nav, ["symbol"], "market").where("n > 30")
    places = {"alpha_annual": 5, "alpha_t": 4, "beta": 6, "down_beta": 5, "r2": 6}
    return out.select("symbol", "n", *(F.round(c, p).alias(c) for c, p in places.items()))


@query(f"""with {DAILY_SQL}, n as (select symbol, avg(adj_close) as level, count(*) as days from bars group by 1), t as (select {symbol_sql('o_custkey // 15')} as symbol, sum((o_orderkey % 9 + 1) * o_totalprice / 1e4 + case when o_orderkey % 3 > 0 then (o_orderkey % 9 + 1) * o_totalprice / 9e3 else 0 end) as traded from orders group by 1)
select symbol, round(traded / level / (days / 252.0::double), 5) as turnover_per_year from n join t using (symbol)""")
def h_nav_turnover(spark, sf_dir):
    nav = daily_bars(spark, sf_dir).select("symbol", F.col("dt").alias("day"), F.col("adj_close").alias("nav"))
    k = F.col("o_orderkey")
    trades = table(spark, sf_dir, "orders").select(customer_symbol(F.col("o_custkey")).alias("symbol"), (k % 9 + 1).alias("qty"), (F.col("o_totalprice") / 1e4).alias("entry_px"), F.when(k % 3 > 0, F.col("o_totalprice") / 9e3).alias("exit_px"))
    return rounded(inference.nav_turnover(nav, trades, ["symbol"]), 5)


@query(f"""with {DAILY_SQL}, p as (select symbol, dt, "close" as price, volume, high * (1 + (volume % 5) / 40.0::double) as value, case when volume % 4 > 0 then (high - low) / 100 end as hs, avg("close" * volume) over (partition by symbol order by dt rows 19 preceding) as adv from bars), m as (select dt, median(hs) as mid from p group by 1),
d as (select p.*, coalesce(hs, mid, 0.0025::double) as h, cast(floor(least(1e6 * 0.05::double, 0.01::double * coalesce(adv, 0)) / price) as bigint) as shares from p join m using (dt))
select symbol, dt, shares, round((value - price) / price, 6) as raw_discount, round((value - price * (1 + h) - 20 / case when shares > 0 then shares end - 0.01::double) / price, 6) as net_discount, (value - price) / price > 0.1::double as suspect, coalesce(volume, 0) > 0 as traded from d""")
def f_discount_flags(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    v = F.col("volume")
    panel = bars.select("symbol", "dt", F.col("close").alias("price"), "volume", (F.col("high") * (1 + v % 5 / F.lit(40.0))).alias("value"), F.when(v % 4 > 0, (F.col("high") - F.col("low")) / 100).alias("half_spread"), F.avg(F.col("close") * v).over(features.last_rows(20)).alias("adv"))
    return rounded(events.discount_flags(panel).select("symbol", "dt", "shares", "raw_discount", "net_discount", "suspect", "traded"))
