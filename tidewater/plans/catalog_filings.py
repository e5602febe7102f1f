"""Registered queries over filings: texts written out of the orders' columns, so that SQL knows from the columns what must be read out of the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins, proximity, timelines
from ..operators.features import calendar as sessions
from ..sources.adapters import customer_symbol, daily_bars, table, trading_days
from ..sources.shared import written
from .catalog import query, rounded


def _long_day(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def _filler(n: Column) -> Column:
    """Plain sentences of about n characters."""
    return F.concat(F.repeat(F.lit("The company makes parts for pumps and valves. "), (n / 46).cast("int")), F.lit(" "))


def filings(spark, sf_dir, *parts: Column | str) -> DataFrame:
    """doc_id, filed, form, text: one filing an order, of the given parts. A file of orders holds many more texts than its size says, so rows are dealt out first."""
    o = table(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("k", F.col("o_orderkey")).withColumn("d", F.to_date("o_orderdate"))
    form = F.when(F.col("k") % 7 == 0, "424B3").when(F.col("k") % 7 < 3, "DEFM14A").otherwise("DEF 14A")
    return o.select(F.col("k").alias("doc_id"), F.col("d").alias("filed"), form.alias("form"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))


@query("""select o_orderkey as doc_id, case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 40 + 2 as int) end as ratio, o_orderkey % 5 = 0 as is_range from orders""")
def k_chosen_ratios(spark, sf_dir):
    n = (F.col("k") % 40 + 2).cast("string")
    chosen = F.when(F.col("k") % 5 == 0, "It has not chosen yet.").otherwise(F.concat(F.lit("The directors then set the reverse split at 1-for-"), n, F.lit(".")))
    return proximity.chosen_ratios(filings(spark, sf_dir, "Holders approved a reverse stock split in a range of 1-for-3 to 1-for-7. ", _filler(300 + F.col("k") % 900), chosen, _filler(F.lit(500)), "A drug was tried at 1-for-9 odds."))


@query("""select o_orderkey as doc_id, case when o_custkey % 100 = 0 then 10.1::double else round(10 + (o_custkey % 100) / 100.0::double, 2) end as stated_amount from orders""")
def k_redemption_amounts(spark, sf_dir):
    cents = F.format_string("$10.%02d per share", (F.col("o_custkey") % 100).cast("int"))
    round_one = F.when(F.col("o_custkey") % 100 == 0, "Holders may redeem at $10.10 per share. Holders who redeem get $10.10 per share.").otherwise("The initial redemption value was $10.00 per share.")
    return proximity.redemption_amounts(filings(spark, sf_dir, "Each warrant may be exercised for $11.50 per share. ", _filler(F.lit(400)), "Holders may redeem shares for ", cents, " from the trust account. ", _filler(F.lit(400)), round_one))


@query("""select o_orderkey as doc_id, case when o_custkey % 200 > 150 then null else round(10 + (o_custkey % 200) / 100.0::double, 2) end as trust_per_share,
case o_orderkey % 3 when 0 then 18 when 1 then 24 else cast(o_orderkey % 30 + 1 as int) end as deadline_months, 'TW' || chr(cast(65 + o_orderkey % 20 as int)) as symbol, case when o_orderkey % 2 = 0 then 'NYSE' else 'Nasdaq' end as exchange,
o_orderkey % 4 > 0 as has_warrant, o_orderkey % 4 = 2 as has_right from orders""")
def k_prospectus_terms(spark, sf_dir):
    k = F.col("k")
    amount = F.format_string("$%.2f per unit", 10 + (F.col("o_custkey") % 200) / 100)
    months = F.when(k % 3 == 0, "eighteen").when(k % 3 == 1, "twenty-four").otherwise((k % 30 + 1).cast("string"))
    symbol = F.concat(F.lit("TW"), F.char(65 + k % 20), F.lit("U"))
    unit = F.when(k % 4 == 0, "one share").when(k % 4 == 2, "one share, one warrant and one right").otherwise("one share and one half of one warrant")
    return proximity.prospectus_terms(filings(
        spark, sf_dir, "Units are sold at $10.50 per unit. ", _filler(F.lit(300)), amount, " will be held in a trust account. ", "We have within ", months, " months from the closing of this offering. Each unit consists of ", unit,
        ". ", "Our units will trade on ", F.when(k % 2 == 0, "NYSE").otherwise("Nasdaq"), " under the symbol \"", symbol, "\".",
    ))


@query("""with o as (select *, cast(o_orderdate as date) as d, case when o_orderkey % 7 = 0 then '424B3' when o_orderkey % 7 < 3 then 'DEFM14A' else 'DEF 14A' end as form from orders),
k as (select *, case when form = '424B3' and o_orderkey % 2 = 0 then 'not_a_proxy' when form != 'DEF 14A' then 'business_combination' when o_orderkey % 3 = 0 then 'extension' when o_orderkey % 3 = 1 then 'business_combination' else 'annual' end as kind from o)
select o_orderkey as doc_id, kind, case when kind != 'not_a_proxy' then d + 30 end as meeting, kind not in ('annual', 'not_a_proxy') as redemption_right,
case when kind != 'not_a_proxy' and o_orderkey % 15 <= 10 then cast(d + 30 - cast(o_orderkey % 15 as int) as date) end as redeem_by, case when kind != 'not_a_proxy' then 10.07::double end as stated_amount from k""")
def k_meeting_terms(spark, sf_dir):
    k, d = F.col("k"), F.col("d")
    what = F.when(k % 2 == 0, "The annual meeting").otherwise("The special meeting")
    why = F.when(k % 3 == 0, "We ask to extend the date of our charter. ").when(k % 3 == 1, "We ask for a vote on a business combination. ").otherwise("We elect directors. ")
    return proximity.meeting_terms(filings(
        spark, sf_dir, what, " will be held on ", _long_day(F.date_add(d, 30)), ". ", why, "You have the right to redeem your shares. ", "Shares must be tendered for redemption before ",
        _long_day(F.date_sub(F.date_add(d, 30), (k % 15).cast("int"))), ". ", "Holders who redeem get $10.07 per share.",
    ))


@query("""with o as (select o_orderkey, cast(o_orderdate as date) as d from orders)
select o_orderkey as doc_id, case when o_orderkey % 200 between 1 and 120 then cast(d + cast(o_orderkey % 200 as int) as date) end as postponed_to, cast(d + 200 as date) as extended_to,
o_orderkey % 3 = 0 as liquidation, case when o_orderkey % 3 = 0 then d + 20 end as liquidation_date, case when o_orderkey % 3 = 0 then 10.3::double end as liquidation_amount, case when o_orderkey % 3 = 0 then 10.3::double else 10.2::double end as per_share from o""")
def k_event_updates(spark, sf_dir):
    k, d = F.col("k"), F.col("d")
    gone = F.concat(F.lit("We will not complete a business combination and will redeem all outstanding shares. Shares will be redeemed on "), _long_day(F.date_add(d, 20)), F.lit(". The per-share redemption price is $10.30 per share."))
    paid = F.lit("Holders who redeemed were paid a redemption price of $10.20 per share.")
    return proximity.event_updates(filings(
        spark, sf_dir, "The meeting was adjourned to ", _long_day(F.date_add(d, (k % 200).cast("int"))), ". ", _filler(F.lit(400)), "Holders approved the extension. The deadline was extended to ", _long_day(F.date_add(d, 200)), ". ", F.when(k % 3 == 0, gone).otherwise(paid),
    ))


@query("""select o_orderkey as doc_id, cast(cast(o_orderdate as date) + 25 as date) as expires, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then 100 else 50 end as odd_lot,
o_orderkey % 4 in (1, 2) as odd_lot_priority, false as odd_lot_only, case o_orderkey % 3 when 0 then 'notes' when 1 then 'preferred' else 'common' end as security from orders""")
def k_offer_details(spark, sf_dir):
    k, d = F.col("k"), F.col("d")
    what = F.when(k % 3 == 0, "its 5% notes").when(k % 3 == 1, "its preferred shares").otherwise("its common shares")
    odd = F.when(k % 4 == 0, "There is nothing else to say. ").when(k % 4 == 1, "Odd lots have priority: holders of fewer than one hundred shares. ").when(k % 4 == 2, "Odd lots are bought without proration from owners of less than 50 shares. ").otherwise("An odd lot is fewer than 50 shares. ")
    return proximity.offer_details(filings(
        spark, sf_dir, "Offer to purchase ", what, ". ", _filler(F.lit(700)), "The offer expired terms of ", _long_day(F.date_sub(d, 40)), " were replaced: it expires at midnight on ", _long_day(F.date_add(d, 25)), ". ", odd,
    ))


@query("""select o_orderkey as doc_id, case o_orderkey % 6 when 0 then 'ROUNDUP_HOLDER' when 1 then 'CASH' when 2 then 'ROUNDUP_PARTICIPANT' when 3 then 'UNKNOWN' when 4 then 'DOWN' else 'CASH' end as treatment from orders""")
def k_fraction_treatment(spark, sf_dir):
    k = F.col("k")
    told = F.when(k % 6 == 0, "Fractional shares will be rounded up to the next whole share.").when(k % 6 == 1, "Holders get cash for fractional shares. Cash is paid for each fraction.")
    told = told.when(k % 6 == 2, "Fractions of holders of record will be rounded up. Fractional shares are rounded up.").when(k % 6 == 3, "Fractional shares are rounded up. A fraction is paid in cash.")
    told = told.when(k % 6 == 4, "Fractional shares are rounded down. Options on a fraction are paid in cash.").otherwise("Fractional shares are rounded up. There is a reverse split followed by a forward split.")
    return proximity.fraction_treatment(filings(spark, sf_dir, _filler(F.lit(200)), told))


# --- joins of entities whose names differ, and timelines ---


@query("""with n as (select p_name, string_split(p_name, ' ') as k, replace(p_name, ' ', '') as s, count(distinct case when p_partkey % 3 = 0 then p_brand end) as brands, bool_or(p_partkey % 3 = 1) as other from part group by p_name)
select x.p_name, y.p_name as title, x.brands from n x, n y where x.brands > 0 and y.other
and (substr(x.s, 1, 4) = substr(y.s, 1, 4) or contains(x.s, y.s) or contains(y.s, x.s) or list_has_any(list_filter(x.k, lambda w: length(w) >= 3), y.k))""")
def c_fuzzy_links(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 3 = 0").groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands"))
    return joins.fuzzy_links(a, p.where("p_partkey % 3 = 1").select(F.col("p_name").alias("title")).distinct(), "p_name", "title")


def _terms(spark, sf_dir) -> DataFrame:
    """Filings of events: each customer's orders."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    form = F.when(k % 3 == 0, "DEFM14A").when(k % 3 == 1, "8-K").otherwise("PRE 14A")
    kind = F.element_at(F.array(*map(F.lit, ("UNKNOWN", "ROUNDUP_HOLDER", "ROUNDUP_HOLDER", "ROUNDUP_PARTICIPANT", "UNKNOWN", "CASH"))), (k % 6 + 1).cast("int"))
    day = F.to_date("o_orderdate")
    return o.select(F.col("o_custkey").alias("event"), day.alias("usable"), k.alias("acc"), form.alias("form"), kind.alias("treatment"), F.when(k % 5 < 3, k % 4 + 2).cast("int").alias("ratio"), (k % 11 == 0).alias("ratio_is_range"), F.when(k % 4 < 3, F.date_add(day, 30)).alias("effective"), (k % 13 == 0).alias("cancel"))


@query("""with f as (select o_custkey as event, cast(o_orderdate as date) as usable, o_orderkey as acc, case o_orderkey % 6 when 1 then 'ROUNDUP_HOLDER' when 2 then 'ROUNDUP_HOLDER' when 3 then 'ROUNDUP_PARTICIPANT' when 5 then 'CASH' end as treatment,
case when o_orderkey % 3 < 2 and o_orderkey % 11 != 0 and o_orderkey % 5 < 3 then cast(o_orderkey % 4 + 2 as int) end as ratio, case when o_orderkey % 4 < 3 then cast(cast(o_orderdate as date) + 30 as date) end as effective, o_orderkey % 13 = 0 as cancel from orders),
a as (select *, min(case when ratio is not null and effective is not null then usable end) over (partition by event order by usable, acc) as announced from f),
k as (select event, usable, acc, coalesce(last_value(treatment ignore nulls) over w, 'UNKNOWN') as treatment, last_value(ratio ignore nulls) over w as ratio, last_value(effective ignore nulls) over w as effective, announced,
bool_or(cancel and was) over w as cancelled, row_number() over (partition by event, usable order by acc desc) as n from (select *, lag(announced) over (partition by event order by usable, acc) is not null as was from a) window w as (partition by event order by usable, acc))
select event, usable, treatment, ratio, effective, announced, cancelled from k where n = 1""")
def e_known_terms(spark, sf_dir):
    return timelines.known_terms(_terms(spark, sf_dir), "v2")


@query("""select l_orderkey, l_linenumber, round(v, 6) as expected_profit, round(case when up != cash then -cash / (up - cash) end, 6) as break_even_p from (
select *, case when changed then up else (case when missed then 0 else 0.8::double end) * up + (case when missed then 1 else 0.2::double end) * cash end as v from (
select *, later - ask as up, (case when changed then later else later / n end) - ask as cash from (
select l_orderkey, l_linenumber, l_extendedprice / l_quantity / 1000 as ask, l_extendedprice / l_quantity / 1000 * n * (1 - l_discount) as later, n, changed, missed from (select *, l_linenumber + 1 as n, l_orderkey % 5 = 0 as changed, l_orderkey % 7 = 0 as missed from lineitem))))""")
def f_roundup_value(spark, sf_dir):
    ask, n = F.col("l_extendedprice") / F.col("l_quantity") / 1000, F.col("l_linenumber") + 1
    changed, later = F.col("l_orderkey") % 5 == 0, ask * n * (1 - F.col("l_discount"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ask.alias("ask"), later.alias("rounded"), F.when(changed, later).otherwise(later / n).alias("cash"), F.when(changed, "changed").otherwise("split").alias("exit"), (F.col("l_orderkey") % 7 == 0).alias("settle_miss"))
    return rounded(timelines.split_value(d, F.lit(0.8)).select("l_orderkey", "l_linenumber", "expected_profit", "break_even_p"))


@query(None)
def f_split_payoffs(spark, sf_dir):
    f = _terms(spark, sf_dir)
    bars = daily_bars(spark, sf_dir)
    events = f.groupBy("event").agg(F.date_add(F.max("usable"), 40).alias("split_on"), F.max("ratio").alias("ratio")).where("ratio is not null").withColumn("symbol", customer_symbol(F.col("event")))
    # read for the entries, the sales and the splits, and the sessions by every step: both are written once
    quotes = written(bars.select("symbol", "dt", F.col("low").alias("bid"), F.col("high").alias("ask")), "quotes")
    return timelines.split_payoffs(events, f, quotes, written(sessions(quotes), "sessions"), "v2")


@query(None)
def f_tender_trades(spark, sf_dir):
    o, k, day = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate")
    bars = daily_bars(spark, sf_dir).withColumn("factor", F.when(F.col("dt") < F.lit("1998-07-01").cast("date"), 2.0).otherwise(1.0))
    ends = F.date_add(day, (30 + k % 25).cast("int"))
    last = F.when(k % 3 == 0, F.date_add(ends, 14)).otherwise(ends)
    done = F.when(k % 5 == 0, "terminated").otherwise("completed")
    deals = o.select(k.alias("deal"), customer_symbol(F.col("o_custkey")).alias("symbol"), day.alias("filed"), ends.alias("expires"), done.alias("outcome"), (100 + F.col("o_totalprice") / 10_000).alias("final_price"), last.alias("final_expires"), F.when(k % 5 == 0, F.date_sub(last, 1)).alias("terminated_on"), F.lit(None).cast("date").alias("paid_on"))
    moved = o.where("o_orderkey % 3 = 0").select(k.alias("deal"), F.date_sub(ends, (k % 9).cast("int")).alias("known"), last.alias("expires"))
    days = written(sessions(trading_days(spark, sf_dir)), "sessions")  # every step reads them
    return timelines.tender_trades(deals, moved, days, bars)


@query(None)
def e_meeting_outcomes(spark, sf_dir):
    o, k, day = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate")
    proxy = k % 3 == 0
    f = o.select(
        F.col("o_custkey").alias("entity"), day.alias("filed"), k.alias("acc"), F.when(proxy, "proxy").otherwise("update").alias("kind"), F.when(proxy, "DEF 14A").otherwise("8-K").alias("form"), F.when(proxy, F.date_add(day, 45)).alias("meeting"), (k % 2 == 0).alias("right"),
        F.lit(None).cast("date").alias("redeem_by"), F.lit(10.0).alias("stated"), F.when(k % 3 == 1, F.date_add(day, 20)).alias("postponed_to"), F.when(k % 5 == 1, F.date_add(day, 180)).alias("extended_to"), F.when(k % 4 == 1, day).alias("voted_on"), F.when(k % 4 == 2, 9.5 + k % 20 / 10).alias("per_share"),
    )
    starts = f.groupBy("entity").agg(F.min("filed").alias("since"), F.date_add(F.min("filed"), 720).alias("deadline"))
    days = sessions(daily_bars(spark, sf_dir))
    return timelines.meeting_outcomes(timelines.assembled(f, starts, days), f, days)


@query("""with v as (select cast(l_shipdate as date) as d, max(l_extendedprice) as top from lineitem where l_quantity > 40 group by 1), o as (select o_orderkey, cast(o_orderdate as date) as d from orders)
select o_orderkey, v.d as found, round(v.top, 6) as top from o asof left join v on v.d <= o.d""")
def c_asof_hot_key(spark, sf_dir):
    """One key holds all rows of both sides; its time is cut into pieces of 90 days, each filled in a task of its own."""
    one = F.lit("all").alias("key")
    v = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(one, F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("top"))
    o = table(spark, sf_dir, "orders").select(one, "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return rounded(joins.asof(o, v, ["key"], "day", "d", ["top"], cell=90).select("o_orderkey", F.col("asof_at").alias("found"), "top"))


@query("""with l as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as d from lineitem), s as (select o_orderkey, o_custkey % 5 as desk, cast(o_orderdate as date) as since, case when o_orderkey % 97 > 0 then cast(cast(o_orderdate as date) + cast(o_orderkey % 9 as int) as date) end as until from orders)
select s.desk, l.d as day, count(*) as pairs, sum(l_linenumber) as lines from l join s on l.l_orderkey % 5 = s.desk where l.d >= s.since and (s.until is null or l.d <= s.until) group by 1, 2""")
def c_interval_hot_keys(spark, sf_dir):
    """Five keys hold all rows: spans of a few days or still open, tiled with cells, meet the days of all line items."""
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 5).alias("desk"), F.to_date("l_shipdate").alias("day"), "l_linenumber").groupBy("desk", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))
    spans = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("desk"), F.to_date("o_orderdate").alias("since"), F.when(k % 97 > 0, F.date_add(F.to_date("o_orderdate"), (k % 9).cast("int"))).alias("until"))
    return joins.interval_join(items, spans, ["desk"], "day", "since", "until").groupBy("desk", "day").agg(F.sum("n").alias("pairs"), F.sum("s").alias("lines"))
