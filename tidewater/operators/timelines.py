"""Ordered timelines: what was known when, folded over the sorted filings of an event, and the trades decided by it.

Folds over a few filings of one entity are `aggregate` over its sorted array; what belongs to sessions is arithmetic on session
numbers; what belongs to prices is an as-of join, or found by numpy in batches of many symbols. No entity's rows are walked in Python.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import settlement_days
from .joins import first_from, session_of
from .rolling import Met, met

#: Forms whose ratio counts under the first and the second reading.
FORMS = {"v1": r"^8-K", "v2": r"^(?:8-K|DEF 14A|DEFM14A|DEF 14C|DEFM14C|424B)"}
ROUND_UP = ("ROUNDUP_HOLDER", "ROUNDUP_PARTICIPANT")


def sessions_ahead(df: DataFrame, calendar: DataFrame, at: str, n: Column, out: str) -> DataFrame:
    """`out`: the day n sessions (n may be negative) from the first session on or after `at`, kept inside the calendar."""
    d = session_of(df, calendar, at, "_i", ahead=True, strict=False)
    days = calendar.select(F.col("day_index").cast("int").alias("_j"), F.col("dt").alias(out))
    ends = calendar.agg(F.min("day_index").cast("int").alias("a"), F.max("day_index").cast("int").alias("b")).first()
    first, last = ends or (0, 0)
    at_ = F.least(F.greatest(F.coalesce(F.col("_i"), F.lit(last + 1)) + n, F.lit(first)), F.lit(last))
    return d.withColumn("_j", F.when(F.col(at).isNotNull(), at_).cast("int")).join(days, "_j", "left").drop("_i", "_j")


def settling(calendar: DataFrame) -> DataFrame:
    """The calendar with the day on which a trade of each session settles, and one of the next session."""
    c = calendar.select("dt", F.col("day_index").cast("int").alias("day_index"))
    d = c.withColumn("_j", F.col("day_index") + settlement_days(F.col("dt")))
    d = d.join(c.select(F.col("day_index").alias("_j"), F.col("dt").alias("settles_on")), "_j", "left").drop("_j")
    return d.join(d.select((F.col("day_index") - 1).alias("day_index"), F.col("settles_on").alias("next_settles_on")), "day_index", "left")


def known_terms(filings: DataFrame, rule: str = "v1", key: str = "event") -> DataFrame:
    """One row per event and day on which its terms changed or were confirmed (usable): treatment, ratio and effective day last stated, the day they were
    announced (the first filing with a ratio and a day), and whether it has been cancelled.

    filings: event, usable, acc (order within a day), form, treatment, ratio, ratio_is_range, effective, cancel. Only forms of the rule state a
    ratio, and never a range. Under v1 any cancellation counts, under v2 only one filed after the announcement."""
    w = Window.partitionBy(key).orderBy("usable", "acc")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    states = F.col("form").rlike(FORMS[rule]) & ~F.coalesce("ratio_is_range", F.lit(False))
    d = filings.withColumn("_ratio", F.when(states, F.col("ratio")))
    told = F.when(F.col("_ratio").isNotNull() & F.col("effective").isNotNull(), F.col("usable"))
    cancel = F.coalesce("cancel", F.lit(False))
    if rule == "v2":
        cancel = cancel & F.min(told).over(before).isNotNull()
    known = d.withColumn("_cancel", cancel).select(
        key, "usable", "acc", F.coalesce(F.last(F.when(F.col("treatment") != "UNKNOWN", F.col("treatment")), ignorenulls=True).over(so_far), F.lit("UNKNOWN")).alias("treatment"),
        F.last("_ratio", ignorenulls=True).over(so_far).alias("ratio"), F.last("effective", ignorenulls=True).over(so_far).alias("effective"),
        F.min(told).over(so_far).alias("announced"), F.max("_cancel").over(so_far).alias("cancelled"),
    )
    return known.withColumn("_n", F.row_number().over(Window.partitionBy(key, "usable").orderBy(F.desc("acc")))).where("_n = 1").drop("_n", "acc")


def split_entries(events: DataFrame, known: DataFrame, calendar: DataFrame) -> DataFrame:
    """event, entry_on and the terms known then: the first session before the split on which, by what is known that day, today's trade settles before the
    effective day and tomorrow's would not. Decided by the terms of that day alone: a later postponement can't move an entry that was due.

    events: event, split_on; known: `known_terms`. Sessions of an event run from its announcement to the split."""
    # settlement days only rise, so a day lies behind the settlement of one session and not behind that of the next: effective days lead to that session by equality,
    # whatever number of sessions lie between an event's announcement and its split
    days = settling(calendar).where("settles_on < next_settles_on")
    chances = days.select("dt", "settles_on", F.explode(F.sequence(F.date_add("settles_on", 1), F.col("next_settles_on"))).alias("effective"))
    terms = ["treatment", "ratio", "effective", "announced", "cancelled"]
    until = F.lead("usable").over(Window.partitionBy("event").orderBy("usable"))
    d = known.withColumn("_until", until).where("announced is not null and effective is not null and not cancelled").join(F.broadcast(chances), "effective")
    d = d.where((F.col("dt") >= F.greatest("usable", "announced")) & (F.col("_until").isNull() | (F.col("dt") < F.col("_until"))))
    due = d.join(events.select("event", "split_on"), "event").where(F.col("dt") < F.col("split_on"))
    return due.groupBy("event").agg(F.min("dt").alias("entry_on"), F.min_by(F.struct(*terms, "settles_on"), "dt").alias("_t")).select("event", "entry_on", "_t.*").drop("announced", "cancelled")


def split_payoffs(events: DataFrame, filings: DataFrame, quotes: DataFrame, calendar: DataFrame, rule: str = "v1") -> DataFrame:
    """One share through each event that rounds up: event, entry_on, treatment, ask, exit (changed or split), exit_on, rounded (the bid sold at), cash (what a
    share that isn't rounded up gets: that bid over the ratio), settle_miss.

    events: event, symbol, split_on (the first adjusted session), ratio (as it came); quotes: symbol, dt, bid, ask (valid ones or null). A filing usable after the entry
    and before the split that cancels, states another ratio or day, or pays cash, means a sale at the first bid from its day on, if that comes before the split."""
    known = known_terms(filings, rule)
    e = split_entries(events, known, calendar).where(F.col("treatment").isin(*ROUND_UP)).join(events.select("event", "symbol", "split_on", F.col("ratio").alias("true_ratio")), "event")
    e = e.join(quotes.select("symbol", F.col("dt").alias("entry_on"), "ask"), ["symbol", "entry_on"], "left").where("ask is not null")
    bids = quotes.where("bid is not null").select("symbol", "dt", "bid")
    states = F.col("form").rlike(FORMS[rule]) & ~F.coalesce("ratio_is_range", F.lit(False))
    later = filings.select("event", "usable", "acc", F.when(states, F.col("ratio")).alias("_ratio"), F.col("effective").alias("_effective"), F.col("treatment").alias("_treatment"), F.coalesce("cancel", F.lit(False)).alias("_cancel"))
    # without a ratio known at entry any ratio is another one
    changed = F.col("_cancel") | F.coalesce((F.col("_ratio") != F.coalesce("ratio", F.lit(0))), F.lit(False)) | F.coalesce(F.col("_effective") != F.col("effective"), F.lit(False)) | F.coalesce(F.col("_treatment").isin("CASH", "DOWN"), F.lit(False))
    turns = e.join(later, "event").where((F.col("usable") > F.col("entry_on")) & (F.col("usable") < F.col("split_on")) & changed)
    sold = first_from(turns.select("event", "symbol", "split_on", "usable", "acc"), bids, ["symbol"], "usable", "dt", ["bid"]).where(F.col("asof_at") < F.col("split_on"))
    sold = sold.groupBy("event").agg(F.min_by(F.struct(F.col("asof_at").alias("on"), F.col("bid")), F.struct("usable", "acc")).alias("_sold"))
    d = first_from(e, bids, ["symbol"], "split_on", "dt", ["bid"]).join(sold, "event", "left")
    out = F.col("_sold").isNotNull()
    return d.select(
        "event", "symbol", "entry_on", "treatment", "ask", F.when(out, "changed").when(F.col("bid").isNotNull(), "split").alias("exit"), F.when(out, F.col("_sold.on")).otherwise(F.col("asof_at")).alias("exit_on"),
        F.when(out, F.col("_sold.bid")).otherwise(F.col("bid")).alias("rounded"), F.when(out, F.col("_sold.bid")).otherwise(F.col("bid") / F.col("true_ratio")).alias("cash"), (~out & (F.col("settles_on") >= F.col("split_on"))).alias("settle_miss"),
    ).where("exit is not null")


def split_value(payoffs: DataFrame, p: Column, fee: float = 0.0) -> DataFrame:
    """expected_profit of one share bought at the ask and rounded up with probability p (0 if the trade settled too late), and break_even_p, the p at which it is
    nothing: rounded up, the share is sold at the later price; else the fraction is paid in cash (that price over the ratio) without a sale."""
    up, cash = F.col("rounded") - F.col("ask") - 2 * fee, F.col("cash") - F.col("ask") - fee
    chance = F.when(F.col("settle_miss"), 0.0).otherwise(p)
    flat_up, flat_cash = F.col("rounded") - F.col("ask"), F.col("cash") - F.col("ask")
    return payoffs.withColumn("expected_profit", F.when(F.col("exit") == "changed", up).otherwise(chance * up + (1 - chance) * cash)).withColumn("break_even_p", F.when(flat_up != flat_cash, -flat_cash / (flat_up - flat_cash)))


def tender_trades(deals: DataFrame, extensions: DataFrame, calendar: DataFrame, bars: DataFrame, shares: int = 99, cutoff: int = 2, fees: tuple[float, ...] = (0.0, 20.0, 40.0)) -> DataFrame:
    """Each deal under both entry rules, and fee: deal, variant, entry_on, entry, exit_on, exit, paid_on, gross, days_locked, dollar_volume, fee, profit.

    E1 enters on the first session after the filing. E2 enters on the last day that still settles before the expiration known by then, less `cutoff`
    sessions: an extension known before that day moves it, which may bring in the next extension, and so on; not entered if the deal was
    terminated by that day or states no expiration. The entry is at the first close from that day on. A terminated deal exits at the first close
    behind the termination, without a fee; a completed one at its final price, in shares of that day (factor: what a share was split by).

    deals: deal, symbol, filed, expires, outcome, final_price, final_expires, terminated_on, paid_on; extensions: deal, known, expires;
    bars: symbol, dt, close, volume, factor, one a symbol and day."""
    c = settling(calendar)
    d = session_of(deals, calendar, "filed", "_first", ahead=True)
    for at, name in (("expires", "_x"), ("final_expires", "_fx")):
        d = session_of(d, calendar, at, name, ahead=False, strict=False)
    x = session_of(extensions.select("deal", "known", F.col("expires").alias("_to")), calendar, "known", "_k", ahead=True)
    x = session_of(x, calendar, "_to", "_tx", ahead=False, strict=False).where("_k is not null")
    moves = x.groupBy("deal").agg(F.collect_list(F.struct(F.col("_k").cast("int").alias("k"), F.col("_to").alias("until"), F.coalesce("_tx", F.lit(0)).cast("int").alias("x"))).alias("_moves"))
    # settlement by session number: the numbers of the first sessions of the shorter cycles
    cycle = calendar.agg(*(F.min(F.when(settlement_days(F.col("dt")) <= k, F.col("day_index"))).cast("int").alias(f"s{k}") for k in (2, 1))).first()
    settle = lambda i: F.when(i >= cycle["s1"], 1).when(i >= cycle["s2"], 2).otherwise(3) if cycle["s1"] is not None else F.when(i >= cycle["s2"], 2).otherwise(3) if cycle["s2"] is not None else F.lit(3)

    def day_for(x: Column) -> Column:
        # the cycle depends on the trade date, so a first guess tells it
        guess = F.greatest(x - settle(x) - cutoff, F.col("_first"))
        return F.greatest(x - settle(guess) - cutoff, F.col("_first"))

    def moved(s: Column, _: Column) -> Column:
        i = day_for(s["x"])
        seen = F.filter(F.col("_moves"), lambda m: (m["k"] <= i) & (m["until"] > s["until"]))
        best = F.array_max(F.transform(seen, lambda m: F.struct(m["until"].alias("until"), m["x"].alias("x"))))
        return F.coalesce(best, s)

    d = d.where("_first is not null").join(moves, "deal", "left").withColumn("_moves", F.coalesce("_moves", F.array().cast(moves.schema["_moves"].dataType)))
    start = F.struct(F.col("expires").alias("until"), F.coalesce("_x", F.lit(0)).cast("int").alias("x"))
    # each step takes in one extension at least, so as many steps as there are extensions settle it
    d = d.withColumn("_last", F.when(F.size("_moves") > 0, F.aggregate(F.sequence(F.lit(1), F.size("_moves")), start, moved)).otherwise(start)).withColumn("_e2", F.when(F.col("expires").isNotNull(), day_for(F.col("_last.x"))))
    ended, done = F.col("outcome") == "terminated", (F.col("outcome") == "completed") & F.col("final_price").isNotNull()
    d = d.where(ended | done).withColumn("_back", F.greatest(F.col("_first") - 21, F.lit(0)))
    last_day = F.lit(calendar.agg(F.max("dt")).first()[0])
    for number, found, day in (("_first", "_e1_day", "dt"), ("_e2", "_e2_day", "dt"), ("_back", "_since", "dt"), ("_fx", "_settled", "settles_on")):
        d = d.join(F.broadcast(c.select(F.col("day_index").alias(number), F.col(day).alias(found))), number, "left")  # a row a session
    # what a deal asks of its symbol's bars is found in one pass over both, sorted once
    asks = d.select(
        "deal", "symbol", "_e1_day", "_e2_day", "_since", "terminated_on", "final_expires", ended.alias("_ended"), done.alias("_done"),
        F.col("final_price").cast("double").alias("final_price"), F.coalesce("paid_on", "_settled", last_day).alias("_paid"),
    )
    px = bars.where(F.col("close").isNotNull()).join(F.broadcast(calendar.select("dt", F.lit(True).alias("_open"))), "dt", "left")
    px = px.select("symbol", "dt", F.col("close").cast("double").alias("close"), F.col("factor").cast("double").alias("factor"), F.when(F.col("_open"), F.col("close") * F.col("volume")).cast("double").alias("_d"))
    kept = asks.drop("symbol", "_since", "_e1_day")
    schema = StructType([*kept.schema.fields])
    for name, kind in _TENDER_PRICES.items():
        schema = schema.add(name, kind)
    both = met(asks, px, functools.partial(_tender_prices, kept.columns), schema)
    each = [F.struct(F.lit(v).alias("variant"), *(F.col(f"_{v}_{x}").alias(f"_{x}") for x in ("on", "entry", "f0"))) for v in ("E1", "E2")]
    both = both.withColumn("_v", F.explode(F.array(*each))).select("*", "_v.*").where(F.col("_on").isNotNull() & ((F.col("variant") == "E1") | F.col("terminated_on").isNull() | (F.col("terminated_on") > F.col("_e2_day"))))
    scale = F.when(F.col("_done") & (F.col("_f0") > 0) & F.col("_f1").isNotNull(), F.col("_f1") / F.col("_f0")).otherwise(1.0)
    t = both.where((F.col("_ended") & (F.col("_sold_on") >= F.col("_on"))) | F.col("_done")).select(
        "deal", "variant", F.col("_on").alias("entry_on"), (F.col("_entry") * scale).alias("entry"), F.when(F.col("_ended"), F.col("_sold_on")).otherwise(F.col("final_expires")).alias("exit_on"), F.when(F.col("_ended"), F.col("_sold")).otherwise(F.col("final_price")).alias("exit"),
        F.when(F.col("_ended"), F.col("_sold_on")).otherwise(F.col("_paid")).alias("paid_on"), "dollar_volume", (~F.col("_ended")).alias("_pays"),
    )
    t = t.withColumn("gross", (F.col("exit") - F.col("entry")) * shares).withColumn("days_locked", F.datediff("paid_on", "entry_on"))
    return t.withColumn("fee", F.explode(F.array(*map(F.lit, fees)))).withColumn("profit", F.col("gross") - F.when(F.col("_pays"), F.col("fee")).otherwise(0.0)).drop("_pays")


_TENDER_PRICES = {f"_{v}_{x}": kind for v in ("E1", "E2") for x, kind in (("on", "date"), ("entry", "double"), ("f0", "double"))} | {"_sold_on": "date", "_sold": "double", "_f1": "double", "dollar_volume": "double"}


def _tender_prices(kept: list[str], m: Met) -> pa.RecordBatch:
    """Per deal: the first bar from each entry day on, the first one behind the termination, the factor of the last one up to the final expiration, and the median
    of dollars traded from `_since` to the day before the first entry."""
    never, n = np.int64(1) << 31, m.facts.num_rows
    known = {c: np.append(m.facts[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False), False) for c in ("dt", "close", "factor", "_d")}
    value = {c: np.append(m.fact(c, 0), 0) for c in known}

    def told(c: str, place: np.ndarray, kind: pa.DataType) -> pa.Array:
        x, none = value[c][place], ~known[c][place]
        return pa.array(x.astype(np.int32), pa.int32(), mask=none).cast(kind) if pa.types.is_date(kind) else pa.array(x, kind, mask=none)

    first = lambda at, after=False: np.where((p := m.find("dt", m.ask(at, never), after)) < m.high, p, n)
    e1, e2, sold = first("_e1_day"), first("_e2_day"), first("terminated_on", True)
    last = m.find("dt", m.ask("final_expires", -never), True) - 1
    out = [told(c, at, kind) for at in (e1, e2) for c, kind in (("dt", pa.date32()), ("close", pa.float64()), ("factor", pa.float64()))]
    out += [told("dt", sold, pa.date32()), told("close", sold, pa.float64()), told("factor", np.where(last >= m.low, last, n), pa.float64())]
    a, b = m.find("dt", m.ask("_since", never)), m.find("dt", m.ask("_e1_day", never))
    at = a[:, None] + np.arange(max(int((b - a).max()), 1))
    at = np.where(at < b[:, None], at, n)
    traded = np.sort(np.where(known["_d"][at], value["_d"][at], np.nan), axis=1)
    count, row = known["_d"][at].sum(axis=1), np.arange(len(a))
    low, high = traded[row, np.maximum(count - 1, 0) // 2], traded[row, np.minimum(count // 2, traded.shape[1] - 1)]
    out.append(pa.array(np.where(count % 2 == 1, low, 0.5 * low + 0.5 * high), pa.float64(), mask=count == 0))
    return pa.RecordBatch.from_arrays([*(m.asks.column(c) for c in kept), *out], names=[*kept, *_TENDER_PRICES])


def assembled(filings: DataFrame, starts: DataFrame, calendar: DataFrame, key: str = "entity", same: int = 60, pending: int = 3) -> DataFrame:
    """Per entity three arrays: meetings (id, filed, meeting, last, redeem_by, right, stated), moves of their dates (id, filed, meeting) and deadlines (known, deadline),
    folded over its filings in order.

    A proxy whose meeting lies within `same` days of the last date of a meeting that is still ahead revises that one, and else calls a new one; proxies
    for a day already past say nothing. A postponement moves the last meeting that was called before and is at most `pending` sessions past. A deadline
    only ever moves on, by current reports.

    filings: key, filed, acc, kind (proxy or update), form, meeting, right, redeem_by, stated, postponed_to, extended_to; starts: key, since, deadline."""
    f = sessions_ahead(filings, calendar, "filed", F.lit(-pending), "_back")
    names = ["filed", "acc", "kind", "form", "meeting", "right", "redeem_by", "stated", "postponed_to", "extended_to", "_back"]
    meeting = "struct<id:int,filed:date,meeting:date,last:date,redeem_by:date,right:boolean,stated:double>"
    move, due = "struct<id:int,filed:date,meeting:date>", "struct<known:date,deadline:date>"
    each = f.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_f"))
    start = F.struct(F.array().cast(f"array<{meeting}>").alias("meetings"), F.array().cast(f"array<{move}>").alias("moves"), F.array(F.struct(F.col("since").alias("known"), F.col("deadline").alias("deadline"))).cast(f"array<{due}>").alias("deadlines"))

    def step(s: Column, e: Column) -> Column:
        calls = (e["kind"] == "proxy") & F.coalesce(e["meeting"] > e["filed"], F.lit(False))
        moves = (e["kind"] == "update") & e["postponed_to"].isNotNull()
        to = F.when(calls, e["meeting"]).otherwise(e["postponed_to"])
        hits = F.when(calls, F.filter(s["meetings"], lambda m: (F.abs(F.datediff(m["last"], e["meeting"])) <= same) & (m["last"] >= e["filed"]))).when(moves, F.filter(s["meetings"], lambda m: (m["filed"] < e["filed"]) & (m["last"] >= e["_back"])))
        hit = F.when(calls | moves, F.coalesce(F.array_max(F.transform(hits, lambda m: m["id"])), F.lit(-1))).otherwise(-1)
        revised = F.transform(s["meetings"], lambda m: F.when(m["id"] == hit, F.struct(m["id"].alias("id"), m["filed"].alias("filed"), m["meeting"].alias("meeting"), F.greatest(m["last"], to).alias("last"), m["redeem_by"].alias("redeem_by"), (m["right"] | (calls & F.coalesce(e["right"], F.lit(False)))).alias("right"), m["stated"].alias("stated"))).otherwise(m))
        called = F.struct(F.size(s["meetings"]).alias("id"), e["filed"].alias("filed"), e["meeting"].alias("meeting"), e["meeting"].alias("last"), e["redeem_by"].alias("redeem_by"), F.coalesce(e["right"], F.lit(False)).alias("right"), e["stated"].cast("double").alias("stated"))
        extends = (e["kind"] == "update") & e["form"].startswith("8-K") & (e["extended_to"] > F.element_at(s["deadlines"], -1)["deadline"])
        return F.struct(
            F.when(hit >= 0, revised).when(calls, F.array_append(s["meetings"], called)).otherwise(s["meetings"]).cast(f"array<{meeting}>").alias("meetings"),
            F.when(hit >= 0, F.array_append(s["moves"], F.struct(hit.alias("id"), e["filed"].alias("filed"), to.alias("meeting")))).otherwise(s["moves"]).cast(f"array<{move}>").alias("moves"),
            F.when(F.coalesce(extends, F.lit(False)), F.array_append(s["deadlines"], F.struct(e["filed"].alias("known"), e["extended_to"].alias("deadline")))).otherwise(s["deadlines"]).cast(f"array<{due}>").alias("deadlines"),
        )

    folded = starts.select(key, "since", "deadline").join(each, key, "left").withColumn("_f", F.coalesce("_f", F.array().cast(each.schema["_f"].dataType)))
    return folded.select(key, F.aggregate("_f", start, step).alias("_s")).select(key, "_s.*")


def meeting_outcomes(timelines: DataFrame, filings: DataFrame, calendar: DataFrame, key: str = "entity", vote_days: int = 45, paid_days: int = 30, lag: int = 5) -> DataFrame:
    """One row per meeting of `assembled`: key, id, filed, meeting, last, redeem_by, right, stated, held (the first vote from three sessions before the meeting to `vote_days` after its
    last date, else that date), paid (the first amount a share reported in `paid_days` from then on, null if over a dollar from the stated one), paid_from (8-K,
    discarded, or null), and pay_on (`lag` sessions after).

    filings: key, filed, acc, kind, voted_on, per_share. The votes and amounts of an entity travel as arrays beside its meetings."""
    m = timelines.select(key, F.explode("meetings").alias("m")).select(key, "m.*")
    m = sessions_ahead(m, calendar, "meeting", F.lit(-3), "_from")
    facts = filings.groupBy(key).agg(F.array_sort(F.array_distinct(F.collect_list("voted_on"))).alias("_votes"), F.array_sort(F.collect_list(F.when((F.col("kind") == "update") & F.col("per_share").isNotNull(), F.struct("filed", "acc", F.col("per_share").cast("double").alias("v"))))).alias("_paid"))
    d = m.join(facts, key, "left")
    vote = F.get(F.filter("_votes", lambda v: (v >= F.col("_from")) & (v <= F.date_add("last", vote_days))), F.lit(0))
    d = d.withColumn("held", F.coalesce(vote, F.col("last")))
    first = F.get(F.filter("_paid", lambda p: (p["filed"] >= F.col("held")) & (p["filed"] <= F.date_add("held", paid_days))), F.lit(0))["v"]
    d = d.withColumn("_v", first)
    far = (F.coalesce("stated", F.lit(0.0)) != 0) & (F.abs(F.col("_v") - F.col("stated")) > 1.0)
    d = d.withColumn("paid", F.when(~far, F.col("_v"))).withColumn("paid_from", F.when(far, "discarded").when(F.col("_v").isNotNull(), "8-K"))
    return sessions_ahead(d, calendar, "held", F.lit(lag), "pay_on").drop("_votes", "_paid", "_v", "_from")


def phase_ends(entities: DataFrame, calendar: DataFrame, near: int = 15) -> DataFrame:
    """`phase_end` and `merged` of entities (closed, changed, last_vote, last_day): the earliest of the closing, the change of name or symbol, and the last vote, if
    the rows end at most `near` sessions behind it. Null and false if nothing ends it but its rows."""
    d = session_of(session_of(entities, calendar, "last_vote", "_v", ahead=True, strict=False), calendar, "last_day", "_l", ahead=True, strict=False)
    vote = F.when((F.col("_l") - F.col("_v") <= near) & (F.col("last_vote") <= F.col("last_day")), F.col("last_vote"))
    end = F.least("closed", "changed", vote)
    return d.withColumn("phase_end", end).withColumn("merged", end.isNotNull()).drop("_v", "_l")
