"""Event studies: quotes, surprises, cut points of the quarter before, timelines of offers and meetings, payoffs, gates."""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf, previous_quarter, quarter_label
from .windows import prior_stats, streak


def valid_quote(bid: Column, ask: Column, least: float = 0.9) -> tuple[Column, Column]:
    """Both sides of a quote, or null for both if it is crossed, one-sided or a stub."""
    ok = (bid > 0) & (ask >= bid) & (bid >= least * ask)
    return F.when(ok, bid), F.when(ok, ask)


def half_spread(df: DataFrame, bid: str, ask: str, at: str, fallback: float = 0.0025) -> DataFrame:
    """half_spread: own quote, else the day's median over securities, else a constant."""
    b, a = F.col(bid), F.col(ask)
    own = F.when((b > 0) & (a > b), (a - b) / (a + b))
    day = df.withColumn("_own", own)
    median = day.groupBy(at).agg(F.median("_own").alias("_median"))
    return day.join(F.broadcast(median), at, "left").withColumn("half_spread", F.coalesce("_own", "_median", F.lit(fallback))).drop("_own", "_median")


def signed_price(price: Column) -> Column:
    """A negative price is a bid-ask midpoint; zero is missing."""
    return F.nullif(F.abs(price), F.lit(0.0))


def in_scope(df: DataFrame) -> DataFrame:
    return df.where((F.col("security") == "common") & ~F.coalesce("is_exchange", F.lit(False)) & F.col("offer_type").isin("dutch", "fixed"))


def item_overlap(items: Column, wanted: list[str]) -> Column:
    """A comma list meets a set."""
    return F.arrays_overlap(F.transform(F.split(items, ","), lambda x: F.trim(x)), F.array(*map(F.lit, wanted)))


def surprise_features(df: DataFrame) -> DataFrame:
    """sue (surprise over its prior deviation, from four quarters on), beat streak and acceleration of (symbol, announced, actual, estimate)."""
    k = (["symbol"], ["announced"])
    d = df.withColumn("surprise", F.col("actual") - F.col("estimate"))
    mean, sd = prior_stats("surprise", *k)
    d = d.withColumn("sue", F.when(sd > 0, (F.col("surprise") - mean) / sd))
    d = streak(d, F.col("surprise") > 0, *k)
    return d.withColumn("acceleration", F.col("surprise") - F.lag("surprise").over(Window.partitionBy("symbol").orderBy("announced")))


def previous_quarter_deciles(df: DataFrame, at: str, value: str, q: int = 10, least: int = 50) -> DataFrame:
    """bucket 1..q of each event by the quantiles of the quarter before; null where that quarter has fewer than `least` events."""
    cuts = df.groupBy(quarter_label(F.col(at)).alias("_q")).agg(F.percentile(value, F.array(*(F.lit(i / q) for i in range(1, q)))).alias("_cuts"), F.count(value).alias("_n")).where(F.col("_n") >= least)
    j = df.withColumn("_q", previous_quarter(F.col(at))).join(F.broadcast(cuts), "_q", "left")
    return j.withColumn("bucket", F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c <= F.col(value))) + 1)).drop("_q", "_cuts", "_n")


def attribute_change(df: DataFrame, key: str, at: str, attributes: list[str]) -> DataFrame:
    """Per key: first and last day, and the first day on which an attribute differs from its first value (null: never)."""
    w = Window.partitionBy(key).orderBy(at)
    first = {a: F.first(a, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for a in attributes}
    d = df
    for a in attributes:
        d = d.withColumn(f"_{a}", F.when(F.col(a).isNotNull() & (F.col(a) != first[a]), F.col(at)))
    return d.groupBy(key).agg(F.min(at).alias("first_day"), F.max(at).alias("last_day"), *(F.min(f"_{a}").alias(f"{a}_changed") for a in attributes))


def meetings(notices: DataFrame, key: str, at: str, meeting: str, gap: int = 60) -> DataFrame:
    """Notices whose meeting dates are at most `gap` days apart are one meeting: key, number, first notice, last date set, notices."""
    w = Window.partitionBy(key).orderBy(meeting, at)
    new = F.coalesce((F.datediff(meeting, F.lag(meeting).over(w)) > gap).cast("int"), F.lit(1))
    d = notices.withColumn("_new", new).withColumn("meeting_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "meeting_n").agg(F.min(at).alias("first_notice"), F.max_by(meeting, at).alias("meeting_date"), F.count(F.lit(1)).alias("notices"))


def consolidated(follow_ups: DataFrame, deal: str, at: str) -> DataFrame:
    """Per deal, of ordered follow-ups (extended_to, final_price, proration, terminated): last extension, first final price and proration, whether and when terminated."""
    g = follow_ups.groupBy(deal)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(at)))
    return g.agg(
        F.max_by("extended_to", F.when(F.col("extended_to").isNotNull(), F.col(at))).alias("extended_to"), F.sum(F.when(F.col("extended_to").isNotNull(), 1).otherwise(0)).alias("extensions"),
        first("final_price").alias("final_price"), first("proration").alias("proration"), F.min(F.when(F.col("terminated"), F.col(at))).alias("terminated_on"),
    )


def tender_payoff(deals: DataFrame, calendar: DataFrame, bars: DataFrame, shares: int = 99, fees: tuple[float, ...] = (0.0, 20.0, 40.0)) -> DataFrame:
    """Per deal (deal, symbol, filed, expires, final_price, terminated_on) and fee: entry at the first close behind the filing, exit at the final
    price, or at the next close after a termination."""
    from .joins import first_from

    days = F.broadcast(calendar.select("dt", "day_index"))
    px = bars.select("symbol", "dt", F.col("close").alias("px"))
    bought = first_from(deals, px, ["symbol"], "filed", "dt", ["px"], exact=False).where("asof_at is not null").withColumnsRenamed({"asof_at": "entry_on", "px": "entry"})
    sold = first_from(bought, px, ["symbol"], "terminated_on", "dt", ["px"], exact=False).drop("asof_at").withColumnRenamed("px", "_sold")
    d = sold.withColumn("exit", F.when(F.col("terminated_on").isNotNull(), F.col("_sold")).otherwise(F.col("final_price")))
    d = d.join(days.withColumnRenamed("dt", "entry_on").withColumnRenamed("day_index", "entry_index"), "entry_on", "left")
    return d.withColumn("fee", F.explode(F.array(*map(F.lit, fees)))).select("deal", "entry_on", "entry_index", "entry", "exit", "fee", (shares * (F.col("exit") - F.col("entry")) - F.col("fee")).alias("profit"))


def redemption_value(panel: DataFrame, filings: DataFrame, bill_yield: DataFrame) -> DataFrame:
    """panel (symbol, dt, price, deadline) with the trust value per share as of the last filing (symbol, filed, per_share), grown at the bill
    rate (dt, rate a day) since, the discount, and the yearly yield to the deadline."""
    from .joins import asof

    growth = bill_yield.select("dt", F.sum(F.log1p("rate")).over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)).alias("g"))  # a daily series
    f = asof(filings.withColumn("_k", F.lit(0)), growth.withColumn("_k", F.lit(0)), ["_k"], "filed", "dt", ["g"]).withColumnRenamed("g", "g0").drop("asof_at", "_k")
    p = asof(panel, f, ["symbol"], "dt", "filed", ["per_share", "g0"]).join(F.broadcast(growth), "dt", "left")
    value = F.col("per_share") * F.exp(F.coalesce(F.col("g") - F.col("g0"), F.lit(0.0)))
    d = p.withColumn("value", value).withColumn("discount", F.when(F.col("value") > 0, 1 - F.col("price") / F.col("value")))
    days = F.datediff("deadline", "dt")
    return d.withColumn("to_deadline", F.when((days > 0) & (F.col("price") > 0), F.pow(F.col("value") / F.col("price"), 365 / days) - 1)).drop("g", "g0", "asof_at")


def best_entry(df: DataFrame, by: list[str], profit: str, at: str) -> DataFrame:
    """The largest positive profit of each group and its day."""
    return df.where(F.col(profit) > 0).groupBy(*by).agg(F.max(profit).alias("best"), F.max_by(at, F.struct(profit, at)).alias("best_on"))


def filing_scope(filings: DataFrame, events: DataFrame, forms: list[str], on: list[str], before: int = 120, after: int = 10) -> DataFrame:
    from .joins import rows_around

    return rows_around(filings.where(F.col("form").isin(forms)), events, on, "filed", "effective", before, after)


#: Name stems up to so many rows and bytes travel to every task as one automaton; more are joined.
STEMS, STEM_BYTES = 500_000, 16 << 20


def mentions(entities: DataFrame, docs: DataFrame, look: int | None = None) -> DataFrame:
    """(entity, doc_id) pairs whose name stem (its words without legal forms) stands as whole words in the document, or in its first `look` characters.

    One pass over each text finds all stems at once: a broadcast automaton in Arrow batches, where the stems are few enough (counted first). More of
    them are met by the stem's first word and checked whole, so only documents that have that word are compared."""
    from .joins import name_key

    stem = entities.select("entity", name_key(F.col("name")).alias("_w")).where("size(_w) > 0").select("entity", F.col("_w")[0].alias("word"), F.array_join("_w", " ").alias("stem"))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.substring("text", 1, look) if look else F.col("text")), "[^a-z0-9]+", " ")), F.lit(" "))
    d = docs.select("doc_id", words.alias("_t"))
    known = stem.agg(F.count_distinct("stem").alias("n"), F.coalesce(F.sum(F.length("stem")), F.lit(0)).alias("size")).first()
    if known["n"] > STEMS or known["size"] > STEM_BYTES:
        met = d.withColumn("word", F.explode(F.array_distinct(F.split(F.trim("_t"), " ")))).join(stem, "word")
        return met.where(F.col("_t").contains(F.concat(F.lit(" "), F.col("stem"), F.lit(" ")))).select("entity", "doc_id").distinct()
    stems = docs.sparkSession.sparkContext.broadcast([r["stem"] for r in stem.select("stem").distinct().collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for s in stems.value:
            automaton.add_word(f" {s} ", s)
        automaton.make_automaton()
        for batch in batches:
            hits = [sorted({s for _, s in automaton.iter(t)}) if stems.value and t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.string()))], names=["doc_id", "stems"])

    found = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, stems array<string>").select("doc_id", F.explode("stems").alias("stem"))
    return found.join(stem.select("entity", "stem"), "stem").select("entity", "doc_id").distinct()


def combine_signals(df: DataFrame, zs: list[str], ret: str, at: str, entity: str, hold: int = 5, least: int = 252) -> DataFrame:
    """equal: mean of the z-scores. inverse_vol: weighted by one over the expanding deviation of each signal's |z|-weighted return, lagged by hold + 1 dates."""
    w = Window.orderBy(at)  # date-level
    legs = df.groupBy(at).agg(*(F.when(F.sum(F.abs(z)) > 0, F.sum(F.col(z) * F.col(ret)) / F.sum(F.abs(z))).alias(f"_r_{z}") for z in zs))
    past = w.rowsBetween(Window.unboundedPreceding, -(hold + 1))
    ws = legs.select(at, *(F.when((F.count(f"_r_{z}").over(past) >= least) & (F.stddev_samp(f"_r_{z}").over(past) > 0), 1 / F.stddev_samp(f"_r_{z}").over(past)).alias(f"_w_{z}") for z in zs))
    j = df.join(F.broadcast(ws), at)
    n = sum((F.when(F.col(z).isNotNull(), 1).otherwise(0) for z in zs), F.lit(0))
    total = sum((F.coalesce(F.col(z) * F.col(f"_w_{z}"), F.lit(0.0)) for z in zs), F.lit(0.0))
    weight = sum((F.when(F.col(z).isNotNull(), F.coalesce(F.col(f"_w_{z}"), F.lit(0.0))).otherwise(0.0) for z in zs), F.lit(0.0))
    equal = sum((F.coalesce(F.col(z), F.lit(0.0)) for z in zs), F.lit(0.0))
    return j.select(at, entity, F.when(n > 0, equal / n).alias("equal"), F.when(weight > 0, total / weight).alias("inverse_vol"))


def expected_max_normal(k: int, steps: int = 4000) -> float:
    """Mean of the largest of k standard normals: quadrature over the values that it takes with any weight."""
    if k <= 1:
        return 0.0
    n = statistics.NormalDist()
    low, high = -8.0, 8.0 + math.sqrt(2 * math.log(k))
    h = (high - low) / steps
    # by the tails, which keep their digits near 1
    return sum(x * k * n.pdf(x) * math.exp((k - 1) * math.log1p(-min(n.cdf(-x), 1 - 1e-16))) * h for x in (low + i * h for i in range(steps + 1)))


def gate(ideas: DataFrame) -> DataFrame:
    """p_pass and worth of ideas (prior_t, tried, n_prior, n_new, needed_t): the prior t less the expected best of `tried` normals, scaled to the new sample.

    One try, none, or an unknown number leaves the prior t as it is. The expected best is worked out once for each number of tries that occurs."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([expected_max_normal(k) for k in batch.column(0).to_pylist()], pa.float64())], names=["_tried", "_best"])

    numbers = ideas.where("tried > 1").select(F.col("tried").cast("long").alias("_tried")).distinct()
    j = ideas.join(numbers.mapInArrow(best, "_tried long, _best double"), F.col("tried") == F.col("_tried"), "left").drop("_tried").withColumn("expected", F.coalesce("_best", F.lit(0.0))).drop("_best")
    t = F.greatest(F.lit(0.0), F.col("prior_t") - F.col("expected")) * F.sqrt(F.col("n_new") / F.col("n_prior"))
    out = j.withColumn("shrunk_t", t).withColumn("p_pass", 1 - normal_cdf(F.col("needed_t") - F.col("shrunk_t")))
    return out.withColumn("worth", F.col("p_pass") >= 0.5)


def spread_by_liquidity(df: DataFrame, spread: str, volume: str, by: list[str], tie: list[str], q: int = 5) -> DataFrame:
    """Median spread per volume bucket."""
    from .features import quantile_bucket

    b = df.withColumn("bucket", quantile_bucket(volume, by, q, tie))
    return b.where("bucket is not null").groupBy("bucket").agg(F.median(spread).alias("median_spread"), F.count(F.lit(1)).alias("n"))


def minimum_detectable(se: Column) -> Column:
    n = statistics.NormalDist()
    return (n.inv_cdf(0.975) + n.inv_cdf(0.8)) * se


def sharpe_error(sharpe: Column, n: Column) -> Column:
    return F.sqrt((1 + F.pow(sharpe, F.lit(2)) / 2) / (n - 1)) * math.sqrt(1.0)


def insider_signal(keys: DataFrame, trades: DataFrame, back: int = 90) -> DataFrame:
    """Net insider buying of the last `back` sessions over dollar volume times `back`; keys (symbol, day_index, adv), trades (symbol, day_index, bought, sold)."""
    from .windows import trailing_event_sums

    d = trailing_event_sums(keys, trades, ["symbol"], "day_index", ["bought", "sold"], back)
    return d.withColumn("net_buying", F.when(F.col("adv") > 0, (F.col("bought_sum") - F.col("sold_sum")) / (F.col("adv") * back)))


def short_interest_signals(panel: DataFrame, reports: DataFrame) -> DataFrame:
    """Oriented short interest as of each row: panel (symbol, dt, adv_shares), reports (symbol, tradeable_from, short)."""
    from .joins import asof

    w = Window.partitionBy("symbol").orderBy("tradeable_from")
    r = reports.withColumn("before", F.lag("short").over(w))
    d = asof(panel, r, ["symbol"], "dt", "tradeable_from", ["short", "before"]).drop("asof_at")
    level = F.when(F.col("adv_shares") > 0, -F.col("short") / (F.col("adv_shares") * 21))
    return d.withColumn("short_level", level).withColumn("short_change", F.when(F.col("before") > 0, -(F.col("short") / F.col("before") - 1))).withColumn("days_to_cover", F.when(F.col("adv_shares") > 0, -F.col("short") / F.col("adv_shares")))


def discount_flags(panel: DataFrame, fee: float = 20.0, haircut: float = 0.01, account: float = 1e6, weight: float = 0.05, of_volume: float = 0.01, most: float = 0.10, fallback: float = 0.0025) -> DataFrame:
    """panel (dt, price, value, half_spread, adv, volume) with shares that may be bought (a weight of the account, or a share of the volume traded), raw_discount to the
    value, net_discount (after half a spread, the fee a share and a haircut a share), suspect (a raw discount beyond `most` is a passed deadline or a stale quote, not a
    gift) and traded. A missing half spread is the day's median, else the fallback."""
    median = panel.groupBy("dt").agg(F.median("half_spread").alias("_median"))
    d = panel.join(median, "dt", "left").withColumn("_h", F.coalesce("half_spread", "_median", F.lit(fallback)))
    d = d.withColumn("shares", F.floor(F.least(F.lit(account * weight), of_volume * F.coalesce("adv", F.lit(0.0))) / F.col("price")))
    raw = (F.col("value") - F.col("price")) / F.col("price")
    net = (F.col("value") - F.col("price") * (1 + F.col("_h")) - fee / F.when(F.col("shares") > 0, F.col("shares")) - haircut) / F.col("price")
    return d.withColumn("raw_discount", raw).withColumn("net_discount", net).withColumn("suspect", raw > most).withColumn("traded", F.coalesce("volume", F.lit(0)) > 0).drop("_median", "_h")
