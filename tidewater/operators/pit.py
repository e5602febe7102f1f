"""Point in time: known-at rules, as-of views, event timelines, and look-ahead audits of transforms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof, session_of
from .quality import reconcile


@dataclass(frozen=True)
class Dataset:
    """A frame whose rows became known at `known_at`."""

    name: str
    frame: DataFrame
    keys: list[str]
    event_time: str
    values: list[str]
    version_key: list[str] = field(default_factory=list)
    known_at: str = "known_at"

    def __post_init__(self):
        if self.known_at not in self.frame.columns:
            raise ValueError(f"{self.name} has no {self.known_at}")

    def asof(self, t: Column, where: Column | None = None, latest: bool = True) -> DataFrame:
        """Rows known at t; the last version of each, if the data set has versions."""
        df = self.frame.where(F.col(self.known_at) <= t)
        df = df if where is None else df.where(where)
        if not (latest and self.version_key):
            return df
        # of versions known at one moment always the same one
        w = Window.partitionBy(*self.version_key).orderBy(F.desc(self.known_at), F.xxhash64(*df.columns))
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def truncate(self, t: Column) -> DataFrame:
        return self.frame.where(F.col(self.known_at) <= t)

    def scramble(self, t: Column, seed: int = 1) -> DataFrame:
        """The value columns permuted among the rows whose event lies after t, one permutation for all of them."""
        after = F.col(self.event_time) > t
        late = self.frame.where(after)
        ident = F.xxhash64(*self.keys, self.event_time)
        # ranks by two hashes pair each row with another's values; hashing deals the ranking out by a prefix first
        pre = F.pmod(ident, F.lit(64))
        a = late.withColumn("_p", pre).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(ident))).drop(*self.values)
        b = late.withColumn("_p", pre).select("_p", F.row_number().over(Window.partitionBy("_p").orderBy(F.xxhash64(ident, F.lit(seed)))).alias("_r"), *(F.col(v).alias(f"_{v}") for v in self.values))
        mixed = a.join(b, ["_p", "_r"]).select(*(F.col(f"_{c}").alias(c) if c in self.values else F.col(c) for c in self.frame.columns))
        return self.frame.where(~after).unionByName(mixed)


def next_session(df: DataFrame, calendar: DataFrame, at: str, out: str, strict: bool = True, sessions: int = 0) -> DataFrame:
    """`out`: the first session after `at` (at or after, unless strict), then `sessions` further."""
    found = session_of(df, calendar, at, "_i", ahead=True, strict=strict)
    target = calendar.select(F.col("dt").alias(out), (F.col("day_index") - sessions).cast("int").alias("_i"))
    return found.join(target, "_i", "left").drop("_i")


def tradeable_from(announced: Column, open_hour: float = 9.5, close_hour: float = 16.0) -> Column:
    """'before', 'during' or 'after' the session."""
    h = F.hour(announced) + F.minute(announced) / 60
    return F.when(h < open_hour, "before").when(h >= close_hour, "after").otherwise("during")


def known_timeline(filings: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Per filing of (usable, cls, ratio, effective, cancel): what is known then: last class, ratio and date that are not null, and
    when both class and ratio were first known; a cancellation counts only from then on."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = filings.select("*", *(F.last(c, ignorenulls=True).over(w).alias(f"known_{c}") for c in ("cls", "ratio", "effective")))
    df = df.withColumn("announced", F.min(F.when(F.col("known_cls").isNotNull() & F.col("known_ratio").isNotNull(), F.col("usable"))).over(w))
    return df.withColumn("cancelled", F.max(F.when(F.col("cancel") & F.col("announced").isNotNull(), 1).otherwise(0)).over(w) == 1)


def ttm(filings: DataFrame, as_of: DataFrame) -> DataFrame:
    """Per (symbol, as_of): the latest annual flow if its period ends with or after the latest quarter, else the sum of the last
    four quarters. Restated periods use the value last filed. filings: symbol, period_start, period_end, filed, val.

    Worked out for each day on which a symbol files, and met by an as-of join: a company's filings meet each other, not all the days asked for."""
    states = _ttm_on(filings, filings.select("symbol", F.col("filed").alias("as_of")).distinct())
    met = asof(as_of.select("symbol", "as_of").distinct(), states.withColumnRenamed("as_of", "_filed"), ["symbol"], "as_of", "_filed", ["ttm"])
    return met.where("asof_at is not null").select("symbol", "as_of", "ttm")


def _ttm_on(filings: DataFrame, as_of: DataFrame) -> DataFrame:
    known = as_of.join(filings, "symbol").where(F.col("filed") <= F.col("as_of")).withColumn("days", F.datediff("period_end", "period_start"))
    kind = F.when(F.col("days").between(330, 400), "annual").when(F.col("days").between(60, 120), "quarter")
    known = known.withColumn("kind", kind).where("kind is not null")
    latest = known.groupBy("symbol", "as_of", "kind", "period_end").agg(F.max_by("val", "filed").alias("val"))
    n = F.row_number().over(Window.partitionBy("symbol", "as_of", "kind").orderBy(F.desc("period_end")))
    top = latest.withColumn("n", n).where("n <= 4")
    quarter, annual = F.col("kind") == "quarter", (F.col("kind") == "annual") & (F.col("n") == 1)
    g = top.groupBy("symbol", "as_of").agg(
        F.max(F.when(annual, F.col("period_end"))).alias("ae"), F.max(F.when(annual, F.col("val"))).alias("av"),
        F.max(F.when(quarter, F.col("period_end"))).alias("qe"), F.sum(F.when(quarter, F.col("val"))).alias("qv"), F.count(F.when(quarter, 1)).alias("qn"),
    )
    use_annual = F.col("ae").isNotNull() & (F.col("qe").isNull() | (F.col("ae") >= F.col("qe")))
    return g.select("symbol", "as_of", F.when(use_annual, F.col("av")).when(F.col("qn") == 4, F.col("qv")).alias("ttm"))


# ---------------------------------------------------------------- audits: each returns the offending rows, none if all is well


def truncation_audit(transform: Callable[[DataFrame], DataFrame], df: DataFrame, cut: Column, at: str, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows up to the cut that change when later rows are withheld."""
    whole = transform(df).where(F.col(at) <= cut)
    part = transform(df.where(F.col(at) <= cut))
    return reconcile(whole, part, keys, columns)


def labels_vanish(labels: Callable[[DataFrame], DataFrame], df: DataFrame, cut: Column, at: str, column: str) -> DataFrame:
    """Last rows before the cut whose label is there although the future is withheld."""
    part = labels(df.where(F.col(at) <= cut))
    last = part.groupBy("symbol").agg(F.max(at).alias(at))
    return part.join(last, ["symbol", at]).where(F.col(column).isNotNull())


def basis_audit(transform: Callable[[DataFrame], DataFrame], df: DataFrame, keys: list[str], columns: list[str], factor: float = 0.37) -> DataFrame:
    """Rows that change when all adjusted closes are rescaled by a constant."""
    numbers = lambda d: d.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns))
    return reconcile(numbers(transform(df)), numbers(transform(df.withColumn("adj_close", F.col("adj_close") * factor))), keys, columns)


def future_swap_audit(rules: Callable[[DataFrame], DataFrame], bars: DataFrame, k: int) -> DataFrame:
    """Rule firings up to bar k that change when the bars behind k are those of the symbol's session before. `rules` should take what it
    needs of earlier sessions (a previous close) from elsewhere than these bars."""
    other = bars.select("symbol", "session").distinct().withColumn("donor", F.lag("session").over(Window.partitionBy("symbol").orderBy("session"))).where("donor is not null")
    late = bars.where(F.col("bar") > k).withColumnRenamed("session", "donor").join(other, ["symbol", "donor"]).drop("donor")
    swapped = bars.where(F.col("bar") <= k).join(other.select("symbol", "session"), ["symbol", "session"], "left_semi").unionByName(late)
    same = bars.join(other.select("symbol", "session"), ["symbol", "session"], "left_semi")
    a, b = (rules(d).where(F.col("bar") <= k) for d in (same, swapped))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def forward_columns(df: DataFrame) -> list[str]:
    """Names that say they look ahead."""
    return [c for c in df.columns if c.startswith(("fwd_", "label_", "next_")) or "future" in c]


def causal_weights(trades: DataFrame, weigh: Callable[[DataFrame], DataFrame], cuts: list, at: str, keys: list[str]) -> DataFrame:
    """Trades up to a cut whose weight changes when later trades are taken away."""
    out = None
    for cut in cuts:
        c = F.lit(cut).cast(trades.schema[at].dataType)
        bad = reconcile(weigh(trades).where(F.col(at) <= c), weigh(trades.where(F.col(at) <= c)), keys, ["weight"]).withColumn("cut", c)
        out = bad if out is None else out.unionByName(bad)
    return out


def _clock(day: Column, minutes: int) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + 60 * minutes)


#: Minutes of the day at which sessions open and close.
OPEN, CLOSE = 9 * 60 + 30, 16 * 60


def known_at(df: DataFrame, calendar: DataFrame, at: str, kind: str, out: str) -> DataFrame:
    """`out`: when a fact stamped `at` may first be used. Kinds:

    at_close: the close of its date. next_open: the open of the first session after its date (filings). announced: its own minute on a session, before the close
    and with a time (00:00 is none), else the next session's open. month_after: the close of the last session up to the end of the following month
    (factor files). month_open: the open of the first session from the start of its month on (bill rates)."""
    day = F.to_date(F.col(at))
    if kind == "at_close":
        return df.withColumn(out, _clock(day, CLOSE))
    if kind == "next_open":
        return next_session(df, calendar, at, "_day").withColumn(out, _clock(F.col("_day"), OPEN)).drop("_day")
    if kind == "month_after":
        d = df.withColumn("_end", F.last_day(F.add_months(day, 1)))
        return _session_day(session_of(d, calendar, "_end", "_i", ahead=False, strict=False), calendar, out, CLOSE).drop("_end")
    if kind == "month_open":
        d = df.withColumn("_start", F.trunc(day, "month"))
        return _session_day(session_of(d, calendar, "_start", "_i", ahead=True, strict=False), calendar, out, OPEN).drop("_start")
    if kind == "announced":
        minute = F.hour(at) * 60 + F.minute(at)
        d = next_session(df, calendar, at, "_day").join(calendar.select(F.col("dt").alias("_on"), F.lit(True).alias("_open")), day == F.col("_on"), "left")
        during = F.coalesce(F.col("_open"), F.lit(False)) & (minute > 0) & (minute < CLOSE)
        return d.withColumn(out, F.when(during, F.date_trunc("minute", at)).otherwise(_clock(F.col("_day"), OPEN))).drop("_day", "_on", "_open")
    raise ValueError(kind)


def _session_day(df: DataFrame, calendar: DataFrame, out: str, minutes: int) -> DataFrame:
    days = calendar.select(F.col("day_index").cast("int").alias("_i"), F.col("dt").alias("_day"))
    return df.join(days, "_i", "left").withColumn(out, _clock(F.col("_day"), minutes)).drop("_i", "_day")


def acts_on(df: DataFrame, calendar: DataFrame, at: str, out: str) -> DataFrame:
    """`out`: the first session that can act on a release stamped `at`: its own day's before the close, else the next."""
    d = session_of(session_of(df, calendar, at, "_on", ahead=True, strict=False), calendar, at, "_after", ahead=True)
    days = calendar.select(F.col("day_index").cast("int").alias("_i"), F.col("dt").alias(out))
    return d.withColumn("_i", F.when(F.hour(at) * 60 + F.minute(at) < CLOSE, F.col("_on")).otherwise(F.col("_after"))).join(days, "_i", "left").drop("_i", "_on", "_after")
