"""URL filters over time: dated list entries against captures, as of the day each was fetched.

An entry says that a list took a domain in, or out, on a day. Per list and domain the entries become validity
intervals, from a day on which it is in until the next on which it is out (of entries of one day, `out` wins; repeats
change nothing). A capture is under an entry if its host is the domain or lies below it. Distinct hosts are matched with
the listed domains first, so that a top label that is on no list is never shuffled with all hosts below it; what matches
is thinned out to distinct (host, day) pairs, so a host with many captures is judged once a day, and meets the intervals
of its domains by equality. Small sides are broadcast behind a check of their size; beyond it AQE splits hot keys.

The host is what stands between `://` and the first of `/?#\\`, without user and password (all up to the last @), port and
dots at the end, in lower case. Addresses (digits and dots, or in brackets) lie below nothing.

Defined results: a capture without a readable host or without a day is under no list. Entries that lack a list, domain
or day are left out; case and dots at the end of a listed domain don't matter. Repeated captures get a row each. Extra
columns of either table are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^/?#\\\]]*\]|[^/?#\\:@\[\]]*?)\.*(?::[^/?#\\]*)?(?:[/?#\\]|$)"
ADDRESS = r"^(\[.*|[0-9.]+)$"
BROADCAST_ROWS = 500_000


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, since, until (null: still in) from entries list, domain, day, active."""
    order = Window.partitionBy("list", "domain").orderBy("day")
    domain = F.nullif(F.regexp_replace(F.lower("domain"), r"\.+$", ""), F.lit(""))
    rows = entries.select("list", domain.alias("domain"), "day", F.coalesce("active", F.lit(True)).alias("active"))
    days = rows.where("list is not null and domain is not null and day is not null").groupBy("list", "domain", "day").agg(F.min("active").alias("active"))
    changed = days.withColumn("before", F.coalesce(F.lag("active").over(order), F.lit(False))).where("active != before")
    return changed.withColumn("until", F.lead("day").over(order)).where("active").select("list", "domain", F.col("day").alias("since"), "until")


def domains_of(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(above)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per capture (page_id, url, fetched): page_id, host, fetched, blocked, lists (sorted, comma-joined), n_entries."""
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched")
    spans = written(intervals(entries), "list-spans")
    listed = checked_broadcast(written(spans.select("domain").distinct(), "list-domains"), BROADCAST_ROWS)
    hosts = rows.select("host").where("host is not null").distinct().select("host", F.explode(domains_of(F.col("host"))).alias("domain"))
    under = checked_broadcast(written(hosts.join(listed, "domain", "left_semi"), "list-hosts"), BROADCAST_ROWS)
    active = (
        rows.where("fetched is not null").join(under, "host").select("host", "fetched", "domain").distinct()
        .join(checked_broadcast(spans, BROADCAST_ROWS), "domain")
        .where((F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
        .groupBy("host", "fetched")
        .agg(F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"), F.count(F.lit(1)).alias("n_entries"))
    )
    active = checked_broadcast(written(active, "list-active"), BROADCAST_ROWS)
    return rows.join(active, ["host", "fetched"], "left").select(
        "page_id", "host", "fetched", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries")
    )
