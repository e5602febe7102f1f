"""As-of, interval, window-range and cascade joins over panels with separate event and known-at times."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(df: DataFrame, at: str) -> Column:
    """A date in days, a time in seconds (both since 1970), a number as it is."""
    kind = df.schema[at].dataType.typeName()
    return F.unix_date(at).cast("long") if kind == "date" else F.col(at).cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col(at)


def asof(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], exact: bool = True, cell: float | None = None) -> DataFrame:
    """Each left row with the `values` (and the time, `asof_at`) of the last right row at or before it (before it, unless `exact`).

    Both sides are unioned, sorted once per key and filled forward: linear, one shuffle. Right rows of one time: the largest values win.
    A left row without key or time finds nothing. Where one key may hold a large share of all rows, `cell` (days, seconds or units) cuts
    each key's time into pieces that are sorted in tasks of their own: the last right row of every piece is carried into the pieces
    behind it, over a table of keys and pieces. The result is the same; the right side is read twice."""
    keys = [F.col(c) for c in by]
    side = F.lit(0 if exact else 2)
    piece = (lambda df, at: F.floor(place(df, at) / cell)) if cell else (lambda df, at: F.lit(0))
    known = functools.reduce(Column.__and__, (F.col(c).isNotNull() for c in (right_at, *by)))
    found = right.where(known).select(*keys, piece(right, right_at).alias("_piece"), F.col(right_at).alias("_at"), side.alias("_side"), F.struct(F.col(right_at).alias("at"), *values).alias("_v"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asked = left.select(*keys, piece(left, left_at).alias("_piece"), F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(found.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    both = found.unionByName(asked)
    if cell:
        heads = both.groupBy(*by, "_piece").agg(F.max("_v").alias("_m"))
        before = F.last("_m", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
        carried = heads.withColumn("_v", before).where("_v is not null and _piece is not null")
        both = both.unionByName(carried.select(*keys, "_piece", F.lit(None).cast(found.schema["_at"].dataType).alias("_at"), F.lit(-1).alias("_side"), "_v", F.lit(None).cast(found.schema["_row"].dataType).alias("_row")))
    order = Window.partitionBy(*by, "_piece").orderBy(F.asc_nulls_first("_at"), "_side", F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_row is not null")
    return filled.select("_row.*", F.col("_last.at").alias("asof_at"), *(F.col(f"_last.{v}").alias(v) for v in values))


def first_from(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, values: list[str], exact: bool = True) -> DataFrame:
    """As `asof`, looking ahead: the first right row at or after each left row (after it, unless `exact`)."""
    a = left.withColumn("_ahead", -place(left, left_at))
    b = right.withColumn("_behind", -place(right, right_at)).withColumn("_on", F.col(right_at))
    return asof(a, b, by, "_ahead", "_behind", ["_on", *values], exact).drop("_ahead").withColumn("asof_at", F.col("_on")).drop("_on")


#: Time cells nest by fours: spans of dates or whole numbers up to RADIX ** LEVELS / 2 on both sides of 1970 (or 0).
RADIX, LEVELS = 4, 10


def _level_column() -> Column:
    return F.explode(F.array(*map(F.lit, range(LEVELS)))).alias("_level")


def _tiled(spans: DataFrame) -> DataFrame:
    """`spans` with the fewest cells that tile the places from `_first` to `_end`, each place in one of them: a row for each stretch of cells of a level,
    their numbers from `_low` to `_high`."""
    size = F.pow(F.lit(RADIX), F.col("_level"))
    low, high = F.ceil(F.col("_first") / size), F.floor((F.col("_end") + 1) / size) - 1
    up_low, up_high = F.ceil(F.col("_first") / (size * RADIX)), F.floor((F.col("_end") + 1) / (size * RADIX)) - 1
    d = spans.select("*", _level_column()).select("*", low.alias("_a"), high.alias("_b"), up_low.alias("_ua"), up_high.alias("_ub")).where("_a <= _b")
    whole = (F.col("_ua") > F.col("_ub")) | (F.col("_level") == LEVELS - 1)
    # what a larger cell can't take: all of it, or what lies before and behind the larger cells
    pair = lambda a, b: F.struct(a.cast("long").alias("_low"), b.cast("long").alias("_high"))
    each = F.array(pair(F.col("_a"), F.when(whole, F.col("_b")).otherwise(F.col("_ua") * RADIX - 1)), pair(F.when(whole, F.col("_b") + 1).otherwise((F.col("_ub") + 1) * RADIX), F.col("_b")))
    return d.select(*spans.columns, "_level", F.explode(each).alias("_c")).select(*spans.columns, "_level", "_c.*").where("_low <= _high")


def interval_join(facts: DataFrame, links: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Facts with the links of the same key that hold on their date (null end: still holds).

    Each link's span is tiled with nested cells, each fact lies in one cell a level, and both meet by (key, level, cell): rows of a key are
    paired only where the link holds (to the day, for times), whatever number of rows the key has on both sides. Facts take only the levels that
    some span uses, at most LEVELS rows. The tiles are many times the links that the optimizer sizes them by, so they are never broadcast."""
    half = RADIX**LEVELS // 2
    shifted = lambda df, c: F.least(F.greatest(F.floor(place(df, c) / (86_400 if df.schema[c].dataType.typeName().startswith("timestamp") else 1)) + half, F.lit(0)), F.lit(2 * half - 1))
    held = links.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(start) <= F.col(end)))).withColumn("_first", shifted(links, start)).withColumn("_end", F.when(F.col(end).isNull(), 2 * half - 1).otherwise(shifted(links, end)))
    spans = _tiled(held).select(*links.columns, "_level", F.explode(F.sequence("_low", "_high")).alias("_cell"))
    used = F.broadcast(_tiled(held.select("_first", "_end").distinct()).select("_level").distinct())
    points = facts.where(F.col(at).isNotNull()).select("*", _level_column()).join(used, "_level", "left_semi").withColumn("_cell", F.floor(shifted(facts, at) / F.pow(F.lit(RADIX), F.col("_level"))))
    return points.join(spans.hint("merge"), [*on, "_level", "_cell"]).drop("_level", "_cell").where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) <= F.col(end))))


def best_match(df: DataFrame, keys: list[str], score: str, *tie: str) -> DataFrame:
    """Per key the row with the smallest score."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(score, *tie))).where("_n = 1").drop("_n")


def latest_before(events: DataFrame, notes: DataFrame, on: list[str], event_at: str, note_at: str, days: int, tie: str) -> DataFrame:
    """Each event with the latest note of its key dated in [event - days, event); of notes of one day the one with the smallest `tie`. An as-of join: no pairs."""
    others = [c for c in notes.columns if c not in (*on, note_at)]
    one = notes.groupBy(*on, note_at).agg(F.min_by(F.struct(*others), tie).alias("_note"))
    near = asof(events, one, on, event_at, note_at, ["_note"], exact=False).where(F.col("asof_at") >= F.date_sub(event_at, days))
    return near.select(*on, *(c for c in events.columns if c not in on), F.col("asof_at").alias(note_at), "_note.*")


def rows_around(facts: DataFrame, events: DataFrame, on: list[str], at: str, event_at: str, before: int, after: int) -> DataFrame:
    """Facts within [event - before, event + after] days of any event of their key, each once: the last event up to a fact and the first one from it on decide."""
    e = events.select(*on, F.col(event_at).alias("_event")).distinct()
    back = asof(facts, e, on, at, "_event", []).withColumnRenamed("asof_at", "_back")
    both = first_from(back, e, on, at, "_event", [])
    near = (F.datediff(at, "_back") <= after) | (F.datediff("asof_at", at) <= before)
    return both.where(near).select(*facts.columns)


def nearest_owner(follow_ups: DataFrame, offers: DataFrame, on: list[str], follow_at: str, offer_at: str, days: int = 365) -> DataFrame:
    """Follow-ups with the offer they belong to: from its date until the issuer's next offer, `days` at most. An as-of join: no pairs."""
    others = [c for c in offers.columns if c not in (*on, offer_at)]
    owned = asof(follow_ups, offers, on, follow_at, offer_at, others).where(F.datediff(follow_at, "asof_at") <= days)
    return owned.select(*on, *(c for c in follow_ups.columns if c not in on), F.col("asof_at").alias(offer_at), *others)


def lagged_period(costs: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """Value of the previous period that the entity has (rows, not calendar)."""
    return costs.withColumn(value, F.lag(value).over(Window.partitionBy(entity).orderBy(period)))


def densify(series: DataFrame, calendar: DataFrame, at: str, values: list[str]) -> DataFrame:
    """All calendar days, values 0 where the series has none."""
    return calendar.select(at).join(series, at, "left").select(at, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def interval_sums(trades: DataFrame, rates: DataFrame, entry: str, exit_: str, at: str, rate: str) -> DataFrame:
    """Sum of the daily rate over (entry, exit] for each trade, as the difference of two running sums. They run over the dates that
    occur on either side, a short axis however many the trades, and trades meet them by equal dates."""
    dates = trades.select(F.col(entry).alias("_d")).union(trades.select(exit_)).union(rates.select(at)).where("_d is not null").distinct()
    daily = rates.groupBy(F.col(at).alias("_d")).agg(F.sum(rate).alias("_r"))
    so_far = F.sum("_r").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
    running = dates.join(daily, "_d", "left").select("_d", F.coalesce(so_far, F.lit(0)).alias("_sum"))
    for end, name in ((entry, "_a"), (exit_, "_b")):
        trades = trades.join(running.select(F.col("_d").alias(end), F.col("_sum").alias(name)), end, "left")
    return trades.withColumn("rate_sum", F.coalesce("_b", F.lit(0)) - F.coalesce("_a", F.lit(0))).drop("_a", "_b")


def session_of(df: DataFrame, calendar: DataFrame, at: str, out: str, ahead: bool, strict: bool = True) -> DataFrame:
    """`out`: the day_index of the first session after `at` (`ahead`), or of the last before it; a session on the day itself counts unless
    `strict`. Found once for each distinct date, over the dates of both sides, and joined by equality."""
    days = calendar.select(F.col("dt").alias("_d"), F.col("day_index").cast("int").alias("_session"))
    asked = df.select(F.col(at).cast("date").alias("_d")).where("_d is not null").distinct()
    # of one day, the session is met first if it counts looking back, or must not looking ahead
    session_first = strict == ahead
    both = days.withColumn("_side", F.lit(0 if session_first else 1)).unionByName(asked.select("_d", F.lit(None).cast("int").alias("_session"), F.lit(1 if session_first else 0).alias("_side")))
    w = Window.orderBy("_d", "_side")
    seen = F.first("_session", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if ahead else F.last("_session", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = both.select("_d", "_session", seen.alias(out)).where("_session is null").drop("_session")
    # a row a date, however many rows ask: never worth a shuffle of theirs
    return df.join(F.broadcast(found), F.col(at).cast("date") == F.col("_d"), "left").drop("_d")


def overrides(df: DataFrame, manual: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Manual values win where given."""
    m = manual.select(*on, *(F.col(c).alias(f"_{c}") for c in columns))
    return df.join(m, on, "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


STOP_WORDS = ["inc", "corp", "co", "company", "ltd", "plc", "the", "group", "holdings", "trust", "llc", "lp"]


def name_key(name: Column) -> Column:
    """Lower-cased words of a name without punctuation and legal forms."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " +")
    return F.filter(F.array_except(words, F.array(*map(F.lit, STOP_WORDS))), lambda x: x != "")


def same_issuer(a: Column, b: Column) -> Column:
    """Names of one issuer: equal first four letters, one in the other, or a shared word of three letters or more."""
    x, y = name_key(a), name_key(b)
    s, t = F.array_join(x, ""), F.array_join(y, "")
    shared = F.arrays_overlap(F.filter(x, lambda w: F.length(w) >= 3), y)
    return F.coalesce((F.length(s) > 0) & (F.length(t) > 0) & ((F.substring(s, 1, 4) == F.substring(t, 1, 4)) | s.contains(t) | t.contains(s) | shared), F.lit(False))


def _blocks(name: Column) -> tuple[Column, Column]:
    """Block keys of a name: those it is found by (words of three letters or more, its beginning), and those it looks under (the words, and every
    stretch of its letters that another name's beginning could be)."""
    words = name_key(name)
    joined = F.array_join(words, "")
    long = F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("w"), w))
    begin = F.when(F.length(joined) > 0, F.array(F.concat(F.lit("b"), F.substring(joined, 1, 4)))).otherwise(F.array().cast("array<string>"))
    n = F.length(joined)
    stretches = F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.concat(F.lit("b"), joined.substr(i, k))))))
    return F.array_union(long, begin), F.array_distinct(F.concat(long, F.coalesce(stretches, F.array().cast("array<string>"))))


def fuzzy_links(a: DataFrame, b: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """Pairs of rows of `a` and `b` whose names are of one issuer (`same_issuer`); the rule is tried only on names that meet in a block.

    Names meet by a shared word of three letters or more, or where the beginning (four letters, or all of a shorter name) of one occurs in the
    other, which equal beginnings and contained names both imply. Distinct names meet, not rows, and each pair of names once."""
    side = {}
    for k, df, name in ((0, a, a_name), (1, b, b_name)):
        found, look = _blocks(F.col(name))
        names = df.select(F.col(name)).where(F.col(name).isNotNull()).distinct()
        side[k] = (names.select(F.col(name).alias(f"_n{k}"), F.explode(found).alias("_block")), names.select(F.col(name).alias(f"_n{k}"), F.explode(look).alias("_block")))
    pairs = side[0][0].join(side[1][1], "_block").select("_n0", "_n1").union(side[0][1].join(side[1][0], "_block").select("_n0", "_n1")).distinct()
    same = pairs.where(same_issuer(F.col("_n0"), F.col("_n1")))
    return a.join(same, a[a_name] == same["_n0"]).drop("_n0").join(b, F.col("_n1") == b[b_name]).drop("_n1")


def cascade_link(df: DataFrame, steps: list[tuple[DataFrame, list[str], str]], out: str) -> DataFrame:
    """`out` from the first step that gives a row's keys exactly one id. Each step: (links, key columns, id column)."""
    for i, (links, keys, ident) in enumerate(steps):
        single = links.groupBy(*keys).agg(F.count_distinct(ident).alias("_n"), F.min(ident).alias(f"_id{i}")).where("_n = 1").drop("_n")
        df = df.join(single, keys, "left")
    ids = [f"_id{i}" for i in range(len(steps))]
    return df.withColumn(out, F.coalesce(*ids)).drop(*ids)


def anti(df: DataFrame, flagged: DataFrame, on: list[str]) -> DataFrame:
    return df.join(flagged.select(*on).distinct(), on, "left_anti")


def semi(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    return df.join(members.select(*on).distinct(), on, "left_semi")


def matched_controls(rows: DataFrame, treated: Column, cells: list[str]) -> DataFrame:
    """Rows that are not treated but share a cell (equal values of `cells`) with one that is; each once."""
    marked = rows.withColumn("_t", F.coalesce(treated, F.lit(False)))
    return marked.where("not _t").join(marked.where("_t").select(*cells).distinct(), cells, "left_semi").drop("_t")
