"""Data quality, quarantine, change capture, hash chains and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize_bars(raw: DataFrame, order: str) -> DataFrame:
    """Lower-case names, adj_close defaults to close, null or non-positive prices dropped, null volume 0, the last row of a (symbol, dt) by `order` kept."""
    df = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    if "adj_close" not in df.columns:
        df = df.withColumn("adj_close", F.col("close"))
    df = df.withColumn("adj_close", F.coalesce("adj_close", "close")).withColumn("dt", F.to_date("dt")).withColumn("volume", F.coalesce("volume", F.lit(0)))
    prices = ["open", "high", "low", "close", "adj_close"]
    df = df.where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in prices]))
    w = Window.partitionBy("symbol", "dt").orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bar_issues(bars: DataFrame, max_move: float = 0.35, max_gap: int = 10) -> DataFrame:
    """symbol, dt, issue, severity of every broken rule: price order (error), zero volume, extreme move, calendar gap (warnings)."""
    w = Window.partitionBy("symbol").orderBy("dt")
    move = F.abs(F.try_divide("adj_close", F.lag("adj_close").over(w)) - 1)
    broken = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    rules = [("price_order", "error", broken), ("zero_volume", "warn", F.col("volume") == 0), ("extreme_move", "warn", move > max_move), ("calendar_gap", "warn", F.datediff("dt", F.lag("dt").over(w)) > max_gap)]
    marks = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, s, hit in rules)))
    return bars.withColumn("_marks", marks).select("symbol", "dt", F.explode("_marks").alias("x")).select("symbol", "dt", "x.issue", "x.severity")


def validate_rows(df: DataFrame, key: str, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(key, column, message, severity) of each rule (column, message, severity, broken) that a row breaks."""
    marks = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(c).alias("column"), F.lit(m).alias("message"), F.lit(s).alias("severity"))) for c, m, s, hit in rules)))
    return df.withColumn("_marks", marks).select(key, F.explode("_marks").alias("x")).select(key, "x.*")


def quarantine(df: DataFrame, rules: DataFrame, symbol: str = "symbol", at: str = "dt") -> tuple[DataFrame, DataFrame]:
    """(kept, moved): rows within [since, until] of a rule for their symbol are moved, with its reason (the smallest, if several)."""
    r = rules.select(F.col("symbol").alias("_s"), "since", "until", "reason")
    hit = (F.col(symbol) == F.col("_s")) & (F.col("since").isNull() | (F.col(at) >= F.col("since"))) & (F.col("until").isNull() | (F.col(at) <= F.col("until")))
    kept = df.join(r, hit, "left_anti")
    moved = df.join(r, hit).groupBy(*df.columns).agg(F.min("reason").alias("reason"))
    return kept, moved


def snapshot_diff(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """key, change: added or removed."""
    a = now.select(key).exceptAll(before.select(key)).withColumn("change", F.lit("added"))
    return a.unionByName(before.select(key).exceptAll(now.select(key)).withColumn("change", F.lit("removed")))


def _normal(c: str) -> Column:
    """One text for equal values of any type; null is the empty text."""
    x = F.trim(F.col(c).cast("string"))
    n = x.try_cast("double")
    return F.coalesce(F.when(n.isNotNull(), F.format_string("%.6f", n)).otherwise(x), F.lit(""))


def changed_rows(latest_source: DataFrame, new: DataFrame, keys: list[str], tracked: list[str], order: str) -> DataFrame:
    """New rows that differ in a tracked column from the latest row of their key, or whose key is new."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    old = latest_source.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*keys, F.concat_ws("\x1f", *map(_normal, tracked)).alias("_old"))
    return new.join(old, keys, "left").where(F.col("_old").isNull() | (F.col("_old") != F.concat_ws("\x1f", *map(_normal, tracked)))).drop("_old")


def changes(before: DataFrame, new: DataFrame, keys: list[str], tracked: list[str], order: str) -> DataFrame:
    """New rows, later than the latest row of their key in `before`, that differ in a tracked column from the row of their key just before
    them, new or old; and the first rows of new keys. Rows that are given again change nothing."""
    latest = Window.partitionBy(*keys).orderBy(F.desc(order))
    prints = F.concat_ws("\x1f", *map(_normal, tracked))
    old = before.join(new.select(*keys).distinct(), keys, "left_semi").withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*keys, F.col(order).alias("_at"), prints.alias("_old"))
    rows = new.join(old, keys, "left").where(F.col("_at").isNull() | (F.col(order) > F.col("_at"))).withColumn("_new", prints)
    was = F.coalesce(F.lag("_new").over(Window.partitionBy(*keys).orderBy(order, "_new")), F.col("_old"))
    return rows.withColumn("_was", was).where(F.col("_was").isNull() | (F.col("_was") != F.col("_new"))).drop("_at", "_old", "_new", "_was")


def chain_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


def first_broken_link(ledger: DataFrame, line: str, payload: Column, start: str = "0" * 64, piece: int = 100_000) -> DataFrame:
    """One row: the first line (a number) whose prev_hash or entry_hash does not follow from the lines before (null: chain is whole).

    Ranges of `piece` line numbers are checked each by itself; what each ends with is handed to the first line of the next one that has any,
    over a table of one row a range."""
    d = ledger.withColumn("_piece", F.floor(F.col(line) / piece))
    ends = d.groupBy("_piece").agg(F.max_by("entry_hash", line).alias("_end"))
    handed = ends.select("_piece", F.lag("_end").over(Window.orderBy("_piece")).alias("_handed"))
    w = Window.partitionBy("_piece").orderBy(line)
    d = d.join(handed, "_piece").withColumn("_before", F.coalesce(F.when(F.row_number().over(w) == 1, F.coalesce("_handed", F.lit(start))), F.lag("entry_hash").over(w)))
    good = (F.col("prev_hash") == F.col("_before")) & (F.col("entry_hash") == chain_hash(F.col("prev_hash"), payload))
    return d.withColumn("_ok", F.coalesce(good, F.lit(False))).agg(F.min(F.when(~F.col("_ok"), F.col(line))).alias("first_broken"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """keys, problem: left_only, right_only, or the first column that differs by more than the tolerance."""
    a = left.select(*keys, F.lit(1).alias("_l"), *(F.col(c).alias(f"_l_{c}") for c in columns))
    b = right.select(*keys, F.lit(1).alias("_r"), *(F.col(c).alias(f"_r_{c}") for c in columns))
    problem = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
    for c in columns:
        x, y = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        apart = F.coalesce(F.abs(x - y) > tolerance * F.greatest(F.lit(1.0), F.abs(y)), x.isNull() != y.isNull())
        problem = problem.when(apart, c)
    return a.join(b, keys, "full_outer").select(*keys, problem.alias("problem")).where("problem is not null")


def stale_symbols(source: DataFrame, built: DataFrame) -> DataFrame:
    """One row: symbols in the source and in what was built from it."""
    return source.agg(F.count_distinct("symbol").alias("source_symbols")).crossJoin(built.agg(F.count_distinct("symbol").alias("built_symbols")))


def severe_symbols(bars: DataFrame) -> DataFrame:
    """Symbols with a move beyond +300 % or -90 % or an open more than half away from the close."""
    move = F.try_divide("adj_close", F.lag("adj_close").over(Window.partitionBy("symbol").orderBy("dt"))) - 1
    return bars.withColumn("_m", move).where((F.col("_m") > 3) | (F.col("_m") < -0.9) | (F.abs(F.try_divide("open", "close") - 1) > 0.5)).select("symbol").distinct()
