"""Daily and session bars derived from the star-schema tables, so that every panel operator has a fact table to run on.

`DAILY_SQL` and `SESSION_SQL` say the same in SQL, as common table expressions named `bars` and `hourly`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(number: Column, kind: str = "S") -> Column:
    return F.concat(F.lit(kind), F.lpad(number.cast("string"), 5, "0"))


def symbol_sql(number: str, kind: str = "S") -> str:
    return f"'{kind}' || lpad(cast({number} as varchar), 5, '0')"


#: Customers and users belong to the symbol of their fifteen: there are as many symbols as suppliers, and a tenth of that in the sessions.
FIFTEEN = 15


def customer_symbol(key: Column) -> Column:
    return symbol_of(F.floor(key / FIFTEEN).cast("long"))


CUSTOMER_SYMBOL_SQL = symbol_sql(f"o_custkey // {FIFTEEN}")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, dt, open, high, low, close, adj_close, volume: one row for each supplier and day with trades.

    A supplier has hardly more trades than days with trades, so sums before the shuffle would save nothing: trades are dealt by symbol, and sorted once
    by symbol and day, which is also how the windows over bars want them."""
    price = F.lit(100.0) + F.sqrt(F.col("l_extendedprice") / F.col("l_quantity")) / 10
    rows = table(spark, sf_dir, "lineitem").select(
        symbol_of(F.col("l_suppkey")).alias("symbol"),
        F.to_date("l_shipdate").alias("dt"),
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("k"),
        price.alias("p"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
    )
    out = rows.repartition("symbol").groupBy("symbol", "dt").agg(
        F.min_by("p", F.struct("k", "p")).alias("open"),
        F.max(F.col("p") * (1 + F.col("d") / 4)).alias("high"),
        F.min(F.col("p") * (1 - F.col("t") / 4)).alias("low"),
        F.max_by(F.col("p") * (1 + (F.col("d") - F.col("t")) / 4), F.struct("k", "p", "d", "t")).alias("close"),
        F.sum("q").cast("long").alias("volume"),
    )
    factor = F.when(F.col("dt") < F.lit("1998-07-01").cast("date"), 0.5).otherwise(1.0)
    return out.select("symbol", "dt", "open", "high", "low", "close", (F.col("close") * factor).alias("adj_close"), "volume")


def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt: the days of `daily_bars`, each once. Every day of a line item has a bar, so no bars are made for it."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("dt")).distinct()


DAILY_SQL = f"""trades as (
  select {symbol_sql("l_suppkey")} as symbol, cast(l_shipdate as date) as dt,
         l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey as k,
         100.0::double + sqrt(l_extendedprice / l_quantity) / 10 as p, l_quantity as q, l_discount as d, l_tax as t
  from lineitem),
bars as (
  select *, "close" * (case when dt < date '1998-07-01' then 0.5::double else 1.0::double end) as adj_close from (
    select symbol, dt, arg_min(p, {{'k': k, 'p': p}}) as open, max(p * (1 + d / 4)) as high, min(p * (1 - t / 4)) as low,
           arg_max(p * (1 + (d - t) / 4), {{'k': k, 'p': p, 'd': d, 't': t}}) as "close", cast(sum(q) as bigint) as volume
    from trades group by symbol, dt))"""


def session_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, session, bar (0..6), bars_in_session, open, high, low, close, volume: events as trades, 7 bars a day, a symbol for
    each fifteen users."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").select(
        symbol_of(F.floor(F.col("user_id") / FIFTEEN).cast("long"), "E").alias("symbol"),
        F.to_date("ts").alias("session"),
        F.floor((F.hour("ts") * 60 + F.minute("ts")) * 7 / 1440).cast("int").alias("bar"),
        "event_id",
        (F.lit(100.0) + F.floor(F.col("value") * 10) / 100).alias("p"),
    )
    out = rows.groupBy("symbol", "session", "bar").agg(
        F.min_by("p", "event_id").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "event_id").alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return out.withColumn("bars_in_session", F.count(F.lit(1)).over(Window.partitionBy("symbol", "session")))


SESSION_SQL = f"""ticks as (
  select {symbol_sql(f"user_id // {FIFTEEN}", "E")} as symbol, cast(ts as date) as session,
         cast(floor((hour(ts) * 60 + minute(ts)) * 7 / 1440.0) as integer) as bar, event_id, 100.0::double + floor(value * 10) / 100 as p
  from events),
hourly as (
  select *, count(*) over (partition by symbol, session) as bars_in_session from (
    select symbol, session, bar, arg_min(p, event_id) as open, max(p) as high, min(p) as low, arg_max(p, event_id) as "close", count(*) as volume
    from ticks group by symbol, session, bar))"""
