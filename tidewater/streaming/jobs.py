"""Incremental jobs: session bars by event time, idempotent scoring, deferred outcomes, change-only sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def hourly_bars(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and volume per symbol and hour of (ts, symbol, price, quantity); the same code runs on a batch and on a stream."""
    source = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    g = source.groupBy("symbol", F.window("ts", "1 hour").alias("w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("quantity").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


#: Keys share this many states: a task handles a bucket's rows and keys together, as frames.
BUCKETS = 512


class LastPrint(StatefulProcessor):
    """Holds of each key (`key__`) when its last row was and its tracked columns as text (`print__`), for all keys of a bucket in one state; gives the rows that
    differ from the one before them. Rows not later than the last one, which come again or late, change nothing. With nothing tracked only a key's first row is given."""

    def __init__(self, order: str, columns: list[str]):
        self.order, self.columns = order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "keys binary")

    def _known(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(self.last.get()[0]).read_pandas() if self.last.exists() else None

    def _hold(self, rows: pd.DataFrame, known: pd.DataFrame | None) -> None:
        """Keep each key's last row of `rows`, sorted, and of what was known the keys that did not come."""
        last = rows.drop_duplicates("key__", keep="last")[["key__", self.order, "print__"]].set_axis(["key__", "_at", "_told"], axis=1)
        if known is not None:
            last = pd.concat([known[~known["key__"].isin(last["key__"])], last], ignore_index=True)
        table = pa.Table.from_pandas(last, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        self.last.update((out.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, known = pd.concat(list(rows), ignore_index=True), self._known()
        if known is None:
            frame["_told"] = None
        else:
            frame = frame.merge(known, on="key__", how="left")
            seen = frame["_at"].notna()
            come = frame[seen]
            frame = pd.concat([frame[~seen], come[~(come[self.order] <= come["_at"]).astype(bool)]])
        if len(frame):
            frame = frame.sort_values(["key__", self.order, "print__"], kind="stable", ignore_index=True)
            before = frame["print__"].shift().where(frame["key__"] == frame["key__"].shift(), frame["_told"])
            self._hold(frame, known)
            yield frame.loc[before.isna() | (before != frame["print__"]), self.columns]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._hold(initialState.sort_values(["key__", self.order], kind="stable"), self._known())


def _text(df: DataFrame, columns: list[str]) -> Column:
    """Values as one text, different for different values; null is a value. (Names of columns that go to a task as rows may not begin with an underscore.)"""
    kinds = dict(df.dtypes)
    each = [F.unix_micros(c) if kinds[c] == "timestamp" else F.col(c) for c in columns]
    each = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in each]
    return F.concat(F.lit(""), *each)


def changed_only(stream: DataFrame, before: DataFrame | None, keys: list[str], tracked: list[str], order: str) -> DataFrame:
    """The rows of a stream in which a tracked column differs from the row of their key before them; `before`, read once when the query starts first, says
    what each key's last row was (rows of the stream's columns)."""
    # a store on disk beside each task: keys need not fit in memory
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def dealt(df: DataFrame):
        told = df.select("*", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket__"), _text(df, keys).alias("key__"), _text(df, tracked).alias("print__"))
        return told.groupBy("bucket__")

    start = None if before is None else dealt(before.select(*stream.columns))
    return dealt(stream).transformWithStateInPandas(LastPrint(order, stream.columns), stream.schema, "Append", "None", start)


def _target(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(columns).parquet(path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None


def _append(rows: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame]):
    """Write each batch of `rows` to a partition of its own, named after the query's folder and the batch: a batch that is run again replaces itself."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def sink(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={name}-{number}")

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scoring_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str], order: str):
    """Score what has arrived and append each prediction once, whichever batch its key comes in again: keys are held as state. Started with a new
    checkpoint over a table that has rows (the columns `keys` and `order` among them), it goes on from these."""
    old = _target(stream.sparkSession, path, ", ".join(f"{c} {t}" for c, t in stream.dtypes if c in (*keys, order)))
    # only keys and order tell a row that was scored before; its other columns are not needed
    before = None if old is None else old.select(*(F.col(c) if c in old.columns else F.lit(None).cast(t).alias(c) for c, t in stream.dtypes))
    return _append(changed_only(stream, before, keys, [], order), path, checkpoint, score)


def change_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], tracked: list[str], order: str):
    """Append each row in which a tracked column differs from the row of its key before it. The last row of each key is held as state, so no batch reads
    the table; a new checkpoint over a table that has rows starts from each key's last one."""
    old = _target(stream.sparkSession, path, ", ".join(f"{c} {t}" for c, t in stream.dtypes))
    return _append(changed_only(stream, old, keys, tracked, order), path, checkpoint, lambda batch: batch)


def resolved(predictions: DataFrame, labels: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Predictions (symbol, ts, probability) with their outcome (symbol, known_ts, for_ts, outcome) once it is known; on streams a left
    outer join bounded by watermarks, which gives null when the horizon has passed without one."""
    p, y = predictions, labels
    if p.isStreaming:
        p, y = p.withWatermark("ts", horizon), y.withWatermark("known_ts", horizon)
    y = y.select(F.col("symbol").alias("_s"), "for_ts", "known_ts", "outcome")
    on = (F.col("symbol") == F.col("_s")) & (F.col("ts") == F.col("for_ts")) & (F.col("known_ts") >= F.col("ts")) & (F.col("known_ts") <= F.col("ts") + F.expr(f"interval {horizon}"))
    return p.join(y, on, "left_outer").select("symbol", "ts", "probability", "known_ts", "outcome")
