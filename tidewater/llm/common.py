"""What the operators of this subpackage share: the shared folder, written tables, gapless slots."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def ship(spark: SparkSession) -> None:
    """Let Python workers started from now on import this repository in local runs (a cluster ships it with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a run on one machine (a local master) gets
    an own one, and any other is refused: what is written to a machine's own disk would be lost to the others."""
    at = spark.conf.get(_SETTING, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set(_SETTING, at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def passing(spark: SparkSession, path: str) -> None:
    """Have the file system remove what is under `path` when the driver ends."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, reads prune columns.
    The table goes when the driver ends."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checked_broadcast(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """`df` (a written table) with a broadcast hint if it holds at most so many rows and bytes; beyond that the join shuffles."""
    sizes = [F.lit(8 * len(df.columns))]
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(field.name), F.lit(0)))
        elif kind in ("array", "map"):
            sizes.append(32 * F.greatest(F.size(field.name), F.lit(0)))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(functools.reduce(Column.__add__, sizes)), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def gapless_slots(df: DataFrame, group: Column, order: list[str], salts: int) -> DataFrame:
    """Add `slot`: 0, 1, ... without gaps inside each value of `group`, with no task that holds a whole group.

    Rows of a group are dealt over `salts` pieces by a hash of `order`; each piece is numbered by itself and
    starts where the counts of the pieces before it end. The counts (groups x salts rows) are summed map-side.
    Rows equal in all of `order` take neighbouring slots in no fixed order.
    """
    dealt = df.withColumn("_g", group).withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = dealt.groupBy("_g", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_g").alias("_g2"), F.col("_s").alias("_s2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_g", "_s").orderBy(*order)
    return (
        dealt.withColumn("_r", F.row_number().over(inside))
        .join(starts, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_s") == F.col("_s2")))
        .withColumn("slot", F.col("_from") + F.col("_r") - 1)
        .drop("_g", "_s", "_g2", "_s2", "_from", "_r")
    )


#: What operators keep in a worker from task to task; each is a list that may be emptied.
memories: list[list] = []


def forget() -> None:
    """Empty what other operators keep in this worker: workers go on from stage to stage."""
    for kept in memories:
        kept.clear()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` (batches to batches) that gives freed memory back to the system when its task ends."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
