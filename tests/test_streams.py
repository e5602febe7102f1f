"""Keyed state of the streams: several batches, late and repeated rows, restarts with and without the checkpoint."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewater.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, v double, note string"


def batch(rng, first, n):
    return [(rng.choice("abc"), T0 + timedelta(minutes=first + i), rng.choice([None, 1.0, 2.0]), rng.choice("xy")) for i in range(n)]


def run(spark, tmp_path, checkpoint, tracked):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")
    jobs.change_stream(stream, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", ["k"], tracked, "at").awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "at", "v", "note").fillna(-1.0).collect())


def changes(rows, tracked):
    out, last = [], {}
    for r in sorted(rows, key=lambda r: r[1]):
        told = tuple(r[i] for i in tracked)
        if last.get(r[0], "none") != told:
            out.append((r[0], r[1], -1.0 if r[2] is None else r[2], r[3]))
        last[r[0]] = told
    return sorted(out)


def test_changes_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for n in range(3):
        more = batch(rng, 100 * n, 40)
        spark.createDataFrame(more, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/src/{n}")
        rows += more
        assert run(spark, tmp_path, "c", ["v"]) == changes(rows, [2])
    # rows given again and rows from before the last ones change nothing; a new checkpoint goes on from the table
    spark.createDataFrame(rows[:50], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/src/again")
    spark.createDataFrame([("a", T0 - timedelta(1), 9.0, "late")], SCHEMA).write.parquet(f"{tmp_path}/src/late")
    want = changes(rows, [2])
    assert run(spark, tmp_path, "c", ["v"]) == want
    assert run(spark, tmp_path, "other", ["v"]) == want
    spark.createDataFrame([("a", T0 + timedelta(9), 77.0, "new")], SCHEMA).write.parquet(f"{tmp_path}/src/new")
    assert run(spark, tmp_path, "other", ["v"]) == sorted([*want, ("a", T0 + timedelta(9), 77.0, "new")])


def test_each_key_is_scored_once(spark, tmp_path):
    rng = random.Random(2)
    rows = batch(rng, 0, 30)
    schema = "k string, at timestamp, v double, note string"
    for n, part in enumerate((rows[:20], rows[10:], rows)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/src/{n}")
    for checkpoint in ("c", "c", "d"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/src/*")
        jobs.scoring_stream(stream, lambda b: b.select("k", "at", (F.coalesce("v", F.lit(0.0)) > 1).alias("up")), f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", ["k", "at"], "at").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out").select("k", "at", "up").collect()
        assert sorted(map(tuple, got)) == sorted((k, at, (v or 0) > 1) for k, at, v, _ in rows)


def test_keys_share_states(spark, tmp_path):
    """60,000 keys, some null, in two batches that overlap by half: keys share a bounded number of states."""
    e = spark.range(60_000).select(F.when(F.col("id") % 10_000 > 0, F.col("id")).alias("k"), F.timestamp_seconds("id").alias("at"))
    e.where("at < timestamp_seconds(40000)").write.parquet(f"{tmp_path}/src/0")
    e.where("at >= timestamp_seconds(20000)").write.parquet(f"{tmp_path}/src/1")
    for n in range(2):
        stream = spark.readStream.schema("k long, at timestamp").parquet(f"{tmp_path}/src/{n}")
        ran = jobs.scoring_stream(stream, lambda b: b, f"{tmp_path}/out", f"{tmp_path}/c{n}", ["k"], "at")
        ran.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in ran.recentProgress if p["stateOperators"]) <= 512
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == 60_000 - 6 + 1 and got.where("k is null").count() == 1
