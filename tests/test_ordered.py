"""Counted ranks and quantiles against sorted lists, with skewed groups, ties, nulls and few or many pieces."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregates, inference, modelling, ordered, quality, windows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.5, round(rng.gauss(0, 1), 2)]), i) for i in range(3000)]
    return out + [("one", 5.0, -1), ("none", None, -2)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, v double, i int").repartition(4)


@pytest.mark.parametrize("pieces", [1, 5, 64])
def test_counts_below_and_quantiles(spark, rows, pieces):
    df = frame(spark, rows)
    values = {}
    for g, v, _ in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    got = {(r.g, r.v): (r.n, r.n_before) for r in ordered.counted(df, ["g"], "v", pieces).collect()}
    assert got == {(g, v): (x.count(v), sum(y < v for y in x)) for g, x in values.items() for v in set(x)}
    probs = [0.0, 0.005, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.q for r in ordered.quantiles(df, ["g"], "v", probs, pieces=pieces).collect()}
    assert got.keys() == values.keys()
    for g, x in values.items():
        assert got[g] == pytest.approx(np.quantile(x, probs).tolist(), abs=1e-12)
    want = df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()
    assert all(got[r.g] == pytest.approx(r.q, abs=1e-12) for r in want)
    (whole,) = ordered.quantiles(df, [], "v", [0.25], pieces=pieces).collect()
    assert whole.q[0] == pytest.approx(np.quantile([v for _, v, _ in rows if v is not None], 0.25))
    assert ordered.quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_ranks_and_numbers(spark, rows):
    df = frame(spark, rows)
    got = {r.i: r.r for r in ordered.average_ranks(df, ["g"], "v", "r").collect()}
    by = {r.i: r.r for r in df.withColumn("r", windows.average_rank("v", ["g"])).collect()}
    assert got == by and len(got) == len(rows)
    n = ordered.numbered(df, ["g"], ["i"], 3, "n").collect()
    for g in {r[0] for r in rows}:
        assert sorted(r.n for r in n if r.g == g) == list(range(1, 1 + sum(x[0] == g for x in rows)))
    top = ordered.largest(df, ["g"], "v", 3).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((x[1] is not None, x[1] or 0) for x in rows if x[0] == g)[::-1][:3]
        assert sorted(((r.v is not None, r.v or 0) for r in top if r.g == g), reverse=True) == mine


def test_auc_and_shuffle_of_one_large_fold(spark):
    rng = random.Random(2)
    data = [(1, "S", i, float(rng.random() < 0.4), round(rng.random(), 3)) for i in range(4000)]
    df = spark.createDataFrame(data, "fold int, symbol string, dt int, label double, probability double")
    pos, neg = [p for *_, y, p in data if y], np.array([p for *_, y, p in data if not y])
    want = sum((neg < p).sum() + 0.5 * (neg == p).sum() for p in pos) / (len(pos) * len(neg))
    assert modelling.auc(df, ["fold"]).first().auc == pytest.approx(want, abs=1e-12)
    mixed = modelling.permuted(df, "probability", ["fold"], ["symbol", "dt"], 5).collect()
    assert sorted(r.probability for r in mixed) == sorted(p for *_, p in data) and sum(r.probability == data[r.dt][4] for r in mixed) < 100
    assert [r.label for r in sorted(mixed, key=lambda r: r.dt)] == [d[3] for d in data]


def test_no_task_gets_a_whole_group(spark):
    """The window that finishes the sums of 100,000 distinct values of one group sees a small part of them."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    cut = ordered.running(df.withColumn("n", F.lit(1)), ["g"], "v", ["n"])
    assert cut.where("v != n_before").count() == 0
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert all("_piece" in line for line in plan.splitlines() if "Window" in line)


def test_chain_over_pieces(spark):
    def ledger(n, bad=()):
        rows, last = [], "0" * 64
        for i in range(n):
            line = 10 + 7 * i
            prev = last if ("prev", i) not in bad else "x"
            last = __import__("hashlib").sha256(f"{prev}p{i}".encode()).hexdigest()
            rows.append((line, f"p{i}" if ("payload", i) not in bad else "forged", prev, last if ("hash", i) not in bad else None))
        return spark.createDataFrame(rows, "line int, payload string, prev_hash string, entry_hash string").repartition(3)

    for bad, want in (((), None), ((("payload", 13),), 101), ((("prev", 0),), 10), ((("hash", 20),), 150), ((("prev", 29),), 213), ((("prev", 5), ("hash", 3)), 31)):
        for piece in (1, 20, 70, 10**6):
            assert quality.first_broken_link(ledger(30, bad), "line", F.col("payload"), piece=piece).first().first_broken == want


def test_newey_west_at_any_length(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0.1, 1, 400_000)
    lags = int(4 * (len(y) / 100) ** (2 / 9))
    assert lags == 25
    e = y - y.mean()
    v = (e @ e + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) ** 0.5 / len(y)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"g": 1, "t": np.arange(len(y)), "y": y}))
    got = inference.newey_west(df, "y", "t", ["g"]).first()
    assert got.se == pytest.approx(v, rel=1e-9) and got.t == pytest.approx(y.mean() / v, rel=1e-9)


def test_quantiles_of_large_groups_sort_only_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LARGE", 2_000)
    monkeypatch.setattr(ordered, "NEAR", 0.01)
    rng = random.Random(7)
    rows = [("big", rng.choice([rng.gauss(0, 1), 0.0, 0.5])) for _ in range(6_000)] + [("small", rng.random()) for _ in range(50)] + [("same", 1.0)] * 3_000 + [("big", None)] * 9
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.105, 0.5, 1.0]
    got = {r.g: r.q for r in ordered.quantiles(df, ["g"], "v", probs).collect()}
    for g in ("big", "small", "same"):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], probs).tolist(), abs=1e-12)


def test_breakdown_median_is_not_one_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LARGE", 500)
    monkeypatch.setattr(ordered, "NEAR", 0.01)
    rng = random.Random(8)
    rows = [(2000 + i % 2, rng.choice([None, rng.gauss(0, 1)])) for i in range(4_001)]
    out = aggregates.breakdown(spark.createDataFrame(rows, "y int, v double"), {"up": F.col("v") > 0, "none": F.lit(False)}, F.col("y"), "v")
    got = {r["slice"]: r.median for r in out.collect()}
    held = {"all": rows, "up": [r for r in rows if r[1] is not None and r[1] > 0], "year 2000": rows[::2], "year 2001": rows[1::2]}
    assert got.keys() == held.keys()
    assert all(got[k] == pytest.approx(np.median([v for _, v in x if v is not None]), abs=1e-12) for k, x in held.items())
    assert "median(" not in out._jdf.queryExecution().logical().toString()


def test_concentration_cuts_are_not_one_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "LARGE", 500)
    rng = random.Random(9)
    rows = [("ab"[i % 2], i % 40, rng.gauss(0, 1)) for i in range(4_000)]
    out = inference.concentration(spark.createDataFrame(rows, "g string, d int, v double"), "v", "d", ["g"])
    for r in out.collect():
        v = np.array([x for g, _, x in rows if g == r.g])
        low, high = np.quantile(v, [0.005, 0.995])
        assert r.trimmed_mean == pytest.approx(v[(v >= low) & (v <= high)].mean(), abs=1e-12)
    assert "percentile(" not in out._jdf.queryExecution().logical().toString()
