"""Joins against all pairs, with one key that holds most rows of both sides."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidewater.operators import joins

DAY = date(2020, 1, 1)


def days(n):
    return DAY + timedelta(n)


def skewed(rng, n, span, *more):
    return [("hot" if rng.random() < 0.7 else rng.choice("abc") if rng.random() < 0.95 else None, days(rng.randrange(span)) if rng.random() < 0.97 else None, *(m(i) for m in more)) for i in range(n)]


def as_sorted(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_asof_in_pieces_is_the_same(spark):
    rng = random.Random(1)
    left = spark.createDataFrame(skewed(rng, 1500, 900, lambda i: i), "k string, at date, i int").repartition(5)
    right = spark.createDataFrame(skewed(rng, 1200, 900, lambda i: rng.random()), "k string, at date, v double").repartition(3)
    for exact in (True, False):
        plain = as_sorted(joins.asof(left, right, ["k"], "at", "at", ["v"], exact))
        for cell in (1, 30, 5000):
            assert as_sorted(joins.asof(left, right, ["k"], "at", "at", ["v"], exact, cell=cell)) == plain
        table = right.collect()
        for k, at, _, found, v in plain:
            fit = [(r.at, r.v) for r in table if r.k == k and r.at and at and (r.at <= at if exact else r.at < at)]
            assert (found, v) == (max(fit) if fit and k else (None, None))


def test_asof_of_times_in_pieces(spark):
    t0 = datetime(2020, 1, 1)
    left = spark.createDataFrame([("x", t0 + timedelta(seconds=s * 7)) for s in range(300)], "k string, ts timestamp")
    right = spark.createDataFrame([("x", t0 + timedelta(seconds=s * 31), s) for s in range(0, 60, 7)], "k string, ts timestamp, s int")
    assert as_sorted(joins.asof(left, right, ["k"], "ts", "ts", ["s"], cell=60)) == as_sorted(joins.asof(left, right, ["k"], "ts", "ts", ["s"]))


def test_first_from(spark):
    rng = random.Random(2)
    a, b = skewed(rng, 300, 90, lambda i: i), skewed(rng, 90, 90, lambda i: rng.random())
    for exact in (True, False):
        got = joins.first_from(spark.createDataFrame(a, "k string, at date, i int"), spark.createDataFrame(b, "k string, d date, v double"), ["k"], "at", "d", ["v"], exact).collect()
        assert len(got) == len(a)
        for r in got:
            if r.k and r.at:
                fit = [d for k, d, _ in b if k == r.k and d and (d >= r.at if exact else d > r.at)]
                assert r.asof_at == min(fit, default=None)


def test_interval_join_tiles_each_span_once(spark):
    rng = random.Random(3)
    facts = skewed(rng, 600, 2500, lambda i: i)
    links = []
    for i in range(500):
        s = days(rng.randrange(2500)) if rng.random() < 0.97 else None
        e = None if s is None or rng.random() < 0.1 else s + timedelta(rng.choice([-1, 0, 1, 15, 16, 17, 255, 256, 300, 1000]))
        links.append((rng.choice(["hot", "hot", "a", None]), s, e, i))
    links += [("hot", date(1700, 1, 1), None, -1), ("a", date(1969, 12, 30), date(2300, 1, 1), -2)]
    got = joins.interval_join(spark.createDataFrame(facts, "k string, at date, i int"), spark.createDataFrame(links, "k string, s date, e date, j int"), ["k"], "at", "s", "e")
    want = sorted((i, j) for k, at, i in facts for k2, s, e, j in links if k and k == k2 and at and s and s <= at and (e is None or at <= e))
    assert sorted((r.i, r.j) for r in got.collect()) == want
    times = spark.createDataFrame([("a", datetime(2020, 1, 1, 12)), ("a", datetime(2020, 1, 1, 8))], "k string, at timestamp")
    spans = spark.createDataFrame([("a", datetime(2020, 1, 1, 9), datetime(2020, 1, 1, 12))], "k string, s timestamp, e timestamp")
    assert joins.interval_join(times, spans, ["k"], "at", "s", "e").count() == 1


def test_notes_rows_and_owners(spark):
    rng = random.Random(4)
    events, notes = skewed(rng, 150, 400, lambda i: i), skewed(rng, 200, 400, lambda i: f"n{i:03d}")
    e, n = spark.createDataFrame(events, "k string, at date, i int"), spark.createDataFrame(notes, "k string, d date, acc string")
    got = sorted((r.i, r.acc) for r in joins.latest_before(e, n, ["k"], "at", "d", 20, "acc").collect())
    want = []
    for k, at, i in events:
        fit = [(d, acc) for k2, d, acc in notes if k and k == k2 and at and d and at - timedelta(20) <= d < at]
        if fit:
            top = max(d for d, _ in fit)
            want.append((i, min(acc for d, acc in fit if d == top)))
    assert got == sorted(want)
    got = sorted(r.acc for r in joins.rows_around(n, e, ["k"], "d", "at", 4, 2).collect())
    assert got == sorted(acc for k, d, acc in notes if k and d and any(k == k2 and at and at - timedelta(4) <= d <= at + timedelta(2) for k2, at, _ in events))
    once = n.dropDuplicates(["k", "d"])
    owners = [tuple(r) for r in once.collect()]
    got = sorted((r.i, r.acc) for r in joins.nearest_owner(e, once, ["k"], "at", "d", 30).collect())
    want = []
    for k, at, i in events:
        fit = [(d, acc) for k2, d, acc in owners if k and k == k2 and at and d and d <= at]
        if fit and (at - max(fit)[0]).days <= 30:
            want.append((i, max(fit)[1]))
    assert got == sorted(want)


def test_hot_key_makes_no_pairs(spark):
    """30,000 rows on both sides of one key: all pairs would be 900 million."""
    facts = spark.range(30_000).select(F.lit("hot").alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 20_000).cast("int")).alias("at"), "id")
    links = spark.range(30_000).select(F.lit("hot").alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 20_000).cast("int")).alias("s"), F.date_add(F.lit(DAY), (F.col("id") % 20_000 + 2).cast("int")).alias("e"), F.col("id").alias("j"))
    assert joins.interval_join(facts, links, ["k"], "at", "s", "e").count() == sum((1 + (d < 10_000)) * sum(1 + (x < 10_000) for x in range(max(0, d - 2), d + 1)) for d in range(20_000))
    plan = joins.interval_join(facts, links, ["k"], "at", "s", "e")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_interval_join_broadcasts_no_tiles(spark):
    """Tiles are many times the links they are sized by; facts take the levels of these spans only (0 to 2)."""
    facts = spark.range(3_000).select(F.lit("k").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("at"))
    links = spark.range(100).select(F.lit("k").alias("k"), F.date_add(F.lit(DAY), (F.col("id") * 7).cast("int")).alias("s"), F.date_add(F.lit(DAY), (F.col("id") * 7 + 30).cast("int")).alias("e"))
    joined = joins.interval_join(facts, links, ["k"], "at", "s", "e")
    assert joined.count() == 100 * 31
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [k" not in plan
    tiles = joins._tiled(spark.range(64).select((F.col("id") + 1000).alias("_first"), (F.col("id") + 1030).alias("_end"))).select("_first", "_level", F.sequence("_low", "_high").alias("c"))
    covered = {}
    for r in tiles.collect():
        covered.setdefault(r._first, []).extend(x for c in r.c for x in range(c * joins.RADIX**r._level, (c + 1) * joins.RADIX**r._level))
    assert {k: sorted(v) for k, v in covered.items()} == {i: list(range(i, i + 31)) for i in range(1000, 1064)}


def test_fuzzy_links_lose_no_pair(spark):
    rng = random.Random(5)
    words = ["Acme", "Bank", "of", "the", "Ohio", "Inc", "Zed", "Z", "AB", "Acmetronic", "First", "Trust", "Cob", "Obank", "co", "Über", "3M"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["", "Inc.", None, "ACME-CORP", "ohio!bank"]
    a = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    b = spark.createDataFrame([(j, n) for j, n in enumerate(reversed(names))], "j int, title string")
    want = as_sorted(a.crossJoin(b).where(joins.same_issuer(F.col("name"), F.col("title"))).select("i", "j"))
    assert as_sorted(joins.fuzzy_links(a, b, "name", "title").select("i", "j")) == want and want
