import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm.common import ship
from tidewater.llm.jaccard_join import _candidates, _few, _many, bands, bitmap, components, connected, representatives, signatures, spares

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    low = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = low[i], low[j]
                low = [min(x, y) if c in (x, y) else c for c in low]
    return [len(s) for s in sets], low


def corpus(seed, n=250):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    texts = [None, "", " \n", "one", "One", "one two", "one two three", "x" * 4000]
    while len(texts) < n:
        base = [word() for _ in range(rng.choice([2, 4, 9, 12, 30, 60, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_bands_hold_both_ends_of_a_link():
    for num, den in ((90, 100), (80, 100)):
        found = bands(num, den, 3000)
        for t in range(1, 2500):
            for s in {-(-t * num // den), t, (t + -(-t * num // den)) // 2}:
                assert any(low <= s and t <= high for low, high, *_ in found), (s, t)


def test_linked_sets_share_a_part():
    rng = np.random.default_rng(6)
    for n in (10, 11, 19, 40, 100, 333, 1500):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rng.integers(0, n // 20 + 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64))))
            overlap = len(np.intersect1d(a, b))
            if 100 * overlap >= 90 * (len(a) + len(b) - overlap) and len(a) + len(b) > 2 * overlap:
                x, y = signatures(a, 90, 100).tolist(), signatures(b, 90, 100).tolist()
                shared = [sum(1 for name in set(x) & set(y) if name & 7 == band) for band in range(8)]
                assert any(shared) and any(m >= max(p, q) for m, p, q in zip(shared, spares(a, 90, 100), spares(b, 90, 100), strict=True))


@pytest.mark.parametrize(("k", "num", "chunk"), [(3, 90, 32 << 20), (5, 80, 32 << 20), (3, 90, 2000)])
def test_as_brute_force(spark, k, num, chunk):
    ship(spark)
    texts = corpus(k + chunk)
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in components(docs, k, num, 100, chunk_bytes=chunk).collect()}
    sizes, low = brute(texts, k, num, 100)
    assert got == {i: (sizes[i], low[i]) for i in range(len(texts))}
    assert len(set(low)) < len(low)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "A b c d"), (None, None), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in components(docs).collect())
    assert got == [("3", 0, "3"), ("7", 2, "7"), ("7", 2, "7"), ("None", 0, "None"), ("None", 2, "7")]
    assert components(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(7, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "other words here", 3), (3, "A b c d e f", 4), (None, "a b c d e f", 5), (None, "x y z", 6), (None, "x y z", 7), (9, "other words here", 8), (None, None, 9), (None, "", 10), (2, "", 11), (2, "", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumnRenamed("row", "Row")
    got = representatives(docs)
    assert got.columns == ["doc_id", "text", "Row"]
    left = sorted((str(r.doc_id), str(r.text)) for r in got.collect())
    assert left == sorted([("3", "A b c d e f"), ("7", "other words here"), ("None", "x y z"), ("None", "None"), ("None", ""), ("2", ""), ("2", "")])
    assert representatives(docs.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)], "u long, v long")
    got = {r.node: r.label for r in connected(edges, "chain").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_large_groups_are_cut(spark):
    ship(spark)
    texts = corpus(12)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in components(docs, 5, 80, 100, group=2).collect()}
    assert got == dict(enumerate(brute(texts, 5, 80, 100)[1]))
def test_candidates_of_cut_groups_join_as_whole_ones_do(spark):
    """Near copies, two families, and sets with little in common, in parts of 300: the same components, whatever the chunks."""
    ship(spark)
    rng = np.random.default_rng(3)
    new = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    one, two, rows, sets = new(90), new(80), [], {}
    for part in range(3):
        for i in range(300):
            base = one if part == 0 or (part == 1 and i % 2) else two if part == 1 else new(60 + i % 9)
            if part == 2 and i % 10 == 0:
                base = one[: 40 + i // 10]
            x = np.unique(np.concatenate((base[rng.integers(0, 3) :], new(rng.integers(1, 6)))))
            sets[1000 * part + i] = x
            rows.append((part, 1000 * part + i, len(x), bytearray(bitmap(x))))
    rows += [(9, 9000 + i, 50, bytearray(bitmap(one[:50]))) for i in range(5)]
    groups = spark.createDataFrame(rows, "part long, node long, n_shingles long, bitmap binary")

    def components_of(links):
        root = {r[1]: r[1] for r in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in links:
            root[max(find(u), find(v))] = min(find(u), find(v))
        return {x: find(x) for x in root}

    whole = components_of([tuple(r) for r in _candidates(groups, 80, 100, 10_000).collect()])
    for weight in (7, 20, 100):
        assert components_of([tuple(r) for r in _candidates(groups, 80, 100, weight).collect()]) == whole
    assert len(set(whole.values())) > 200 and sum(v == whole[1] for v in whole.values()) > 140


def test_copies_without_an_id_meet_no_task_whole(spark):
    ship(spark)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone twentytwo"
    copies = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    near = spark.createDataFrame([(5, text + " more"), (6, "something else altogether")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.n_shingles): r["count"] for r in components(copies.unionByName(near)).groupBy("doc_id", "component_id", "n_shingles").count().collect()}
    assert got == {(None, 5, 20): 100_000, (5, 5, 21): 1, (6, 6, 1): 1}
    # what reaches the block task: one row for each distinct text
    from tidewater.llm.jaccard_join import _shingles

    assert _shingles(copies.withColumn("row", F.lit(1).cast("long")).repartition(8), 3).count() == 1


def test_sets_leave_frequent_parts_and_no_link_is_lost(spark):
    ship(spark)
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    passage = [word() for _ in range(25)]
    texts = []
    for i in range(60):
        own = [word() for _ in range(70)]
        texts.append(" ".join(own[:30] + passage + own[30:]))
        if i % 3 == 0:
            own[rng.randrange(70)] = "other"
            texts.append(" ".join(own[:30] + passage + own[30:]))
    base = [word() for _ in range(90)]
    for i in range(40):  # near copies in number, which can't leave
        texts.append(" ".join([*base[: i + 20], f"w{i}", *base[i + 21 :]]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for k, num in ((3, 90), (5, 80)):
            got = {r.doc_id: r.component_id for r in components(docs, k, num, 100, frequent=4, group=16).collect()}
            assert got == dict(enumerate(brute(texts, k, num, 100)[1]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_and_many_agree():
    rng = np.random.default_rng(8)
    for n in (2, 5, 12):
        for cut in (n, n // 2):
            base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
            sets = sorted((np.unique(np.concatenate((base[rng.integers(0, 30) :], rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)))) for _ in range(n)), key=len)
            size, maps = [len(x) for x in sets], [bitmap(x) for x in sets]

            def groups(links, n=n):
                root = list(range(n))
                for p, q in links:
                    root = [root[p] if r == root[q] else r for r in root]
                return {frozenset(i for i in range(n) if root[i] == r) for r in root}

            assert groups(_few(size, maps, list(range(n)), cut, 80, 100)) == groups(_many(np.array(size), maps, list(range(n)), cut, 80, 100))
