import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidewater.llm.length_buckets import boundaries, pack


def test_boundaries_are_the_best():
    rng = random.Random(11)
    for trial in range(300):
        edges = sorted(rng.sample(range(0, 60), rng.randint(1, 10)) if trial % 3 else rng.sample(range(4000, 90_000), 7))
        counts = [rng.randint(1, rng.choice((2, 9, 10_000))) for _ in edges]
        buckets = rng.randint(1, 6)

        def cost(cuts, edges=edges, counts=counts):
            return sum(n * min(c for c in cuts if c >= e) for e, n in zip(edges, counts, strict=True))

        k = min(buckets, len(edges))
        best = min(cost((*c, edges[-1])) for c in itertools.combinations(edges[:-1], k - 1))
        got = boundaries(edges, counts, buckets)
        assert len(got) == k and got == sorted(got) and cost(got) == best
    assert boundaries([], [], 3) == []


def test_places(spark):
    rng = random.Random(12)
    texts = [None, "", " \n", *(" ".join("w" * rng.choice([1, 5, 30, 31, 90, 400])) for _ in range(500)), *["same words here"] * 150, "y " * 9000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, bucket int")
    got = pack(docs, buckets=4, budget=1000).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r.padding == r.boundary - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    assert len({r.bucket for r in got}) == 4
    numbers = defaultdict(list)
    for (bucket, batch), rows in batches.items():
        assert len(rows) == 1 or len(rows) * rows[0].boundary <= 1000
        assert sorted(r.place for r in rows) == list(range(len(rows)))
        numbers[bucket].append(batch)
    assert all(sorted(x) == list(range(len(x))) for x in numbers.values())


def test_long_documents_are_padded_no_more_than_they_must(spark):
    lengths = [4097, 4098, 4099, 5000, 5001, 9999, 70_001]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    assert [r.padding for r in pack(docs, buckets=8, length=F.col("n")).collect()] == [0] * 7
    assert sum(r.padding for r in pack(docs, buckets=4, length=F.col("n")).collect()) == 2 + 1 + 1
    assert sum(r.padding for r in pack(docs, buckets=1, length=F.col("n")).collect()) == sum(70_001 - n for n in lengths)


def test_many_lengths_in_little_time():
    rng = random.Random(5)
    edges = sorted(rng.sample(range(10_000_000), 50_000))
    assert len(boundaries(edges, [rng.randint(1, 100) for _ in edges], 8)) == 8


def test_empty_tables(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert pack(spark.createDataFrame([(None, None), (1, None), (1, None)], "doc_id long, text string")).count() == 3
