import random
import zlib

import pytest

from tidewater.llm.hist_sort import shard, splitters, write_shards


def rows_of(texts):
    return [(i, t, 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("hot", "rows"), [(0, 500_000), (400, 500_000), (400, 20)])
def test_near_equal_bytes_and_gapless_slots(spark, hot, rows):
    rng = random.Random(hot)
    texts = [None, "", "é" * 30] + ["hot copy " * 5] * hot + ["x" * rng.randint(0, 300) + str(i) for i in range(800)]
    docs = spark.createDataFrame(rows_of(texts), "doc_id long, text string, shard int")
    got = shard(docs, rows=rows).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert abs(sum(r.size for r in mine) - total / 8) <= 2 * largest
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    home = {}
    for r in got:  # a text's copies meet in one shard, or in neighbours
        home.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(h) == 1 for t, h in home.items() if t != "hot copy " * 5)


def test_splitters_are_exact_within_tolerance(spark):
    rng = random.Random(8)
    rows = [(rng.randint(-(1 << 63), (1 << 63) - 1) if i % 3 else 5, rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(1, 50)) for i in range(2000)]
    keyed = spark.createDataFrame(rows, "a long, b long, size long")
    total = sum(r[2] for r in rows)
    for step in (4, 10):
        cuts = splitters(keyed, ["a", "b"], "size", 6, 60.0, 0.0, step)
        assert cuts == sorted(cuts) and len(cuts) == 5
        for k, c in enumerate(cuts):
            assert abs(sum(r[2] for r in rows if (r[0], r[1]) < c) - total * (k + 1) / 6) <= 60


def test_a_splitter_goes_to_the_end_of_a_small_group(spark):
    rng = random.Random(3)
    texts = [t for i in range(400) for t in [f"text {i} " + "x" * rng.randint(50, 80)] * rng.choice([1, 1, 4])]
    docs = spark.createDataFrame(rows_of(texts), "doc_id long, text string, shard int")
    home, size = {}, {}
    for r in shard(docs, slack=0.05).collect():
        home.setdefault(texts[r.doc_id], set()).add(r.shard)
        size[r.shard] = size.get(r.shard, 0) + r.size
    assert all(len(h) == 1 for h in home.values())
    assert max(size.values()) - min(size.values()) <= 0.1 * sum(size.values()) / 8


def test_written_shards_keep_every_row_and_column(spark, tmp_path):
    rows = [(i % 40, f"text {i % 50}", i, "x", 0.5) for i in range(300)] + [(None, None, -1, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, size string, k1 double")
    path = write_shards(docs, f"{tmp_path}/s", rows=16)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    for s in range(8):
        mine = [r["slot_"] for r in back.where(f"shard = {s}").collect()]
        assert sorted(mine) == list(range(len(mine)))


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shard(empty).count() == 0
    same = spark.createDataFrame([(1, "a")] * 20 + [(None, None)] * 3, "doc_id long, text string")
    got = shard(same).collect()
    assert len(got) == 23
    for s in {r.shard for r in got}:
        mine = sorted(r.slot for r in got if r.shard == s)
        assert mine == list(range(len(mine)))
    path = write_shards(same, f"{tmp_path}/s")
    assert spark.read.parquet(path).count() == 23
