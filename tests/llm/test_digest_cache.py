import os
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewater.llm import digest_cache
from tidewater.llm.common import ship
from tidewater.llm.digest_cache import UnitCounter, count, counter, stored, version

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


def test_units_count_as_whole_texts_do():
    counts, whole = UnitCounter(Tokenizer.from_file(BYTES), most=2000), library(BYTES)
    rng = random.Random(4)
    letters = "ab thé\n\t éß😀nd*ing.,'s-$|<>́   12٣²½3Aжщ҂ѝ漢字_\x1c\x85\r　ªµ́​"
    texts = ["", " ", "\n", "a" * 3000, "1" * 500, " " * 300, "é" * 400, "don't I'LL x's '' 's"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    parts = ["<|endoftext|>", " ", "'s", "'ll", " 've", "word", "\n", "  ", "'", ",", "<", "|>", "12", "é", "<|endoftext"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for k in range(0, len(texts), 500):
        assert counts(texts[k : k + 500]) == [whole(t) for t in texts[k : k + 500]]
    assert isinstance(counter(BYTES), UnitCounter)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_cache_and_rows(spark, tmp_path, monkeypatch, name):
    ship(spark)
    path, cache = public_tokenizers.path(name), f"file://{tmp_path}/cache"
    whole = library(path)
    texts = [None, "", " ", "The same text.", "the SAME text.", "<|endoftext|> a", "<|ENDOFTEXT|> a", "<s> x", "ä" * 3000, "word " * 2000, "漢字 " * 30]
    rows = [(i if i % 5 else None, t, i, "z") for i, t in enumerate(texts * 3)]
    rows += [(7, "one id", 1, "")] * 4 + [(None, "no id", 1, "")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, content string").repartition(4)

    def answers(frame, limit=512):
        return sorted((tuple(r) for r in count(frame, path, cache, limit).collect()), key=repr)

    def wanted(rows, limit=512):
        return sorted(((r[0], len((r[1] or "").encode()), n, n > limit) for r in rows for n in [whole(r[1] or "")]), key=repr)

    assert answers(docs.limit(0)) == []
    assert answers(docs) == wanted(rows)
    tokenizer = version(path)
    known = stored(docs, cache, tokenizer)
    assert known.count() == len({r[1] or "" for r in rows})

    # what is stored is not encoded again: only the new text is appended
    more = docs.unionByName(spark.createDataFrame([(99, "a new text", 0, "")], docs.schema))
    files = len(os.listdir(f"{tmp_path}/cache"))
    assert answers(docs, 3) == wanted(rows, 3) and len(os.listdir(f"{tmp_path}/cache")) == files
    assert answers(more) == wanted([*rows, (99, "a new text")])
    assert spark.read.schema(digest_cache.CACHE_SCHEMA).parquet(cache).count() == stored(docs, cache, tokenizer).count() == len({r[1] or "" for r in rows}) + 1

    # a stored count is believed, of this tokenizer only
    planted = spark.range(1).select(digest_cache.digest(digest_cache.F.lit("planted")).alias("content"), digest_cache.F.lit(7).cast("long").alias("n_bytes"), digest_cache.F.lit(1234).cast("long").alias("n_tokens"), digest_cache.F.lit(tokenizer).alias("tokenizer"))
    planted.write.mode("append").parquet(cache)
    planted.withColumn("n_tokens", digest_cache.F.lit(5).cast("long")).withColumn("tokenizer", digest_cache.F.lit("another")).write.mode("append").parquet(cache)
    one = spark.createDataFrame([(1, "planted")], "doc_id long, text string")
    assert answers(one) == [(1, 7, 1234, True)]

    # counts appended twice change nothing; hot digests and the shuffled join give the same
    spark.read.schema(digest_cache.CACHE_SCHEMA).parquet(cache).limit(5).write.mode("append").parquet(cache)
    assert answers(more) == wanted([*rows, (99, "a new text")])


def test_hot_texts_and_shuffled_misses(spark, tmp_path, monkeypatch):
    ship(spark)
    whole = library(BYTES)
    rows = [(None, "one text in a third of the rows")] * 1500 + [(i, None) for i in range(1200)] + [(i, f"text {i % 700}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(((r[0], len((r[1] or "").encode()), whole(r[1] or ""), False) for r in rows), key=repr)
    for k, few in enumerate((500_000, 10)):
        monkeypatch.setattr(digest_cache, "FEW", few)
        cache = f"file://{tmp_path}/{k}"
        for _ in range(2):
            assert sorted((tuple(r) for r in count(docs, BYTES, cache).collect()), key=repr) == want
        assert spark.read.parquet(cache).count() == 702


def test_whole_table(spark):
    from tidewater.llm.queries import QUERIES

    sf, whole = "/root/testdata/sf0.001", library(BYTES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n, n > 512) for r in docs for n in [whole(r.text or "")])
    assert sorted(tuple(r) for r in QUERIES["op11_digest_cache"](spark, sf).collect()) == want
