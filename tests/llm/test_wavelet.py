import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewater.llm.common import ship
from tidewater.llm.wavelet import WaveletFile, WordTokens, build, read_shards, write_shards

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_units_encode_as_whole_texts_do():
    tokens = WordTokens(TOKENIZER, most=50)
    rng = random.Random(2)
    texts = ["", " ", "don't Won'T I'LL x's", "a\x1cb\x85c\xa0d\x0be\x0cf", "<|endoftext|> a<|startoftext|>b<|", "ÀÉß ſK İi", "a1b2''s", "***it's***"]
    texts += ["".join(rng.choice("ab the\n é😀nd*ing.,'s-$|<>́123A") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for t in texts:
        ((_, ids, lengths),) = tokens.encode([t.encode()], 2)
        assert ids.tolist() == [*tokens.library.encode(t, add_special_tokens=False).ids, 2] and lengths.tolist() == [len(ids)], t


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 70_000, 140_000])
def test_file_answers_as_the_sequence(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 49_000).astype("<u2")
    file = WaveletFile(build(ids, np.array([5, 9]), np.array([n // 3, n - n // 3])))
    assert (file.all_ids() == ids).all() and file.docs.tolist() == [5, 9] and file.lengths.sum() == n
    for k in rng.integers(0, n, min(n, 25)).tolist():
        value = int(ids[k])
        places = np.flatnonzero(ids == value)
        assert file.access(k) == value
        assert file.count(value) == len(places) and file.count(value, 0, k) == (places < k).sum()
        assert file.locate(value, len(places) // 2) == places[len(places) // 2]
    assert file.count(65_000) == 0
    with pytest.raises(IndexError):
        file.locate(65_000, 0)


@pytest.mark.parametrize("shard", [1, 50, 1 << 21])
def test_round_trip(spark, tmp_path, shard):
    ship(spark)
    texts = [None, "", "The same text.", "The same text.", "x" * 3000, *(f"word {i} don't" for i in range(60))]
    docs = spark.createDataFrame([((i * 7) % 65 if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    path = f"{tmp_path}/w"
    write_shards(docs, TOKENIZER, 2, path, shard_tokens=shard, partitions=3)
    got = sorted(read_shards(spark.read.parquet(path)).collect(), key=lambda r: (r.start, r.n_tokens))
    library, at = Tokenizer.from_file(TOKENIZER), 0
    want = sorted(((i * 7) % 65 if i else None, t) for i, t in enumerate(texts) if i)
    for row, (key, text) in zip(got, [(None, None), *want], strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_shards(docs, TOKENIZER, 2, f"{tmp_path}/w")
    assert read_shards(spark.read.schema("part int, seq int, first_doc long, n_docs long, n_tokens long, file binary").parquet(f"{tmp_path}/w")).count() == 0
