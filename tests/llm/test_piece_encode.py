import hashlib
import random

import public_tokenizers
import pytest

from tidewater.llm.common import ship
from tidewater.llm.piece_encode import PieceCodec, encode_digests, encode_ids

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a b", " \n", "a▁ b", "日本x​", "\x00a", "<s> </s>", "x" * 50 + " " + "é" * 40, "\n\n b\t", "😀" * 30, "Ａ" * 5]


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


def test_same_ids_and_text_as_the_library(codec):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab the▁\n é😀nd*ing.,'s-$|") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == codec.library.encode(t), t
        assert ids == [i for x in codec.encode_segments(codec.cut(t)) for i in x], t
        assert codec.decode(ids) == codec.library.decode(ids), t
    assert codec.differed == 0


def test_heap_and_rounds_agree(codec):
    words = ["▁understanding", "▁thinking", "▁▁▁▁▁ab", "strawberries", "▁ñéßx", "▁a"]
    assert codec.encode_segments(words) == [codec.agenda(x) for x in words]


def test_where_they_differ_the_library_is_believed_and_the_case_counted():
    own = PieceCodec(MODEL)
    right = own.encode_segments(["▁hello", "ab", "▁"])
    assert own.checked(["▁hello", "ab", "▁"], [[1, 2], right[1], right[2]]) == right and own.differed == 1


def test_rows(spark, codec):
    ship(spark)
    texts = [None, *ODD, "the same", "the same"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in encode_digests(docs, MODEL).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = codec.library.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
    assert {r.doc_id: r.decoded for r in encode_ids(docs, MODEL).collect()}[1] == ""
    assert encode_digests(docs.limit(0), MODEL).count() == 0
