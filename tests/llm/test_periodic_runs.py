import hashlib
import random
import zlib

import numpy as np
import pytest

from tidewater.llm.common import ship
from tidewater.llm.periodic_runs import LEAST, collapse, digests, find, planted, runs


def brute(words):
    """Every run by looking at each lag: (start, end, period), smallest period of a stretch first."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(LEAST, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def as_found(texts):
    rows = find([np.array(t, np.int64) for t in texts])
    return [[tuple(r[1:]) for r in rows.tolist() if r[0] == i] for i in range(len(texts))]


def periodic(rng, letters, most):
    """Concatenated powers of short and long words, nested, with odd ends."""
    out = []
    while len(out) < most:
        u = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 25, 40, 77]))]
        for _ in range(rng.randrange(3)):
            u = u * rng.randint(1, 4) + [rng.randrange(letters)] * rng.randint(0, 2)
        out += u * rng.randint(1, 4) + u[: rng.randrange(len(u) + 1)]
    return out[: rng.randint(most // 2, most)]


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_all_runs_of_random_and_nested_texts(letters):
    rng = random.Random(letters)
    texts = [[rng.randrange(letters) for _ in range(rng.randint(0, 60))] for _ in range(150)]
    texts += [periodic(rng, letters, most) for most in (30, 100, 300, 700) for _ in range(25)]
    for text, got in zip(texts, as_found(texts), strict=True):
        assert got == brute(text), text


def test_squares_of_periodic_words_and_their_nests():
    texts = []
    for u in ([0], [0, 1], [0, 1, 2], [0, 0, 1]):
        for k in (5, 9, 20, 60):
            for odd in ([], u[:1], [7], u[:2]):
                v = u * k + odd
                texts += [v * 2, v * 3 + v[:4], [9] + v + v[: len(v) - 1], (v + v[1:]) * 2, u * k + odd + u * (k + 3) + odd + u * k]
    for text, got in zip(texts, as_found(texts), strict=True):
        assert got == brute(text), text


def test_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    for text in (b, thue, thue + thue):
        assert as_found([text])[0] == brute(text)


def test_one_long_text():
    rng = random.Random(5)
    u = [rng.randrange(1000) for _ in range(40_000)]
    text = [1, 2, 3, *u, *u, *u[:500], 4] + [7] * 100_000 + [5, 6] * 30_000
    (got,) = as_found([text])
    assert (3, 80_503, 40_000) in got and (80_504, 180_504, 1) in got and (180_504, 240_504, 2) in got


def words_of(text):
    return (text or "").encode().split()


def expected(key, text):
    words = words_of(text)
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (key, len(found), *four, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_rows_nulls_ties_and_clashing_columns(spark):
    ship(spark)
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b\x0c\r ", "a " * 11, "a " * 12, "a b " * 30, "ä b " * 10 + "x " + "b ä " * 10, "the end. " * 40, "q" * 50_000, "w " * 5000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows = [(None if i % 17 == 3 else i, t, i, "x") for i, t in enumerate(texts)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, period string").repartition(3)
    got = sorted((tuple(r) for r in digests(docs).collect()), key=repr)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=repr)
    assert runs(docs.where("text is null")).count() == 0 and digests(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "x " + "a b " * 8 + "y")], "doc_id long, text string")
    assert [tuple(r) for r in runs(one).collect()] == [(1, 1, 16, 2)] and collapse(one).first().text == "x a b y"


def test_whole_table(spark):
    from tidewater.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    small = [r for r in docs if len(words_of(r.text)) <= 3000]
    assert sum(planted(r.doc_id, len(words_of(r.text))) is not None for r in small) > 5
    for r in small:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
