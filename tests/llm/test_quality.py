import math
import random
import re
from collections import Counter

import pytest

from tidewater.llm.common import ship
from tidewater.llm import quality
from tidewater.llm.quality import RULES, choose, count_texts, counts, cutoffs, judge, report, tail

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_counts_as_brute_force():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "ü ß 日本 a\x0bb\x0cc", "line\nline\n\n \n \nline", "a b " * 40, "x" * 5000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d# ", "é|", "  "]) for _ in range(rng.randint(0, 150))) for _ in range(300)]
    got = count_texts([t if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t), t


def test_tail_and_choice():
    exact = sum(math.comb(50, k) * 0.1**k * 0.9 ** (50 - k) for k in range(4))
    assert tail(3, 50, 0.1) == pytest.approx(exact, rel=1e-12)
    assert tail(0, 0, 0.1) == 1 and tail(50, 50, 0.1) == pytest.approx(1)
    assert choose(1000, [0, 0, 0, 900], [5, 99, 100, 500], 0.01, 0.001) == 1  # the last cutoff rejects too many
    assert choose(20, [0, 0], [5, 9], 0.01, 0.001) is None  # too few labels
    assert choose(1000, [0, 0], [0, 0], 0.01, 0.001) is None  # nothing caught


def test_false_rejection_stays_under_the_limit():
    rng, failures, runs = random.Random(4), 0, 400
    for _ in range(runs):  # true risks rise above the limit at the last two cutoffs
        risks = [0.01, 0.03, 0.06, 0.12]
        scores = [rng.random() for _ in range(300)]
        at = choose(300, [sum(s < r for s in scores) for r in risks], [1, 10, 100, 1000], 0.05, 0.1)
        failures += at is not None and risks[at] > 0.05
    assert failures / runs <= 0.1


def test_judge(spark):
    ship(spark)
    rng = random.Random(5)
    good = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(60)) for _ in range(1500)]
    bad = [" ".join(w + "***" for w in t.split()) for t in good[:300]]
    texts = [*good, *bad, None, "", "short"]
    docs = spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, int(i < 1500), 0) for i in range(1800)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in judge(docs, labels).collect()}
    assert len(got) == len(texts)
    assert not any(got[i].kept for i in range(1500, 1800)) and got[1600].broken == "symbols"
    assert sum(not got[i].kept and not got[i].base_failed for i in range(1500)) <= 0.02 * 1500
    assert all(got[i].base_failed for i in range(1800, 1803))
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
    assert judge(docs.limit(0), labels).count() == 0
    assert judge(docs.withColumn("lang", docs.lang.substr(9, 1)).limit(5), labels.limit(0)).count() == 5


def test_cutoffs_as_brute_force_and_copies_count_once(spark):
    ship(spark)
    rng = random.Random(6)
    docs, labels = [], []
    for lang, share in (("en", 0.002), ("de", 0.0005), (None, 0.0)):
        for i in range(3600):
            words = [rng.choice("abcdefgh") * rng.randint(1, 6) + ("*" * rng.randint(1, 4) if rng.random() < share * 40 or i % 4 == 0 else "") for _ in range(rng.choice([10, 30, 60]))]
            docs.append((len(docs), " ".join(words), lang))
            labels.append((len(docs) - 1, int(i % 4 != 0)))
    for i in range(0, 4000, 5):  # copies, labelled too
        docs.append((len(docs), docs[i][1], docs[i][2]))
        labels.append((len(docs) - 1, labels[i][1]))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    label = spark.createDataFrame([*labels, labels[0]], "doc_id long, quality int")
    found = counts(frame, "lang")
    got = {r["_stratum"]: {x: r[f"_{x}"] for x in RULES if r[f"_{x}"] is not None} for r in cutoffs(found, label).collect()}

    best = {}
    for i, q in labels:
        key = (docs[i][2] or "(null)", docs[i][1])
        best[key] = max(q, best.get(key, 0))
    texts = list(best)
    n = count_texts([t.encode() for _, t in texts])
    stands = [k for k in range(len(texts)) if n["n_words"][k] >= 20 and 100 * n["n_repeat_words"][k] <= 30 * n["n_words"][k]]
    want = {}
    for lang in ("en", "de", "(null)"):
        mine = [k for k in stands if texts[k][0] == lang]
        good = [k for k in mine if best[texts[k]]]
        for rule, (value, cuts) in RULES.items():
            top, bottom = value.split(" / ")
            v = {k: n[top][k] / n[bottom][k] if n[bottom][k] else 0.0 for k in mine}
            at = choose(len(good), [sum(v[k] > c for k in good) for c in cuts], [sum(v[k] > c for k in mine if not best[texts[k]]) for c in cuts], quality.LIMIT / len(RULES), quality.DELTA / (3 * len(RULES)))
            if at is not None:
                want.setdefault(lang, {})[rule] = cuts[at]
    assert got == want and want
    told = {r.stratum: r for r in report(frame, label).collect()}
    assert sum(r.good for r in told.values()) == sum(best.values()) and all(r.rejected_by_cutoffs <= 0.02 * r.good for r in told.values()) and any(r.rejected_by_base for r in told.values())
