import numpy as np
import pytest

from tidewater.llm import toxicity
from tidewater.llm.common import ship
from tidewater.llm.toxicity import SYMBOLS, fit_curve, gram_counts, judge, restored, spaced_words

TEXT = b"you stupid idiot the moron is pathetic and worthless trash he said a clown of disgusting lies " * 20


@pytest.fixture(scope="module")
def model():
    n = gram_counts([TEXT]).reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in (3, 2, 1, 0):
        own = n.sum(axis=tuple(range(order)))
        p = (own + 4 * p) / (own.sum(-1, keepdims=True) + 4)
    return np.log(p).reshape(-1)


def test_counts_of_grams():
    n = gram_counts([b"ab. AB", b"", b"a"]).reshape((SYMBOLS,) * 4)
    assert n[0, 0, 0, 1] == 3 and n[0, 0, 1, 2] == 2 and n[0, 1, 2, 0] == 2 and n[0, 0, 1, 0] == 1 and n.sum() == 8


@pytest.mark.parametrize("token", ["1d10t", "idiiiooot", "i.d.i.o.t", "IDIOT!!!", "idi0t,", "(idiot)", "id|ot", "id*ot"])
def test_restores(model, token):
    assert "idiot" in restored(token, model)


def test_leaves_plain_words_alone(model):
    assert restored("The", model) == ["the"] and restored("...", model) == [] and restored("été", model) == ["été"]
    assert "idiot" in spaced_words("an i d i o t here", model)
    assert len(restored("x" * 500 + "1" + "y" * 500, model)) == 1


def test_whole_runs_and_long_pieces_are_decoded(model):
    plain = "you said the lies " * 12
    found = {f for w in toxicity.spaced_words(" ".join((plain + "stupid idiot is the clown").replace(" ", "")), model) for f in toxicity.features(w)}
    assert "idiot*" in found or "idiot" in found
    assert "idiot" in spaced_words(" ".join("youaresaidthe" * 8 + "idiot"), model) and "stup*" in found
    assert "idiot" in restored("idi" + "o" * 90 + "t", model)
    chained = restored("-".join(["y0u", "5tup1d", "1d10t", "m0r0n"] * 6), model)
    assert {"you", "stupid", "idiot", "moron"} <= set(chained)
    assert {"stupid", "idiot"} <= set(restored("y0u_5tup1d.1d10t", model))


@pytest.mark.parametrize(("token", "word"), [("iidiot", "idiot"), ("idiiot", "idiot"), ("sstupid", "stupid"), ("7#3", "the"), ("#3", "he")])
def test_no_gate_before_the_lattice(model, token, word):
    assert word in restored(token, model)


def test_spaced_runs_of_three_and_all_states(model):
    assert "the" in spaced_words("so t h e end", model) and spaced_words("so t h end", model) == []
    # digits of many readings: more states than a beam of 40 holds
    rng = np.random.default_rng(1)
    other = np.log(rng.dirichlet(np.ones(SYMBOLS), SYMBOLS**3)).reshape(-1)
    token = "1686!|"
    best = max(((_cost(token, x, other), "".join(y)) for x in _readings(token) if (y := [c for c in x[0] if c])), default=None)
    assert toxicity.restore(token, other) == best[1]


@pytest.mark.parametrize("blank", ["  ", "\t", "\xa0", "\n", " \u2003 ", "\r\n\t"])
def test_letters_with_any_white_space_between(model, blank):
    for text in (blank.join("idiot"), f"so {blank.join('1d10t')} here", f"i-d{blank}i-o{blank}t"):
        assert "idiot" in spaced_words(text, model), text
    assert spaced_words(f"I{blank}am", model) == [] == spaced_words(f"a{blank}b here", model)


@pytest.mark.parametrize("n", range(60, 71))
def test_no_length_at_which_words_are_lost(model, n):
    """Stretched, chained, spaced and stretched-and-disguised words of 60 to 70 characters, and their neighbours in length."""
    assert "idiot" in restored("idi" + "o" * (n - 4) + "t", model) and "idiot" in restored("1d1" + "0" * (n - 4) + "t", model)
    chain = "-".join(["y0u", "5tup1d", "1d10t"] * 8)
    assert {"stupid", "idiot"} <= set(restored(chain[: n - 6] + "-1d10t-", model))
    assert "idiot" in spaced_words("\t".join(("youaresaid" * 8)[: n - 5] + "idiot"), model)


def test_scores_as_worked_out_one_text_at_a_time(spark):
    """Every score of the smallest table: whole texts, token by token without memory, by the fitted model, weights and curve."""
    from tidewater.llm.toxicity import features, fit, restored

    ship(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text")
    f = fit(rows, labels)
    assert f.beta is not None and f.weights

    def weight(words):
        return max((f.weights.get(x, 0.0) for w in words for x in features(w)), default=0.0)

    want = {}
    for r in rows.collect():
        tokens = set((r.text or "").split())
        each = []
        for t in tokens:
            letters = t.lower().rstrip(".,;:?!\"')]}")
            each.append(weight([letters] if letters.isalpha() and not any(a == b for a, b in zip(letters, letters[1:], strict=False)) else restored(letters if letters.isalpha() else t, f.model)))
        each += [weight([w]) for w in spaced_words(r.text or "", f.model)]
        each = [w for w in each if w]
        x = np.array([1.0, max(each, default=0.0), np.log1p(sum(each)), np.log1p(100 * len(each) / (len(tokens) + 20)), np.log1p(len(tokens))])
        want[r.doc_id] = 1 / (1 + np.exp(-np.clip(x @ f.beta, -30, 30)))
    got = {r.doc_id: r.score for r in judge(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _readings(token):
    """All (emitted symbols, channel cost) of a token."""
    out = [((), 0.0)]
    for options in toxicity.readings(token):
        out = [((*e, x), cost + more) for e, cost in out for x, more in options]
    return out


def _cost(token, reading, model):
    a = b = d = 0
    total = -reading[1]
    for x in [toxicity._symbol(c) for c in reading[0] if c] + [0]:
        total += float(model[((a * SYMBOLS + b) * SYMBOLS + d) * SYMBOLS + x])
        a, b, d = b, d, x
    return total


def test_curve():
    rng = np.random.default_rng(15)
    x = np.column_stack([np.ones(4000), rng.normal(size=4000)])
    y = rng.random(4000) < 1 / (1 + np.exp(-(x @ [-1.0, 2.0])))
    assert fit_curve(x, y.astype(float), np.ones(4000)) == pytest.approx([-1, 2], abs=0.25)


def test_held_out_accuracy_on_the_given_tables(spark):
    ship(spark)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = judge(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    score, truth = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    auc = (score[truth == 1][:, None] > score[truth == 0]).mean() + (score[truth == 1][:, None] == score[truth == 0]).mean() / 2
    wrong = np.mean([r.predicted != r.toxic for r in rows])
    assert auc > 0.9 and wrong < 0.03


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a", 1.0), (1, None, 1.0), (2, "", 1.0), (2, "", 1.0), (3, "z" * 50_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert sorted(r.score for r in judge(docs, labels).collect()) == [0.0] * 5
    assert judge(docs.limit(0), labels).count() == 0


def test_restore_as_exhaustive_search():
    rng = np.random.default_rng(2)
    for seed in range(3):
        other = np.log(np.random.default_rng(seed).dirichlet(np.full(SYMBOLS, 0.1 if seed else 1.0), SYMBOLS**3) + 1e-6).reshape(-1)
        for _ in range(150):
            token = "".join(rng.choice(list("aabbcd10$!*#ß.")) for _ in range(rng.integers(1, 7)))
            best = max(((_cost(token, x, other), "".join(x[0])) for x in _readings(token) if any(x[0])), default=(0, ""))
            got = toxicity.restore(token, other)
            assert got == best[1] or any("".join(x[0]) == got and abs(_cost(token, x, other) - best[0]) < 1e-9 for x in _readings(token)), (token, got, best)


def test_one_pair_as_the_lattice():
    rng = np.random.default_rng(3)
    other = np.log(rng.dirichlet(np.full(SYMBOLS, 0.05), SYMBOLS**3) + 1e-7).reshape(-1)
    words = {"".join(rng.choice(list("abcdß")) for _ in range(rng.integers(2, 10))) for _ in range(3000)}
    pairs = [w for w in words if sum(a == b for a, b in zip(w, w[1:], strict=False)) == 1]
    changed = 0
    for w in pairs:
        assert toxicity.restore(w, other) == "".join(toxicity.decode(w, other)), w
        changed += toxicity.restore(w, other) != w
    assert len(pairs) > 300 and changed > 10
