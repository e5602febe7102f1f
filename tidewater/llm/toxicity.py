"""Toxicity of texts behind leetspeak, spacing and repetition: noisy-channel restoration, then a score.

A character language model (4-grams over a-z, one symbol for everything else, and a word boundary; 28**4 counts at
most) is counted over the whole corpus. A token that may hide a word becomes a lattice: signs and digits may stand for
letters or be padding, letters of a run may be repeats, runs of single letters may be one spaced word. Viterbi takes
the restoration with the best product of channel and language model. Restored words and their beginnings carry weights
learned from labelled texts, and a logistic curve turns a text's strongest words into its score.

Labels are learned from at most 2 x SAMPLE rows (SAMPLE of each class, by a hash of the id): half of them weigh words,
the other half fit the curve. Every word sure enough keeps its weight: it stands in three toxic texts of that sample or
more, so the sample bounds what is sent to the executors. Everything else covers all rows, whole texts and all states of
the lattice.

Defined results: null and empty texts have no words and get the score of a text without any weighted word. Rows with a
null doc_id count as held out. Repeated rows are scored each by itself. Without labels of both classes all scores are 0.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import forget, fresh, memories, released

SAMPLE = 10_000
SYMBOLS = 28
OTHER = 27
#: Tokens in a generation of a worker's memory.
REMEMBERED = 200_000
#: A word or beginning is weighted if its share among toxic texts exceeds that among others by so many standard errors.
SURE = 4.0
PREFIXES = (4, 5, 6)
#: Costs (in nats) of the channel.
AS_LETTER, AS_VOWEL, PADDING, REPEAT, PAIR = 0.7, 2.0, 3.0, 0.3, 5.0
#: Letters of a run that are looked at together from each of its letters on: no word that is weighed is longer.
WORD = 24
NOWHERE, AT_SIGNS, ANYWHERE = 0, 1, 2

# Letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "&": "a", "%": "x",
}

_EDGE = "\"'.,;:?!()[]{}<>*_~-|/\\#&%$@+=^`"
_CLOSING = ".,;:?!\"')]}"
_TAIL = re.compile(r"([^\w\s])\1{2,}$|[.,;:?!\"')\]}]+$")
_RUN = re.compile(r"([a-z])\1\1")
_REPEATED = re.compile(r"(.)\1")
_SAME = re.compile(r"(.)\1*", re.DOTALL)
_CHAIN = re.compile(r"\w[^\w\s]\w|[^\W_]_[^\W_]")
_PLAIN = re.compile(r"[^\W\d_]+")
#: Single characters, or such joined by single signs, with white space of any kind and length between.
_SPACED = re.compile(r"(?<!\S)(?:\S(?:[^\w\s]\S)*+\s+)+\S(?:[^\w\s]\S)*+(?!\S)")
_BLANKS = re.compile(r"\s+")
_PIECE = re.compile(r"[^,;:?\"/\\()\[\]{}]+")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = OTHER


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of (three symbols before, symbol) over all words; what lies before a word counts as boundary."""
    total = np.zeros(SYMBOLS**4, np.int64)
    chunk: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        chunk.append(t)
        size += len(t)
        if size < 1 << 20 and i + 1 < len(texts):
            continue
        s = _SYMBOL[np.frombuffer(b"\0\0\0\0" + b"\0".join(chunk) + b"\0", np.uint8)]
        d, c, b, a = s[3:], s[2:-1], s[1:-2], s[:-3]
        b = np.where(c == 0, 0, b)
        a = np.where(b == 0, 0, a)
        inside = (d != 0) | (c != 0)
        total += np.bincount((((a * SYMBOLS + b) * SYMBOLS + c) * SYMBOLS + d)[inside], minlength=SYMBOLS**4)
        chunk, size = [], 0
    return total


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | three before), as float32 of SYMBOLS**4; each order is smoothed by the one below."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            total += gram_counts([t for t in batch.column(0).cast(pa.binary()).to_pylist() if t])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long")
    counted = parts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SYMBOLS**4)
    n[counted["gram"].to_numpy()] = counted["n"].to_numpy()
    n = n.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in (3, 2, 1, 0):
        own = n.sum(axis=tuple(range(order)))
        p = (own + 4 * p) / (own.sum(-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32).reshape(-1)


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER


def readings(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each character of a token what it may stand for, and at what cost."""
    runs = [len(m[0]) for m in _SAME.finditer(token)]
    for c, (at, whole) in zip(token, ((i, n) for n in runs for i in range(n)), strict=True):
        options: list[tuple[str, float]] = []
        if c in LEET:
            options += [(x, AS_LETTER) for x in LEET[c]]
            options.append(("", PADDING if c.isdigit() else PADDING / 2))
            if c.isdigit():
                options.append((c, PADDING))
        elif c == "*":
            options += [("", 1.0), *((x, AS_VOWEL) for x in "aeiou")]
        elif c.isalpha():
            options.append((c, 0.0))
        else:
            options.append(("", 0.1))
        if at and c.isalnum():
            options.append(("", REPEAT if whole > 2 else PAIR))
        yield options


def decode(token: str, model: np.ndarray, breaks: int = NOWHERE) -> list[str]:
    """The most probable words behind a lower-case token, of any length; one word, unless they may be broken at signs or anywhere."""
    values, size = model.item, SYMBOLS**3
    # state: the last three symbols; links lead back over what was emitted
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for c, options in zip(token, readings(token), strict=True):
        steps = [(x, _symbol(x) if x else 0, cost) for x, cost in options]
        if breaks == AT_SIGNS and not c.isalnum():
            steps.append((" ", 0, 0.1))
        following: dict[int, tuple[float, tuple | None]] = {}
        for key, (p, link) in states.items():
            for x, s, cost in steps:
                if not x:
                    to, q = key, p - cost
                elif s:
                    to, q = (key * SYMBOLS + s) % size, p - cost + values(key * SYMBOLS + s)
                elif key:
                    to, q = 0, p - cost + values(key * SYMBOLS)
                else:
                    continue
                if to not in following or following[to][0] < q:
                    following[to] = (q, (link, x) if x else link)
        if breaks == ANYWHERE:
            for key, (p, link) in list(following.items()):
                if key and (0 not in following or following[0][0] < p + values(key * SYMBOLS)):
                    following[0] = (p + values(key * SYMBOLS), (link, " "))
        states = following
    link = max(((p + (values(key * SYMBOLS) if key else 0.0), link) for key, (p, link) in states.items() if link), key=lambda x: x[0], default=(0.0, None))[1]
    out = []
    while link:
        link, x = link
        out.append(x)
    return [x for x in "".join(reversed(out)).split(" ") if x]


def _of_pair(token: str, at: int, model: np.ndarray) -> str:
    """As `decode`, for letters of which only the one at `at` repeats the one before it: the token with or without it. The two readings
    differ in the symbols from there to three further on."""
    s = [0, 0, 0, *map(_symbol, token), 0]
    t = s[: at + 3] + s[at + 4 :]
    value = model.item
    kept = sum(value(((s[j - 3] * SYMBOLS + s[j - 2]) * SYMBOLS + s[j - 1]) * SYMBOLS + s[j]) for j in range(at + 3, min(at + 7, len(s))))
    left = sum(value(((t[j - 3] * SYMBOLS + t[j - 2]) * SYMBOLS + t[j - 1]) * SYMBOLS + t[j]) for j in range(at + 3, min(at + 6, len(t))))
    return token if kept >= left - PAIR else token[:at] + token[at + 1 :]


def restore(token: str, model: np.ndarray) -> str:
    """The most probable word behind a lower-case token."""
    if _PLAIN.fullmatch(token) and (pair := _REPEATED.search(token)) and not _REPEATED.search(token, pair.end() - 1):
        return _of_pair(token, pair.end() - 1, model)
    return "".join(decode(token, model))


def run_words(run: str, model: np.ndarray) -> list[str]:
    """Words behind a run of characters that may hold several, each once: as the lattice breaks it, and what begins at each letter (WORD letters)."""
    word = restore(run, model)
    out = [word[i : i + WORD] for i in range(max(1, len(word) - 2))]
    return [x for x in dict.fromkeys(out + decode(run, model, ANYWHERE)) if x]


def restored(token: str, model: np.ndarray) -> list[str]:
    """Words behind one token of a text, of any length; [] if it holds no letter or sign for one."""
    token = token.lower()
    if _PLAIN.fullmatch(token) and not _REPEATED.search(token):
        return [token]
    out = []
    for piece in _PIECE.findall(token):
        piece = _TAIL.sub("", piece)
        bare = piece.strip(_EDGE)
        if _PLAIN.fullmatch(bare) and not _RUN.search(bare):
            out.append(bare)
            if bare == piece and not _REPEATED.search(bare):
                continue
        if any(c.isalpha() or c in LEET for c in piece) and (word := restore(piece, model)):
            if word not in out:
                out.append(word)
            if _CHAIN.search(piece):
                out += [x for x in decode(piece, model, AT_SIGNS) if x not in out]
    return out


def spaced_words(text: str, model: np.ndarray) -> list[str]:
    """Words spelled with white space of any kind and length between their letters (three at least), of the whole run."""
    out = []
    for m in _SPACED.finditer(text):
        run = _BLANKS.sub("", m[0]).lower()
        if sum(c.isalnum() or c in LEET for c in run) > 2:
            out += run_words(run, model)
    return out


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Scorer:
    """Values of a text that the curve is over; remembers the weights of up to twice `most` tokens, the longest unseen going first."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], most: int = REMEMBERED):
        self.model, self.weights, self.most = model, weights, most
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def word(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def token(self, token: str) -> float:
        """Weight of a token not known yet."""
        w = self.older.get(token)
        if w is None:
            # letters before closing signs mean what the letters alone mean
            bare = token.lower().rstrip(_CLOSING)
            if bare != token and _PLAIN.fullmatch(bare):
                w = self.known[bare] if bare in self.known else self.token(bare)
            else:
                w = max((self.word(x) for x in restored(token, self.model)), default=0.0)
        if len(self.known) >= self.most:
            self.older, self.known = self.known, {}
        self.known[token] = w
        return w

    def values(self, text: str) -> list[float]:
        tokens = set(text.split())
        get = self.known.get
        weights = [w for t in tokens if (w := found if (found := get(t)) is not None else self.token(t))]
        weights += [w for x in spaced_words(text, self.model) if (w := self.word(x))]
        n = np.log1p(len(tokens))
        return [1.0, max(weights, default=0.0), np.log1p(sum(weights)), np.log1p(100 * len(weights) / (len(tokens) + 20)), n]


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def sample_of(labels: DataFrame, most: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """At most `most` rows of each class that may be learned from, and how many rows each of them stands for."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    each = [usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    return each[0].unionAll(each[1]), {t: max(1.0, n / most) for t, n in counts.items()}


def _weigh(sample: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Weights of words and beginnings from the labelled texts of `sample` (text, toxic)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(spaced_words(text or "", model))
                for t in set((text or "").split()):
                    if t not in known:
                        known[t] = restored(t, model)
                    words.update(known[t])
                for f in {f for w in words for f in features(w)}:
                    seen.setdefault(f, [0, 0])[toxic] += 1
            if len(known) > REMEMBERED:
                known.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], names=["feature", "toxic", "clean"])

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}
    counted = sample.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    p, q = (F.col("a") + 0.5) / (n[1] + 1), (F.col("b") + 0.5) / (n[0] + 1)
    pooled = (F.col("a") + F.col("b") + 1) / (n[0] + n[1] + 2)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    rows = counted.withColumn("z", z).withColumn("w", F.log(p / q)).where((F.col("z") > SURE) & (F.col("a") >= 3)).select("feature", "w").collect()
    return {r["feature"]: r["w"] for r in rows}


def fit_curve(values: np.ndarray, toxic: np.ndarray, stands_for: np.ndarray) -> np.ndarray:
    """Logistic coefficients by Newton's method with a small ridge."""
    beta = np.zeros(values.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(values @ beta, -30, 30)))
        gradient = values.T @ (stands_for * (toxic - p)) - 0.1 * beta
        hessian = (values * (stands_for * p * (1 - p))[:, None]).T @ values + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Fitted:
    """Language model, weights and curve; small and of bounded size."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], beta: np.ndarray | None):
        self.model, self.weights, self.beta = model, weights, beta

    def scores(self, texts: list[str | None], scorer: Scorer) -> np.ndarray:
        if self.beta is None or not texts:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(np.array([scorer.values(t or "") for t in texts]) @ self.beta, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Fitted:
    model = language_model(docs)
    chosen, weight = sample_of(labels, most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", F.col("toxic").cast("int").alias("toxic"), (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).alias("weighs"))
    weights = _weigh(rows.where("weighs"), model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, weights)
        for batch in batches:
            values = [scorer.values(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["v", "toxic"])

    got = rows.where("not weighs").select("text", "toxic").mapInArrow(run, "v array<double>, toxic int").collect() if weights else []
    toxic = np.array([r["toxic"] for r in got], float)
    if not len(toxic) or toxic.min() == toxic.max():
        return Fitted(model, weights, None)
    return Fitted(model, weights, fit_curve(np.array([r["v"] for r in got]), toxic, np.array([weight[int(t)] for t in toxic])))


_scorers: list[tuple[int, Scorer]] = []
memories.append(_scorers)


def _scorer(key: int, fitted: Fitted) -> Scorer:
    """The worker's memory for one broadcast, kept from task to task."""
    if not _scorers or _scorers[0][0] != key:
        _scorers[:] = [(key, Scorer(fitted.model, fitted.weights))]
    return _scorers[0][1]


def score(docs: DataFrame, fitted: Fitted, name: str) -> DataFrame:
    """All columns of `docs`, and the score as column `name`."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    at, key = docs.columns.index("text"), uuid.uuid4().int

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        scorer = _scorer(key, f)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f.scores(batch.column(at).to_pylist(), scorer))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def judge(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, fit(rows, labels, most), "score")
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def mild(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Rows of `docs`, all columns, that are not predicted as toxic."""
    name = fresh(docs, "score")
    return score(docs, fit(docs, labels, most), name).where(F.col(name) < 0.5).drop(name)
