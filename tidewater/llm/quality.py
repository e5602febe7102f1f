"""Quality rules whose cutoffs carry a guarantee on labelled holdouts.

Each rule is a value of a text that is larger the worse the text, and a fixed list of cutoffs from lenient to
strict. Per stratum and rule the cutoffs are tested in that order against the rows labelled good: a cutoff passes
while the exact binomial tail P(Bin(n, limit) <= rejected) stays within its level, and the first that fails ends
the sequence, so a sequence needs no further correction; levels are divided by strata x rules (Bonferroni) and the
limit by the rules. With probability 1 - delta over the labels, the rules together then reject at most a share
`limit` of good texts in every stratum at once. Of the cutoffs that pass, the most lenient one is taken that still
catches 99 % of the bad texts which the strictest passing one catches. Strata with too few labels get no cutoff.

Defined results: null and empty texts have no words and fail the base rule; null strata are a stratum of their own;
repeated rows each get their own verdict; labels given twice for a doc_id count as good if any says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, forget, released, written
from .wordhash import SPACES, rolling, words_at

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
LIMIT = 0.02
DELTA = 0.05
ENOUGH = 0.99

#: Strata with cutoffs whose table may be broadcast.
BROADCAST_ROWS = 20_000

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs"]

#: Rule: its value as SQL over the counts, and its cutoffs from lenient to strict.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "capitals": ("n_capitals / word_chars", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
    "bangs": ("n_bangs / n_words", [3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1]),
    "dup_lines": ("n_dup_lines / n_lines", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]),
    "repeats": ("n_repeat_words / n_words", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]),
}


def _table(values: bytes) -> np.ndarray:
    t = np.zeros(256, np.int32)
    t[list(values)] = 1
    return t


_IN_WORD = 1 - _table(SPACES) - _table(bytes(range(0x80, 0xC0)))
_SYMBOL, _CAPITAL, _BANG = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"!")


def _repeated(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text, its words that lie in a window of WINDOW words found twice or more in it."""
    total = np.zeros(len(hashes) + 1, np.int64)
    windows = rolling(hashes, WINDOW)
    if len(windows):
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        inside = np.flatnonzero(text[: len(windows)] == text[WINDOW - 1 :])
        key = windows[inside] ^ (text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        found = inside[order[np.unique(np.concatenate((same, same + 1)))]]
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, found, 1)
        np.add.at(edge, found + WINDOW, -1)
        total[1:] = np.cumsum(np.cumsum(edge)[:-1] > 0)
    return total[bounds[1:]] - total[bounds[:-1]]


def count_texts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts of many texts."""
    out: dict[str, list] = {c: [] for c in _COUNTS}
    for first, hashes, bounds, buf, _, _ in words_at(texts, SPACES, lower=False):
        n = len(bounds) - 1
        part = [t or b"" for t in texts[first : first + n]]
        begins = np.cumsum([0, *(len(t) + 1 for t in part)])
        b = np.frombuffer(buf, np.uint8)
        for name, table in (("word_chars", _IN_WORD), ("n_symbols", _SYMBOL), ("n_capitals", _CAPITAL), ("n_bangs", _BANG)):
            total = np.concatenate(([0], np.cumsum(table[b], dtype=np.int64), [0]))
            total[-1] = total[-2]
            out[name].append(total[begins[1:]] - total[begins[:-1]])
        out["n_words"].append(np.diff(bounds))
        out["n_repeat_words"].append(_repeated(hashes, bounds))
        lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in part]
        out["n_lines"].append(np.array([len(x) for x in lines], np.int64))
        out["n_dup_lines"].append(np.array([len(x) - len(set(x)) for x in lines], np.int64))
    return {c: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for c, x in out.items()}


def counts(docs: DataFrame, stratum: str | None) -> DataFrame:
    """doc_id, stratum, a hash of the text, and the counts of every whole text."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = count_texts(batch.column(3).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[c]) for c in _COUNTS)], names=["doc_id", "stratum", "hash", *_COUNTS])

    kind = F.lit("all") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit("(null)"))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kind.alias("stratum"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, stratum string, hash long, " + ", ".join(f"{c} long" for c in _COUNTS))


def tail(rejected: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= rejected), exactly summed."""
    if n <= 0:
        return 1.0
    log_p, log_q, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    total, x = 0.0, rejected
    while x >= 0:
        term = math.exp(top - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * log_p + (n - x) * log_q)
        total += term
        if x < n * p and term < total * 1e-17:
            break
        x -= 1
    return min(1.0, total)


def choose(good: int, rejected: list[int], caught: list[int], limit: float, level: float) -> int | None:
    """Index of the cutoff to take, of cutoffs that reject so many of `good` and catch so many bad texts; None if none passes or helps."""
    passing = 0
    while passing < len(rejected) and tail(rejected[passing], good, limit) <= level:
        passing += 1
    best = caught[passing - 1] if passing else 0
    return next((k for k in range(passing) if caught[k] >= ENOUGH * best), None) if best else None


def _value(rule: str) -> F.Column:
    return F.coalesce(F.expr(RULES[rule][0].replace(" / ", " / nullif(") + ", 0)"), F.lit(0.0))


def _fails_base() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct labelled texts of each stratum: their counts and quality."""
    label = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    return found.join(label, "doc_id").groupBy("stratum", "hash").agg(F.max("quality").alias("quality"), *(F.first(c).alias(c) for c in _COUNTS))


def cutoffs(found: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """stratum and its cutoff for each rule (null: none), from labelled rows; `found` has the counts. A stratum gets a cutoff only with
    more than 1 / limit good labels, so strata that come to the driver, one after the other, are bounded by the labels."""
    spark = found.sparkSession
    each = [
        F.sum(F.when((F.col("quality") == q) & (_value(r) > c), 1).otherwise(0)).alias(f"{r}_{k}_{q}")
        for r, (_, cuts) in RULES.items() for k, c in enumerate(cuts) for q in (0, 1)
    ]
    sums = written(_labelled(found, labels).where(~_fails_base()).groupBy("stratum").agg(F.sum("quality").alias("good"), *each), "quality-sums")
    level, share = delta / max(1, sums.count() * len(RULES)), limit / len(RULES)
    out = []
    for row in sums.where((F.col("good") + 1) * -math.log1p(-share) >= -math.log(level)).toLocalIterator():
        chosen = []
        for r, (_, cuts) in RULES.items():
            at = choose(row["good"], [row[f"{r}_{k}_1"] for k in range(len(cuts))], [row[f"{r}_{k}_0"] for k in range(len(cuts))], share, level)
            chosen.append(None if at is None else cuts[at])
        if any(c is not None for c in chosen):
            out.append((row["stratum"], *chosen))
    return spark.createDataFrame(out, "_stratum string, " + ", ".join(f"_{r} double" for r in RULES))


def _judged(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """`found` with base_failed, broken and kept."""
    broken = F.array_compact(F.array(*(F.when(_value(r) > F.col(f"_{r}"), F.lit(r)) for r in sorted(RULES))))
    return (
        found.join(checked_broadcast(chosen, BROADCAST_ROWS), F.col("stratum") == F.col("_stratum"), "left")
        .withColumn("base_failed", _fails_base())
        .withColumn("broken", F.array_join(broken, ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("broken") == ""))
        .drop("_stratum", *(f"_{r}" for r in RULES))
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """Per row of `docs`: the counts, base_failed, the rules broken (`broken`, sorted and comma-joined) and `kept`."""
    found = written(counts(docs, stratum), "quality")
    return _judged(found, cutoffs(found, labels, limit, delta)).select("doc_id", "stratum", *_COUNTS, "base_failed", "broken", "kept")


def report(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """Per stratum over distinct labelled texts: how many are good, and how many of those the base rule and, behind it, the cutoffs reject."""
    found = written(counts(docs, stratum), "quality")
    good = _judged(_labelled(found, labels).where("quality = 1"), cutoffs(found, labels, limit, delta))
    return good.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("good"), F.count_if("base_failed").alias("rejected_by_base"), F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("rejected_by_cutoffs")
    )


def keep(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with all their columns; the texts are counted again where they lie instead of being joined."""
    found = written(counts(docs, stratum), "quality")
    rows = cutoffs(found, labels, limit, delta).collect()
    chosen = {row["_stratum"]: {r: row[f"_{r}"] for r in RULES if row[f"_{r}"] is not None} for row in rows}
    at, of = docs.columns.index("text"), None if stratum is None else docs.columns.index(stratum)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            n = count_texts(batch.column(at).cast(pa.binary()).to_pylist())
            strata = ["all"] * batch.num_rows if of is None else ["(null)" if x is None else str(x) for x in batch.column(of).to_pylist()]
            good = (n["n_words"] >= 20) & (100 * n["n_repeat_words"] <= 30 * n["n_words"])
            with np.errstate(divide="ignore", invalid="ignore"):
                for rule, (text, _) in RULES.items():
                    top, bottom = text.split(" / ")
                    value = np.where(n[bottom] > 0, n[top] / n[bottom], 0.0)
                    good &= value <= np.array([chosen.get(s, {}).get(rule, np.inf) for s in strata])
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
