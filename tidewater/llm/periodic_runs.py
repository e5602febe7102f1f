"""Periodic runs of words: every maximal stretch that repeats with its smallest period, exact, and the text with each run cut to one period.

Many texts are laid end to end, the longest first, with a number of its own between any two, and searched together:

* Periods below `SHORT` by direct scans: words equal to the word one lag before, in stretches long enough.
* Longer ones scale by scale; a scale of width w serves periods from 2w to 4w and looks only at texts of 4w words or more.
  A position is a minimizer if its w-word gram has the least hash of some window of w grams; grams that are themselves
  periodic (period up to w/3: those inside runs found before) are left out. A window inside a run comes again one period
  on with the same minimizer, so each run has a pair of equal minimizers at its period's distance. Equal grams that are
  not periodic lie more than w/3 apart, so fewer than twelve pairs start at any of them.
* Where a run's whole first period is inside one shorter-period run (`uu` with u of period up to w/3), it has no such
  gram; it joins two runs of one period that meet, and their phases give its periods.
* Each pair seeds an extension both ways, by equal prefix sums of two hashes modulo primes, doubling lengths down.
  Stretches found with several periods keep the smallest.

Time is words x log(words), whatever repeats. The words of a text are numbered by a dictionary, so no two words are taken for one.

Defined results: null, empty and blank texts have no words and no runs. Rows that repeat are each answered. A null id
stays null and plants nothing (see `planted`). Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix

LEAST = 12
SHORT = 24
PRIMES = (2147483647, 2147483629)
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

_I = np.int64
_U = np.uint64


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, _U)
    step = base
    while len(out) < n:
        out = np.concatenate((out, out * _U(step) % _U(prime)))
        step = step * step % prime
    return out[:n]


class Prefixes:
    """Prefix sums of a sequence of numbers under two hashes; tells equal stretches at a lag."""

    def __init__(self, numbers: np.ndarray):
        mixed = mix(numbers.astype(_U) + _U(1))
        self.n, self.parts = len(numbers), []
        for k, prime in enumerate(PRIMES):
            value = (mixed >> _U(31 * k)) % _U(prime)
            power = _powers(1_000_003 + 977_777 * k, self.n + 1, prime)
            total = np.zeros(self.n + 1, _U)
            # each term is below 2**31, so sums of 2**32 terms fit
            np.cumsum(value * power[: self.n] % _U(prime), out=total[1:])
            self.parts.append((_U(prime), power, total % _U(prime)))

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are the stretches from i and from j (i <= j) of that length equal?"""
        same = np.ones(len(i), bool)
        for prime, power, total in self.parts:
            a = (total[i + length] + prime - total[i]) % prime * power[j - i] % prime
            same &= a == (total[j + length] + prime - total[j]) % prime
        return same

    def grams(self, width: int) -> np.ndarray:
        """A hash for each stretch of `width` numbers, in no order that the numbers know of."""
        out = np.zeros(max(0, self.n - width + 1), _U)
        for prime, power, total in self.parts:
            a = (total[width:] + prime - total[:-width]) % prime
            # all brought to the power of the last position
            out = (out << _U(31)) ^ (a * power[: len(a)][::-1] % prime)
        return mix(out)

    def forward(self, i: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Length of the longest stretch from i that equals the one a lag later."""
        got = np.zeros(len(i), _I)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            at = np.flatnonzero(i + lag + got + step <= self.n)
            if len(at):
                a = i[at] + got[at]
                good = self.equal(a, a + lag[at], np.full(len(at), step, _I))
                got[at[good]] += step
            step >>= 1
        return got

    def backward(self, i: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Length of the longest stretch that ends before i and equals the one that ends before i + lag."""
        got = np.zeros(len(i), _I)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            at = np.flatnonzero(i - got - step >= 0)
            if len(at):
                a = i[at] - got[at] - step
                good = self.equal(a, a + lag[at], np.full(len(at), step, _I))
                got[at[good]] += step
            step >>= 1
        return got


def _windows(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """Least (or greatest) of each `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


class Found:
    """Runs found so far: start, end, period; a stretch keeps its smallest period, which is met first."""

    def __init__(self):
        self.rows = np.zeros((0, 3), _I)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        keep = end - start >= np.maximum(LEAST, 2 * period)
        new = np.stack((start[keep], end[keep], period[keep]), 1)
        if len(new):
            rows = np.concatenate((self.rows, new))
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            first = np.ones(len(rows), bool)
            first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            self.rows = rows[first]


def _scan(numbers: np.ndarray, lag: int, found: Found) -> None:
    """Runs of one short period."""
    at = np.flatnonzero(numbers[lag:] == numbers[:-lag])
    need = max(LEAST, 2 * lag) - lag
    if len(at) >= need:
        edge = np.flatnonzero(np.diff(at) != 1)
        first, last = np.concatenate((at[:1], at[edge + 1])), np.concatenate((at[edge], at[-1:]))
        long = last - first + 1 >= need
        found.add(first[long], last[long] + 1 + lag, np.full(long.sum(), lag, _I))


def _pairs(prefixes: Prefixes, n: int, width: int, found: Found) -> tuple[np.ndarray, np.ndarray]:
    """Equal minimizers from 2 to 4 widths apart among the first n numbers: first place and distance."""
    none = np.zeros(0, _I)
    h = prefixes.grams(width)[: n - width + 1]
    if len(h) < 2 * width:
        return none, none
    inside = found.rows[(found.rows[:, 2] * 3 <= width) & (found.rows[:, 1] - found.rows[:, 0] >= width) & (found.rows[:, 1] <= n)]
    if len(inside):
        depth = np.zeros(len(h) + 1, _I)
        np.add.at(depth, inside[:, 0], 1)
        np.add.at(depth, inside[:, 1] - width + 1, -1)
        h = np.where(np.cumsum(depth[:-1]) > 0, np.iinfo(_U).max, h)
    least = _windows(h, width, np.minimum)
    # the greatest of the windows a gram lies in: it is the least of one of them if it is not below that
    padded = np.concatenate((np.zeros(width - 1, _U), least, np.zeros(width - 1, _U)))
    chosen = np.flatnonzero((h <= _windows(padded, width, np.maximum)) & (h != np.iinfo(_U).max))
    order = np.lexsort((chosen, h[chosen]))
    place, value = chosen[order], h[chosen][order]
    starts, lags = [none], [none]
    for k in range(1, len(place)):
        apart = place[k:] - place[:-k]
        near = (value[k:] == value[:-k]) & (apart < 4 * width)
        if not near.any():
            break
        far = near & (apart >= 2 * width)
        starts.append(place[:-k][far])
        lags.append(apart[far])
    return np.concatenate(starts), np.concatenate(lags)


def _meetings(prefixes: Prefixes, n: int, width: int, found: Found) -> tuple[np.ndarray, np.ndarray]:
    """Periods from 2 to 4 widths whose first period lies in one run and whose second lies in another of the same period."""
    starts, lags = [], []
    rows = found.rows[(found.rows[:, 2] * 3 <= width) & (found.rows[:, 1] - found.rows[:, 0] >= 2 * width) & (found.rows[:, 1] <= n)]
    rows = rows[np.lexsort((rows[:, 0], rows[:, 2]))]
    pairs = np.flatnonzero((rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 0] <= rows[:-1, 1]) & (rows[1:, 0] > rows[:-1, 1] - rows[:-1, 2]))
    for (s1, e1, p), (s2, e2, _) in zip(rows[pairs].tolist(), rows[pairs + 1].tolist(), strict=True):
        x = np.arange(e1 - 2 * p + 1, e1 - p + 1)
        x = x[x >= s1]
        x = x[prefixes.equal(x, np.full(len(x), s2), np.full(len(x), p))]
        for phase in (s2 - x).tolist():
            q = np.arange(2 * width + (phase - 2 * width) % p, 4 * width, p)
            first, last = np.maximum(s1, s2 - q), np.minimum(e1, e2 - q)
            good = last - first >= q
            starts.append(first[good])
            lags.append(q[good])
    none = [np.zeros(0, _I)]
    return np.concatenate(starts or none), np.concatenate(lags or none)


def find(texts: list[np.ndarray]) -> np.ndarray:
    """All runs of each sequence of word numbers (below 2**40): rows of text, start, end, period, sorted by text, start and period."""
    sizes = np.array([len(t) for t in texts], _I)
    order = np.argsort(-sizes, kind="stable")
    begin = np.concatenate((np.zeros(1, _I), np.cumsum(sizes[order] + 1)))
    numbers = np.empty(begin[-1], _I)
    for k, i in enumerate(order.tolist()):
        numbers[begin[k] : begin[k + 1] - 1] = texts[i]
        numbers[begin[k + 1] - 1] = (1 << 40) + k
    found = Found()

    def prefix(least: int) -> int:
        """Numbers of the texts that have so many words."""
        return int(begin[np.searchsorted(-sizes[order], -least, side="right")])

    for lag in range(1, SHORT):
        n = prefix(max(LEAST, 2 * lag))
        if n > lag:
            _scan(numbers[:n], lag, found)
    width = SHORT // 2
    prefixes = None
    while n := prefix(4 * width):
        if prefixes is None or n * 2 < prefixes.n:
            prefixes = Prefixes(numbers[:n])
        pairs = [_pairs(prefixes, n, width, found), _meetings(prefixes, n, width, found)]
        start, lag = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        if len(start):
            found.add(start - prefixes.backward(start, lag), start + lag + prefixes.forward(start, lag), lag)
        width *= 2
    rows = found.rows
    text = np.searchsorted(begin, rows[:, 0], side="right") - 1
    rows = np.stack((order[text], rows[:, 0] - begin[text], rows[:, 1] - begin[text], rows[:, 2]), 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray | None:
    """Which of n words no run of (start, end, period) holds after its first period; None if all."""
    if not len(runs):
        return None
    depth = np.zeros(n + 1, _I)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def planted(key: int | None, n: int) -> np.ndarray | None:
    """The word that stands at each of n places of a row's text where its id asks for a repeated tail; None where it does not."""
    if key is None or n == 0:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _of_batch(keys: list[int | None], texts: list[bytes | None], places: Callable | None) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """For each row: its index, runs (start, end, period) and words."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    words, numbers = [], []
    for key, text in zip(keys, texts, strict=True):
        own = (text or b"").split()
        if places and (at := places(key, len(own))) is not None:
            own = [own[i] for i in at.tolist()]
        words.append(own)
        numbers.append(np.fromiter(map(ids.__getitem__, own), _I, len(own)))
    rows = find(numbers)
    bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    for i, own in enumerate(words):
        yield i, rows[bounds[i] : bounds[i + 1], 1:], own


def _batches(keys: list, texts: list[bytes | None], most: int = 8_000_000) -> Iterator[tuple[list, list[bytes | None]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most or i + 1 == len(texts):
            yield keys[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0


def runs(docs: DataFrame) -> DataFrame:
    """Every run of every text: doc_id, start, length, period (words from 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(keys[i], *r) for i, found, _ in _of_batch(keys, texts, None) for r in found.tolist()]
                key, start, end, period = (np.array([r[k] for r in rows], object) for k in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int64()), pa.array(end - start, pa.int64()), pa.array(period, pa.int64())], names=["doc_id", "start", "length", "period"])

    return _read(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and `text` as its words, one blank between any two, without those that a run holds after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = [_joined(found, own).decode(errors="replace") for _, found, own in _of_batch(keys, texts, None)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return _read(docs).mapInArrow(run, "doc_id long, text string")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def _joined(found: np.ndarray, own: list[bytes]) -> bytes:
    keep = kept_words(len(own), found)
    return b" ".join(own if keep is None else [own[i] for i in np.flatnonzero(keep).tolist()])


_NOTHING = hashlib.sha256(b"").hexdigest()


def digests(docs: DataFrame, places: Callable[[int | None, int], np.ndarray | None] | None = planted) -> DataFrame:
    """Per row: number of runs, the longest one (ties: smallest start, then period), and digests of all runs and of the collapsed text.
    `places` may say which of a row's own words stands at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns: list[list] = [[] for _ in range(7)]
                for _, found, own in _of_batch(keys, texts, places):
                    best, told = (None,) * 4, _NOTHING
                    if len(found):
                        length = found[:, 1] - found[:, 0]
                        k = int(length.argmax())
                        s, n, p = int(found[k, 0]), int(length[k]), int(found[k, 2])
                        best = (s, n, p, 1000 * n // p)
                        told = hashlib.sha256("".join(f"{a},{b - a},{q}\n" for a, b, q in found.tolist()).encode()).hexdigest()
                    for column, value in zip(columns, (len(found), *best, told, hashlib.sha256(_joined(found, own)).hexdigest()), strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return _read(docs).mapInArrow(run, SCHEMA)
