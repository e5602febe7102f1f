"""Moving aggregates over the last rows of each symbol, and what rows find among their symbol's facts, over batches of many symbols.

A window with a moving frame works every frame out anew, row by row and value by value, and a grouped map hands over one symbol at a time. Here rows come in batches as they lie,
sorted by symbol and order; each step takes the values of one lag for all rows of a batch at once, the oldest first, as a frame would meet them: sums are the same to the
last bit, and no row's result depends on values outside of its frame. A row's number in its symbol tells which lags it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType


def _lag(x: np.ndarray, row: np.ndarray, k: int, none) -> np.ndarray:
    """The value k rows before each row, `none` before the symbol's first row."""
    if not k:
        return x
    out = np.full(len(x), none, x.dtype)
    out[k:] = x[: max(len(x) - k, 0)]
    return np.where(row > k, out, none)


def _counts(known: np.ndarray, row: np.ndarray, n: int, last: int) -> np.ndarray:
    """How many of the n rows up to the one `last` rows before each row are known."""
    at = np.arange(len(known))
    so_far = np.concatenate((np.zeros(1, np.int64), np.cumsum(known)))
    end = np.maximum(at - last + 1, 0)
    start = np.maximum(np.maximum(end - n, at - row + 1), 0)
    return np.where(end > start, so_far[end] - so_far[np.minimum(start, end)], 0)


def _extreme(take: Callable, none: float) -> Callable:
    def widest(x: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        # the extremes of 1, 2, 4 .. rows; two of the widest that fit cover n
        width = 1
        while 2 * width <= n:
            x, width = take(x, _lag(x, row, width, none)), 2 * width
        return take(x, _lag(x, row, n - width, none))

    def run(n: int, last: int, row: np.ndarray, x: np.ndarray, known: np.ndarray) -> np.ndarray:
        nan = known & np.isnan(x)
        out = _lag(widest(np.where(known & ~nan, x, none), row, n), row, last, none)
        if nan.any():  # larger than any number
            only = take is np.fmin
            out = np.where((_counts(nan, row, n, last) > 0) & ((not only) | (_counts(known & ~nan, row, n, last) == 0)), np.nan, out)
        return out

    return run


def _avg(n: int, last: int, row: np.ndarray, x: np.ndarray, known: np.ndarray) -> np.ndarray:
    total, x = np.zeros(len(x)), np.where(known, x, 0.0)
    for k in range(n - 1 + last, last - 1, -1):
        total += _lag(x, row, k, 0.0)
    return total / np.maximum(_counts(known, row, n, last), 1)


def _moments(n: int, last: int, row: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums of squares of x and of products of x and y around their means."""
    count, mx, my, xx, xy = (np.zeros(len(x)) for _ in range(5))
    x, y = np.where(known, x, 0.0), np.where(known, y, 0.0)
    for lag in range(n - 1 + last, last - 1, -1):
        a, b, k = _lag(x, row, lag, 0.0), _lag(y, row, lag, 0.0), _lag(known, row, lag, False)
        count += k
        size = np.maximum(count, 1)
        d = np.where(k, a - mx, 0.0)
        part = d / size
        mx += part
        my += np.where(k, b - my, 0.0) / size
        xx += d * (d - part)
        xy += d * np.where(k, b - my, 0.0)
    return count, xx, xy


def _sd(n: int, last: int, row: np.ndarray, x: np.ndarray, known: np.ndarray) -> np.ndarray:
    count, xx, _ = _moments(n, last, row, x, x, known)
    return np.sqrt(xx / np.where(count > 1, count - 1, np.nan))


def _beta(n: int, last: int, row: np.ndarray, y: np.ndarray, x: np.ndarray, known: np.ndarray) -> np.ndarray:
    count, xx, xy = _moments(n, last, row, x, y, known)
    rest = np.where(count > 1, count - 1, np.nan)
    spread = xx / rest
    return np.where(spread > 0, xy / rest / np.where(spread > 0, spread, 1.0), np.nan)


_KINDS = {"avg": _avg, "max": _extreme(np.fmax, -np.inf), "min": _extreme(np.fmin, np.inf), "sd": _sd, "beta": _beta}
#: Those that have no value, and so are null, where they come out as NaN of numbers.
_OPEN = {"sd", "beta"}


def rolled(df: DataFrame, wants: dict[str, tuple], by: str = "symbol", order: str = "dt") -> DataFrame:
    """`df` with a double for each of `wants`: name -> (kind, n, least, last, column, ...), over the n rows of the symbol that end `last` rows before a row, in order; null under
    `least` values. Kinds: avg, max, min, sd (of a sample), beta (of a first column on a second, over rows that have both). `order` tells a symbol's rows apart.

    A task holds a batch of rows and, of the batch before, as many as the longest frame reaches back."""
    # the row's number also keeps a symbol's rows together and in order, without a shuffle where windows over the symbol have done so
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    schema = StructType([*df.schema.fields])
    for name in wants:
        schema = schema.add(name, DoubleType())
    reach = max(n + last for _, n, _, last, *_ in wants.values())
    columns = sorted({c for want in wants.values() for c in want[4:]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, values = np.zeros(0, np.int64), {c: (np.zeros(0), np.zeros(0, bool)) for c in columns}
        for batch in batches:
            before = len(row)
            row = np.concatenate((row, batch.column("_row").to_numpy(zero_copy_only=False)))
            for c in columns:
                column = batch.column(c)
                new = column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
                values[c] = tuple(np.concatenate(pair) for pair in zip(values[c], new, strict=True))
            out = []
            with np.errstate(all="ignore"):
                for kind, n, least, last, *of in wants.values():
                    known = np.logical_and.reduce([values[c][1] for c in of])
                    found = _KINDS[kind](n, last, row, *(values[c][0] for c in of), known)[before:]
                    few = (_counts(known, row, n, last) < least)[before:]
                    out.append(pa.array(found, pa.float64(), mask=few | np.isnan(found) if kind in _OPEN else few))
            kept = [batch.column(f.name) for f in schema.fields[: len(schema.fields) - len(wants)]]
            yield pa.RecordBatch.from_arrays([*kept, *out], names=schema.names)
            row, values = row[-reach:], {c: (x[-reach:], known[-reach:]) for c, (x, known) in values.items()}

    return numbered.mapInArrow(run, schema)


@dataclass
class Met:
    """Rows that ask, the facts of their symbols in order, and between which of them (`low` to `high`, the last one not) each row's own lie."""

    asks: pa.RecordBatch
    facts: pa.Table
    ask_symbol: np.ndarray
    fact_symbol: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def fact(self, name: str, none=np.nan) -> np.ndarray:
        return self._plain(self.facts[name].combine_chunks(), none)

    def ask(self, name: str, none=np.nan) -> np.ndarray:
        return self._plain(self.asks.column(name), none)

    @staticmethod
    def _plain(column, none) -> np.ndarray:
        """Numbers as they are, dates as days since 1970, nulls as `none`."""
        if pa.types.is_date(column.type):
            column = column.cast(pa.int32()).cast(pa.int64())
        return column.fill_null(none).to_numpy(zero_copy_only=False)

    def find(self, at: str, wanted: np.ndarray, after: bool = False) -> np.ndarray:
        """The place of each row's first fact with `at` (whole numbers or dates) no less than wanted (`after`: larger); `high` if there is none."""
        wide = np.int64(1) << 33
        place = np.searchsorted(self.fact_symbol * wide + self.fact(at, 0), self.ask_symbol * wide + wanted, "right" if after else "left")
        return np.clip(place, self.low, self.high)


def met(asks: DataFrame, facts: DataFrame, take: Callable[[Met], pa.RecordBatch], schema: StructType | str, by: str = "symbol", order: str = "dt") -> DataFrame:
    """What `take` makes of rows that ask and the facts of their symbols: both are sorted once by symbol, a symbol's facts before its asks, and read in batches. A task
    holds a batch and one symbol's facts (as many as it has days), whatever number of rows ask of one symbol."""
    empty = lambda df: F.lit(None).cast(df.select(F.struct("*")).schema[0].dataType)
    first = facts.where(F.col(by).isNotNull()).select(by, F.lit(0).alias("_side"), F.col(order).alias("_at"), F.struct(*facts.columns).alias("_fact"), empty(asks).alias("_ask"))
    then = asks.select(by, F.lit(1).alias("_side"), F.lit(None).cast(facts.schema[order].dataType).alias("_at"), empty(facts).alias("_fact"), F.struct(*asks.columns).alias("_ask"))
    both = first.unionByName(then).select(F.row_number().over(Window.partitionBy(by).orderBy("_side", "_at")).alias("_row"), "_side", "_fact", "_ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_symbol = None, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            symbol = np.cumsum(batch.column("_row").to_numpy() == 1)  # 0: still that of the batch before
            facts_here = batch.column("_side").to_numpy() == 0
            here = pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column("_fact").filter(pa.array(facts_here)))])
            fact_symbol = np.concatenate((kept_symbol, symbol[facts_here]))
            here = here if kept is None else pa.concat_tables([kept, here])
            asked, ask_symbol = pa.RecordBatch.from_struct_array(batch.column("_ask").filter(pa.array(~facts_here))), symbol[~facts_here]
            if asked.num_rows:
                yield take(Met(asked, here, ask_symbol, fact_symbol, np.searchsorted(fact_symbol, ask_symbol, "left"), np.searchsorted(fact_symbol, ask_symbol, "right")))
            kept = here.slice(int(np.searchsorted(fact_symbol, symbol[-1]))).combine_chunks()
            kept_symbol = np.zeros(kept.num_rows, np.int64)

    return both.mapInArrow(run, schema)
