"""Sharding by histogram sort: equal bytes per shard, one exchange.

Rows are ordered by (hash of the text, hash of the id, id), so equal texts stand together. The splitters between shards
are found by counting, never by sorting: each round counts the exact bytes below every probe inside the key ranges that
still hold an open target, and a target closes when a probe comes within `tolerance` of it, or when its range is a single
key. Where a target falls among equal texts, the nearer end of the group is taken if it lies within `slack` of the target
(copies then share a shard); only larger groups are parted, by the hash of the id. Then rows are exchanged once, by
shard and by as many ranges of keys as keep each near ROWS rows (ranges with a hot text are cut again by id), and numbered
inside their range; a row's slot is its number plus the counted rows of the shard's ranges before it.

A row whose key equals a splitter lies at or above it. Only rows with equal text and equal id can't be parted.
Defined results: a null text counts 1 byte and has checksum 0; null ids sort by their hash as any other; repeated rows
get slots of their own, in no fixed order among themselves.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, fresh, shared_path, written

SHARDS = 8
#: Largest distance of a splitter from its target, as a share of a shard; and where that keeps equal texts together.
TOLERANCE, SLACK = 0.001, 0.01
#: Probes by which a range is cut in one round, as a power of 2.
STEP = 10
#: Rows that one task numbers, about.
ROWS = 500_000
BROADCAST_ROWS = 200_000
_LOW = -(1 << 63)


def _bits(key: Column, above: int, bits: int) -> Column:
    """`bits` bits of a signed 64-bit key behind the first `above`, in key order."""
    ordered = key.bitwiseXOR(F.lit(_LOW))
    return F.shiftrightunsigned(ordered, 64 - above - bits).bitwiseAND(F.lit((1 << bits) - 1)) if bits else F.lit(0).cast("long")


def splitters(keyed: DataFrame, keys: list[str], size: str, parts: int, tolerance: float, slack: float = 0.0, step: int = STEP) -> list[tuple[int, ...]]:
    """Keys (tuples over 64-bit columns `keys`) below which k / parts of all bytes lie, k = 1 .. parts - 1, each within
    `tolerance` bytes, or within `slack` where that keeps rows together that differ in the last key only. What comes to the driver
    in a round is at most 2**step counts for each open range."""
    total = keyed.agg(F.sum(size)).first()[0] or 0
    targets = [total * k / parts for k in range(1, parts)]
    found: list[tuple[int, ...] | None] = [None] * len(targets)
    # a range holds all keys that share the earlier columns (signed) and the first bits of the one at hand; below: bytes before it
    open_ranges: dict[tuple[int, ...], tuple[int, list[int]]] = {(0,): (0, list(range(len(targets))))}
    for j, above in [(j, above) for j in range(len(keys)) for above in range(0, 64, step)]:
        if not open_ranges:
            break
        bits = min(step, 64 - above)
        whole_key, last = above + bits == 64, above + bits == 64 and j + 1 == len(keys)
        prefix = [*(F.col(c) for c in keys[:j]), F.shiftrightunsigned(F.col(keys[j]).bitwiseXOR(F.lit(_LOW)), 64 - above) if above else F.lit(0).cast("long")]
        names = [f"_at{i}" for i in range(len(prefix))]
        rows = keyed.select(*(c.alias(n) for c, n in zip(prefix, names, strict=True)), _bits(F.col(keys[j]), above, bits).alias("_digit"), F.col(size).alias("_size"))
        for i, n in enumerate(names):
            rows = rows.where(F.col(n).isin(sorted({r[i] for r in open_ranges})))
        by_range: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for r in rows.groupBy(*names, "_digit").agg(F.sum("_size")).collect():
            by_range.setdefault(tuple(r[: len(names)]), []).append((r[-2], r[-1]))
        following: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        for place, (below, wanted) in open_ranges.items():
            edges, at_edge = [], below
            for digit, n in sorted(by_range.get(place, [])):
                edges.append((at_edge, at_edge + n, digit))
                at_edge += n
            for k in wanted:
                for start, end, digit in edges:
                    if start <= targets[k] < end or (end == at_edge and targets[k] >= end):
                        near = max(tolerance, slack) if whole_key and j + 2 == len(keys) else tolerance
                        value = (place[-1] << bits) + digit
                        if min(targets[k] - start, end - targets[k]) <= near or last:
                            value += targets[k] - start > end - targets[k]
                            found[k] = _as_key(place[:-1], value, above + bits, len(keys))
                        else:
                            place2 = (*place[:-1], value) if not whole_key else (*place[:-1], value + _LOW, 0)
                            following.setdefault(place2, (start, []))[1].append(k)
                        break
        open_ranges = following
    return [f for f in found if f is not None]


def _as_key(before: tuple[int, ...], value: int, bits: int, columns: int) -> tuple[int, ...]:
    """The smallest key with these columns and these first bits of the next one (a value one above its range carries over)."""
    number = functools.reduce(lambda x, y: (x << 64) + y - _LOW, before, 0)
    number = (number << 64) + (value << (64 - bits))
    number = min(number << (64 * (columns - len(before) - 1)), (1 << (64 * columns)) - 1)
    return tuple((number >> (64 * (columns - 1 - i)) & ((1 << 64) - 1)) + _LOW for i in range(columns))


def _keyed(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """`docs` with size, crc and both keys in columns of these names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    new = {"size": (F.octet_length(text) + 1).cast("long"), "crc": F.crc32(text), "k1": F.xxhash64(text), "k2": F.xxhash64(F.col("doc_id").cast("long"))}
    return docs.withColumns({names[n]: c for n, c in new.items()})


def _placed(rows: DataFrame, keyed: DataFrame, cuts: list[tuple[int, ...]], names: dict[str, str], each: int) -> DataFrame:
    """`rows` with shard and slot; `keyed` (written) has the same rows' keys k1 and k2."""

    def shard_of(k1: Column, k2: Column) -> Column:
        def among(low: int, high: int) -> Column:  # binary search, as nested comparisons
            if low == high:
                return F.lit(low)
            middle = (low + high) // 2
            a, b = cuts[middle]
            return F.when((k1 < a) | ((k1 == a) & (k2 < b)), among(low, middle)).otherwise(among(middle + 1, high))

        return among(0, len(cuts))

    total = keyed.count()
    n = dict(names)
    bits = min(24, max(3, math.ceil(math.log2(max(1, total / each)))))

    def ranged(some: DataFrame, k1: str, k2: str) -> DataFrame:
        return some.withColumns({n["shard"]: shard_of(F.col(k1), F.col(k2)), n["range"]: _bits(F.col(k1), 0, bits)})

    own = ranged(keyed, "k1", "k2")
    at = [n["shard"], n["range"]]
    # ranges that a hot text fills are cut again by the hash of the id
    hot = written(own.groupBy(*at).count().where(F.col("count") > 4 * each).select(*at, F.ceil(F.log2(F.col("count") / each)).cast("int").alias(n["bits"])), "histogram-hot")
    most = hot.agg(F.max(n["bits"])).first()[0]

    def cut(some: DataFrame, k2: str) -> DataFrame:
        if most is None:
            return some.withColumn(n["part"], F.lit(0).cast("long"))
        some = some.join(checked_broadcast(hot, BROADCAST_ROWS), at, "left")
        return some.withColumn(n["part"], F.when(F.col(n["bits"]).isNotNull(), _bits(F.col(k2), 0, most)).otherwise(F.lit(0))).drop(n["bits"])

    key = [*at, n["part"]]
    before = Window.partitionBy(n["shard"]).orderBy(n["range"], n["part"]).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(own, "k2").groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(n["from"]))
    starts = checked_broadcast(written(starts, "histogram-starts"), BROADCAST_ROWS)
    inside = Window.partitionBy(*key).orderBy(n["k1"], n["k2"], "doc_id")
    numbered = cut(ranged(rows, n["k1"], n["k2"]), n["k2"]).withColumn(n["slot"], F.row_number().over(inside))
    return numbered.join(starts, key).withColumn(n["slot"], F.col(n["from"]) + F.col(n["slot"]) - 1).drop(n["range"], n["part"], n["from"])


_NAMES = ("size", "crc", "k1", "k2", "shard", "range", "part", "bits", "from", "slot")


def _cuts(keyed: DataFrame, shards: int, tolerance: float, slack: float) -> list[tuple[int, ...]]:
    total = keyed.agg(F.sum("size")).first()[0] or 0
    return splitters(keyed, ["k1", "k2"], "size", shards, tolerance * total / shards, slack * total / shards)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, slack: float = SLACK, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    names = {n: n for n in _NAMES}
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = written(_keyed(ids, names).drop("text"), "histogram-keys")
    return _placed(keyed, keyed, _cuts(keyed, shards, tolerance, slack), names, rows).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str | None = None, shards: int = SHARDS, tolerance: float = TOLERANCE, slack: float = SLACK, rows: int = ROWS) -> str:
    """Write the documents with all their columns under `path` (the shared folder if none is given), one folder per shard and in the
    order of their slots, which column `slot` holds (`shard` and `slot` get an underscore where `docs` has them); returns the path."""
    names = {n: fresh(docs, n) for n in _NAMES}
    keyed = _keyed(docs, names).select(*(F.col(names[n]).alias(n) for n in ("size", "k1", "k2")))
    keyed = written(keyed, "histogram-keys")
    placed = _placed(_keyed(docs, names), keyed, _cuts(keyed, shards, tolerance, slack), names, rows)
    path = path or shared_path(docs.sparkSession, "shards")
    placed.select(*docs.columns, names["shard"], names["slot"]).sortWithinPartitions(names["shard"], names["slot"]).write.partitionBy(names["shard"]).parquet(path)
    return path
