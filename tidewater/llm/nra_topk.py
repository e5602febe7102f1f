"""Exact top-k inner products by no-random-access aggregation.

Vectors become integers, floor(scale * x). They are dealt into blocks by a hash of the row, and a block is one row that
holds its vectors. Queries are packed likewise, many to a pack; packs of a bounded number of bytes are broadcast at a
time, so that no vector is copied or shuffled for them. Where a block meets a pack, each component gives two sorted lists, from its
largest value down and from its smallest up, of which a query uses the one that its own sign favours. All queries of
the pack read their lists together, a stretch at a time. What has been read of a vector, and for each list in which it
has not come up the value read last (above) or the list's last value (below), bound its score from both sides; bounds
of a whole pack are two matrix products. A query stops once no more than SLACK * k vectors can still reach its k-th lower
bound, and what those still lack is resolved: their scores become exact. At the lists' ends bounds meet by themselves.
A query's blocks meet in one last ranking.

Defined results: rows with a null id, a null vector, or null or non-finite components take no part. Every row is a
candidate and (if it is asked for) a query of its own, whatever other rows repeat its id; it is left out only against
itself. Equal scores of rows that share an id stand side by side. Vectors of unlike length are not compared. A query
with no candidate has no rows. Scores are exact while they fit 64 bits, and clipped to the ends of that range beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, passing, shared_path, written

#: Vectors of a block and queries of a pack, and how many components either may hold.
BLOCK, QUERIES, COMPONENTS = 8192, 512, 4 << 20
#: Bytes of packs that are broadcast at a time.
ROUND_BYTES = 64 << 20
#: Shares of the lists read when bounds are looked at.
DEPTHS = (0.5, 0.75, 0.875, 0.9375, 0.96875, 1.0)
SLACK = 4
BROADCAST_ROWS = 200_000
#: Components beyond this set a vector apart, as sums over it may need more than 64-bit floats.
LARGE = float(1 << 20)


class Lists:
    """Two sorted lists for each component of a block's vectors (rows of whole numbers), read from the front in step."""

    def __init__(self, vectors: np.ndarray):
        both = np.concatenate((vectors, -vectors), axis=1)
        self.order = np.argsort(-both, axis=0, kind="stable")
        self.values = np.take_along_axis(both, self.order, 0)
        self.floor = self.values[-1]
        self.rewind()

    def rewind(self) -> None:
        """Nothing has been read."""
        self.low = np.repeat(self.floor[None, :], len(self.values), 0)
        self.read = 0

    def advance(self, to: int) -> None:
        """Read every list on to its entry number `to`."""
        np.put_along_axis(self.low, self.order[self.read : to], self.values[self.read : to], 0)
        self.read = to

    def bounds(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores (a row for each row of `weights`, whose entries are not negative)."""
        return weights @ self.low.T, weights @ np.maximum(self.low, self.values[self.read - 1]).T


def _kind(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The quickest type in which no sum of products is rounded."""
    most = 2.0 * max(1, vectors.shape[1]) * max(1.0, np.abs(vectors).max(initial=0)) * max(1.0, np.abs(queries).max(initial=0))
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _of_kind(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape) if kind is object else x.astype(kind)


def block_top(vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, held: dict[type, tuple[np.ndarray, Lists]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """Vectors among which each query's k best are, all that tie with the k-th included: (queries, vectors, scores, share of the lists
    read), in pieces as queries stop. `own` is the position of the query itself among the vectors (-1: not there).
    `held` keeps the lists of these vectors for more queries."""
    kind, held = _kind(vectors, queries), {} if held is None else held
    if kind not in held:
        typed = _of_kind(vectors, kind)
        held[kind] = typed, Lists(typed)
    (vectors, lists), queries = held[kind], _of_kind(queries, kind)
    lists.rewind()
    weights = np.maximum(np.concatenate((queries, -queries), axis=1), 0)
    n, left = len(vectors), np.arange(len(queries))
    for depth in DEPTHS:
        lists.advance(max(1, math.ceil(depth * n)))
        low, high = lists.bounds(weights[left])
        mine = np.flatnonzero(own[left] >= 0)
        low[mine, own[left[mine]]] = high[mine, own[left[mine]]] = -math.inf
        edge = np.partition(low, n - k, axis=1)[:, n - k :][:, :1] if n > k else np.full((len(left), 1), -math.inf)
        able = (high >= edge) & (high > -math.inf)
        stops = (able.sum(1) <= SLACK * k) | (lists.read == n)
        at, found = np.nonzero(able[stops])
        at = left[stops][at]
        yield at, found, (vectors[found] * queries[at]).sum(1), lists.read / n
        left = left[~stops]
        if not len(left):
            return


def _best(k: int, scale: float):
    """Blocks beside packs to (query_row, query_id, row, vec_id, score, read): the k best of each pair of a query and a block."""
    names = ["query_row", "query_id", "row", "vec_id", "score", "read"]

    def vectors_of(lists: pa.Array, i: int, dims: int) -> np.ndarray:
        x = scale * lists[i].values.to_numpy(zero_copy_only=False).reshape(-1, dims)
        return np.floor(np.nan_to_num(x, posinf=np.finfo(float).max, neginf=-np.finfo(float).max))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a block meets its packs one after the other; its lists are sorted once
        last, vectors, held = np.zeros(0, np.int64), np.zeros((0, 0)), {}
        for batch in batches:
            c = {name: batch.column(j) for j, name in enumerate(batch.schema.names)}
            for i in range(len(batch)):
                dims = c["dims"][i].as_py()
                rows, ids, query_rows, query_ids = (np.asarray(c[x][i].values) for x in ("rows", "ids", "query_rows", "query_ids"))
                if not np.array_equal(rows, last):
                    vectors, held, last = vectors_of(c["vectors"], i, dims) if dims else np.zeros((len(rows), 0)), {}, rows
                queries = vectors_of(c["queries"], i, dims) if dims else np.zeros((len(query_rows), 0))
                by_row = np.argsort(rows)
                at = by_row[np.minimum(np.searchsorted(rows, query_rows, sorter=by_row), len(rows) - 1)]
                own = np.where(rows[at] == query_rows, at, -1)
                step = len(queries) if _kind(vectors, queries) is not object else 16
                for first in range(0, len(queries), step):
                    for q, v, score, read in block_top(vectors, queries[first : first + step], own[first : first + step], k, held):
                        score = np.clip(score, -(1 << 63), (1 << 63) - 1) if score.dtype == object else score
                        score, q = score.astype(np.int64), q + first
                        order = np.lexsort((rows[v], ids[v], ~score, q))
                        q, v, score = q[order], v[order], score[order]
                        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), bool), q[1:] != q[:-1])))
                        best = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k
                        q, v, score = q[best], v[best], score[best]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_rows[q], query_ids[q], rows[v], ids[v], score, np.full(len(q), read))], names=names)

    return run, "query_row long, query_id long, row long, vec_id long, score long, read double"


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, block: int = BLOCK, queries: int = QUERIES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Per query its k best: query_id, rank, vec_id, score, and the share of its lists read in the block that the row comes from.
    `vectors` has vec_id and embedding; `is_query` is over vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    large = F.exists("v", lambda x: F.abs(x) > LARGE / scale)
    rows = written(rows.select("vec_id", "v", F.size("v").alias("dims"), large.alias("large"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "topk-vectors")

    def deals(n: Column, most: int) -> Column:
        return F.ceil(n / F.greatest(F.lit(1), F.least(F.lit(most), F.floor(COMPONENTS / F.greatest("dims", F.lit(1)))))).cast("long")

    kinds = rows.groupBy("dims", "large").agg(deals(F.count(F.lit(1)), block).alias("blocks"), deals(F.count_if("asks"), queries).alias("packs"))
    before = Window.orderBy("dims", "large").rowsBetween(Window.unboundedPreceding, -1)  # one row for each length of vectors
    kinds = written(kinds.withColumn("first", F.coalesce(F.sum("packs").over(before), F.lit(0))), "topk-kinds")
    n_blocks, n_packs, dims = kinds.agg(F.sum("blocks"), F.sum("packs"), F.max("dims")).first()
    per_round = max(1, round_bytes // (8 * max(1, min(queries * (dims or 0), COMPONENTS))))
    kinds = checked_broadcast(kinds, BROADCAST_ROWS)

    def dealt(some: DataFrame, over: str, columns: tuple[str, str, str], most: int) -> DataFrame:
        key, x = ["dims", "large", "number"], F.collect_list(F.struct("row", "vec_id", "v"))
        some = some.join(kinds, ["dims", "large"]).withColumn("number", F.pmod(F.xxhash64("row"), F.col(over)))
        grouped = some.repartition(max(1, min(most, 10_000)), *key).groupBy(*key, "first").agg(x.alias("x"))
        return grouped.select("dims", (F.col("first") + F.col("number")).alias("number"), *(e.alias(c) for e, c in zip((F.col("x.row"), F.col("x.vec_id"), F.flatten("x.v")), columns, strict=True)))

    blocks = written(dealt(rows, "blocks", ("rows", "ids", "vectors"), n_blocks or 1).drop("number"), "topk-blocks")
    packs = written(dealt(rows.where("asks"), "packs", ("query_rows", "query_ids", "queries"), n_packs or 1), "topk-packs")
    run, schema = _best(k, float(scale))
    found = shared_path(vectors.sparkSession, "topk-found")
    for r in range(max(1, -(-(n_packs or 0) // per_round))):
        some = packs.where(F.floor(F.col("number") / per_round) == r).drop("number")
        pairs = blocks.repartition(max(1, min(n_blocks or 1, 10_000))).join(F.broadcast(some), "dims")
        pairs.mapInArrow(run, schema).write.mode("append").parquet(found)
    passing(vectors.sparkSession, found)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    best = vectors.sparkSession.read.schema(schema).parquet(found).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "read")
