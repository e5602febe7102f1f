"""Packing into length buckets whose boundaries are optimal for the corpus.

Lengths (words, unless a length column is given; any whole number) are counted over all documents into an exact
histogram. It comes to the driver: lengths that differ sum to no more than all words do, so there are at most
sqrt(2 * words) of them (5.5 million for 1.5e13 words). Dynamic programming over it picks the `buckets` boundaries, each a
length that occurs, with the fewest padded tokens (each document is padded to the boundary of its bucket). The best
earlier boundary is a minimum over straight lines, whose lower hull is kept, so a bucket takes one pass over the histogram.
Inside a bucket documents are numbered without gaps and cut into batches of budget // boundary rows, at least one.

Defined results: null and empty texts have length 0 and go to the first bucket. Repeated rows take places of their
own. Of equally good boundaries the smaller is taken. An empty table has no batches.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_slots, written

BUCKETS = 8
BUDGET = 65_536
#: Rows that one task numbers.
ROWS = 1_000_000


def words(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def boundaries(edges: list[int], counts: list[int], buckets: int) -> list[int]:
    """The boundaries (`buckets` of the sorted `edges`, or all if fewer; the last is among them) with the fewest padded tokens."""
    n = len(edges)
    if not n:
        return []
    below = list(itertools.accumulate(counts))
    best = [e * c for e, c in zip(edges, below, strict=True)]  # one bucket up to each edge
    before: list[list[int]] = []
    for used in range(1, min(buckets, n)):
        # with the bucket before ending at i, edge j costs best[i] - edges[j] * below[i], and edges[j] * below[j] whatever i is
        hull: list[int] = []
        now, where, first = [0] * n, [0] * n, 0
        for j in range(used, n):
            i = j - 1
            while len(hull) - first > 1:
                a, b = hull[-2], hull[-1]
                if (best[i] - best[a]) * (below[b] - below[a]) >= (best[b] - best[a]) * (below[i] - below[a]):
                    break
                hull.pop()
            hull.append(i)
            while first + 1 < len(hull) and best[hull[first + 1]] - edges[j] * below[hull[first + 1]] < best[hull[first]] - edges[j] * below[hull[first]]:
                first += 1
            where[j] = hull[first]
            now[j] = best[hull[first]] + edges[j] * (below[j] - below[hull[first]])
        before.append(where)
        best = now
    out, j = [edges[n - 1]], n - 1
    for where in reversed(before):
        j = where[j]
        out.append(edges[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, bucket, boundary, batch (from 0 in its bucket), place (from 0 in its batch), padding."""
    spark = docs.sparkSession
    n = words(F.col("text").cast("string")) if length is None else length.cast("long")
    # a number of its own for each row, fixed once written: rows alike in id and length are dealt apart
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    histogram = rows.groupBy("n_tokens").count().toArrow().sort_by("n_tokens")
    cuts = boundaries(histogram["n_tokens"].to_pylist(), histogram["count"].to_pylist(), buckets)
    edges = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array(F.lit(0).cast("long"))
    bucket = F.size(F.filter(edges, lambda e: e < F.col("n_tokens")))
    total = sum(histogram["count"].to_pylist())
    placed = gapless_slots(rows.withColumn("bucket", bucket), F.col("bucket"), ["doc_id", "n_tokens", "row"], max(32, math.ceil(total / ROWS)))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1))))
    return (
        placed.withColumn("boundary", F.element_at(edges, F.col("bucket") + 1))
        .withColumn("batch", F.floor(F.col("slot") / per_batch).cast("long"))
        .withColumn("place", (F.col("slot") - F.col("batch") * per_batch).cast("long"))
        .select("doc_id", "n_tokens", "bucket", "boundary", "batch", "place", (F.col("boundary") - F.col("n_tokens")).alias("padding"))
    )
