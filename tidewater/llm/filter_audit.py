"""How filters interact: what each would remove in every order they could be applied in, and their Shapley shares.

The filters' subsets form a lattice: a state is the set applied so far, an edge applies one more. Rows are reduced to counts
by part and by the set of filters they fail, so everything after that is small. Each edge then removes the rows that fail
its filter and none of its state. Orders are counted forward (paths from the empty set to a state) and backward (paths
from it to the full set); an edge lies on forward x backward of them, which weighs its removals for the Shapley sum. The
steps of each single order are looked up from the same edges.

The whole job is native columns. Rows that repeat an earlier text are found by digest: a groupBy gives the smallest doc_id of
each, and rows come together only with that very id. Rows equal in id, part and text are counted before anything is joined,
so a third of all rows being one text, one id, one part or without an id meets no task whole.

Defined results: null texts are empty (they fail the word count, and are copies of each other); a null part is the empty string.
A row without a doc_id is never a repeat, nor makes others one, and has no label. Rows that share a text and a doc_id are not
repeats of each other. Of several labels of a doc_id one with 1 is enough. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: What is counted of the rows in a state or on an edge.
COUNTS = ("n", "good", "toxic")


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each subset of n filters (as bits): orders that reach it, and orders that lead on from it to all."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if state >> f & 1:
                backward[state & ~(1 << f)] += backward[state]
    return forward, backward


def edges(fails: DataFrame, n: int) -> DataFrame:
    """From counts by part and failed set (part, mask, n, good, toxic) to one row per part and edge (state, f): what it leaves,
    removes and finds removed already, who fails its filter only, and on how many orders it lies. States and edges without rows have zeros."""
    forward, backward = path_counts(n)
    full = (1 << n) - 1
    steps = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(full + 1) for f in range(n) if not s >> f & 1]
    step = F.explode(F.array(*(F.struct(F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(w).cast("long").alias("orders")) for s, f, w in steps)))
    masks = fails.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))
    # per part one array of its counts by mask: 2**n entries
    table = masks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS).alias("c")))).alias("c"))
    lined = table.select("part", F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.struct(m.alias("mask"), *(F.coalesce(F.col("c")[m][k], F.lit(0)).alias(k) for k in COUNTS))).alias("c"))
    on = lined.select("part", "c", step.alias("e")).select("part", "c", "e.*").withColumn("bit", F.expr("shiftleft(1, f)"))

    def total(what: str, holds) -> Column:
        return F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + F.when(holds(x["mask"]), x[what]).otherwise(0))

    state, bit = F.col("state"), F.col("bit")

    def untouched(m: Column) -> Column:
        return m.bitwiseAND(state) == 0

    def fails_it(m: Column) -> Column:
        return m.bitwiseAND(bit) != 0

    return on.select(
        "part", "state", "f", "orders",
        total("n", lambda m: untouched(m) & ~fails_it(m)).alias("kept"),
        total("n", lambda m: untouched(m) & fails_it(m)).alias("removed"),
        total("n", lambda m: ~untouched(m) & fails_it(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: untouched(m) & fails_it(m)).alias("good_lost"),
        total("toxic", lambda m: untouched(m) & fails_it(m)).alias("toxic_lost"),
    )


def report(fails: DataFrame, letters: str = LETTERS) -> DataFrame:
    """From counts by part and failed set to one row per part, order of the filters and step in it."""
    n = len(letters)
    # parts x edges rows, of which the Shapley sums and the orders' steps are both read
    each = common.written(edges(fails, n), "filter-edges")
    shapley = each.groupBy("part", "f").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    ways = []
    for order in permutations(range(n)):
        name, state = "".join(letters[f] for f in order), 0
        for k, f in enumerate(order):
            ways.append((name, k + 1, state, f))
            state |= 1 << f
    spark = fails.sparkSession
    # n! x n rows, whatever the tables hold
    orders = F.broadcast(spark.createDataFrame(ways, "filter_order string, step int, state int, f int"))
    lined = each.join(shapley, ["part", "f"]).join(orders, ["state", "f"])
    return lined.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_fails(text: Column) -> Column:
    """Bits of the four conditions that a text alone decides (A to D)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return reduce(add, (F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of documents by part (source) and failed set: n, good (labelled quality 1), toxic (labelled 1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_fails(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("content"))
    rows = common.written(read.groupBy("doc_id", "part", "mask", "content").agg(F.count(F.lit(1)).alias("n")), "filter-rows")
    named = rows.where("doc_id is not null")
    least = named.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    first = named.join(least.withColumn("first", F.lit(True)), ["content", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("first"), 0).otherwise(16))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*((F.max(F.coalesce(F.col(c), F.lit(0))) == 1).alias(c) for c in ("quality", "toxic")))
    counts = first.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(told, "doc_id", "left")
    labelled = counts.select("part", "mask", "n", F.when(F.col("quality"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"))
    nameless = rows.where("doc_id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return labelled.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents: one row per part, order and step."""
    return report(failed_sets(docs, labels))
