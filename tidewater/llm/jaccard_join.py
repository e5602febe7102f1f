"""N-gram Jaccard join with signature trees; exact.

Texts become sets of distinct k-word shingles. Two texts link when den * |A & B| >= num * |A | B|.

1. Every text is hashed to its set's size, a digest of the set, and part signatures. Sizes lie in bands that
   overlap so that both ends of any link share a band. A link leaves at most m shingles of a band's two sets unmatched,
   so of a set that fills more than m hash parts, one filled part at least is equal in the other; sets that fill fewer
   name their empty parts too, and then both do. So linked sets share a named part: no link is lost.
2. Equal digests are one class. Signatures travel packed, 5 bytes each, to buckets of bounded size. The classes that
   share a part are a group (equal groups count once); inside a group, token bitmaps ordered by size and OR-combined
   tile by tile leave the pairs whose largest possible overlap still allows a link, and enough of them to join all
   such pairs make blocks (connected components). Of the parts a set names in a band, more are equal in a linked set than
   it needs, so it leaves groups of frequent parts (a common passage) as long as it keeps one: its links meet in others.
   Sets that can't leave (near copies in great number) stay; a large group is cut into bounded chunks by size, and
   each pair of chunks is compared by itself.
3. Inside a block, a tree per chunk holds at each node the OR of its members' token bitmaps and their size range. A
   dual traversal of two trees drops node pairs whose sizes, or whose largest possible overlap, forbid a link, and
   node pairs already joined; what is left is compared exactly. Chunks are bounded in bytes; a block with several is
   compared chunk against chunk, each pair in its own task.
4. Links join classes into components, which take the smallest doc_id of their documents.

Defined results: null texts and texts without words have empty sets and stay alone; texts with fewer words than k are
one shingle. Rows with a null doc_id take part, and a component of such rows only has a null id. Repeated rows each
get a row. Shingles, and whole sets, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, forget, fresh, give_back, released, written
from .wordhash import SPACES, mix, rolling, sequence, words

NUM, DEN, WORDS = 90, 100, 3
SPARE = 2
#: Ratio of a band's largest to its smallest size.
BAND = 1.6
FANOUT = 8
#: Members of a group whose bitmaps are OR-combined, and compared, together.
TILE = 128
#: Weight (a member's is 1, and 1 more for each 16,384 shingles) beyond which a group is cut into chunks of about so much.
GROUP = 4096
#: Members beyond which a part is frequent.
FREQUENT = 128
#: Members of groups that one task compares, about.
TASK = 20_000
CHUNK_BYTES = 32 << 20
#: Digests a task remembers so as not to name the parts of a copy again.
SEEN = 200_000
#: Signatures that one bucket gets.
BUCKET = 3_000_000
BROADCAST_ROWS = 200_000
#: A class with more than one of so many equal shares of all rows is met by broadcast; so there are at most so many.
SHARES = 50_000

_U = np.uint64


@functools.cache
def bands(num: int, den: int, largest: int) -> tuple[tuple[int, int, int, int], ...]:
    """(smallest size, largest size, most unmatched shingles of a link, parts) of each band up to sizes of `largest`; any linked
    pair of sizes lies whole in one. There are parts enough that a set of seven tenths of the smallest size fills more than
    can be left unmatched."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND), low * den // num)
        unmatched = (den - num) * 2 * high // (den + num)
        parts = unmatched + 1 + SPARE
        while unmatched and parts < 4 * unmatched and parts * (1 - math.exp(-0.7 * low / parts)) < 1.05 * unmatched + SPARE:
            parts += max(1, unmatched // 20)
        out.append((low, high, unmatched, parts if unmatched else 1))
        low = max(low + 1, -(-(high + 1) * num // den))
    return tuple(out)


def bitmap(shingles: np.ndarray) -> bytes:
    """Token bitmap of two bits a token or more, a power of two wide; `folded` makes it narrower."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(shingles & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps at the width of the narrowest, as rows of 64-bit words."""
    width = min(map(len, maps))
    out = np.zeros((len(maps), width), np.uint8)
    for row, x in zip(out, maps, strict=True):
        np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0, out=row)
    return out.view(np.uint64)


def set_digest(shingles: np.ndarray) -> int:
    """64 bits of a set of hashes, whatever their order."""
    return int(mix(mix(shingles ^ _U(0x5BF03635)).sum(keepdims=True, dtype=np.uint64) + _U(len(shingles))).view(np.int64)[0])


def _dealt(spread: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(band, unmatched, parts, part of each shingle) for each band that a set's size lies in."""
    n = len(spread)
    for k, (low, high, unmatched, parts) in enumerate(bands(num, den, 1 << (n + 1).bit_length())):
        if low <= n <= high and parts > 1:  # with one part only equal sets link, and those are one class
            yield k, unmatched, parts, ((spread >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def signatures(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """One 64-bit name per part of the set that must be named, over all bands the size lies in; its last 3 bits tell those bands
    apart. `shingles` are sorted."""
    out = []
    spread = mix(shingles)
    for k, unmatched, parts, part in _dealt(spread, num, den):
        order = np.argsort(part, kind="stable")
        named, starts = np.unique(part[order], return_index=True)
        name = np.add.reduceat(spread[order], starts)
        if len(named) <= unmatched:  # too few to be sure that one of them is matched
            empty = np.setdiff1d(np.arange(parts), named)
            named, name = np.concatenate((named, empty)), np.concatenate((name, np.zeros(len(empty), np.uint64)))
        out.append(mix(name + _U(0x9E3779B97F4A7C15) * (named.astype(np.uint64) + _U(1)) + _U(k << 40)) & ~_U(7) | _U(k & 7))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def spares(shingles: np.ndarray, num: int, den: int) -> list[int]:
    """By the last 3 bits of a band: of the parts that the set names in it, how many at least are equal in any linked set."""
    out = [np.iinfo(np.int32).max] * 8
    for k, unmatched, parts, part in _dealt(mix(shingles), num, den):
        named = int(np.count_nonzero(np.bincount(part)))
        out[k & 7] = min(out[k & 7], (named if named > unmatched else parts) - unmatched)
    return out


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, hashes, bounds in words(texts, SPACES, lower=True):
        grams = rolling(hashes, k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            else:
                yield sequence(hashes[a:b]) if b > a else np.zeros(0, np.uint64)


def _sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, row, size of the set, its digest (`node`), and (of the first row a task meets with that digest) token bitmap and spares.
    `docs` has doc_id, text and row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()
        for batch in batches:
            sizes, nodes, maps, spare = [], [], [], []
            for x in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), k):
                sizes.append(len(x))
                nodes.append(set_digest(x))
                known = nodes[-1] in seen or not len(x)
                maps.append(None if known else bitmap(x))
                spare.append(None if known else spares(x, num, den))
                if len(seen) < SEEN:
                    seen.add(nodes[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary()), pa.array(spare, pa.list_(pa.int32()))], names=["doc_id", "row", "n_shingles", "node", "bitmap", "spares"])

    return docs.mapInArrow(run, "doc_id long, row long, n_shingles long, node long, bitmap binary, spares array<int>")


def _packed(nodes: np.ndarray, names: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Signatures by bucket: (bucket, 5 low bytes of each signature behind the nodes and how many each has)."""
    if not len(names):
        return
    bucket = ((names >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, nodes, names = bucket[order], nodes[order], names[order]
    edge = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = nodes[a:b]
        start = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        count = np.diff(np.append(start, b - a)).astype("<u4")
        low = names[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        yield int(bucket[a]), len(start).to_bytes(4, "little") + own[start].astype("<i8").tobytes() + count.tobytes() + low.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int.from_bytes(blob[:4], "little")
    nodes, count = np.frombuffer(blob, "<i8", m, 4), np.frombuffer(blob, "<u4", m, 4 + 8 * m)
    low = np.frombuffer(blob, np.uint8, -1, 4 + 12 * m).reshape(-1, 5)
    names = np.zeros((len(low), 8), np.uint8)
    names[:, :5] = low
    return np.repeat(nodes, count), names.view("<u8")[:, 0]


def _groups(docs: DataFrame, k: int, num: int, den: int, buckets: int) -> DataFrame:
    """(part, node, band, names, members): the classes that share a named part with another. Parts of a band with the same classes
    count once; `names` says how many they are, and `members` how many classes are in each."""

    @released
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for at in range(0, len(texts), 2000):
                nodes, names = [], []
                for shingles in shingle_sets(texts[at : at + 2000], k):
                    node = set_digest(shingles)
                    if len(shingles) and node not in seen:
                        if len(seen) < SEEN:
                            seen.add(node)
                        names.append(signatures(shingles, num, den))
                        nodes.append(np.full(len(names[-1]), node, np.int64))
                if names:
                    rows = list(_packed(np.concatenate(nodes), np.concatenate(names), buckets))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "parts"])

    def meet(table: pa.Table) -> pa.Table:
        pairs = [_unpacked(x) for x in table["parts"].to_pylist()]
        nodes, names = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((nodes, names))
        nodes, names = nodes[order], names[order]
        fresh = np.ones(len(nodes), bool)
        fresh[1:] = (names[1:] != names[:-1]) | (nodes[1:] != nodes[:-1])
        nodes, names = nodes[fresh], names[fresh]
        start = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        size = np.diff(np.append(start, len(nodes)))
        band = names[start] & _U(7)
        members = mix(np.add.reduceat(mix(nodes.view(np.uint64)), start) + size.astype(np.uint64) + (band << _U(56))).view(np.int64)
        several = np.flatnonzero(size > 1)
        part, where, count = np.unique(members[several], return_index=True, return_counts=True)
        start, size, band = start[several][where], size[several][where], band[several][where].astype(np.int32)
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        out = pa.table({"part": np.repeat(part, size), "node": nodes[at], "band": np.repeat(band, size), "names": np.repeat(count.astype(np.int64), size), "members": np.repeat(size, size)})
        del pairs, nodes, names, order, fresh, members
        give_back()
        return out

    met = docs.select("text").mapInArrow(name, "bucket int, parts binary").groupBy("bucket").applyInArrow(meet, "part long, node long, band int, names long, members long")
    return met.groupBy("part", "node").agg(F.max("band").alias("band"), F.sum("names").alias("names"), F.max("members").alias("members"))


def _thinned(groups: DataFrame, most: int) -> DataFrame:
    """Rows of `groups` (part, node, band, names, members, spares, ...) without those that leave frequent parts (of more than `most` members).
    A set leaves all of a band if they are fewer than its spares there: some part of it that is equal in a linked set is then not frequent."""
    often = F.sum(F.when(F.col("members") > most, F.col("names")).otherwise(0)).over(Window.partitionBy("node", "band"))
    stays = (F.col("members") <= most) | (F.element_at("spares", F.col("band") + 1) <= F.col("_often"))
    return groups.withColumn("_often", often).where(stays).drop("_often", "band", "names", "members", "spares")


def _candidates(groups: DataFrame, num: int, den: int, weight: int) -> DataFrame:
    """(u, v) that join all members of each group of `groups` (part, node, n_shingles, bitmap; written) whose bitmaps and sizes allow a link.

    A group up to `weight` is compared by itself. A larger one is cut by size, and by a hash of the node within a size, into chunks of at most
    about three times that; first each chunk is compared by itself, and one pivot of each chunk with the other pivots. In near copies that joins
    nearly all members. Then chunks meet pair by pair, unless their sizes forbid a link, but only for members that are outside of their group's
    largest component so far: each of these meets all members of the other chunks, and members inside it are joined already."""
    each = 1 + F.floor(F.col("n_shingles") / 16_384)
    whole = groups.withColumns({c: F.lit(0).cast("long") for c in ("mine", "other", "chunk")}).withColumn("label", F.col("node"))
    large = written(groups.groupBy("part").agg(F.sum(each).alias("all")).where(F.col("all") > weight).select("part"), "jaccard-large")
    if large.isEmpty():
        return _possible(whole, num, den)
    large = checked_broadcast(large, BROADCAST_ROWS)
    # one row for each part and size, however many members have it
    sizes = groups.join(large, "part", "left_semi").groupBy("part", "n_shingles").agg(F.sum(each).alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("part").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", "n_shingles", F.floor(before / weight).alias("first"), F.ceil(F.col("all") / weight).alias("pieces"))
    sizes = written(sizes, "jaccard-sizes")
    cut = groups.join(checked_broadcast(sizes, BROADCAST_ROWS), ["part", "n_shingles"])
    cut = written(cut.select(*groups.columns, (F.col("first") + F.pmod(F.xxhash64("node"), F.col("pieces"))).alias("chunk")), "jaccard-cut")
    own = cut.select("*", F.col("chunk").alias("mine"), F.col("chunk").alias("other"), F.col("node").alias("label"))
    pivots = cut.groupBy("part", "chunk").agg(F.min(F.struct("n_shingles", "node")).alias("p")).select("part", "p.node")
    pivots = cut.join(checked_broadcast(written(pivots, "jaccard-pivots"), BROADCAST_ROWS), ["part", "node"], "left_semi")
    pivots = pivots.withColumns({c: F.lit(-1).cast("long") for c in ("mine", "other", "chunk")}).withColumn("label", F.col("node"))
    first = whole.join(large, "part", "left_anti").unionByName(own.select(whole.columns)).unionByName(pivots.select(whole.columns))
    links = written(_possible(first, num, den), "jaccard-first")

    so_far = connected(links, "jaccard-joined")
    cut = written(cut.join(so_far, "node", "left").withColumn("label", F.coalesce("label", "node")), "jaccard-labelled")
    main = cut.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    cut = cut.join(checked_broadcast(written(main, "jaccard-main"), BROADCAST_ROWS), "part").withColumn("left", F.col("label") != F.col("main")).drop("main")
    spans = cut.groupBy("part", "chunk").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.max("left").alias("left"))
    spans = written(spans, "jaccard-spans")
    a = spans.select("part", F.col("chunk").alias("mine"), "high", F.col("left").alias("mine_left"))
    b = spans.select("part", F.col("chunk").alias("other"), "low", F.col("left").alias("other_left"))
    pairs = a.join(b, "part").where((F.col("mine") < F.col("other")) & (F.col("low") * num <= F.col("high") * den) & (F.col("mine_left") | F.col("other_left")))
    # a chunk sends all its members where the other has some left, and else only those left
    sends = F.explode(F.array(F.struct(F.col("mine").alias("chunk"), F.col("other_left").alias("all")), F.struct(F.col("other").alias("chunk"), F.col("mine_left").alias("all"))))
    pairs = checked_broadcast(written(pairs.select("part", "mine", "other", sends.alias("s")).select("part", "mine", "other", "s.*"), "jaccard-pairs"), BROADCAST_ROWS)
    across = cut.join(pairs, ["part", "chunk"]).where("left or all")
    return links.unionByName(_possible(across.select(whole.columns), num, den))


def _few(size: list[int], maps: list[bytes], labels: list[int], cut: int, num: int, den: int) -> list[tuple[int, int]]:
    """As `_many`, for few members: bitmaps are whole numbers."""
    width = min(map(len, maps))
    bits = []
    for x in maps:
        folds = 0
        for i in range(0, len(x), width):
            folds |= int.from_bytes(x[i : i + width], "little")
        bits.append(folds)
    surplus = [n - x.bit_count() for n, x in zip(size, bits, strict=True)]
    joined, links = Joined.by(labels), []
    for p in range(cut):
        for q in range(cut if cut < len(size) else p + 1, len(size)):
            x, y = size[p], size[q]
            if y * num > x * den or x * num > y * den or joined.find(p) == joined.find(q):
                continue
            if ((bits[p] & bits[q]).bit_count() + min(surplus[p], surplus[q])) * (num + den) >= num * (x + y):
                joined.join(p, q)
                links.append((p, q))
    return links


def _many(size: np.ndarray, bitmaps: list[bytes], labels: list[int], cut: int, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that join all members whose bitmaps and sizes allow a link: between the first `cut` members and the others, or of all
    with all where there are no others. Sizes rise in both. Members of one label are joined already."""
    maps = folded(bitmaps)
    surplus = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
    joined, links = Joined.by(labels), []
    tiles = [slice(i, min(i + TILE, end)) for start, end in ((0, cut), (cut, len(size))) for i in range(start, end, TILE)]
    second = -(-cut // TILE)
    across = second < len(tiles)
    union = [np.bitwise_or.reduce(maps[t], axis=0) for t in tiles]
    for i, a in enumerate(tiles[:second]):
        for j in range(second if across else i, len(tiles)):
            b = tiles[j]
            if size[b][0] * num > size[a][-1] * den:
                break  # sizes rise from tile to tile
            most = int(np.bitwise_count(union[i] & union[j]).sum()) + min(surplus[a].max(), surplus[b].max())
            roots = {joined.find(x) for t in (a, b) for x in range(t.start, t.stop)}
            if most * (num + den) < num * (size[a][0] + size[b][0]) or len(roots) == 1:
                continue
            common = np.zeros((a.stop - a.start, b.stop - b.start), np.int64)
            for w in range(0, maps.shape[1], 16):
                common += np.bitwise_count(maps[a][:, None, w : w + 16] & maps[b][None, :, w : w + 16]).sum(2, dtype=np.int64)
            x, y = size[a][:, None], size[b][None, :]
            able = (common + np.minimum(surplus[a][:, None], surplus[b][None, :])) * (num + den) >= num * (x + y)
            able &= (x * den >= y * num) & (y * den >= x * num)
            for p, q in np.argwhere(able).tolist():
                p, q = p + a.start, q + b.start
                if joined.find(p) != joined.find(q):
                    joined.join(p, q)
                    links.append((p, q))
    return links


def _possible(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) that join all members of a chunk, or all of one and of another, whose bitmaps and sizes allow a link. `rows`: part, mine, other (each of
    these is compared by itself), chunk, n_shingles, node, bitmap, label (members of one are joined already)."""
    keys, columns = ["part", "mine", "other"], ["chunk", "n_shingles", "node", "bitmap", "label"]

    def links(batches: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links inside each run of equal keys."""
        table = pa.Table.from_batches(batches)
        key = [table[c].to_numpy() for c in keys]
        edge = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in key])) + 1
        chunk, size, node = (table[c].to_numpy() for c in columns[:3])
        maps, label = table["bitmap"].to_pylist(), table["label"].to_pylist()
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(node)], strict=True):
            cut = int(np.searchsorted(chunk[a:b], chunk[a], "right"))
            if b - a <= 12:
                found = _few(size[a:b].tolist(), maps[a:b], label[a:b], cut, num, den)
            else:
                found = _many(size[a:b], maps[a:b], label[a:b], cut, num, den)
            if found:
                p, q = np.array(found).T
                yield node[a + p], node[a + q]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # all of one group, the last that has been met

        def out() -> Iterator[pa.RecordBatch]:
            ends = list(links(held))
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*ends, strict=True)], names=["u", "v"])

        for batch in batches:
            if not len(batch):
                continue
            key = [batch.column(i).to_numpy() for i in range(3)]
            # the batch's last group may go on; all before it are whole
            last = int(np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in key]))[-1]) + 1 if any((x != x[-1]).any() for x in key) else 0
            goes_on = bool(held) and all(held[-1].column(i)[-1].as_py() == key[i][-1] for i in range(3)) and not last
            if not goes_on:
                if last:
                    held.append(batch.slice(0, last))
                if held:
                    yield from out()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from out()

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK))
    dealt = rows.select(*keys, *columns).repartition(n, *keys).sortWithinPartitions(*keys, "chunk", "n_shingles", "node")
    return dealt.mapInArrow(run, "u long, v long")


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Components of a graph of (u, v) long pairs: node, label (its smallest node). Large-star and small-star rounds, each written
    to the shared folder, until nothing moves; a round's rows never outnumber the edges."""
    current = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # exchanged once more, so that AQE may split a node with very many edges
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).repartition("u")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u != v").distinct(), name)
        sums = [x.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first() for x in (current, after)]
        if tuple(sums[0]) == tuple(sums[1]):
            break
        current = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


class Joined:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    @classmethod
    def by(cls, labels: list[int]) -> Joined:
        """Positions of one label joined."""
        joined, first = cls(len(labels)), {}
        for i, x in enumerate(labels):
            joined.parent[i] = first.setdefault(x, i)
        return joined

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


class Tree:
    """Signature tree over sets of one chunk. Members are ordered by size, then by their smallest hashes, and grouped FANOUT at a time."""

    def __init__(self, sets: list[np.ndarray], positions: list[int], bits: int):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:2].tolist()))
        self.sets, self.positions = [sets[i] for i in order], [positions[i] for i in order]
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, x in zip(maps, self.sets, strict=True):
            flags = np.zeros(bits, bool)
            flags[(x & _U(bits - 1)).astype(np.int64)] = True
            row[:] = np.packbits(flags).view(np.uint64)
        size = np.array([len(x) for x in self.sets])
        surplus = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, size, size, surplus, np.arange(len(sets)), np.arange(1, len(sets) + 1))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, surplus, first, last = self.levels[-1]
            cut = np.arange(0, len(maps), FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(surplus, cut),
                first[cut], last[np.minimum(cut + FANOUT, len(maps)) - 1],
            ))


def traverse(a: Tree, b: Tree, joined: Joined, num: int, den: int) -> list[tuple[int, int]]:
    """Links found between members of two trees (or of one with itself), enough of them to join all that are linked."""
    links: list[tuple[int, int]] = []
    same = a is b

    def one_group(tree: Tree, level: int, node: int) -> int | None:
        *_, first, last = tree.levels[level]
        root = joined.find(tree.positions[first[node]])
        return root if all(joined.find(p) == root for p in tree.positions[first[node] + 1 : last[node]]) else None

    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, na, lb, nb = stack.pop()
        if la == 0 and lb == 0:
            p, q = a.positions[na], b.positions[nb]
            if (same and na == nb) or joined.find(p) == joined.find(q):
                continue
            x, y = a.sets[na], b.sets[nb]
            overlap = len(np.intersect1d(x, y, assume_unique=True))
            if den * overlap >= num * (len(x) + len(y) - overlap):
                joined.join(p, q)
                links.append((p, q))
            continue
        if (root := one_group(a, la, na)) is not None and root == one_group(b, lb, nb):
            continue
        # open the higher node, and keep its children that may still hold a link
        if la >= lb:
            level, kids = la - 1, np.arange(na * FANOUT, min((na + 1) * FANOUT, len(a.levels[la - 1][0])))
            mine, other, node = a.levels[level], b.levels[lb], nb
        else:
            level, kids = lb - 1, np.arange(nb * FANOUT, min((nb + 1) * FANOUT, len(b.levels[lb - 1][0])))
            mine, other, node = b.levels[level], a.levels[la], na
        maps, low, high, surplus, first, last = (x[kids] for x in mine)
        map2, low2, high2, surplus2, first2, last2 = (x[node] for x in other)
        common = np.bitwise_count(maps & map2).sum(1, dtype=np.int64)
        most = np.minimum(common + np.minimum(surplus, surplus2), np.minimum(high, high2))
        need = -(-num * (low + low2) // (num + den))
        keep = (most >= need) & (high2 * den >= low * num) & (high * den >= low2 * num)
        if same:  # each pair once: the node of `a` does not begin behind the node of `b`
            keep &= (first < last2) if la >= lb else (first2 < last)
        for k in kids[keep].tolist():
            stack.append((level, k, lb, nb) if la >= lb else (la, na, level, k))
    return links


def _bits(sets: list[np.ndarray]) -> int:
    """Bitmap width for sets of these sizes: 4 bits a token at least, up to 64 Ki."""
    return 1 << min(16, max(6, (4 * max(map(len, sets), default=1) - 1).bit_length()))


def _unpack(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in frame["shingles"]]


def _inside(num: int, den: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links inside one chunk."""
        frame = frame.drop_duplicates("node")
        sets, joined = _unpack(frame), Joined(len(frame))
        tree = Tree(sets, list(range(len(sets))), _bits(sets))
        traverse(tree, tree, joined, num, den)
        node = frame["node"].to_numpy()
        root = np.array([joined.find(i) for i in range(len(node))], np.int64)
        moved = root != np.arange(len(node))
        return pd.DataFrame({"u": node[moved], "v": node[root[moved]]})

    return run


def _between(num: int, den: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Links between two chunks of a block; `joined` carries what each chunk's own links have joined."""
        if not len(left) or not len(right):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        sets, n = [*_unpack(left), *_unpack(right)], len(left)
        node, root = (np.concatenate((left[c].to_numpy(), right[c].to_numpy())) for c in ("node", "root"))
        joined, first = Joined(len(node)), {}
        for i, r in enumerate(root.tolist()):
            joined.join(i, first.setdefault(r, i))
        bits = _bits(sets)
        links = traverse(Tree(sets[:n], list(range(n)), bits), Tree(sets[n:], list(range(n, len(node))), bits), joined, num, den)
        return pd.DataFrame({"u": np.array([node[p] for p, _ in links], np.int64), "v": np.array([node[q] for _, q in links], np.int64)})

    return run


def _shingles(docs: DataFrame, k: int) -> DataFrame:
    """node and shingles of `docs` (text, row); a row met again in a task is left out, and each node is there once."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts, rows = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            fresh_ = [t for t, r in zip(texts, rows, strict=True) if not (r in seen or seen.add(r))]
            for at in range(0, len(fresh_), 1000):
                sets = list(shingle_sets(fresh_[at : at + 1000], k))
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

    return docs.select("text", "row").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _row(docs: DataFrame) -> Column:
    """Tells rows of different doc_id or text apart."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def components(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN, **sizes: int) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    return members(docs, k, num, den, **sizes).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def members(docs: DataFrame, k: int, num: int, den: int, chunk_bytes: int = CHUNK_BYTES, group: int = GROUP, frequent: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, row (a hash of doc_id and text), n_shingles, and `first`, the doc_id and row of its component's smallest row (by
    doc_id, rows without one last, then by `row`); null where the row is the only one of its component, or its set is empty."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row(docs).alias("row"))
    sets = written(_sets(texts, k, num, den), "jaccard-sets")
    # about so many signatures a shingle over all bands, from the bands' own arithmetic
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total * 5 * (den - num) / (den + num) / BUCKET) + 1)
    # one bitmap for each class, joined to the groups the class is in
    maps = sets.where("bitmap is not null").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.max("bitmap").alias("bitmap"), F.max("spares").alias("spares"))
    groups = written(_thinned(_groups(texts, k, num, den, buckets).join(maps, "node"), frequent), "jaccard-groups")
    able = _candidates(groups, num, den, group)
    blocks = written(connected(able, "jaccard-candidates"), "jaccard-blocks")

    # the shingles of one row of each class in a block, hashed anew; rows alike in id and text have one `row`
    first = sets.where("n_shingles > 0").groupBy("node").agg(F.min("row").alias("row"), (8 * F.max("n_shingles")).alias("bytes"))
    wanted = written(first.join(blocks, "node"), "jaccard-wanted")
    found = _shingles(texts.join(checked_broadcast(wanted.select("row"), BROADCAST_ROWS), "row", "left_semi"), k)
    place = wanted.select("node", "label", "bytes")

    pair = "u long, v long"
    large = wanted.groupBy("label").agg(F.sum("bytes").alias("all")).where(F.col("all") > chunk_bytes)
    if large.isEmpty():
        # each member already points at its component's first member
        links = found.join(checked_broadcast(place, BROADCAST_ROWS), "node").groupBy("label").applyInPandas(_inside(num, den), pair)
        labels = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    else:
        so_far = Window.partitionBy("label").orderBy("bytes", "node").rowsBetween(Window.unboundedPreceding, -1)
        chunk = F.floor(F.coalesce(F.sum("bytes").over(so_far), F.lit(0)) / chunk_bytes).cast("int")
        found = written(found.join(place.withColumn("chunk", chunk), "node"), "jaccard-members")
        links = written(found.groupBy("label", "chunk").applyInPandas(_inside(num, den), pair), "jaccard-links")
        # one pivot of each chunk, of the chunk's largest component, meets the other pivots; what they don't join meets all other chunks
        rooted = found.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = place.withColumn("chunk", chunk).groupBy("label").agg(F.max("chunk").alias("chunks")).where("chunks > 0").drop("chunks")
        rooted = written(rooted.join(checked_broadcast(written(several, "jaccard-several"), BROADCAST_ROWS), "label").select("label", "chunk", "node", "root", "shingles"), "jaccard-chunks")
        pivots = rooted.groupBy("label", "chunk", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("label", "chunk").agg(F.max_by("root", F.struct("n", "root")).alias("node"))
        pivots = rooted.join(checked_broadcast(written(pivots.select("label", "node"), "jaccard-block-pivots"), BROADCAST_ROWS), ["label", "node"], "left_semi")
        links = written(links.unionByName(pivots.groupBy("label").applyInPandas(_inside(num, den), pair)), "jaccard-block-links")
        so_far = connected(links, "jaccard-block-joined").withColumnRenamed("label", "root")
        rooted = written(rooted.drop("root").join(so_far, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-rooted")
        main = rooted.groupBy("label", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        rooted = rooted.join(checked_broadcast(written(main, "jaccard-block-main"), BROADCAST_ROWS), "label").withColumn("left", F.col("root") != F.col("main")).drop("main")
        has_left = written(rooted.groupBy("label", "chunk").agg(F.max("left").alias("left")), "jaccard-block-left")
        a, b = (has_left.select("label", F.col("chunk").alias(c), F.col("left").alias(f"{c}_left")) for c in ("mine", "other"))
        pairs = a.join(b, "label").where((F.col("mine") < F.col("other")) & (F.col("mine_left") | F.col("other_left")))
        sides = []
        for c, o in (("mine", "other"), ("other", "mine")):
            sent = checked_broadcast(written(pairs.select("label", "mine", "other", F.col(c).alias("chunk"), F.col(f"{o}_left").alias("all")), "jaccard-block-pairs"), BROADCAST_ROWS)
            sent = rooted.join(sent, ["label", "chunk"]).where("left or all")
            # columns anew: both sides come from one table
            sides.append(sent.select(*(F.col(x).alias(x) for x in sent.columns)).groupBy("label", "mine", "other"))
        across = sides[0].cogroup(sides[1]).applyInPandas(_between(num, den), pair)
        labels = connected(links.unionByName(across), "jaccard-across")
    # the smallest row of each class, then of each component; rows take it from their class
    place_of = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = written(sets.where("n_shingles > 0").groupBy("node").agg(F.min(place_of).alias("first"), F.count(F.lit(1)).alias("n")), "jaccard-classes")
    labels = written(labels, "jaccard-labels")
    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()
    linked = written(labels.join(classes, "node").select("node", "label", "first"), "jaccard-linked")
    smallest = checked_broadcast(written(linked.groupBy("label").agg(F.min("first").alias("smallest")), "jaccard-smallest"), BROADCAST_ROWS)
    linked = written(linked.join(smallest, "label").select("node", "smallest"), "jaccard-places")
    own = classes.join(linked, "node", "left").where("n > 1 or smallest is not null").select("node", F.coalesce("smallest", "first").alias("first"), "n")
    own = written(own, "jaccard-own")
    rows = sets.select("doc_id", "row", "n_shingles", "node")
    # classes with very many rows are few, and their rows stay where they are
    many = max(1000, sets.count() // SHARES)
    hot, others = F.broadcast(own.where(F.col("n") > many).drop("n")), own.where(F.col("n") <= many).drop("n")
    some = rows.where("n_shingles > 0")
    placed = some.join(hot, "node").unionByName(some.join(hot, "node", "left_anti").join(others, "node", "left"))
    alone = rows.where("n_shingles = 0").withColumn("first", F.lit(None).cast(own.schema["first"].dataType))
    return placed.unionByName(alone).drop("node")


def representatives(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Rows of `docs`, all columns, one for each component: that of its smallest doc_id (rows without one come last; rows alike in both doc_id
    and text count as one). Rows with an empty set all stay."""
    found = written(members(docs, k, num, den).where("first is not null").select("row", F.col("first.row").alias("kept")), "jaccard-members-of")
    gone = checked_broadcast(written(found.where("row != kept").select("row").distinct(), "jaccard-gone"), 10 * BROADCAST_ROWS)
    key = fresh(docs, "row")
    left = docs.withColumn(key, _row(docs)).join(gone.withColumnRenamed("row", key), key, "left_anti")
    # rows that are repeated whole are rare; only they are grouped
    again = written(found.where("row = kept").groupBy("row").count().where("count > 1").select("row"), "jaccard-again")
    if again.isEmpty():
        return left.select(docs.columns)
    again = checked_broadcast(again, 10 * BROADCAST_ROWS).withColumnRenamed("row", key)
    one = left.join(again, key, "left_semi").dropDuplicates([key])
    return left.join(again, key, "left_anti").select(docs.columns).unionByName(one.select(docs.columns))
