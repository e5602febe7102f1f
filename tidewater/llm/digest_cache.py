"""Token counts by a digest cache: only texts that no stored count answers for are encoded, each distinct one once.

A count is stored under two digests: one of the tokenizer (its file, the library and its version) and one of the
normalised text. A run

1. reads the documents' digests (texts stay where they are), groups them and joins them to the stored counts;
2. fetches one text for each digest without a count, encodes it in Arrow batches and appends the counts;
3. joins the documents' digests to the cache as it now stands.

Digests of many documents (more than 1 in `HOT` and 1,000 rows, so fewer than `HOT`) are met by a broadcast and their
documents kept apart from the shuffled join, and their text is picked by a map-side combined aggregate. Texts travel only
where a count is missing. Appended files are committed as one Spark job: a run that dies leaves nothing half written, and
counts appended twice (two runs at once, a task split in two) are equal, so readers take any of them.

Normalised means: null is the empty text, and nothing else. The byte-level vocabularies tell every byte apart, and in the
others a special string is told by its case, so nothing more may be folded without changing a count.

Defined results: null and empty texts have 0 bytes and 0 tokens and are counted through the cache like others. Rows that
repeat, share an id or have none are each answered. An empty table appends nothing. Only the id and text columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HOT = 1000
#: So many digests without a count (32 bytes each) are broadcast; more meet their texts in a shuffled join.
FEW = 500_000
#: Units in a generation of a worker's memory.
REMEMBERED = 400_000
CACHE_SCHEMA = "content binary, n_bytes long, n_tokens long, tokenizer string"

# Characters with Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"


def _letters(first: int, last: int) -> str:
    return "".join(c for c in map(chr, range(first, last)) if unicodedata.category(c)[0] == "L")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(256 + i) for i, b in enumerate(others)}


_BYTES = _byte_letters()


class UnitCounter:
    """Counts of a byte-level BPE whose own splitter cuts at words: texts are cut where that splitter always cuts (behind a run of
    letters or digits, before white space that follows something else), and the library encodes each unit once while it is remembered."""

    def __init__(self, tokenizer, most: int = REMEMBERED):
        self.library, self.model, self.most = tokenizer, tokenizer.model, most
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        letter = f"[{_letters(0x41, 0x250)}\u0400-\u0481]"
        # signs, but for those an apostrophe or a special string could start with
        sign = r"[!-&(-/:;=?@\[-`{}~]"
        self.lone = re.compile(rf" ?(?:{letter}+|[0-9]+|{sign}+)")
        self.units = re.compile(rf" ?(?:{letter}++|[0-9]++)(?![\u0250-\U0010ffff\x80-\xbf])| ?{sign}++(?=[A-Za-z0-9 \n]|\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

    def learn(self, units: set[str]) -> None:
        new = units - self.known.keys()
        if len(self.known) + len(new) > self.most and self.known:
            self.older, self.known, new = self.known, {}, units
        fresh = []
        for x in new:
            if (n := self.older.get(x)) is None:
                fresh.append(x)
            else:
                self.known[x] = n
        mixed, model = [], self.model
        for x in fresh:
            if self.lone.fullmatch(x):  # a single word to the library's splitter: straight to its model
                told = _BYTES[32] + x[1:] if x[0] == " " else x
                self.known[x] = len(model.tokenize(told if x.isascii() else x.encode().decode("latin-1").translate(_BYTES)))
            else:
                mixed.append(x)
        for k in range(0, len(mixed), 5000):
            part = mixed[k : k + 5000]
            self.known.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.units.findall(t) for t in texts]
        self.learn(set().union(*cut))
        get = self.known.__getitem__
        return [sum(map(get, x)) for x in cut]


def _by_units(tokenizer) -> bool:
    """Is this the splitter that `UnitCounter` knows, with special strings that hold no white space and begin with '<'?"""
    import json

    spec = json.loads(tokenizer.to_str())
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    added = all(t["content"].startswith("<") and not re.search(f"[{SPACE}]", t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
    return spec["normalizer"] is None and plain.items() <= (spec["pre_tokenizer"] or {}).items() and spec["model"]["type"] == "BPE" and added


@functools.cache
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """What counts texts with the library of the file's kind; one for each worker process, kept from task to task."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if _by_units(tokenizer):
        return UnitCounter(tokenizer)
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def version(path: str) -> str:
    """Digest of a tokenizer: its file, the library that reads it and that library's version."""
    library = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__} {library.__version__}|no special tokens added".encode()).hexdigest()


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def stored(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """The counts of one tokenizer (content, n_tokens), each digest once; none where nothing has been stored yet."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    kept = spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return kept.where(F.col("tokenizer") == tokenizer).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(texts: DataFrame, path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """(content, text) to the cache's columns without the tokenizer; a text met twice in a task is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        seen: set[bytes] = set()
        for batch in batches:
            keys, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            fresh: dict[bytes, str] = {}
            size = 0
            for i, (key, text) in enumerate(zip(keys, words, strict=True)):
                if key not in seen:
                    seen.add(key)
                    fresh[key] = text or ""
                    size += len(fresh[key])
                if fresh and (size >= batch_chars or i + 1 == len(keys)):
                    n = count(list(fresh.values()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array([len(t.encode()) for t in fresh.values()], pa.int64()), pa.array(n, pa.int64())], names=["content", "n_bytes", "n_tokens"])
                    fresh, size = {}, 0

    return texts.mapInArrow(run, "content binary, n_bytes long, n_tokens long")


def refresh(docs: DataFrame, rows: DataFrame, path: str, cache: str) -> DataFrame:
    """Append what the cache lacks of `rows` (content), encoded from the texts of `docs`. Returns the digests of many rows."""
    tokenizer = version(path)
    wanted = rows.groupBy("content").agg(F.count(F.lit(1)).alias("n")).join(stored(docs, cache, tokenizer), "content", "left")
    wanted = common.written(wanted, "token-wanted")
    total, missing = wanted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n_tokens").isNull(), 1))).first()
    hot = common.written(wanted.where(F.col("n") > max(1000, total // HOT)).select("content", F.col("n_tokens").isNull().alias("lacks")), "token-hot")
    if missing:
        lacking = wanted.where("n_tokens is null")
        seldom = lacking.where(F.col("n") <= max(1000, total // HOT)).select("content")
        texts = docs.select(digest(F.col("text")).alias("content"), "text")
        found = texts.join(F.broadcast(hot.select("content")), "content", "left_anti")
        if missing <= FEW:  # texts that need no encoding stay where they are
            found = found.join(F.broadcast(seldom), "content", "left_semi").repartition("content")
        else:
            found = found.join(seldom.hint("merge"), "content", "left_semi")
        if hot.where("lacks").head(1):
            often = texts.join(F.broadcast(hot.where("lacks").select("content")), "content", "left_semi")
            found = found.unionAll(often.groupBy("content").agg(F.first("text").alias("text")))
        _encoded(found, path).withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").parquet(cache)
    return hot.select("content")


def count(docs: DataFrame, path: str, cache: str, limit: int = 512) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = common.written(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest(F.col("text")).alias("content")), "token-rows")
    hot = refresh(docs, rows, path, cache)
    counts = stored(docs, cache, version(path))
    often = common.written(counts.join(F.broadcast(hot), "content", "left_semi"), "token-often").withColumnRenamed("n_tokens", "often")
    met = rows.join(F.broadcast(often), "content", "left")
    n = F.coalesce("often", "n_tokens")
    # rows that have their count already are not shuffled
    both = met.where("often is not null").withColumn("n_tokens", F.lit(None).cast("long")).unionByName(met.where("often is null").join(counts, "content", "left"))
    return both.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
