"""Token-id output: one wavelet matrix per shard, in one compressed file, and its readers.

A wavelet matrix keeps a sequence of ids as bit-planes, most significant bit first; below each plane the ids
are parted stably, zeros before ones. With the number of ones before any place (rank, kept per 512 bits) and
its inverse (select, by binary search over the same counts), the file answers `access`, `count` and `locate`
without being unpacked whole: planes are stored as separately compressed blocks of 2**16 bits.

`write_shards` sorts by id, encodes with the tokenizers library and writes one Parquet table whose rows are the
files, so that it lands on whatever store Spark writes to; a task ends a file at `shard_tokens` ids, so memory
is bounded however many rows a task has. `read_shards` gives the documents back from the files alone.

Defined results: null and empty texts are documents that hold the end id only. Rows with equal doc_id stand in
order of their text (null first) and each has its own run; null doc_ids come first.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .wordhash import SPACES, words_at

MAGIC = b"WMX1"
BLOCK = 1 << 16
WORD = 512
SHARD_TOKENS = 1 << 21
REMEMBERED = 1_500_000

FILE_SCHEMA = "part int, seq int, first_doc long, n_docs long, n_tokens long, file binary"
DOC_SCHEMA = "part int, seq int, k int, doc_id long, local long, n_tokens long, ids_crc32 long"


def build(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard. docs: doc_id per document (as int64, the null mark is NULL_DOC); lengths: ids per document."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    pack = zstandard.ZstdCompressor(level=1).compress
    blobs, planes, zeros, x = [], [], [], ids
    for level in range(bits - 1, -1, -1):
        bit = (x & x.dtype.type(1 << level)) != 0
        packed = np.packbits(bit, bitorder="little")
        frames = [pack(packed[k : k + BLOCK // 8].tobytes()) for k in range(0, len(packed), BLOCK // 8)]
        ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (WORD // 8))).view(np.uint64)).reshape(-1, WORD // 64).sum(1, np.uint16)
        blobs.append(b"".join(frames))
        blobs.append(pack(ones.astype("<u2").tobytes()))
        planes.append([[len(f) for f in frames], len(blobs[-1])])
        up = np.concatenate((x[~bit], x[bit]))
        zeros.append(len(bit) - int(ones.sum(dtype=np.int64)))
        x = up
    tail = pack(np.diff(docs, prepend=0).astype("<i8").tobytes() + lengths.astype("<i8").tobytes())
    head = json.dumps({"n": len(ids), "bits": bits, "docs": len(docs), "zeros": zeros, "planes": planes, "tail": len(tail)}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + tail + b"".join(blobs)


class WaveletFile:
    """Reads a file made by `build`; blocks are unpacked when first touched."""

    def __init__(self, file: bytes):
        if file[:4] != MAGIC:
            raise ValueError("not a wavelet file")
        (size,) = struct.unpack_from("<I", file, 4)
        head = json.loads(file[8 : 8 + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self._file, self._unpack = file, zstandard.ZstdDecompressor().decompress
        at = 8 + size
        tail = self._unpack(file[at : at + head["tail"]])
        half = head["docs"] * 8
        self.docs, self.lengths = np.cumsum(np.frombuffer(tail[:half], "<i8")), np.frombuffer(tail[half:], "<i8")
        at += head["tail"]
        self._frames, self._ones = [], []
        for frames, ones in head["planes"]:
            ends = np.cumsum([0, *frames]) + at
            self._frames.append(ends)
            at = int(ends[-1])
            counts = np.frombuffer(self._unpack(file[at : at + ones]), "<u2").astype(np.int64)
            self._ones.append(np.concatenate(([0], np.cumsum(counts))))
            at += ones
        self._block = functools.lru_cache(64)(self._read_block)

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        ends = self._frames[plane]
        return np.unpackbits(np.frombuffer(self._unpack(self._file[ends[block] : ends[block + 1]]), np.uint8), bitorder="little")

    def _bit(self, plane: int, at: int) -> int:
        return int(self._block(plane, at // BLOCK)[at % BLOCK])

    def _rank(self, plane: int, at: int) -> int:
        """Ones before place `at`."""
        word = at // WORD
        before = int(self._ones[plane][word])
        if at % WORD:
            start = word * WORD
            block = self._block(plane, start // BLOCK)
            before += int(block[start % BLOCK : start % BLOCK + at % WORD].sum())
        return before

    def _select(self, plane: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) such bit."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._rank(plane, middle + 1)
            if (ones if bit else middle + 1 - ones) > nth:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for plane in range(self.bits):
            bit, ones = self._bit(plane, at), self._rank(plane, at)
            value = value << 1 | bit
            at = self.zeros[plane] + ones if bit else at - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._rank(plane, start), self._rank(plane, end)
            if value >> (self.bits - 1 - plane) & 1:
                start, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often an id stands in [start, end)."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def locate(self, value: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of an id."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= nth < b - a:
            raise IndexError(nth)
        at = a + nth
        for plane in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def all_ids(self) -> np.ndarray:
        """The whole sequence: planes are undone from the last to the first."""
        x = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        kind = x.dtype.type
        for plane in range(self.bits - 1, -1, -1):
            ends = self._frames[plane]
            packed = b"".join([self._unpack(self._file[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: self.n].view(bool)
            up = np.empty_like(x)
            up[~bit], up[bit] = x[: self.zeros[plane]], x[self.zeros[plane] :]
            up |= bit.astype(kind) << kind(self.bits - 1 - plane)
            x = up
        return x


# Inside a unit without white space, the library's own splitting always parts runs of letters from runs of signs.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PUNCT = "!-&(-/:-@\\[-`{-~"
_PARTS = re.compile(f"([{_LETTERS}]++(?=[{_PUNCT}]|\\Z)|[{_PUNCT}]++(?=[{_LETTERS}]|\\Z))|.+", re.DOTALL)

_PUNCT_BYTES = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
#: In an ASCII part without white space: what makes it more than one word to the library.
_MIXED = re.compile("[A-Za-z0-9']|<\\|")


class WordTokens:
    """Ids of texts from a tokenizers file whose normaliser and splitter never join across white space.

    The units between white space are told apart by 64-bit hashes, a chunk of texts at a time; each distinct one is
    encoded once and remembered.

    Every id comes from the library: runs of ASCII letters or signs are single words to it and go straight to its
    model; anything else passes its normaliser and splitter first.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.model, self.normal, self.pre = self.library.model, self.library.normalizer, self.library.pre_tokenizer
        self.parts: dict[str, bytes] = {}
        self._forget()
        self.wide = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.packer, self.width = ("H", 2) if self.wide == "<u2" else ("I", 4)

    @staticmethod
    def split(unit: bytes) -> list[str]:
        """Parts of a unit. ASCII is lower-cased, as the library does."""
        if unit.isalpha():
            return [unit.lower().decode()]
        head = unit.rstrip(_PUNCT_BYTES)
        if head.isalpha():
            return [head.lower().decode(), unit[len(head) :].decode()]
        text = unit.decode()
        if "<|" in text:
            return [text]
        return [x.lower() if (x := m[0]).isascii() else x for m in _PARTS.finditer(text)]

    def _encode_part(self, part: str) -> bytes:
        if part.isascii() and (part.isalpha() or not _MIXED.search(part)):
            ids = [t.id for t in self.model.tokenize(part)]
        elif "<|" in part:
            ids = self.library.encode(part, add_special_tokens=False).ids
        else:
            ids = [t.id for word, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(part)) for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}{self.packer}", *ids)

    def _ids(self, unit: bytes) -> bytes:
        own = []
        for p in self.split(unit):
            ids = self.parts.get(p)
            if ids is None:
                ids = self.parts[p] = self._encode_part(p)
            own.append(ids)
        return own[0] if len(own) == 1 else b"".join(own)

    def _forget(self) -> None:
        """Start anew: known hashes (sorted), and where and how long each one's ids are in the store."""
        self.known, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = bytearray()

    def _places(self, hashes: np.ndarray, first: np.ndarray, buf: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where these distinct units' ids (hashes sorted) stand in the store, and how many; new ones are encoded and put at its end."""
        if len(self.known) + len(hashes) > self.most:
            self._forget()
        if len(self.parts) > self.most // 2:
            self.parts.clear()
        slot = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = slot < len(self.known)
        new[inside] = self.known[slot[inside]] != hashes[inside]
        if new.any():
            words = first[new]
            ids = [self._ids(buf[a:b]) for a, b in zip(start[words].tolist(), end[words].tolist(), strict=True)]
            size = np.array([len(x) for x in ids], np.int64) // self.width
            at = len(self.store) // self.width + np.cumsum(size) - size
            self.store += b"".join(ids)
            self.known, self.at, self.size = (np.insert(x, slot[new], y) for x, y in ((self.known, hashes[new]), (self.at, at), (self.size, size)))
            slot = np.searchsorted(self.known, hashes)
        return self.at[slot], self.size[slot]

    def encode(self, texts: list[bytes | None], end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Chunks of texts: index of the first, the ids of all with `end_id` behind each, and the number of ids of each."""
        for first, hashes, bounds, buf, start, end in words_at(texts, SPACES, lower=False):
            unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            at, size = (x[back] for x in self._places(unique, where, buf, start, end))
            total = np.concatenate(([0], np.cumsum(size)))
            ids = np.frombuffer(self.store, self.wide)[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
            lengths = np.diff(total[bounds]) + 1
            out = np.full(len(ids) + len(lengths), end_id, self.wide)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths - 1)] = ids
            yield first, out, lengths


@functools.cache
def _tokens(path: str) -> WordTokens:
    """One for each worker process, kept from task to task."""
    return WordTokens(path)


NULL_DOC = -(1 << 63)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Write the wavelet files of all documents, in ascending doc_id order, as a table of FILE_SCHEMA at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer_path)
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        doc: list[int] = []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            file = build(flat, np.array(doc, np.int64), np.concatenate(sizes))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "first_doc": [doc[0]], "n_docs": [len(doc)], "n_tokens": [len(flat)], "file": [file]}, schema)

        for batch in batches:
            keys = [NULL_DOC if x is None else x for x in batch.column(0).to_pylist()]
            for first, flat, lengths in tokens.encode(batch.column(1).cast(pa.binary()).to_pylist(), end_id):
                ids.append(flat)
                sizes.append(lengths)
                doc += keys[first : first + len(lengths)]
                size += len(flat)
                if size >= shard_tokens:
                    yield flush()
                    ids, sizes, doc, seq, size = [], [], [], seq + 1, 0
        if ids:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows that share an id, or have none, are in order of their text's hash, so that they too spread over partitions
    by = ["doc_id", F.xxhash64(F.col("text").cast("string"))]
    rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    rows.sortWithinPartitions(*by).mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_shards(files: DataFrame) -> DataFrame:
    """Documents of a table of wavelet files: doc_id, start, n_tokens, ids_crc32, read from the files' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file = WaveletFile(batch.column(2)[k].as_py())
                ids = file.all_ids().astype("<u4")
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[k].as_py(), np.int32)), pa.array(np.full(n, batch.column(1)[k].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                        pa.array(file.docs, mask=file.docs == NULL_DOC), pa.array(starts), pa.array(file.lengths), pa.array(np.array(crc, np.int64)),
                    ],
                    names=["part", "seq", "k", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    # ids before each part, then before each file of a part: no task sees more than one row for each partition that wrote files
    def before(by: Window) -> Window:
        return by.rowsBetween(Window.unboundedPreceding, -1)

    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("all").over(before(Window.orderBy("part"))), F.lit(0)).alias("from"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    offsets = files.select("part", "seq", inside.alias("in_part")).join(parts, "part").select("part", "seq", (F.col("from") + F.col("in_part")).alias("offset"))
    read = files.select("part", "seq", "file").mapInArrow(run, DOC_SCHEMA)
    return read.join(offsets, ["part", "seq"]).select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
