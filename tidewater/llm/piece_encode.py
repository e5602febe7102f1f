"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

A text is cut where no merge can reach (before each run of word marks, and between characters that no chain of
pieces connects: letters and signs, or digits among themselves), and each segment is encoded by a score-ordered agenda of
adjacent symbol pairs: the best-scored pair merges first, ties go left. Short segments are merged many at a time, one
agenda step of every segment per numpy round; long ones use a heap. A worker remembers the segments it met last (two
generations of bounded size), and each newly encoded segment is held against the sentencepiece library, batch by batch;
where they differ the library's ids stand and the case is counted.

Defined results: null and empty texts have no ids and decode to ''. Repeated rows are encoded each by itself.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
SHORT = 24
NONE = np.iinfo(np.int64).max
#: Segments in a generation of a worker's memory.
REMEMBERED = 450_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceCodec:
    """Encoder and decoder of one model file; holds the pair table of the agenda."""

    def __init__(self, model_path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.differed = 0
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with identity normalisation and a dummy prefix is needed")
        self.text = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.byte_id = [0] * 256
        normal = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
            elif p.type == 1:
                normal[p.piece] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        self.ids, self.score = normal, [p.score for p in model.pieces]
        longer = [p for p in normal if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            raise ValueError("pieces that hold a word mark behind other characters are not supported")
        self._cutting(longer)
        self._pair_table()

    def _cutting(self, longer: list[str]) -> None:
        """The expression that finds segments. Characters side by side in some piece are of one group; no merge joins two groups."""
        group: dict[str, str] = {}

        def root(c: str) -> str:
            while group.setdefault(c, c) != c:
                c = group[c]
            return c

        for piece in longer:
            for a, b in itertools.pairwise(piece.lstrip(MARK)):
                group[root(a)] = root(b)
        members: dict[str, list[str]] = {}
        for c in sorted(group):
            members.setdefault(root(c), []).append(re.escape(c))
        runs = [f"[{''.join(m)}]+" for m in sorted(members.values(), key=len, reverse=True)]
        alone = f"[^{MARK}{''.join(map(re.escape, sorted(group)))}]"
        self.segments = re.compile(f"{MARK}*(?:{'|'.join([*runs, alone])})|{MARK}+", re.DOTALL)
        self.apart = next((c for c in "\n\t\x01\x02" if c not in group), None)
        if self.apart is None:
            raise ValueError("a control character that no longer piece holds is needed")

    def _pair_table(self) -> None:
        """All (left piece, right piece) pairs whose join is a piece, as sorted 64-bit keys; priority is the rank of its score."""
        by_score = sorted(self.ids.items(), key=lambda x: -self.score[x[1]])
        rank = {i: r for r, (_, i) in enumerate(by_score)}
        keys, merged, ranks = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
                    ranks.append(rank[i])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.best = (np.array(ranks, np.int64) << 32 | np.array(merged, np.int64))[order]
        self.pairs = {k: (r, m) for k, m, r in zip(keys, merged, ranks, strict=True)}

    def _symbols(self, segment: str) -> list[int]:
        return [self.ids.get(c, -1) for c in segment]

    def _ids(self, segment: str, pieces: list[int], lengths: list[int] | None = None) -> list[int]:
        """Piece ids with characters outside the vocabulary (-1) spelled as bytes."""
        if min(pieces) >= 0:
            return pieces
        out, at = [], 0
        for p in pieces:
            if p >= 0:
                out.append(p)
                at += len(self.text[p])
            else:
                out += [self.byte_id[b] for b in segment[at].encode()]
                at += 1
        return out

    def agenda(self, segment: str) -> list[int]:
        """One segment by a heap of adjacent pairs (linked symbols; stale entries are skipped)."""
        symbol = self._symbols(segment)
        n = len(symbol)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int, j: int) -> None:
            if symbol[i] >= 0 and symbol[j] >= 0 and (hit := self.pairs.get(symbol[i] << 32 | symbol[j])):
                heapq.heappush(heap, (hit[0], i, j, symbol[i], symbol[j], hit[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        alive = [True] * n
        while heap:
            _, i, j, left, right, into = heapq.heappop(heap)
            if not (alive[i] and alive[j] and after[i] == j and symbol[i] == left and symbol[j] == right):
                continue
            symbol[i], alive[j], after[i] = into, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return self._ids(segment, [s for s, a in zip(symbol, alive, strict=True) if a])

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | piece for pairs that merge, NONE for others."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.best[at], NONE)

    def agendas(self, segments: list[str]) -> list[list[int]]:
        """Segments of like length, all together: each round does the best merge of every segment."""
        out: list = [None] * len(segments)
        width = max(map(len, segments)) + 1
        get, fill = self.ids.get, [-2] * width
        s = np.array([([get(c, -1) for c in x] + fill)[:width] for x in segments], np.int64)
        rows = np.arange(len(segments))
        pair = self._look(s[:, :-1], s[:, 1:])
        columns = np.arange(width)
        while True:
            at = pair.argmin(1)
            here = np.arange(len(rows))
            best = pair[here, at]
            go = best != NONE
            if not go.all():
                for k, x in zip(rows[~go].tolist(), s[~go].tolist(), strict=True):
                    out[k] = x[: x.index(-2)]
                if not go.any():
                    break
                rows, s, pair, at, best = rows[go], s[go], pair[go], at[go], best[go]
                here = np.arange(len(rows))
            s[here, at] = best & 0xFFFFFFFF
            tail = columns[:-1] > at[:, None]
            s[:, :-1] = np.where(tail, s[:, 1:], s[:, :-1])
            pair[:, :-1] = np.where(tail[:, :-1], pair[:, 1:], pair[:, :-1])
            s[:, -1], pair[:, -1] = -2, NONE
            left = np.maximum(at - 1, 0)
            pair[here, left] = self._look(s[here, left], s[here, left + 1])
            pair[here, at] = self._look(s[here, at], s[here, at + 1])
        return [self._ids(x, p) for x, p in zip(segments, out, strict=True)]

    def cut(self, text: str) -> list[str]:
        return self.segments.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        short = sorted({x for x in segments if len(x) <= SHORT}, key=len)
        found = {}
        for k in range(0, len(short), 1500):
            found |= zip(short[k : k + 1500], self.agendas(short[k : k + 1500]), strict=True)
        return [found[x] if len(x) <= SHORT else self.agenda(x) for x in segments]

    def encode(self, text: str) -> list[int]:
        segments = self.cut(text)
        return [i for ids in (self.checked(segments, self.encode_segments(segments)) if segments else []) for i in ids]

    def decode_marked(self, ids: list[int]) -> str:
        """Text of ids that begin and end between characters, the first word mark included."""
        parts: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(raw.decode(errors="replace"))
                raw.clear()
            parts.append(self.text[i].replace(MARK, " "))
        if raw:
            parts.append(raw.decode(errors="replace"))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        return self.decode_marked(ids).removeprefix(" ")

    def checked(self, segments: list[str], ids: list[list[int]]) -> list[list[int]]:
        """`ids`, with the library's own where it encodes a segment otherwise (`differed` counts these). A segment without a leading mark is shown to it
        behind a character that joins nothing."""
        shown = [x[1:] if x[0] == MARK else self.apart + x for x in segments]
        skip = len(self.library.encode(self.apart))
        theirs = self.library.encode([x or " " for x in shown], num_threads=1)
        out = []
        for x, y, a, b in zip(segments, shown, ids, theirs, strict=True):
            own = a if not y else b if x[0] == MARK else b[skip:]
            self.differed += a != own
            out.append(own)
        return out


class Remembered:
    """Encodes batches of texts; keeps the ids, as decimal text, of up to twice `most` segments, the longest unseen going first, and
    those of them whose decoded text differs from their own."""

    def __init__(self, codec: PieceCodec, most: int = REMEMBERED):
        self.codec, self.most = codec, most
        self.ids: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.changed: dict[str, str] = {}

    def learn(self, segments: set[str]) -> None:
        """Afterwards `ids` has all `segments`."""
        new = segments - self.ids.keys()
        if len(self.ids) + len(new) > self.most and self.ids:
            self.older, self.ids = self.ids, {}
            self.changed = {x: y for x, y in self.changed.items() if x in self.older}
            new = segments
        older = self.older
        fresh = []
        for x in new:
            if (known := older.get(x)) is None:
                fresh.append(x)
            else:
                self.ids[x] = known
        text = self.codec.text
        for k in range(0, len(fresh), 20_000):
            part = fresh[k : k + 20_000]
            ids = self.codec.checked(part, self.codec.encode_segments(part))
            for x, y in zip(part, ids, strict=True):
                self.ids[x] = ",".join(map(str, y))
                if "".join([text[i] for i in y]) != x and (back := self.codec.decode_marked(y)) != x.replace(MARK, " "):
                    self.changed[x] = back

    def digest(self, segments: list[str]) -> tuple[int, str, str]:
        """`segments` have been learned. Segments decode each by itself, so those that keep their text need no second look."""
        known, changed = self.ids, self.changed
        ids = ",".join([known[x] for x in segments])
        if changed and not changed.keys().isdisjoint(segments):
            segments = [changed.get(x, x) for x in segments]
        decoded = "".join(segments).replace(MARK, " ")[1:]
        n = ids.count(",") + 1 if ids else 0
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _groups(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@functools.cache
def _memory(model_path: str) -> Remembered:
    """One for each worker process, kept from task to task."""
    return Remembered(PieceCodec(model_path))


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, the number of ids, and the SHA-256 of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(model_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows: list[tuple[int, str, str]] = []
            for a, b in _groups(texts):
                cut = [memory.codec.cut(t) for t in texts[a:b]]
                memory.learn(set().union(*cut))
                rows += [memory.digest(x) for x in cut]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def encode_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, its ids as an array, and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _groups(texts):
                ids = [codec.encode(t) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
