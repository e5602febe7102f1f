"""64-bit hashes of all words of many texts at once (numpy over UTF-8 bytes; the same on every machine)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of `[^\x20\x09-\x0D]+`: every byte but these.
SPACES = b" \t\n\x0b\x0c\r"
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z and everything outside ASCII.
SIGNS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit value over the whole value."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, for positions below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 4096)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers


def _hashes(buf: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every run of word bytes."""
    b = np.frombuffer(buf, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word[b], [False]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    up, down = _power_tables(len(b) + 1)
    total = np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), total))
    return mix((total[end] - total[start]) * down[start]), start, end


def words(texts: list[bytes | None], separators: bytes, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of texts: index of the first text, its words' hashes, and where each text's words begin (one more entry than texts)."""
    for first, hashes, bounds, _, _, _ in words_at(texts, separators, lower):
        yield first, hashes, bounds


def words_at(texts: list[bytes | None], separators: bytes, lower: bool) -> Iterator[tuple]:
    """As `words`, with the chunk's bytes and each word's first and end byte in them."""
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    k = 0
    while k < len(texts):
        n, size = k, 0
        while n < len(texts) and (n == k or size + len(texts[n] or b"") < _CHUNK):
            size += len(texts[n] or b"") + 1
            n += 1
        parts = [x or b"" for x in texts[k:n]]
        buf = b"\n".join(parts)
        buf = buf.translate(LOWER) if lower else buf
        hashes, start, end = _hashes(buf, is_word)
        begins = np.cumsum([0, *(len(x) + 1 for x in parts)])
        yield k, hashes, np.searchsorted(start, begins), buf, start, end
        k = n


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (shorter by k - 1)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _U(0xD6E8FEB86659FD93) + hashes[j : j + n]
    return mix(total + _U(k))


def sequence(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole short sequence, as `rolling` with its own length gives it."""
    return rolling(hashes, len(hashes))


def of_words(text: str, separators: bytes, lower: bool = True) -> np.ndarray:
    """The words' hashes of one text."""
    return next(words([text.encode()], separators, lower))[1]
