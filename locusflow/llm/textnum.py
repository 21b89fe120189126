"""Vectorised word hashing over Arrow string buffers.

A *word* is a maximal run of ASCII letters, digits and non-ASCII characters; ASCII letters are
lower-cased. Hashes are 64 bits, the same in every process. Nothing here loops over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_NGRAM = np.random.default_rng(7).integers(1, 1 << 63, 512, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: The same words in SQL (DuckDB).
SQL_WORDS = (
    "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
)

_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        p = np.full(size, _BASE if which == "up" else _INVERSE, np.uint64)
        p[0] = 1
        have = _powers[which] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place)."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets between them; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that cross no text boundary."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) for each span, independent of where it lies."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[values] * _power("up", n), dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", n + 1)[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the n + 1 word offsets of the texts."""
    starts, ends = runs(IS_WORD[data], offsets)
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def ngrams(word: np.ndarray, bounds: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every text, and their n + 1 offsets.

    With ``short``, a text of fewer than n words (but one at least) has one gram, all its words.
    """
    count = np.diff(bounds)
    if not len(word):
        return word, np.zeros(len(bounds), np.int64)
    padded = np.concatenate([word, np.zeros(n - 1, np.uint64)])
    gram = np.zeros(len(word), np.uint64)
    for j in range(n):
        gram += padded[j : j + len(word)] * _NGRAM[j]
    owner_end = np.repeat(bounds[1:], count)
    keep = np.arange(len(word)) + n <= owner_end
    if short:
        few = np.flatnonzero((count > 0) & (count < n))
        at = bounds[few]
        for i, a in zip(few.tolist(), at.tolist()):
            part = word[a : a + count[i]]
            gram[a] = (part * _NGRAM[: len(part)]).sum(dtype=np.uint64) + U(len(part))
        keep[at] = True
    ends = np.concatenate([[0], np.cumsum(keep)])
    return mix(gram[keep]), ends[bounds]


def char_index(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of characters before each byte position of ``at`` (positions within ``data``)."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
