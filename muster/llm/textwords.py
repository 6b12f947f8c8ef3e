"""Words, word hashes and n-gram hashes of many texts at once, with numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``.  Everything works on UTF-8 bytes:
the six white-space characters are ASCII, so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# workers hold large batches briefly; this pool gives their memory back at once
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are worked on at once.
STEP = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_COEFF = [U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_tables: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, STEP + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > STEP + 1:
            return out[0], out[1]
        _tables[:] = out
    return _tables[0], _tables[1]


def word_spans(buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word reaches over a document's start."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    black = ~IS_WHITE[buf]
    inner = doc_starts[(doc_starts > 0) & (doc_starts < n)]
    before = np.zeros(n, bool)
    before[1:] = black[:-1]
    before[inner] = False
    after = np.zeros(n, bool)
    after[:-1] = black[1:]
    after[inner - 1] = False
    return np.flatnonzero(black & ~before), np.flatnonzero(black & ~after) + 1


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U(1)) * power[: len(buf)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hashed_docs(col: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row in the array, hashes of its words in order) for every row; see ``split_docs``."""
    for i, h, _, _ in split_docs(col, lower):
        yield i, h


def split_docs(col: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row in the array, hashes, first bytes and end bytes of its words) for every row.

    ``col`` is a binary array; null counts as empty.  Long texts are taken in
    pieces that end at white space, so memory beside the result stays bounded.
    """
    texts = [x.as_buffer() if x.is_valid else None for x in col] if len(col) else []
    group, size = [], 0
    for i, b in enumerate(texts):
        n = b.size if b is not None else 0
        if n > STEP:
            yield from _group(group, lower)
            group, size = [], 0
            yield i, *_long(np.frombuffer(b, np.uint8), lower)
            continue
        group.append((i, b))
        size += n
        if size >= STEP // 2:
            yield from _group(group, lower)
            group, size = [], 0
    yield from _group(group, lower)


def _group(group: list, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    if not group:
        return
    sizes = np.array([b.size if b is not None else 0 for _, b in group])
    at = np.concatenate([[0], np.cumsum(sizes)])
    buf = np.concatenate([np.frombuffer(b, np.uint8) if b is not None and b.size else np.zeros(0, np.uint8) for _, b in group])
    if lower:
        buf = LOWER[buf]
    starts, ends = word_spans(buf, at[:-1])
    h = _hashes(buf, starts, ends)
    cut = np.searchsorted(starts, at)
    for k, (i, _) in enumerate(group):
        own = slice(cut[k], cut[k + 1])
        yield i, h[own], starts[own] - at[k], ends[own] - at[k]


def _long(buf: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, lo = [], 0
    none = np.zeros(0, np.int64)
    while lo < len(buf):
        hi = min(len(buf), lo + STEP)
        while hi < len(buf) and not IS_WHITE[buf[hi]]:
            more = np.flatnonzero(IS_WHITE[buf[hi : hi + STEP]])
            hi = hi + int(more[0]) if len(more) else min(len(buf), hi + STEP)
        piece = LOWER[buf[lo:hi]] if lower else buf[lo:hi]
        starts, ends = word_spans(piece, none)
        parts.append((_hashes(piece, starts, ends), starts + lo, ends + lo))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; coefficients repeat beyond five with a twist."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total = total * U(_BASE) + words[j : j + m] * _COEFF[j % 5]
    return mix(total)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words count as one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return ngrams(words, len(words)) ^ U(len(words))
    return np.unique(ngrams(words, n))
