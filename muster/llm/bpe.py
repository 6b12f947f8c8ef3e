"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern.  A minimal perfect
hash over the vocabulary (as many slots as entries, one probe) answers for
pre-tokens that are entries themselves; others are merged by a heap of
neighbouring pairs over linked byte parts, lowest rank first and leftmost among
equals, in O(n log n).  Answers are remembered in a bounded table.

Defined results: a null or empty text has no ids.  Special tokens are never
made.  Texts of any length are worked on in pieces of bounded memory, except
that one pre-token is taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.store import small_batches

#: Pre-tokens in each of the two generations whose ids a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 150_000, 64
#: Characters of a text up to which its pre-tokens are listed at once.
LISTED = 1 << 20
_MASK = (1 << 64) - 1


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Hash and displace: each bucket of keys has the displacement that sends its
    keys to free slots; a bucket of one key names its slot outright."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.m = max(1, n // 4)
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.m].append(i)
        self.shift = [0] * self.m
        at: list[int | None] = [None] * n
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        free = iter(())
        for b in order:
            own = buckets[b]
            if len(own) == 1:
                if not isinstance(free, list):
                    free = [s for s in range(n) if at[s] is None]
                s = free.pop()
                at[s], self.shift[b] = own[0], -s - 1
            elif own:
                d = 0
                while len(places := {_slot(hashes[i], d, n) for i in own}) < len(own) or any(at[p] is not None for p in places):
                    d += 1
                for i in own:
                    at[_slot(hashes[i], d, n)] = i
                self.shift[b] = d
        self.order = at  # slot -> index of the key

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.m]
        return -d - 1 if d < 0 else _slot(h, d, self.n)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slots = [(keys[i], ranks[keys[i]]) for i in self.hash.order]
        self.bytes_of = {r: b for b, r in ranks.items()}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def whole(self, token: bytes) -> int | None:
        key, rank = self.slots[self.hash.slot(token)]
        return rank if key == token else None

    def merged(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is no entry."""
        ranks, n = self.ranks, len(token)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 if i starts none
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(token[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i:
                p = before[i]
                if (r := ranks.get(token[p:stop])) is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i : end[i]]])
            i = end[i]
        return out

    def ids(self, token: str) -> list[int]:
        b = token.encode()
        r = self.whole(b)
        return [r] if r is not None else self.merged(b)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class Memory(dict):
    """pre-token -> ids as little-endian unsigned 32-bit integers, the lately used ones."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.old: dict[str, bytes] = {}

    def __missing__(self, token: str) -> bytes:
        out = self.old.get(token)
        if out is None:
            ids = self.vocabulary.ids(token)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[token] = out
        return out


@lru_cache(maxsize=4)
def _memory(path: str) -> Memory:
    return Memory(Vocabulary.load(path))


def pre_tokens(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    if len(text) <= LISTED:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(itertools.islice(found, LISTED // 8)):
        yield part


def encoder(path: str, pattern: str) -> Callable[[str], Iterator[bytes]]:
    compiled, memory = regex.compile(pattern), _memory(path)
    return lambda text: (b"".join(map(memory.__getitem__, part)) for part in pre_tokens(compiled, text))


def encoded(text: Column, path: str, pattern: str) -> Column:
    """array<int> of ids."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = encoder(path, pattern)
        for col in batches:
            rows = [b"".join(run(t.as_py() or "")) for t in col]
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The bytes that an array of ids stands for; null gives null."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = _memory(path).vocabulary
        for col in batches:
            yield pa.array([None if x is None else v.decode(np.array(x, np.int64)) for x in col.to_pylist()], pa.binary())

    return decode(ids)


def digests(text: Column, path: str, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): encodes, then decodes the ids."""

    @F.arrow_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = encoder(path, pattern)
        v = _memory(path).vocabulary
        for col in batches:
            n, a, b = [], [], []
            for t in col:
                ids, back, k = hashlib.sha256(), hashlib.sha256(), 0
                for part in run(t.as_py() or ""):
                    ids.update(part)
                    back.update(v.decode(np.frombuffer(part, "<u4")))
                    k += len(part) // 4
                n.append(k)
                a.append(ids.hexdigest())
                b.append(back.hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", digests(F.col("text"), path, pattern).alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``input_ids`` and ``n_tokens``; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    out = docs.withColumn("input_ids", encoded(F.col("text"), path, pattern))
    return out.withColumn("n_tokens", F.size("input_ids").cast("long"))
