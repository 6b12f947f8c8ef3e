"""Periodic runs of words by a harmonic grid of longest common extensions.

A run is a stretch of words whose smallest period q (words q apart are equal)
fits into it twice, that is ``least`` words long or longer, and that no
neighbouring word extends keeping the period.  For each period p the places jp
and (j + 1)p are compared: the longest common extension to the right comes from
the suffix array of the words, its LCP array and range minima over it, the one
to the left from the arrays of the reversed words.  A run of period p holds two
neighbouring places of p's grid, so every run is found; a stretch that multiples
of its period find as well counts with the smallest.

The arrays are made for many short documents at once, parted by words that
stand nowhere else.  A document in which no ``least / 2`` words stand twice has
no run, as the words of a run but its last period stand one period further on
too; such documents need no arrays.  A document is worked on whole: some 300
bytes of memory for each word of the longest.

Words are compared by 64-bit hashes, case included.

Defined results: null, empty and short texts have no runs.  Each row is taken
by itself, so repeated rows and null ids change nothing; other columns are
kept, and columns named ``runs`` or ``collapsed`` are replaced.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.llm.store import free_name, small_batches
from muster.llm.textwords import ngrams, split_docs

#: Words of documents whose arrays are made at once, and places of the grid that are looked at at once.
GROUP_WORDS, PLACES = 1 << 16, 1 << 18
_NONE = np.zeros((0, 3), np.int64)


def suffix_ranks(s: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ..: the ranks of all suffixes by their first 2 ** k items, until all differ.

    The last item of ``s`` must stand nowhere else.  Equal suffixes have the rank of
    the first of them, so only those that still have equals are sorted again.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    fresh = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    levels, k = [rank.astype(np.int32)], 1
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    while len(active):
        key = rank[active] * (n + 1) + rank[active + k] + 1
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.concatenate([[True], old[1:] != old[:-1]])
        i = np.arange(len(active))
        new = old + i[fresh][np.cumsum(fresh) - 1] - i[first][np.cumsum(first) - 1]
        rank[active] = new
        levels.append(rank.astype(np.int32))
        last = np.concatenate([fresh[1:], [True]])
        active = np.sort(active[~(fresh & last)])
        k *= 2
    return levels


class Extensions:
    """Longest common extensions to the right of any two places of ``s``, whose last item stands nowhere else."""

    def __init__(self, s: np.ndarray):
        levels = suffix_ranks(s)
        self.rank = rank = levels[-1]
        places = np.empty(len(s), np.int64)
        places[rank] = np.arange(len(s))
        i, j = places[:-1].copy(), places[1:].copy()
        lcp = np.zeros(len(i), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][i] == levels[k][j]
            step = same.astype(np.int64) << k
            lcp += step.astype(np.int32)
            i += step
            j += step
        self.minima = [lcp]  # minima[k][i]: the least of lcp[i : i + 2 ** k]
        while (half := 1 << (len(self.minima) - 1)) * 2 <= len(lcp):
            m = self.minima[-1]
            self.minima.append(np.minimum(m[:-half], m[half:]))

    def between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of places ``i`` and ``j``, which must differ."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1  # the power of two within hi - lo
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            m = self.minima[level]
            out[own] = np.minimum(m[lo[own]], m[hi[own] - (1 << int(level))])
        return out


def grid(s: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) where ``s[lo:hi]`` has equal items at neighbouring places of a period's grid."""
    n = hi - lo
    longest, p = n // 2, 1
    while p <= longest:
        # as many periods as give PLACES places, or one
        q = min(longest, max(p, int(p * np.exp(min(30.0, PLACES / (2 * n))))))
        periods = np.arange(p, q + 1)
        counts = (n - 1) // periods
        period = np.repeat(periods, counts)
        j = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = lo + j * period
        equal = s[at] == s[at + period]
        yield at[equal], period[equal]
        p = q + 1


def _settled(documents: list[np.ndarray], least: int) -> list[np.ndarray]:
    """The runs of each document, as rows of start, length, period."""
    total = sum(map(len, documents)) + len(documents) + 1
    s, at, spans = np.empty(total, np.int64), 1, []
    _, ids = np.unique(np.concatenate(documents), return_inverse=True)
    s[0], taken = -1, 0
    for k, d in enumerate(documents):
        s[at : at + len(d)] = ids[taken : taken + len(d)]
        spans.append((at, at + len(d)))
        taken += len(d)
        at += len(d) + 1
        s[at - 1] = -k - 2
    right, left = Extensions(s), Extensions(s[::-1])
    out = []
    for lo, hi in spans:
        found = [_NONE]
        for x, p in grid(s, lo, hi):
            if not len(x):
                continue
            f = right.between(x, x + p)
            b = left.between(total - x, total - x - p)
            long = (f + b >= p) & (f + b + p >= least)
            found.append(np.stack([x - b - lo, p + f + b, p], 1)[long])
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        rows = rows[first]
        out.append(rows[np.lexsort((rows[:, 2], rows[:, 0]))])
    return out


def may_repeat(words: np.ndarray, least: int) -> bool:
    """Whether some ``least / 2`` words stand twice, as they do in every run."""
    if len(words) < least:
        return False
    grams = np.sort(ngrams(words, max(1, (least + 1) // 2)))
    return bool((grams[1:] == grams[:-1]).any())


def runs_of(documents: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """Rows of start, length, period, by start and period, for each document given as an array of words' hashes."""
    out, group, size = [_NONE] * len(documents), [], 0
    for k, d in enumerate([*documents, None]):
        if group and (d is None or size + len(d) > GROUP_WORDS):
            for i, rows in zip(group, _settled([documents[i] for i in group], least)):
                out[i] = rows
            group, size = [], 0
        if d is not None and may_repeat(d, least):
            group.append(k)
            size += len(d)
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


_NEW = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(col: pa.Array, least: int) -> list[pa.Array]:
    """The runs of each text, and the words that stay, joined by a space."""
    documents = [h for _, h, _, _ in split_docs(col, lower=False)]
    runs, rest = runs_of(documents, least), []
    for x, d, r in zip(col, documents, runs):
        words = x.as_py().split() if x.is_valid else []  # bytes: the six white-space characters
        if len(r):
            words = [words[i] for i in np.flatnonzero(kept_words(len(d), r)).tolist()]
        rest.append(b" ".join(words))
    ends = np.cumsum([0, *map(len, runs)], dtype=np.int32)
    rows = np.concatenate([_NONE, *runs])
    structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], fields=list(_RUN))
    return [pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(rest, pa.binary()).cast(pa.string())]


def with_runs(docs: DataFrame, least: int = 12, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns or those named in ``keep``) with ``runs`` (array of start, length,
    period) and ``collapsed``, the words that stay, joined by a space."""
    small_batches(docs.sparkSession)
    new = ("runs", "collapsed")
    own = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    text = free_name(docs, "__text")
    given = docs.select(*[F.col(f"`{c}`") for c in own], F.col("text").cast("binary").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_found(batch.columns[-1], least)], [*own, *new])

    types = T.StructType([*given.schema.fields[:-1], *T.StructType.fromDDL(_NEW).fields])
    return given.mapInArrow(run, types)


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of equals the one with the smallest start, then period; null without runs."""
    keyed = F.transform(runs, lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(keyed)


def planted(text: Column, doc_id: Column) -> Column:
    """Texts of which every tenth, by a checksum of the id, ends in a repetition; the others as they are.

    h is the CRC-32 of the decimal id, g = h / 10.  Where h ends in 0, word i from
    a = g % n on becomes word a + (i - a) % p with p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n = lambda w: F.size(w)
    a = lambda w: (g % n(w)).cast("int")
    p = lambda w: (1 + F.floor((n(w) - a(w)) / (3 + g % 8))).cast("int")

    def tail(w: Column) -> Column:
        both = F.transform(F.array(F.struct(a(w).alias("a"), p(w).alias("p"))), lambda z: F.transform(w, lambda x, i: F.when(i < z["a"], x).otherwise(F.get(w, z["a"] + (i - z["a"]) % z["p"]))))
        return F.array_join(both[0], " ")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    # one element arrays name what is computed once
    repeated = F.transform(F.array(words), lambda w: F.when(n(w) > 0, tail(w)).otherwise(F.lit("")))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), repeated).otherwise(text)
