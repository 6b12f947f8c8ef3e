"""Token counts with the library's own tokenizer, for texts of any length.

Short texts are cut at single spaces between two other characters.  Such a
space always starts a pre-token of the byte-level pattern (white space stands
in a pre-token at its start only, or makes up all of it), so pieces can be
counted one by one and remembered.  Added tokens hold no white space; they stay
whole inside a piece.

Texts above HUGE characters become overlapping chunks on different tasks.  Each
chunk is encoded with offsets.  From a place where both of two neighbours start
a pre-token, both cut the rest alike, as a match depends on what follows only;
that place is the proven boundary where they are spliced.  It must not be near
the end of the left chunk, where text that the match looks at is missing.  If
an overlap has no such place it is doubled, up to the whole text.

Defined results: a null or empty text has no tokens.  Repeated rows are counted
each.  The tokenizer's file must be at the same path on every machine.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, processors

from muster.llm.store import small_batches, stored, with_row_id

HUGE, CHUNK, OVERLAP, MARGIN = 65_536, 32_768, 512, 64
#: Chunks in one task.
CHUNKS = 4
#: Pieces in each of the two generations that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 64
# a task has one core; the library's own threads would cost memory and time
os.environ["TOKENIZERS_PARALLELISM"] = "false"
_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def _tokenizer(path: str, offsets: bool) -> Tokenizer:
    t = Tokenizer.from_file(path)
    if "ByteLevel" not in repr(t.pre_tokenizer):
        raise ValueError(f"{path} has no byte-level pre-tokenizer, for which the places of cuts are proven")
    t.no_truncation()
    t.no_padding()
    if offsets:  # else a pre-token's offset leaves out its leading space
        t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


class _Pieces:
    """Numbers of tokens of pieces, the lately used ones remembered."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path, False)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, pieces: list[str]) -> int:
        young, old = self.young, self.old
        fresh = []
        for p in {p for p in pieces if p not in young}:
            if (n := old.get(p)) is not None:
                young[p] = n
            else:
                fresh.append(p)
        for k in range(0, len(fresh), 1024):
            part = fresh[k : k + 1024]
            for p, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                young[p] = len(e)
        total = sum(map(young.__getitem__, pieces))
        if len(young) > REMEMBERED:
            self.old, self.young = {p: n for p, n in young.items() if len(p) <= LONGEST}, {}
        return total


@lru_cache(maxsize=4)
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def plain_counts(text: Column, path: str) -> Column:
    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(path)
        for col in batches:
            yield pa.array([pieces.count(_CUT.split(t)) if (t := x.as_py()) else 0 for x in col], pa.int64())

    return count(text)


def boundaries(text: str, path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Character where each pre-token starts, tokens before it, and all tokens."""
    e = _tokenizer(path, True).encode(text, add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    starts = np.array([a for a, _ in e.offsets], np.int64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    return starts[first], first, len(words)


def chunk_edges(text: Column, at: Column, overlap: Column, path: str) -> Column:
    """For a chunk at character ``at``: boundaries, in characters of the whole
    text, in its first ``overlap`` characters and in those that it shares with
    the next chunk, with the tokens before each; and all its tokens."""

    @F.arrow_udf("head array<bigint>, head_n array<bigint>, tail array<bigint>, tail_n array<bigint>, total bigint")
    def edges(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ats, overlaps in batches:
            cols: list[list] = [[] for _ in range(5)]
            for t, a, w in zip(texts.to_pylist(), ats.to_pylist(), overlaps.to_pylist()):
                places, before, total = boundaries(t, path)
                head = places < w
                tail = (places >= CHUNK) & (places < len(t) - MARGIN)
                for c, v in zip(cols, (places[head] + a, before[head], places[tail] + a, before[tail], total)):
                    c.append(v)
            yield pa.StructArray.from_arrays([*[pa.array(c, pa.list_(pa.int64())) for c in cols[:4]], pa.array(cols[4], pa.int64())],
                                             ["head", "head_n", "tail", "tail_n", "total"])

    return edges(text, at, overlap)


def huge_counts(docs: DataFrame, path: str) -> DataFrame:
    """row, n_tokens for ``docs`` (row, text; stored), all of them long."""
    overlap, parts = OVERLAP, []
    todo = docs
    while True:
        n = F.length("text")
        tasks = 1 + todo.agg(F.coalesce(F.sum(F.ceil(n / CHUNK)), F.lit(0))).first()[0] // CHUNKS
        chunks = todo.select("row", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).alias("k"))
        at = F.col("k") * CHUNK
        piece = F.substring("text", at + 1, F.lit(CHUNK + overlap))
        edges = stored(
            chunks.select("row", "k", at.cast("long").alias("at"), piece.alias("piece")).repartition(tasks, F.col("row"), F.col("k"))
            .select("row", "k", chunk_edges(F.col("piece"), F.col("at"), F.lit(overlap).cast("long"), path).alias("e")),
            "edges",
        )
        nxt = edges.select("row", (F.col("k") - 1).alias("k"), F.col("e.head").alias("head"), F.col("e.head_n").alias("head_n"))
        both = edges.select("row", "k", "e.tail", "e.tail_n", "e.total").join(nxt, ["row", "k"], "left")
        place = F.try_element_at(F.array_intersect("tail", "head"), F.lit(1))
        spot = lambda places, before: F.try_element_at(before, F.array_position(places, place).cast("int"))
        both = both.withColumn("last", F.col("head").isNull()).withColumn("found", F.col("last") | place.isNotNull())
        # what this chunk counts up to the splice, less what the next one counts before it
        share = F.when(F.col("last"), F.col("total")).when(F.col("found"), spot(F.col("tail"), F.col("tail_n")) - spot(F.col("head"), F.col("head_n")))
        sums = stored(both.groupBy("row").agg(F.sum(share).alias("n_tokens"), F.bool_and("found").alias("ok")), "sums")
        parts.append(sums.where("ok").select("row", "n_tokens"))
        bad = sums.where("NOT ok").select("row")
        if bad.isEmpty():
            break
        todo = stored(todo.join(bad, "row", "left_semi"), "again")
        longest = todo.agg(F.max(F.length("text"))).first()[0]
        if overlap >= longest:  # every chunk reaches the text's end: the first one counts it all
            parts.append(todo.select("row", plain_counts(F.col("text"), path).alias("n_tokens")))
            break
        overlap *= 8
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for ``docs`` (a stored table)."""
    small_batches(docs.sparkSession)
    rows = with_row_id(docs.select("doc_id", "text"), "row")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    huge = F.length("text") > HUGE
    short = rows.where(~F.coalesce(huge, F.lit(False))).select("doc_id", n_bytes.alias("n_bytes"), plain_counts(F.col("text"), path).alias("n_tokens"))
    long = stored(rows.where(huge), "long")
    counted = long.select("row", "doc_id", n_bytes.alias("n_bytes")).join(huge_counts(long.select("row", "text"), path), "row")
    both = short.unionByName(counted.select("doc_id", "n_bytes", "n_tokens"))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)
