"""Near-duplicate documents by b-bit MinHash.

1.  A document's set of shingles gets BANDS * ROWS minima, each the least value
    of the set under another hash function.  Minima of ROWS functions make the key
    of a band; documents with a key in common are candidates.  Of each minimum only
    the lowest BITS bits are kept, packed into one signature.
2.  Two minima agree with the probability J, the similarity of the sets, and
    bits of different minima agree by chance with 2 ** -BITS.  So the share of equal
    fields, counted by bits over packed words, is J + (1 - J) 2 ** -BITS, from which
    J is estimated.  Candidates whose estimate is more than SLACK below the
    threshold are given up.
3.  The others are confirmed on their full sets, and documents reachable by
    confirmed links form a component.

Equal sets are one point.  The points of a band key form a cell.  Each cell's least
point is compared with all others first, which connects most groups of near
copies; then all pairs of small cells that are not connected yet, and two more
points of large ones; of what is still open in large cells, points outside the
largest component are compared with all others, block against block, where
signatures tell which points need their texts.

A link of the similarity 0.8 is missed with the probability (1 - 0.8 ** ROWS) **
BANDS = 7e-10, or where the estimate is SLACK too low (3e-11); links of higher
similarity less often.  Nothing is capped: the last step is quadratic in points
of one cell that stay apart, with a few numbers and 40 bytes read for each.

Defined results: null or empty texts and texts of white space have an empty set,
n_shingles 0, and are linked with nothing; their component is their own doc_id.
A text of fewer words than a shingle has one shingle, the whole.  Repeated rows
are equal points.  A component is named by its smallest doc_id that is not
null.  Columns besides doc_id and text are never looked at.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm import jaccard
from muster.llm.store import if_small, small_batches, stored, with_row_id
from muster.llm.textwords import hashed_docs, mix, shingle_set

BANDS, ROWS, BITS, SLACK = 40, 4, 2, 0.3
#: Shingles that are hashed at once.
STEP = 1 << 14
_SIZE = BANDS * ROWS
_U = np.uint64
_I64 = pa.int64()
_STEPS = np.arange(1, 2 * _SIZE + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)
_FACTORS, _TERMS = mix(_STEPS[:_SIZE]) | _U(1), mix(_STEPS[_SIZE:])
_FIELDS = _U(0x5555555555555555)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least value of each set, none of them empty, under each function: (sets, functions)."""
    out = np.full((len(sets), _SIZE), np.iinfo(np.uint64).max, np.uint64)
    lo = 0
    while lo < len(sets):
        hi, size = lo + 1, len(sets[lo])
        while hi < len(sets) and size + len(sets[hi]) <= STEP:
            size += len(sets[hi])
            hi += 1
        every = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *map(len, sets[lo : hi - 1])])
        for at in range(0, size, STEP) if hi == lo + 1 else (0,):  # one long set piece by piece
            part = every[at : at + STEP]
            for k in range(_SIZE):
                least = np.minimum.reduceat(part * _FACTORS[k] + _TERMS[k], starts)
                np.minimum(out[lo:hi, k], least, out=out[lo:hi, k])
        lo = hi
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of all minima, mixed, packed into words: (sets, words)."""
    fields = (mix(least) & _U((1 << BITS) - 1)).reshape(len(least), _SIZE * BITS // 64, 64 // BITS)
    return (fields << (np.arange(64 // BITS, dtype=np.uint64) * _U(BITS))).sum(2, dtype=np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band: (sets, bands)."""
    rows = least.reshape(len(least), BANDS, ROWS)
    total = np.broadcast_to(_TERMS[:BANDS], rows.shape[:2]).copy()
    for r in range(ROWS):
        total = mix(total + rows[:, :, r])
    return total


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of the similarity from packed signatures, along the last axis."""
    apart = a ^ b
    equal = np.bitwise_count(~(apart | (apart >> _U(1))) & _FIELDS).sum(-1, dtype=np.int64)
    chance = 2.0**-BITS
    return (equal / _SIZE - chance) / (1 - chance)


def _words(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint64).reshape(len(signs), -1)


def _estimate(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def estimate(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array(estimated(_words(x.to_pylist()), _words(y.to_pylist())) if len(x) else [], pa.float64())

    return estimate(a, b)


def may_link(signs: list[bytes], sizes: np.ndarray, labels: np.ndarray, blocks: np.ndarray, percent: int) -> np.ndarray:
    """Which points may have a partner of another component, of two blocks one of the other block, by their signatures."""
    words, across = _words(signs), bool((blocks != blocks[0]).any())
    out = np.zeros(len(signs), bool)
    for i in range(1, len(signs)):
        may = (labels[:i] != labels[i]) & ((blocks[:i] != blocks[i]) | (not across))
        may &= 100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])
        near = np.flatnonzero(may)
        near = near[estimated(words[near], words[i]) >= percent / 100 - SLACK]
        if len(near):
            out[i] = out[near] = True
    return out


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """row, doc_id, n, key, signature, bands of every document; the last two null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, np.ndarray]] = []
            size = 0
            for i, words in hashed_docs(batch.column("text"), lower=True):
                s = shingle_set(words, n)
                held.append((i, s))
                size += len(s)
                if size > 16 * STEP:
                    yield made(batch, held)
                    held, size = [], 0
            yield made(batch, held)

    def made(batch: pa.RecordBatch, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        at = pa.array([i for i, _ in held], pa.int32())
        sizes, some = np.array([len(s) for _, s in held], np.int64), [s for _, s in held if len(s)]
        least = minima(some)
        signs, bands = signatures(least), band_keys(least)
        place = np.cumsum(sizes > 0) - 1
        keys = np.array([jaccard.set_key(s) for _, s in held], np.int64)
        pick = lambda rows: [rows[p] if k else None for p, k in zip(place, sizes)]
        columns = [pa.array(sizes), pa.array(keys), pa.array([None if x is None else x.tobytes() for x in pick(signs)], pa.binary()), pa.array(pick(bands.view(np.int64)), pa.list_(_I64))]
        return pa.RecordBatch.from_arrays([*batch.select(["row", "doc_id"]).take(at).columns, *columns], ["row", "doc_id", "n", "key", "signature", "bands"])

    return docs.mapInArrow(run, "row long, doc_id long, n long, key long, signature binary, bands array<long>")


def _promising(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (key, pivot) whose estimate does not rule them out."""
    one = signs.select("key", F.col("n").alias("n0"), F.col("signature").alias("s0"))
    other = signs.select(F.col("key").alias("pivot"), F.col("n").alias("n1"), F.col("signature").alias("s1"))
    both = pairs.distinct().join(one, "key").join(other, "pivot")
    both = both.where(100 * F.least("n0", "n1") >= percent * F.greatest("n0", "n1"))
    return both.where(_estimate(F.col("s0"), F.col("s1")) >= percent / 100 - SLACK).select("key", "pivot")


def _open_blocks(live: DataFrame) -> DataFrame:
    """Blocks of cells in which most points are connected: those of the largest component
    against the others, and these among themselves."""
    sizes = live.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    home = sizes.groupBy("cell").agg(F.max_by("label", F.struct("n", "label")).alias("home"), F.max("n").alias("cores"), F.sum("n").alias("size"))
    home = stored(home.select("cell", "home", "cores", (F.col("size") - F.col("cores")).alias("borders")), "home")
    rows = stored(live.select("cell", "key", "label").join(if_small(home), "cell").withColumn("side", (F.col("label") != F.col("home")).cast("int")), "sides")
    others = rows.where("side = 1 AND borders > 1").select(F.xxhash64("cell", F.lit(1)).alias("cell"), "key", "label", F.col("borders").alias("size"))
    return jaccard.region_blocks(rows).unionByName(jaccard.cell_blocks(others))


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, leaf: int = 16, pivots: int = 2) -> DataFrame:
    """row, doc_id, n_shingles, component_id, point of every row of ``docs`` (a stored table).

    ``row`` is the row id that ``with_row_id`` gives ``docs``; rows of a component
    have the same ``point``.
    """
    if percent < 80:
        raise ValueError("bands are laid out for similarities of 0.8 and more")
    small_batches(docs.sparkSession)
    texts_of = with_row_id(docs.select("doc_id", "text"), "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    profile = stored(_profile(texts_of, n), "profile")
    rows = profile.select("row", "doc_id", "n", "key")
    postings = profile.select(F.explode("bands").alias("cell"), "key").distinct()
    cells = postings.groupBy("cell").agg(F.min("key").alias("pivot"), F.max("key").alias("hi")).where("pivot < hi").select("cell", "pivot")
    members = stored(postings.join(cells, "cell").select("cell", "key", "pivot"), "members")
    points = stored(members.select("key").distinct(), "points")
    mine = if_small(points)
    signs = stored(profile.join(mine, "key", "left_semi").groupBy("key").agg(F.max("n").alias("n"), F.max("signature").alias("signature")), "signs")
    chosen = rows.where("n > 0").join(mine, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    texts = stored(jaccard.with_texts(stored(chosen, "chosen"), texts_of.select("row", "text"), "row").select("key", "text"), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        found = jaccard.measured(_promising(pairs, signs, percent), texts, n)
        return found.where(jaccard.is_close(percent)).select(F.col("key").alias("a"), F.col("pivot").alias("b"))

    labels = jaccard.relabelled(None, linked(members.where("key != pivot").select("key", "pivot")))
    live = jaccard.live_cells(members.select("cell", "key", F.lit(0).alias("parent")), labels)
    if not live.isEmpty():
        large = live.where(F.col("size") > leaf)
        elected = stored(jaccard.elect(large, pivots, 1), "elected")
        heads = elected.join(large.select("cell", F.col("key").alias("pivot"), F.col("label").alias("other")), ["cell", "pivot"])
        trial = large.join(heads, "cell").where("label != other").select("key", "pivot")
        labels = jaccard.relabelled(labels, linked(jaccard.open_pairs(live.where(F.col("size") <= leaf)).unionByName(trial)))
        open_ = jaccard.live_cells(large.select("cell", "key", "parent"), labels)
        if not open_.isEmpty():
            labels = jaccard.relabelled(labels, jaccard.block_links(_open_blocks(open_), signs, texts, n, percent, may_link))
    return jaccard.component_rows(rows, labels)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest doc_id stays."""
    return jaccard.one_of_each(docs, n, percent, near_components)
