"""Exact similarity join of documents' shingle sets in the Jaccard metric space.

The distance 1 - J of two sets is a metric.  Documents whose distance is at
most eps = 1 - threshold are linked, and documents reachable by links form a
component.

1.  Documents with equal sets become one point.
2.  Points that share no shingle are all at distance 1 from one another, where
    no pivot can tell them apart.  So the space is first cut into cells by
    shingle: a point belongs to the cells of its n - ceil(t n) + 1 first
    shingles in one global order, rare ones first.  Two linked points always
    share a cell.  (The order comes from counts of all shingles in a table that
    grows with the documents up to a bound; whatever its counts, any order is
    exact.  In a table that stays small, the many rare shingles of an entry hide a
    common one, and cells grow faster than the input.)  Cells are cut again
    by the size of the sets, into classes so wide that linked sets are in one or
    in neighbouring classes; a point is in its own and the next.
3.  Each cell elects a pivot, a plain minimum that needs no cell gathered, and
    exact distances to the pivot are computed, once for a point and pivot
    however many cells they share, unless the points' signatures (counts of
    shingles by class) prove that it is far.  Points within eps are linked to it.
4.  By the triangle inequality, partners of a point within eps of a pivot are
    within 2 eps of it.  So the pivot's region is made of the points within eps,
    its core, which are connected already, and of the boundary points beyond
    eps but within 2 eps, which are copied to it.  Only boundary points that are
    not connected with the core yet are compared with it.
5.  All points of a cell that are not in its pivot's core are joined again
    without it: cells of at most ``leaf`` points become pairs, larger ones elect
    more pivots.  There a point is in the core of its nearest pivot only, its
    Voronoi region, if that is within eps, and in the boundary of all other
    pivots within 2 eps; and so on with what is left.  Cells whose points are
    all connected end the recursion.
6.  What pivots do not divide, regions and cells that they do not halve, is
    joined block against block: signatures first tell which points may have a
    partner in the other block, then only those are compared.  Pairs that are
    connected already are left out, and pivots of the block bound the others.

Sets hold 64-bit hashes of shingles and points are known by 64-bit hashes of
their sets.  Documents travel as text, which is smaller than its set.

Defined results: null or empty texts and texts of white space have an empty
set, n_shingles 0, and are linked with nothing; their component is their own
doc_id.  A text of fewer words than a shingle has one shingle, the whole.
Repeated rows are equal points.  A component is named by its smallest doc_id
that is not null.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.graph import components
from muster.llm.store import as_table, free_name, if_small, small_batches, stored, with_row_id, with_rows
from muster.llm.textwords import hashed_docs, shingle_set

#: Entries of the table of shingle counts: four a document at least, but 2 ** 16 to 2 ** 22.
TABLE_BITS = (16, 22)
#: Entries whose counts travel in one row.
PART = 1 << 12
#: Points that are compared with one pivot in one task.
GROUP = 200
#: Points of a block of what is joined block against block.
BLOCK = 500
_I64 = pa.int64()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), _I64)


def set_key(s: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)


def table_bits(documents: int) -> int:
    """Bits of a shingle's hash that name its entry in the table of counts."""
    return min(max(TABLE_BITS[0], (4 * documents - 1).bit_length()), TABLE_BITS[1])


def _entry(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _profile(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """row, doc_id, n, key of every document, and rows with part and counts: a task's counts
    of PART entries, 65535 at most, all low bytes before all high ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            sizes, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, words in hashed_docs(batch.column("text"), lower=True):
                s = shingle_set(words, n)
                sizes[i], keys[i] = len(s), set_key(s)
                np.add.at(counts, _entry(s, bits), np.uint32(1))
            none = pa.nulls(batch.num_rows, _I64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(sizes), pa.array(keys), none, pa.nulls(batch.num_rows, pa.binary())], names)
        parts = counts.reshape(-1, PART)
        for at in np.array_split(np.flatnonzero(parts.any(1)), max(1, len(parts) // 64)):
            if len(at):
                planes = np.minimum(parts[at], 65535).astype("<u2").view(np.uint8).reshape(len(at), PART, 2).transpose(0, 2, 1)
                none = pa.nulls(len(at), _I64)
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at, _I64), pa.array([x.tobytes() for x in planes], pa.binary())], names)

    names = ["row", "doc_id", "n", "key", "part", "counts"]
    return docs.mapInArrow(run, "row long, doc_id long, n long, key long, part long, counts binary")


def _counts(profile: DataFrame, bits: int) -> np.ndarray:
    """The table of counts, 2 ** bits entries; tasks' counts are added up part by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                low, high = np.frombuffer(counts, np.uint8).reshape(2, PART).astype(np.uint32)
                sums[part] = np.minimum(sums.get(part, 0) + low + (high << 8), np.uint32(1 << 31))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), _I64), pa.array([x.astype("<u4").tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    table = np.zeros(((1 << bits) // PART, PART), np.uint32)
    told = profile.where("part IS NOT NULL").select("part", "counts").repartition("part")
    for part, counts in told.mapInArrow(run, "part long, counts binary").collect():  # 4 bytes an entry, 16 MB at most
        table[part] = np.frombuffer(counts, "<u4")
    return table.ravel()


def _postings(docs: DataFrame, n: int, percent: int, counts: np.ndarray) -> DataFrame:
    """shingle, key, n for the first shingles of every point, and its key, n and signature; equal points once a task."""
    table, bits = docs.sparkSession.sparkContext.broadcast(counts), len(counts).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = table.value, set()
        for batch in batches:
            parts, keys, sizes, lengths, signs = [], [], [], [], []
            for _, words in hashed_docs(batch.column("text"), lower=True):
                s = shingle_set(words, n)
                if not len(s) or (k := int(set_key(s))) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(k)
                first = len(s) + 1 - -(-percent * len(s) // 100)
                parts.append(s[np.lexsort((s, rank[_entry(s, bits)]))[:first]])
                keys.append(k)
                sizes.append(len(s))
                lengths.append(first)
                signs.append(signature(s))
            if parts:
                total = int(sum(lengths))
                columns = [_signed(np.concatenate(parts)), *(pa.array(np.repeat(np.array(x, np.int64), lengths)) for x in (keys, sizes)), pa.nulls(total, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                columns = [pa.nulls(len(keys), _I64), pa.array(keys, _I64), pa.array(sizes, _I64), pa.array(signs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["shingle", "key", "n", "signature"]
    return docs.select("text").mapInArrow(run, "shingle long, key long, n long, signature binary")


def signature(s: np.ndarray) -> bytes:
    """How many shingles fall into each of K classes by hash, in half a byte each; K is a power of two, n / 2 < K <= n, 8 at least."""
    bits = max(3, len(s).bit_length() - 1)
    c = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (c[::2] | (c[1::2] << 4)).tobytes()


def distance_bound(a: bytes, b: bytes, n: int, m: int) -> float:
    """A lower bound of the distance of two sets of n and m shingles: every class
    where the counts differ has shingles that only one of them has."""
    x, y = (np.frombuffer(z, np.uint8) for z in (a, b))
    x, y = (np.stack([z & 15, z >> 4], 1).ravel().astype(np.int64) for z in (x, y))
    if x.max() == 15 or y.max() == 15:  # counts end there
        return 0.0
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[::2] + x[1::2]
        else:
            y = y[::2] + y[1::2]
    apart = int(np.abs(x - y).sum())
    return 1 - (n + m - apart) / (n + m + apart)


def _bound(a: Column, b: Column, n: Column, m: Column) -> Column:
    @F.arrow_udf("double")
    def bound(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cols in batches:
            yield pa.array([distance_bound(*row) for row in zip(*(c.to_pylist() for c in cols))], pa.float64())

    return bound(a, b, n, m)


def _within(assign: DataFrame, signs: DataFrame, reach: float) -> DataFrame:
    """The pairs of ``assign`` whose distance may be ``reach`` or less."""
    if reach >= 1:
        return assign.distinct()
    both = assign.distinct().join(signs.select("key", F.col("n").alias("n0"), F.col("signature").alias("s0")), "key")
    both = both.join(signs.select(F.col("key").alias("pivot"), F.col("n").alias("n1"), F.col("signature").alias("s1")), "pivot")
    ratio = F.least("n0", "n1") / F.greatest("n0", "n1")
    both = both.where(ratio >= 1 - reach - 1e-9)
    return both.where(_bound(F.col("s0"), F.col("s1"), F.col("n0"), F.col("n1")) <= reach + 1e-9).select("key", "pivot")


def _members(postings: DataFrame, percent: int) -> DataFrame:
    """cell, key, pivot of all cells of two points or more; the pivot is the least point."""

    def shared(rows: DataFrame, by: str) -> DataFrame:
        cells = rows.groupBy(by).agg(F.min("key").alias("pivot"), F.max("key").alias("hi"))
        return cells.where("pivot < hi").select(by, "pivot")

    rows = stored(postings.join(shared(postings, "shingle").drop("pivot"), "shingle"), "shared")
    width = math.log(100 / percent) + 1e-9 if percent < 100 else 1e-9
    size = F.floor(F.log("n") / width)
    rows = rows.select("key", F.explode(F.array(F.xxhash64("shingle", size), F.xxhash64("shingle", size + 1))).alias("cell")).distinct()
    return stored(rows.join(shared(rows, "cell"), "cell").select("cell", "key", "pivot"), "members")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0


def with_texts(rows: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    return texts.join(if_small(rows), by)


def measured(assign: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """key, pivot, common, union, distance for the pairs of ``assign`` (key, pivot)."""
    assign = stored(assign.distinct(), "assign")
    salts = assign.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    points = assign.join(salts, "pivot").select("pivot", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"), "key", F.lit(1).alias("role"))
    heads = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("key"), F.lit(0).alias("role"))
    rows = with_texts(stored(points.unionByName(heads), "heads"), texts, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, at = np.zeros(0, np.uint64), None
        for batch in batches:
            pivots, salts, roles = (batch.column(c).to_pylist() for c in ("pivot", "salt", "role"))
            common, a, b, keep = [], [], [], []
            for i, words in hashed_docs(batch.column("text"), lower=True):
                s = shingle_set(words, n)
                if roles[i] == 0:
                    head, at = s, (pivots[i], salts[i])
                elif at == (pivots[i], salts[i]):
                    common.append(_common(s, head))
                    a.append(len(s))
                    b.append(len(head))
                    keep.append(i)
            taken = batch.select(["key", "pivot"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x, _I64) for x in (common, a, b))], ["key", "pivot", "common", "a", "b"])

    placed = rows.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role").select("pivot", "salt", "role", "key", "text")
    out = placed.mapInArrow(run, "key long, pivot long, common long, a long, b long")
    union = F.col("a") + F.col("b") - F.col("common")
    return stored(out.select("key", "pivot", "common", union.alias("union"), (1 - F.col("common") / union).alias("distance")), "distances")


def is_close(percent: int) -> F.Column:
    return 100 * F.col("common") >= percent * F.col("union")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(if_small(labels), "key", "left").withColumn("label", F.coalesce("label", "key"))


def live_cells(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells (cell, key, parent) with points of two components at least, one of cells with equal points; with label and size."""
    named = _labelled(cells, labels)
    seen = named.groupBy("cell").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"),
        F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("x"), F.min("key").alias("k0"), F.max("key").alias("k1"),
    ).where("lo < hi")
    one = seen.groupBy("size", "x", "k0", "k1").agg(F.min("cell").alias("cell")).select("cell", "size")
    return stored(named.join(one, "cell").select("cell", "key", "label", "size", "parent"), "live")


def _live_regions(regions: DataFrame, labels: DataFrame) -> DataFrame:
    """Of regions (cell, key, core): boundary points that are not connected with their core, and the cores of
    regions that have some; with label, and the numbers of both."""
    named = stored(_labelled(regions, labels), "regions")
    home = stored(named.where("core").groupBy("cell").agg(F.min("label").alias("home"), F.count(F.lit(1)).alias("cores")), "home")
    border = named.where("NOT core").join(if_small(home), "cell").where("label != home")
    border = stored(border.groupBy("cell", "key").agg(F.min("label").alias("label"), F.max("cores").alias("cores")), "border")
    sizes = stored(border.groupBy("cell").agg(F.max("cores").alias("cores"), F.count(F.lit(1)).alias("borders")), "sizes")
    cores = named.where("core").select("cell", "key", "label").join(if_small(sizes), "cell").withColumn("side", F.lit(0))
    borders = border.drop("cores").join(if_small(sizes), "cell").withColumn("side", F.lit(1))
    return cores.unionByName(borders)


def open_pairs(live: DataFrame) -> DataFrame:
    """The pairs of small cells that are not connected yet."""
    other = live.select("cell", F.col("key").alias("pivot"), F.col("label").alias("other"))
    return live.join(other, "cell").where("key < pivot AND label != other").select("key", "pivot")


def elect(live: DataFrame, pivots: int, level: int) -> DataFrame:
    """cell, pivot: the least points of a cell in an order that changes with the level, one in each of ``pivots`` classes."""
    k = F.xxhash64(F.lit(level), "key")
    return live.groupBy("cell", F.pmod(k, F.lit(pivots)).alias("class")).agg(F.min_by("key", k).alias("pivot")).select("cell", "pivot")


def _split(cells: DataFrame, elected: DataFrame, distances: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Cells (cell, key, size) by their pivots: what no pivot links (cell, key, parent),
    and the pivots' regions (cell, key, core).  Distances beyond 2 eps may be missing."""
    known = distances.select("key", "pivot", "distance", is_close(percent).alias("close"))
    seen = cells.select("cell", "key", "size").join(elected, "cell").join(if_small(known), ["key", "pivot"], "left")
    self_ = F.col("key") == F.col("pivot")
    seen = stored(seen.select("cell", "key", "size", "pivot", F.when(self_, 0.0).otherwise(F.col("distance")).alias("d"), (self_ | F.coalesce("close", F.lit(False))).alias("close")), "seen")
    own = seen.groupBy("cell", "key").agg(F.max("size").alias("parent"), F.min(F.when(F.col("close"), F.struct("d", "pivot")))["pivot"].alias("own"))
    own = stored(own, "own")
    rest = own.where("own IS NULL").select("cell", "key", "parent")
    within = seen.where(F.col("d") <= 2 * (1 - percent / 100) + 1e-9).join(own.select("cell", "key", "own"), ["cell", "key"])
    regions = within.select(F.xxhash64("cell", "pivot").alias("cell"), "key", F.col("pivot").eqNullSafe(F.col("own")).alias("core"))
    return rest, regions


def _task_links(sets: list[np.ndarray], labels: np.ndarray, blocks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what can be connected; of two blocks only pairs across them."""
    n, eps = len(sets), 1 - percent / 100 + 1e-9
    if n < 2 or (labels == labels[0]).all():
        return []
    sizes, labels, across = np.array([len(s) for s in sets]), labels.copy(), bool((blocks != blocks[0]).any())
    heads = sorted({0, n // 3, 2 * n // 3, n - 1})
    common = np.array([[_common(s, sets[h]) for h in heads] for s in sets])
    distance = 1 - common / (sizes[:, None] + sizes[heads] - common)
    out = []
    for i in range(1, n):
        may = (np.abs(distance[:i] - distance[i]) <= eps).all(1) & (labels[:i] != labels[i])
        may &= (100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])) & ((blocks[:i] != blocks[i]) | (not across))
        for j in np.flatnonzero(may).tolist():
            if labels[j] != labels[i]:
                c = _common(sets[i], sets[j])
                if 100 * c >= percent * (sizes[i] + sizes[j] - c):
                    out.append((i, j))
                    labels[labels == labels[j]] = labels[i]
    return out


def _may_link(signs: list[bytes], sizes: np.ndarray, labels: np.ndarray, blocks: np.ndarray, percent: int) -> np.ndarray:
    """Which points may have a partner of another component, of two blocks one of the other block, by their signatures."""
    counts = [np.frombuffer(z, np.uint8) for z in signs]
    counts = [np.stack([z & 15, z >> 4], 1).ravel().astype(np.int32) for z in counts]
    full = np.array([c.max() == 15 for c in counts])
    least = min(len(c) for c in counts)
    table = np.stack([c.reshape(least, -1).sum(1) for c in counts])
    across = bool((blocks != blocks[0]).any())
    out = np.zeros(len(signs), bool)
    for i in range(1, len(signs)):
        both = sizes[:i] + sizes[i]
        apart = np.where(full[:i] | full[i], 0, np.abs(table[:i] - table[i]).sum(1))
        may = (1 - (both - apart) / (both + apart) <= 1 - percent / 100 + 1e-9) & (labels[:i] != labels[i])
        may &= (100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])) & ((blocks[:i] != blocks[i]) | (not across))
        if may.any():
            out[i] = True
            out[:i] |= may
    return out


_PLACE = ["cell", "b0", "b1"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (cell, b0, b1) of sorted rows."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        place = list(zip(*(batch.column(c).to_pylist() for c in _PLACE)))
        cuts = [0] + [i for i in range(1, len(place)) if place[i] != place[i - 1]] + [len(place)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and place[lo] != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = place[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def block_links(spread: DataFrame, signs: DataFrame, texts: DataFrame, n: int, percent: int, may_link: Callable[..., np.ndarray] = _may_link) -> DataFrame:
    """a, b: links that connect the points of ``spread`` (cell, b0, b1, mine, key, label), block against block.

    A group of one (cell, b0, b1) has at most two blocks.  ``may_link`` tells by the
    signatures which of its points need their texts.
    """
    column = lambda t, c: t.column(c).to_numpy()

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            keep = np.flatnonzero(may_link(t.column("signature").to_pylist(), column(t, "n"), column(t, "label"), column(t, "mine"), percent))
            yield from t.select(columns).take(pa.array(keep)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            sets: list = [None] * t.num_rows
            for i, words in hashed_docs(t.column("text").combine_chunks(), lower=True):
                sets[i] = shingle_set(words, n)
            keys = column(t, "key")
            found = np.array(_task_links(sets, column(t, "label"), column(t, "mine"), percent), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys[found[:, k]]) for k in (0, 1)], ["a", "b"])

    columns = [*_PLACE, "mine", "key", "label"]
    # tasks by work, not by bytes
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lambda rows, more: rows.repartition(tasks, *_PLACE).sortWithinPartitions(*_PLACE).select(*columns, *more)
    signed = placed(spread.select(*columns).join(signs, "key"), ["n", "signature"])
    may = stored(signed.mapInArrow(sieve, "cell long, b0 int, b1 int, mine int, key long, label long"), "may")
    return stored(placed(with_texts(may, texts, "key"), ["text"]).mapInArrow(run, "a long, b long"), "links")


def cell_blocks(live: DataFrame) -> DataFrame:
    """Whole cells, each block against each."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    spread = live.select("cell", "key", "label", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return spread.select("cell", F.least("mine", "other").alias("b0"), F.greatest("mine", "other").alias("b1"), "mine", "key", "label")


def region_blocks(regions: DataFrame) -> DataFrame:
    """Regions, each block of the core against each of the boundary."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    core = F.col("side") == 0
    mine = F.pmod(F.xxhash64("key"), F.when(core, blocks("cores")).otherwise(blocks("borders"))).cast("int")
    spread = regions.select("cell", "key", "label", "side", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.when(core, blocks("borders")).otherwise(blocks("cores")) - 1)).alias("other"))
    pick = lambda a, b: F.when(F.col("side") == 0, F.col(a)).otherwise(F.col(b))
    return spread.select("cell", pick("block", "other").alias("b0"), pick("other", "block").alias("b1"), F.col("side").cast("int").alias("mine"), "key", "label")


def relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """key, label of all points with links, after new ``edges`` (a, b)."""
    if labels is None:
        return stored(components(edges).select(F.col("v").alias("key"), F.col("component").alias("label")), "labels")
    for c in ("a", "b"):
        edges = edges.join(labels.select(F.col("key").alias(c), F.col("label").alias(f"{c}_")), c, "left").withColumn(c, F.coalesce(f"{c}_", c)).drop(f"{c}_")
    merged = stored(components(edges).select(F.col("v").alias("label"), F.col("component").alias("to")), "merged")
    old = labels.join(merged, "label", "left").select("key", F.coalesce("to", "label").alias("label"))
    new = merged.select(F.col("label").alias("key"), F.col("to").alias("label")).join(labels.select("key"), "key", "left_anti")
    return stored(old.unionByName(new), "labels")


def join_components(docs: DataFrame, n: int = 3, percent: int = 90, leaf: int = 16, pivots: int = 8, rounds: int = 4) -> DataFrame:
    """row, doc_id, n_shingles, component_id of every row of ``docs`` (a stored table).

    ``row`` is the row id that ``with_row_id`` gives ``docs``.
    """
    eps = 1 - percent / 100
    small_batches(docs.sparkSession)
    texts_of = with_row_id(docs.select("doc_id", "text"), "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bits = table_bits(docs.count())
    profile = stored(_profile(texts_of, n, bits), "profile")
    rows = profile.where("part IS NULL").select("row", "doc_id", "n", "key")

    posted = stored(_postings(texts_of, n, percent, _counts(profile, bits)), "postings")
    signs = posted.where("shingle IS NULL").groupBy("key").agg(F.max("n").alias("n"), F.max("signature").alias("signature"))
    members = _members(posted.where("shingle IS NOT NULL").select("shingle", "key", "n"), percent)
    signs = stored(signs.join(members.select("key").distinct(), "key", "left_semi"), "signs")
    chosen = rows.where("n > 0").groupBy("key").agg(F.min("row").alias("row")).join(members.select("key").distinct(), "key", "left_semi")
    texts = stored(with_texts(stored(chosen, "chosen"), texts_of.select("row", "text"), "row").select("key", "text"), "texts")

    pairs = lambda d: d.where(is_close(percent)).select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    distances = measured(_within(members.where("key != pivot").select("key", "pivot"), signs, 2 * eps), texts, n)
    labels = relabelled(None, pairs(distances))
    # in a cell of one pivot every point within eps of it is in its core, and all cells of a pivot have one region
    within = distances.where(F.col("distance") <= 2 * eps + 1e-9).select(F.col("pivot").alias("cell"), "key", is_close(percent).alias("core"))
    heads = within.select("cell", F.col("cell").alias("key"), F.lit(True).alias("core")).distinct()
    regions = within.unionByName(heads)
    linked = distances.where(is_close(percent)).select("key", "pivot")
    cells = members.where("key != pivot").join(if_small(linked), ["key", "pivot"], "left_anti").select("cell", "key", F.lit(0).alias("parent"))
    level = 0
    while True:
        close_by = stored(_live_regions(regions, labels), "close")
        live = live_cells(cells, labels)
        todo, links = [not x.isEmpty() for x in (close_by, live)], []
        if not any(todo):
            break
        if todo[0]:
            links.append(block_links(region_blocks(close_by), signs, texts, n, percent))
        small, rest = live.where(F.col("size") <= leaf), live.where(F.col("size") > leaf)
        again = ((2 * F.col("size") <= F.col("parent")) | F.lit(level == 0)) & F.lit(level < rounds)
        whole, large = rest.where(~again), rest.where(again)
        if not whole.isEmpty():
            links.append(block_links(cell_blocks(whole), signs, texts, n, percent))
        elected = stored(elect(large, pivots, level), "elected")
        if todo[1]:
            trial = large.select("cell", "key").join(elected, "cell").where("key != pivot").select("key", "pivot")
            distances = measured(_within(open_pairs(small), signs, eps).unionByName(_within(trial, signs, 2 * eps)), texts, n)
            links.append(pairs(distances))
        every = links[0]
        for e in links[1:]:
            every = every.unionByName(e)
        labels = relabelled(labels, every)
        cells, regions = _split(large, elected, distances, percent)
        level += 1

    return component_rows(rows, labels)


def component_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component_id and point (the component's least point) of ``rows`` (row, doc_id, n, key),
    whose points have ``labels`` (key, label) if they have links."""
    named = rows.join(labels, "key", "left").withColumn("point", F.when(F.col("n") > 0, F.coalesce("label", "key")))
    named = stored(named.select("row", "doc_id", "n", "point"), "named")
    least = named.where("point IS NOT NULL").groupBy("point").agg(F.min("doc_id").alias("least"))
    least = stored(least, "least")
    return named.join(least, "point", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "point"
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, join: Callable[..., DataFrame] = join_components, **kw) -> DataFrame:
    """The rows of ``docs`` that stay: of each component that ``join`` finds the row
    with the smallest doc_id (null last; one of equals), and all without words."""
    docs = as_table(docs)
    found = stored(join(docs, n, percent, **kw).select("row", "doc_id", "point"), "found")
    firsts = found.where("point IS NOT NULL").groupBy("point").agg(F.min_by("row", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("row")).select("row")
    row = free_name(docs, "row")
    kept = firsts.unionByName(found.where("point IS NULL").select("row")).withColumnRenamed("row", row)
    return with_rows(docs, row, kept, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
