"""Repeated passages by a sparse suffix array.

Of a text's suffixes (from each word on) only those at content-selected places
are retained: where the hash of the next GRAM words is the least of a run of
such grams.  The run is as long as a passage of ``least`` words has grams, so
every passage that long holds a retained place, the same one in all its copies.
Retained suffixes whose gram stands in one document only are dropped.  The
others carry the words that a passage through them can reach, are sorted by
gram and following words, and each is compared with its neighbours; a match is
extended to the left and right.  Suffixes that this leaves open, as the longest
match to the left and the one to the right may be with different neighbours,
are settled by comparing all windows of ``least`` words through the place.

A gram of very many documents is dealt to several tasks.  Each sends on one
copy of every window that it saw, and a grouped minimum and maximum find the
windows of other tasks: exact again, without gathering the gram's suffixes.

A passage counts when it stands in two documents (rows) or more.  Words are
compared by 64-bit hashes, case included.

Defined results: null, empty and short texts have no passages.  Repeated rows
repeat each other.  Spans are in words, from start_word up to but not including
end_word; overlapping and touching ones are one.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.store import as_table, free_name, small_batches, stored, with_row_id
from muster.llm.textwords import hashed_docs, mix, ngrams, split_docs

GRAM = 8
#: Suffixes of one gram that are compared in one task.
GROUP = 2048
#: A gram with more than one in HOT of all places meets them by broadcast; there are fewer than HOT such grams.
HOT = 1 << 17
#: Sorted suffixes that are compared at once: whole grams, up to this many where one gram has no more.
BATCH = 2048
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_I64 = pa.int64()


def _running(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every w neighbours, by doubling."""
    f = np.minimum if least else np.maximum
    size = 1
    while size * 2 <= w:
        x = f(x[: len(x) - size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def retained(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the retained suffixes and the hashes of their grams."""
    if len(words) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, w = ngrams(words, GRAM), least - GRAM + 1
    lows = _running(grams, w, True)
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_running(np.concatenate([pad, lows, pad]), w, False) == grams)
    return at, grams[at]


def _suffixes(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = np.array(batch.column("row").to_pylist(), np.int64), []
            for i, words in hashed_docs(batch.column("text"), lower=False):
                at, h = retained(words, least)
                out.append((h.view(np.int64), np.full(len(at), rows[i]), at))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["gram", "row", "at"])

    return docs.select("row", "text").mapInArrow(run, "gram long, row long, at long")


def _with_context(docs: DataFrame, least: int) -> DataFrame:
    """Retained suffixes of ``docs`` (row, text, places) with the words around them."""
    reach = least - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = batch.column("row").to_pylist(), batch.column("places").to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            for i, _, starts, ends in split_docs(batch.column("text"), lower=False):
                text = batch.column("text")[i].as_buffer()
                for p in places[i]:
                    at = p["at"]
                    lo, hi = max(0, at - reach), min(len(starts), at + least)
                    left = text.slice(starts[lo], ends[at - 1] - starts[lo]).to_pybytes() if lo < at else b""
                    right = text.slice(starts[at], ends[hi - 1] - starts[at]).to_pybytes()
                    for c, v in zip(cols, (p["gram"], p["salts"], rows[i], at, left, right)):
                        c.append(v)
                    if len(cols[0]) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
                        cols = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    names = ["gram", "salts", "row", "at", "left", "right"]
    types = [_I64, _I64, _I64, _I64, pa.binary(), pa.binary()]
    return docs.mapInArrow(run, "gram long, salts long, row long, at long, left binary, right binary")


def _matrix(left: pa.Array, right: pa.Array, reach: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words around each place, and which of them the text has."""
    n = len(left)
    words, there = np.zeros((n, reach + least), np.uint64), np.zeros((n, reach + least), bool)
    for i, h in hashed_docs(left, lower=False):
        words[i, reach - len(h) : reach] = h
        there[i, reach - len(h) : reach] = True
    for i, h in hashed_docs(right, lower=False):
        words[i, reach : reach + len(h)] = h
        there[i, reach : reach + len(h)] = True
    return words, there


def _neighbours(words: np.ndarray, there: np.ndarray, rows: np.ndarray, reach: int, least: int) -> np.ndarray:
    """Which windows through each place a neighbour in the sorted order repeats: (places, windows)."""
    n, windows = len(words), reach + 1
    found = np.zeros((n, windows), bool)
    if n < 2:
        return found
    same = (words[1:] == words[:-1]) & there[1:] & there[:-1] & (rows[1:] != rows[:-1])[:, None]
    right = np.where(same[:, reach:].all(1), least, np.argmin(same[:, reach:], 1))
    back = same[:, :reach][:, ::-1]
    left = np.where(back.all(1), reach, np.argmin(back, 1)) if reach else np.zeros(n - 1, np.int64)
    first = reach - left  # window o holds the words o .. o + least - 1 of the matrix
    o = np.arange(windows)
    both = (o >= first[:, None]) & (o + least <= (reach + right)[:, None])
    found[1:] |= both
    found[:-1] |= both
    return found


def _window_hashes(words: np.ndarray, there: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    n, width = words.shape
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(width, _BASE, np.uint64)]))
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(width, pow(_BASE, -1, 1 << 64), np.uint64)]))
    acc, has = np.zeros((n, width + 1), np.uint64), np.zeros((n, width + 1), np.int64)
    np.cumsum(words * power[:width], axis=1, out=acc[:, 1:])
    np.cumsum(there, axis=1, out=has[:, 1:])
    m = width - least + 1
    return mix((acc[:, least:] - acc[:, :m]) * inverse[:m]), has[:, least:] - has[:, :m] == least


def _compare(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to found spans, and the windows of grams that other tasks share."""
    reach = least - GRAM

    def settle(t: pa.Table) -> pa.RecordBatch:
        rows, at, salts, grams = (t.column(c).to_numpy() for c in ("row", "at", "salts", "gram"))
        words, there = _matrix(*(pa.concat_arrays(t.column(c).chunks) for c in ("left", "right")), reach, least)
        found = _neighbours(words, there, rows, reach, least)
        hashes, whole = _window_hashes(words, there, least)
        # windows that no neighbour repeats, of grams with a third suffix, and all of shared grams
        _, inverse, size = np.unique(grams, return_inverse=True, return_counts=True)
        open_ = ((size[inverse] > 2) & ~(found | ~whole).all(1)) | (salts > 1)
        check = np.isin(inverse, np.unique(inverse[open_]))
        i, o = np.nonzero(whole & check[:, None])
        h = hashes[i, o]
        order = np.lexsort((rows[i], h))
        i, o, h = i[order], o[order], h[order]
        sent = np.zeros(0, np.int64)
        lo = hi = np.zeros(0, np.int64)
        if len(h):
            cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends = np.concatenate([cut[1:], [len(h)]])
            lo, hi = rows[i[cut]], rows[i[ends - 1]]
            twice = np.repeat(lo != hi, ends - cut)
            found[i[twice], o[twice]] = True
            sent = np.flatnonzero(salts[i[cut]] > 1)
            sent_h, sent_i, sent_o, lo, hi = h[cut[sent]], i[cut[sent]], o[cut[sent]], lo[sent], hi[sent]
            singles_extra = (salts[i] > 1) & ~twice
        any_ = found.any(1)
        start = at[any_] - reach + np.argmax(found[any_], 1)
        end = at[any_] + least - np.argmax(found[any_][:, ::-1], 1)
        k = len(start)
        none = pa.nulls(k, _I64)
        if not len(sent):
            return pa.RecordBatch.from_arrays([pa.array(rows[any_]), pa.array(start), pa.array(end), none, none, none], names)
        # copies of one row make a window seen twice by the same row only: send each of its places
        extra = np.flatnonzero(singles_extra)
        e_i, e_o, e_h = i[extra], o[extra], h[extra]
        t_rows = np.concatenate([rows[any_], rows[e_i], rows[sent_i]])
        t_start = np.concatenate([start, at[e_i] - reach + e_o, at[sent_i] - reach + sent_o])
        t_end = np.concatenate([end, at[e_i] - reach + e_o + least, at[sent_i] - reach + sent_o + least])
        mask = np.concatenate([np.ones(k, bool), np.zeros(len(extra) + len(sent), bool)])
        t_h = np.concatenate([np.zeros(k, np.int64), e_h.view(np.int64), sent_h.view(np.int64)])
        t_lo = np.concatenate([np.zeros(k, np.int64), rows[e_i], lo])
        t_hi = np.concatenate([np.zeros(k, np.int64), rows[e_i], hi])
        return pa.RecordBatch.from_arrays([pa.array(t_rows), pa.array(t_start), pa.array(t_end), *(pa.array(x, mask=mask) for x in (t_h, t_lo, t_hi))], names)

    names = ["row", "start", "end", "window", "lo", "hi"]
    for t in _whole_grams(batches):
        yield settle(t)


def _whole_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted suffixes in tables of about BATCH rows that part no gram's share of this task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH):
            held.append(batch.slice(lo, BATCH))
            if sum(b.num_rows for b in held) < BATCH:
                continue
            t = pa.Table.from_batches(held)
            gram, salt = t.column("gram").to_numpy(), t.column("salt").to_numpy()
            last = (gram == gram[-1]) & (salt == salt[-1])  # may go on in the next batch
            cut = int(np.argmax(last))
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _merged(spans: DataFrame) -> DataFrame:
    """row, start, end of the unions of overlapping and touching spans; a document's spans at a time."""
    own = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("fresh", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    marked = marked.withColumn("island", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def repeated_spans(docs: DataFrame, least: int = 50) -> DataFrame:
    """row, start, end for ``docs`` (row, text binary; stored): words that stand in
    passages of ``least`` words which another row repeats."""
    small_batches(docs.sparkSession)
    places = stored(_suffixes(docs, least), "suffixes")
    shared = places.groupBy("gram").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    shared = stored(shared.select("gram", F.ceil(F.col("n") / GROUP).alias("salts"), "n"), "shared")
    # frequent grams go to where their places are; in the shuffle of the others no gram has more than one HOT-th of all places
    frequent = F.col("n") * HOT > places.count()
    hot = F.broadcast(shared.where(frequent).select("gram", "salts"))
    rest = shared.where(~frequent).select("gram", "salts")
    wanted = places.join(hot, "gram").unionByName(places.join(hot, "gram", "left_anti").join(rest, "gram"))
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("at", "gram", "salts")).alias("places"))
    around = _with_context(docs.select("row", "text").join(wanted, "row").select("row", "text", "places"), least)
    # equal surroundings go together, unless they are so many themselves
    salt = F.pmod(F.xxhash64("left", "right") + F.pmod(F.xxhash64("row"), F.ceil(F.col("salts") / 4)), F.col("salts"))
    ordered = around.repartition("gram", salt).withColumn("salt", salt).sortWithinPartitions("gram", "salt", "right")
    ordered = ordered.select("gram", "salt", "salts", "row", "at", "left", "right")
    found = stored(ordered.mapInArrow(lambda it: _compare(it, least), "row long, start long, end long, window long, lo long, hi long"), "found")
    windows = found.where("window IS NOT NULL")
    across = windows.groupBy("window").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h").select("window")
    late = windows.where("lo = hi").join(across, "window").select("row", "start", "end")
    return _merged(found.where("window IS NULL").select("row", "start", "end").unionByName(late))


def _rows(docs: DataFrame) -> DataFrame:
    return with_row_id(docs.select("doc_id", "text"), "row").select("row", "doc_id", F.col("text").cast("binary").alias("text"))


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """doc_id, start_word, end_word, n_words of every repeated passage of ``docs`` (a stored table)."""
    rows = _rows(docs)
    spans = stored(repeated_spans(rows, least), "spans")
    return spans.join(rows.select("row", "doc_id"), "row").select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words")
    )


def cut_words(text: Column, spans: Column) -> Column:
    """``text`` without the words of ``spans`` (array of start, end) and the white space after them."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, all_spans in batches:
            given, out = all_spans.to_pylist(), [None] * len(texts)
            for i, _, starts, _ in split_docs(texts, lower=False):
                b = texts[i].as_py()
                if b is not None:
                    parts, at = [], 0
                    for s in sorted(given[i] or [], key=lambda s: s["start"]):
                        parts.append(b[at : starts[s["start"]]])
                        at = starts[s["end"]] if s["end"] < len(starts) else len(b)
                    out[i] = b"".join([*parts, b[at:]]).decode("utf-8", "replace")
            yield pa.array(out, pa.string())

    return cut(text.cast("binary"), spans)


def without_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """``docs`` with all repeated passages cut out of the texts."""
    docs = as_table(docs)
    row, spans = free_name(docs, "row"), free_name(docs, "spans")
    found = repeated_spans(_rows(docs), least).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias(spans)).withColumnRenamed("row", row)
    out = with_row_id(docs, row).join(found, row, "left")
    return out.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut_words(F.col("text"), F.col(spans)))).select(*[F.col(f"`{c}`") for c in docs.columns])
