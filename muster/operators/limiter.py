"""A limiter of requests: when each may go, and which are refused.

Requests of a key go in order of arrival, none before the one ahead of it, and none
while ``n`` earlier ones have gone within the last ``w`` seconds, for each limit (n, w).
A request that had to wait goes GUARD after the oldest of them leaves the window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.pieces import with_pieces

#: Microseconds after the end of a window at which a request that waits for it goes.
GUARD = 1000
LIMITS = ((20, 1), (100, 120))


class Turns:
    """The limiter of one key; ``gone`` are the times of its last requests, in order."""

    def __init__(self, limits: Iterable[tuple[int, int]], max_wait: int | None, gone: Iterable[int] = ()):
        self.limits = [(n, w * 1_000_000) for n, w in limits]
        self.max_wait = max_wait
        self.gone = deque(gone, maxlen=max(n for n, _ in self.limits))

    def go(self, arrival: int) -> int | None:
        """When a request that arrives (microseconds) goes; None if it is refused, as it then leaves the queue.

        The time that a request may wait counts from when its turn comes, after the one ahead.
        """
        gone = self.gone
        at = turn = max(arrival, gone[-1]) if gone else arrival
        while True:
            # all windows that are full now; when the longest wait is over another one may be
            full = [gone[-n] + w for n, w in self.limits if len(gone) >= n and at < gone[-n] + w]
            if not full:
                break
            at = max(full) + GUARD
            if self.max_wait is not None and at > turn + self.max_wait:
                return None
        gone.append(at)
        return at


def _steps(limits: Iterable[tuple[int, int]]) -> tuple[int, int, list[tuple[int, int]]]:
    """The limit (n, w) that is slowest for each request, and combinations (requests, wait) of the others that may add to it."""
    spaced = [(n, w * 1_000_000 + GUARD) for n, w in limits]
    n, w = max(spaced, key=lambda x: (x[1] / x[0], x[0]))
    best = {0: 0}  # requests -> longest wait; n others hold some that n's limit replaces
    for m, v in spaced:
        if (m, v) == (n, w):
            continue
        for _ in range(n - 1):
            more = {a + m: b + v for a, b in best.items() if b + v > max(w * ((a + m) // n), best.get(a + m, -1))}
            if not more:
                break
            best |= more
    kept: list[tuple[int, int]] = []
    for a, b in sorted(best.items()):
        if all(b > y + w * ((a - x) // n) for x, y in kept):
            kept.append((a, b))
    return n, w, kept


def paced(events: DataFrame, key: str, limits: Iterable[tuple[int, int]] = LIMITS) -> DataFrame:
    """``events`` (event_id, key, ts) with ``go``, in microseconds, where all requests wait as long as they must.

    A request follows the n-th before it by w at least, so it goes at the greatest of
    arrival(j) + L(i - j) over all j up to i, where L(k) is the longest wait that limits can
    put between requests k apart: w for every n of the slowest limit, and what others add.
    These are running maxima of arrivals, less the waits up to them, by the remainder of
    the request's number: grouped sums over pieces, no sequential fold.  A request that
    arrives just when a window ends waits GUARD as well here.  Events without a time go at once.
    """
    n, w, others = _steps(limits)
    e = events.select("event_id", F.col(key).alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    timed = with_pieces(e.where("t IS NOT NULL"), "k", "t")
    piece = Window.partitionBy("k", "piece")
    earlier = Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece of a key

    def with_before(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
        """``rows`` with what ``found`` has for their piece."""
        names = [F.col(c).alias(f"{c}_") for c in keys]
        found = found.select(*names, *[c for c in found.columns if c not in keys])
        on = F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}_"))
        for c in keys[1:]:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}_"))
        return rows.join(found, on).drop(*[f"{c}_" for c in keys])

    sizes = timed.groupBy("k", "piece").agg(F.count(F.lit(1)).alias("size"))
    first = sizes.select("k", "piece", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("first"))
    rows = with_before(timed, first, ["k", "piece"]).withColumn("i", F.col("first") + F.row_number().over(piece.orderBy("t", "event_id")) - 1)
    turn = F.floor(F.col("i") / n)
    rows = rows.select("k", "event_id", "t", "piece", "i", F.pmod("i", F.lit(n)).alias("r"), turn.alias("turn"), (F.col("t") - turn * w).alias("x"))
    # the greatest x of the same remainder so far, in the piece and before it
    heads = rows.groupBy("k", "r", "piece").agg(F.max("x").alias("x"))
    by_r = Window.partitionBy("k", "r").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = heads.select("k", "r", "piece", F.max("x").over(by_r).alias("x0"))
    own = F.max("x").over(Window.partitionBy("k", "r", "piece").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = with_before(rows.withColumn("own", own), before, ["k", "r", "piece"])
    rows = rows.select("k", "event_id", "t", "i", (F.greatest("own", "x0") + F.col("turn") * w).alias("q"))
    # a limit's wait is also behind all requests that follow: from the n - 1 before, and from those that others add
    reach = sorted({a + d for a, _ in others for d in (0, n - 1)})[-1]
    return _spread(rows, n, others, reach).unionByName(e.where("t IS NULL").select("k", "event_id", "t", F.col("t").alias("go"))).select("event_id", F.col("k").alias(key), "t", "go")


def _spread(rows: DataFrame, n: int, others: list[tuple[int, int]], reach: int) -> DataFrame:
    """go of each row from q of the ``reach`` before it, which are read from its own and the previous block of rows."""
    block = max(10 * reach, 10_000)
    b = F.floor(F.col("i") / block)
    last = F.col("i") % block >= block - reach  # the next block looks back at these
    dealt = rows.select("*", F.explode(F.when(last, F.array(b, b + 1)).otherwise(F.array(b))).alias("b"))
    order = Window.partitionBy("k", "b").orderBy("i")
    ahead = dealt.withColumn("p", F.max("q").over(order.rowsBetween(-(n - 1), 0)))
    waits = [F.lag("p", a).over(order) + v if a else F.col("p") for a, v in others]
    return ahead.withColumn("go", F.greatest("t", *waits)).where(F.col("b") == b).select("k", "event_id", "t", "go")


def limited(events: DataFrame, key: str, limits: Iterable[tuple[int, int]] = LIMITS, max_wait: float | None = None) -> DataFrame:
    """``events`` (event_id, key, ts) with ``wait_us``, null where a request is refused
    as it would have to wait longer than ``max_wait`` seconds.

    A request that arrives when the longest window is over for all before it starts a
    session.  ``paced`` gives times that no request exceeds (who is refused delays
    nobody), so sessions are found without a fold; each is then one sorted stream of a
    task, which holds the last few times only.  Events without a time go at once.
    """
    limits = tuple(limits)
    window = max(w for _, w in limits) * 1_000_000
    wait = None if max_wait is None else int(max_wait * 1_000_000)
    e = paced(events, key, limits).withColumnRenamed(key, "k")
    timed = with_pieces(e.where("t IS NOT NULL"), "k", "t")
    inside = Window.partitionBy("k", "piece").orderBy("t", "event_id")
    earlier = Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = timed.groupBy("k", "piece").agg(F.max("go").alias("go"))
    before = sums.select(F.col("k").alias("k_"), F.col("piece").alias("piece_"), F.max("go").over(earlier).alias("go0"))
    rows = timed.join(before, F.col("k").eqNullSafe(F.col("k_")) & (F.col("piece") == F.col("piece_"))).drop("k_", "piece_")
    gone = F.greatest(F.max("go").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("go0"))
    rows = rows.withColumn("start", F.when(gone.isNull() | (F.col("t") >= gone + window), F.struct("t", "event_id")))
    # the last start so far, in the piece or before it
    heads = rows.groupBy("k", "piece").agg(F.max("start").alias("start"))
    carried = heads.select(F.col("k").alias("k_"), F.col("piece").alias("piece_"), F.max("start").over(earlier).alias("start0"))
    rows = rows.join(carried, F.col("k").eqNullSafe(F.col("k_")) & (F.col("piece") == F.col("piece_"))).drop("k_", "piece_")
    session = F.coalesce(F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("start0"))
    rows = rows.select("k", session.alias("session"), "t", "event_id").select("k", "session.t", F.col("session.event_id").alias("s"), F.col("t").alias("at"), "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turns = None, None
        for batch in batches:
            out = []
            for k, t, s, arrival in zip(*(batch.column(c).to_pylist() for c in ("k", "t", "s", "at"))):
                if (k, t, s) != at:
                    at, turns = (k, t, s), Turns(limits, wait)
                go = turns.go(arrival)
                out.append(None if go is None else go - arrival)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("event_id"), pa.array(out, pa.int64())], [key, "event_id", "wait_us"])

    types = dict(events.dtypes)
    placed = rows.repartition("k", "t", "s").sortWithinPartitions("k", "t", "s", "at", "event_id")
    out = placed.mapInArrow(run, f"`{key}` {types[key]}, event_id {types['event_id']}, wait_us long")
    return out.unionByName(e.where("t IS NULL").select(F.col("k").alias(key), "event_id", F.lit(0).cast("long").alias("wait_us")))
