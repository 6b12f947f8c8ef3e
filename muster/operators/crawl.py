"""Ingestion as relations: captured matches, purchases, queues and admission."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.operators.pieces import with_pieces
from muster.operators.surrogate import numbered
from muster.sources.shared import written


def is_build_item(item: Column, excluded: tuple[int, ...] = ()) -> Column:
    """Not a shard, not a consumable, not excluded."""
    never = item.between(220000, 220007) | item.between(2142, 2145)
    return ~(never | item.isin(*excluded)) if excluded else ~never


def inventory(events: Column) -> Column:
    """Items of an array of (type, item_id) in order of time: purchases push, undoing
    and selling take the last of that item away, and the first of each stays."""

    def step(acc, e):
        n = F.array_position(F.reverse(acc), e["item_id"])
        at = (F.size(acc) - n + 1).cast("int")
        removed = F.when(n > 0, F.concat(F.slice(acc, 1, at - 1), F.slice(acc, at + 1, F.size(acc)))).otherwise(acc)
        return F.when(e["type"] == "ITEM_PURCHASED", F.array_append(acc, e["item_id"])).when(e["type"].isin("ITEM_UNDO", "ITEM_SOLD"), removed).otherwise(acc)

    return F.array_distinct(F.aggregate(events, F.array().cast("array<int>"), step))


def timeline_item_order(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Order of purchase of each ``keys`` from its events (type, item_id); one participant's events at a time."""
    e = events.where((F.col("type") != "ITEM_PURCHASED") | is_build_item(F.col("item_id")))
    rows = e.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "type", "item_id"))).alias("e"))
    return rows.select(*keys, inventory(F.transform("e", lambda x: F.struct(x["type"].alias("type"), x["item_id"].alias("item_id")))).alias("item_order"))


def patch_windows(dated: DataFrame) -> DataFrame:
    """When each patch begins and ends, from matches whose patch is known."""
    starts = dated.groupBy("patch").agg(F.min("game_creation").alias("starts_at"))
    return starts.withColumn("ends_at", F.lead("starts_at").over(Window.orderBy("starts_at")))  # a row for each patch


def patch_boundaries(matches: DataFrame, targets: list[str], by: str = "game_creation") -> DataFrame:
    """patch, position, starts_at, previous_at, minutes: where each of ``targets`` begins among ``matches``
    (match_id, game_creation, patch; patch null where it is not known) in order of time.

    Each boundary is the first match of the target or a later patch by bisection, where a
    match of unknown patch counts as before.  All boundaries are searched at once: matches
    are numbered in order of time and stored sorted, so a round is one read of as many rows
    as there are targets, and there are as many rounds as the number of matches has bits.
    """
    spark = matches.sparkSession
    placed = numbered(matches.select(F.struct(by, "match_id").alias("at"), "patch"), "at", "i")
    placed = written(placed.select("i", f"at.{by}", "patch").repartitionByRange("i").sortWithinPartitions("i"), "timeline")
    n = placed.count()
    key = lambda patch: tuple(map(int, patch.split(".")))
    reach = {t: (0, n) for t in targets}
    while open_ := {t: (lo + hi) // 2 for t, (lo, hi) in reach.items() if lo < hi}:
        seen = {r["i"]: r["patch"] for r in placed.where(F.col("i").isin(sorted(set(open_.values())))).collect()}  # a row for each target
        for t, mid in open_.items():
            lo, hi = reach[t]
            reach[t] = (lo, mid) if seen[mid] is not None and key(seen[mid]) >= key(t) else (mid + 1, hi)
    found = spark.createDataFrame([(t, lo) for t, (lo, _) in reach.items() if lo < n], "patch string, position long")
    at = placed.select("i", F.col(by).alias("at")).where(F.col("i").isin(sorted({p for lo, _ in reach.values() for p in (lo, lo - 1)})))
    out = found.join(F.broadcast(at.select(F.col("i").alias("position"), F.col("at").alias("starts_at"))), "position")
    before = at.select((F.col("i") + 1).alias("position"), F.col("at").alias("previous_at"))
    minutes = F.round((F.unix_micros(F.col("starts_at").cast("timestamp")) - F.unix_micros(F.col("previous_at").cast("timestamp"))) / 60_000_000).cast("long")
    return out.join(F.broadcast(before), "position", "left").select("patch", "position", "starts_at", "previous_at", minutes.alias("minutes"))


def deduce_patches(undated: DataFrame, windows: DataFrame) -> DataFrame:
    """``undated`` with the patch whose window holds its game_creation; null before the first.

    Windows are a handful of rows in one array, so there is no range join.
    """
    w = windows.agg(F.array_sort(F.collect_list(F.struct("starts_at", "patch"))).alias("w"))
    past = F.filter("w", lambda x: x["starts_at"] <= F.col("game_creation"))
    return undated.crossJoin(F.broadcast(w)).withColumn("patch_deduced", F.try_element_at(past, F.lit(-1))["patch"]).drop("w")  # one row


def new_match_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Ids that are not ingested yet, once each, latest number first."""
    fresh = ids.select("match_id").distinct().join(known.select("match_id"), "match_id", "left_anti")
    return fresh.orderBy(F.substring_index("match_id", "_", -1).cast("long").desc())


def pick_requested(queue: DataFrame, rows: int) -> DataFrame:
    """Players asked for since their last visit, first come first."""
    due = (F.col("error_count") < 5) & (F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < F.col("requested_at")))
    return queue.where(F.col("requested_at").isNotNull() & due).orderBy("requested_at", "puuid").limit(rows)


def request_player(queue: DataFrame, puuid: str, now: Column) -> DataFrame:
    """The queue after a request for ``puuid``: a pending request keeps its time, and
    who was visited less than an hour ago is left alone."""
    mine = F.col("puuid") == puuid
    stale = F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < now - F.expr("INTERVAL 1 HOUR"))
    pending = F.col("last_crawled_at").isNull() & F.col("requested_at").isNotNull() | (F.col("requested_at") > F.col("last_crawled_at"))
    out = queue.withColumns({
        "requested_at": F.when(mine & stale & ~F.coalesce(pending, F.lit(False)), now).otherwise(F.col("requested_at")),
        "priority": F.when(mine & stale, F.greatest("priority", F.lit(1))).otherwise(F.col("priority")),
    })
    known = queue.where(mine)
    new = queue.sparkSession.range(1).select(F.lit(puuid).alias("puuid")).join(known.select("puuid"), "puuid", "left_anti")
    blank = new.select(*[F.lit(puuid).alias(c) if c == "puuid" else (F.lit(1) if c == "priority" else now if c == "requested_at" else F.lit(0) if c == "error_count" else F.lit(None)).cast(t).alias(c) for c, t in queue.dtypes])
    return out.unionByName(blank)


def pick_players(queue: DataFrame, limit: int, now: Column, requested: int = 10, revisit_hours: int = 6) -> DataFrame:
    """Whom to visit next: half tracked (asked for, top of the ladder, tracked), the rest
    discovered; if too few were discovered, more tracked ones.

    Each class is a distributed top-k of ``limit`` names at most, in one array; the
    quotas are stretches of these arrays, in the same plan.
    """
    half = limit // 2
    by = (F.col("last_crawled_at").asc_nulls_first(), F.desc("discovered_at"), "puuid")
    due = queue.where(F.col("error_count") < 5)
    old = F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < now - F.make_interval(hours=F.lit(revisit_hours)))

    def first(name: str, rows: DataFrame, *order: Column | str) -> DataFrame:
        """One row: the first names in order."""
        top = rows.orderBy(*order).limit(limit).select("puuid", F.row_number().over(Window.orderBy(*order)).alias("place"))  # ``limit`` rows
        return top.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "puuid"))), lambda x: x["puuid"]).alias(name))

    lists = first("asked", pick_requested(queue, min(requested, half)), "requested_at", "puuid")
    for name, rows in (("top", due.where((F.col("priority") == 2) & old)), ("tracked", due.where("priority = 1")), ("found", due.where("priority = 0"))):
        lists = lists.crossJoin(first(name, rows, *by))  # one row each
    take = lambda a, n: F.slice(a, F.lit(1), F.greatest(F.lit(0), n))
    lists = lists.withColumn("seen", F.concat("asked", F.array_except(take("top", half - F.size("asked")), "asked")))
    lists = lists.withColumn("seen", F.concat("seen", F.array_except(take("tracked", half - F.size("seen")), "seen")))
    lists = lists.withColumn("fresh", take("found", limit - F.size("seen")))
    lists = lists.withColumn("more", F.array_except(take("tracked", limit - F.size("seen") - F.size("fresh")), F.concat("seen", "fresh")))
    marked = lambda c, tracked: F.transform(c, lambda p: F.struct(p.alias("puuid"), F.lit(tracked).alias("tracked")))
    return lists.select(F.posexplode(F.concat(marked("seen", True), marked("fresh", False), marked("more", True))).alias("pick", "p")).select((F.col("pick") + 1).alias("pick"), "p.puuid", "p.tracked")


def after_visits(queue: DataFrame, visits: DataFrame, now: Column) -> DataFrame:
    """The queue after ``visits`` (puuid, ok): a failure counts, a success clears the count; five failures in a row end the picking."""
    out = queue.join(visits.select("puuid", "ok"), "puuid", "left")
    seen = F.col("ok").isNotNull()
    return out.withColumns({
        "error_count": F.when(F.col("ok"), 0).when(seen, F.col("error_count") + 1).otherwise(F.col("error_count")),
        "last_crawled_at": F.when(seen, now).otherwise(F.col("last_crawled_at")),
    }).select(*queue.columns)


def promote_tracked(queue: DataFrame, players: DataFrame, min_games: int) -> DataFrame:
    """The queue with discovered players of enough games tracked."""
    ready = players.where(F.col("games") >= min_games).select("puuid", F.lit(True).alias("ready"))
    out = queue.join(ready, "puuid", "left")
    return out.withColumn("priority", F.when((F.col("priority") == 0) & F.col("ready"), 1).otherwise(F.col("priority"))).drop("ready")


def mark_ladder_top(queue: DataFrame, ratings: DataFrame, top: int) -> DataFrame:
    """The queue with the ladder's top at priority 2, and those who left it at 1."""
    best = ratings.where(F.col("rank_position") <= top).select("puuid", F.lit(True).alias("best"))
    out = queue.join(best, "puuid", "full")
    p = F.when(F.col("best"), 2).when(F.col("priority") == 2, 1).otherwise(F.col("priority"))
    return out.withColumn("priority", p).drop("best")


def sliding_counts(events: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """``events`` with how many of the same keys came in the ``seconds`` before, itself included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w))


def admitted(events: DataFrame, key: str, most: int = 5, seconds: int = 120) -> DataFrame:
    """``events`` (event_id, key, ts) with whether each is let in: at most ``most`` of a key
    in ``seconds``, where refused ones do not count.

    Events are cut into sessions, which start after a gap of ``seconds`` or more, as
    no admission is remembered there.  Sessions are found in pieces of time, so no
    key is one task's work; each is then a stream in order of time that holds the
    times of the last ``most`` admissions only.  Events without a time are let in.
    """
    micros = seconds * 1_000_000
    e = events.select(F.col(key).alias("k"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    e = with_pieces(e, "k", "t")
    inside = Window.partitionBy("k", "piece").orderBy("t", "event_id")
    earlier = Window.partitionBy("k").orderBy("piece")  # a row for each piece of a key

    # where sessions start: after a gap inside a piece, or between a piece and the one before
    spans = e.groupBy("k", "piece").agg(F.min("t").alias("first"), F.max("t").alias("last")).withColumn("before", F.lag("last").over(earlier))
    gap = lambda at, before: F.when(before.isNull() | (at - before >= micros), at)
    step = e.withColumn("start", F.when(F.col("t") - F.lag("t").over(inside) >= micros, F.col("t")))
    own = step.groupBy("k", "piece").agg(F.max("start").alias("late"))
    heads = spans.join(own.select(F.col("k").alias("k_"), F.col("piece").alias("piece_"), "late"), F.col("k").eqNullSafe(F.col("k_")) & F.col("piece").eqNullSafe(F.col("piece_")))
    heads = heads.withColumn("head", gap(F.col("first"), F.col("before")))
    heads = heads.withColumn("carried", F.max(F.coalesce("late", "head")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    heads = heads.select("k_", "piece_", F.coalesce("head", "carried").alias("open"))
    so_far = F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    e = step.withColumn("so_far", so_far).join(heads, F.col("k").eqNullSafe(F.col("k_")) & F.col("piece").eqNullSafe(F.col("piece_")))
    e = e.select("k", F.coalesce("so_far", "open").alias("session"), "t", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, deque(maxlen=most)
        for batch in batches:
            out = []
            for k, session, t in zip(*(batch.column(c).to_pylist() for c in ("k", "session", "t"))):
                if (k, session) != at:
                    at = k, session
                    last.clear()
                ok = t is None or most > 0 and (len(last) < most or last[0] <= t - micros)
                if ok and t is not None:
                    last.append(t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("event_id"), pa.array(out, pa.bool_())], [key, "event_id", "admitted"])

    types = dict(events.dtypes)
    placed = e.repartition("k", "session").sortWithinPartitions("k", "session", "t", "event_id")
    return placed.mapInArrow(run, f"`{key}` {types[key]}, event_id {types['event_id']}, admitted boolean")
