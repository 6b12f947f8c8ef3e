"""Streams whose events are worked on in order of time, however they arrive.

Events are held in the state of their key until the watermark is past them; a timer
then gives them, in order of time and id, to a fold, which keeps a short memory.
So frames, micro-batches and files may bring them in any order, and the results
are those of the batch operators.  Events that are later than the watermark are
dropped by Spark.  State of a key goes when it has been idle for ``keep``.

Sessions need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB
provider, which ``use_rocksdb`` sets.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from muster.operators.limiter import LIMITS, Turns

Row = tuple
#: memory, events in order -> memory, rows to emit without their key
Fold = Callable[[list[int], list[Row]], tuple[list[int], list[Row]]]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class Plan:
    """What a fold reads and gives: DDL of the held events (``t`` first, in microseconds), names of the output columns."""

    fold: Fold
    held: str
    out: list[str]
    keep: int  # microseconds that a key's memory outlives its last event


class InOrder(StatefulProcessor):
    def __init__(self, plan: Plan):
        self.plan = plan
        self.columns = [c.split()[0] for c in plan.held.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.plan.held)
        self.memory = handle.getValueState("memory", "values array<bigint>")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, at_once = None, []
        for frame in rows:
            new = [tuple(None if pd.isna(x) else x for x in r) for r in frame[self.columns].astype(object).itertuples(index=False)]
            at_once += [r for r in new if r[0] is None]  # no time, no place in the order
            new = [r for r in new if r[0] is not None]
            if new:
                self.pending.appendList(new)
                first = min([r[0] for r in new] + ([] if first is None else [first]))
        if first is not None:
            self._wake(first)
        if at_once:
            yield self._frame(key, [x for r in at_once for x in self.plan.fold([], [r])[1]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        past = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.pending.get())
        due = [r for r in held if r[0] <= past]
        memory = list(self.memory.get()[0]) if self.memory.exists() else []
        memory, out = self.plan.fold(memory, due)
        if len(due) < len(held):
            self.pending.put(held[len(due) :])
            self._wake(held[len(due)][0])
        else:
            self.pending.clear()
            if due:  # come back when the key has been idle long enough
                self._wake(due[-1][0] + self.plan.keep)
            else:
                memory = []
        if memory:
            self.memory.update((memory,))
        else:
            self.memory.clear()
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass

    def _wake(self, micros: int) -> None:
        at = -(-int(micros) // 1000)
        if self.timer.exists():
            (now,) = self.timer.get()
            if now <= at:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _frame(self, key: tuple, rows: list[Row]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.plan.out)


def in_order(events: DataFrame, key: str, plan: Plan, types: str, late: str) -> DataFrame:
    """``events`` (key, ts and what the plan holds) by the plan; ``late`` is how late an event may be."""
    use_rocksdb(events.sparkSession)
    timed = events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", late)
    return timed.groupBy(key).transformWithStateInPandas(InOrder(plan), types, "Append", "EventTime")


def admitted_stream(events: DataFrame, most: int = 5, seconds: int = 120, late: str | None = None) -> DataFrame:
    """A stream of (user_id, event_id, ts) with whether each is let in, as ``crawl.admitted``."""
    micros = seconds * 1_000_000

    def fold(memory: list[int], rows: list[Row]) -> tuple[list[int], list[Row]]:
        last, out = deque(memory, maxlen=most), []
        for t, event in rows:
            ok = t is None or most > 0 and (len(last) < most or last[0] <= t - micros)
            if ok and t is not None:
                last.append(t)
            out.append((event, ok))
        return list(last), out

    plan = Plan(fold, "t bigint, event_id bigint", ["user_id", "event_id", "admitted"], micros)
    return in_order(events, "user_id", plan, "user_id long, event_id long, admitted boolean", late or f"{seconds} seconds")


def limited_stream(events: DataFrame, limits: Iterable[tuple[int, int]] = LIMITS, max_wait: float | None = None, late: str = "2 minutes") -> DataFrame:
    """A stream of (user_id, event_id, ts) with the wait of each, null where it is refused, as ``limiter.limited``."""
    limits = tuple(limits)
    wait = None if max_wait is None else int(max_wait * 1_000_000)
    keep = max(w for _, w in limits) * 1_000_000 + (wait or 0)

    def fold(memory: list[int], rows: list[Row]) -> tuple[list[int], list[Row]]:
        turns, out = Turns(limits, wait, memory), []
        for t, event in rows:
            go = turns.go(t) if t is not None else None
            out.append((event, 0 if t is None else None if go is None else go - t))
        return list(turns.gone), out

    plan = Plan(fold, "t bigint, event_id bigint", ["user_id", "event_id", "wait_us"], keep)
    return in_order(events, "user_id", plan, "user_id long, event_id long, wait_us long", late)


#: What an event does to an inventory.
BOUGHT, UNDONE, SOLD = 0, 1, 2


def _kind(type_: Column) -> Column:
    return F.when(type_ == "ITEM_PURCHASED", BOUGHT).when(type_ == "ITEM_UNDO", UNDONE).when(type_ == "ITEM_SOLD", SOLD)


def inventory_stream(events: DataFrame, key: str, late: str = "10 minutes", idle: int = 3600) -> DataFrame:
    """A stream of (key, ts, position, type, item_id) to the order of purchase after each release:
    (key, t, item_order), as ``crawl.inventory``; the row of the greatest t is the latest."""

    def fold(memory: list[int], rows: list[Row]) -> tuple[list[int], list[Row]]:
        held = list(memory)
        for _, _, kind, item in rows:
            if kind == BOUGHT:
                held.append(item)
            elif item in held:
                del held[len(held) - 1 - held[::-1].index(item)]
        return held, [(rows[-1][0], list(dict.fromkeys(held)))] if rows else []

    known = events.withColumn("kind", _kind(F.col("type"))).where("kind IS NOT NULL AND ts IS NOT NULL")
    plan = Plan(fold, "t bigint, position bigint, kind bigint, item_id bigint", [key, "t", "item_order"], idle * 1_000_000)
    return in_order(known.select(key, "ts", F.col("position").cast("long").alias("position"), F.col("kind").cast("long").alias("kind"), F.col("item_id").cast("long").alias("item_id")), key, plan,
                    f"`{key}` {dict(events.dtypes)[key]}, t long, item_order array<bigint>", late)
