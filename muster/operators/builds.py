"""Item builds of champions: which item goes into which slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.counters import counters

SLOTS, BOOTS_SLOT, PRISMATIC_SLOT, SHOWN = 6, 1, 2, 3


def build_slots(rows: DataFrame, ref_items: DataFrame) -> DataFrame:
    """Counters by champion, slot and item.

    Slot 1 is the first boots, slot 2 every prismatic item held, slots 3 to 6 the
    other items in the order of purchase (of the inventory where that is unknown).
    """
    kinds = ref_items.agg(*[F.collect_list(F.when(F.col("category") == c, F.col("id"))).alias(c) for c in ("boots", "prismatic", "excluded")])
    r = rows.crossJoin(F.broadcast(kinds))  # one row
    source = F.when(F.size("item_order") > 0, F.col("item_order")).otherwise(F.col("items"))
    usable = F.filter(source, lambda i: ~F.array_contains("excluded", i))
    slot = lambda n, i: F.struct(n.cast("int").alias("slot"), i.cast("int").alias("item_id"))
    boots = F.transform(F.slice(F.filter(usable, lambda i: F.array_contains("boots", i)), 1, 1), lambda i: slot(F.lit(BOOTS_SLOT), i))
    special = F.transform(F.filter("items", lambda i: F.array_contains("prismatic", i)), lambda i: slot(F.lit(PRISMATIC_SLOT), i))
    rest = F.filter(usable, lambda i: ~F.array_contains("boots", i) & ~F.array_contains("prismatic", i))
    rest = F.transform(F.slice(rest, 1, SLOTS - PRISMATIC_SLOT), lambda i, k: slot(k + PRISMATIC_SLOT + 1, i))
    r = r.select("champion", "placement", F.explode(F.concat(boots, special, rest)).alias("s"))
    return r.groupBy("champion", "s.slot", "s.item_id").agg(*counters())


def build_selection(slots: DataFrame) -> DataFrame:
    """Up to three items a slot, most games first; a slot's first item is not shown in later slots.

    A champion's slots hold at most a few hundred items, so the greedy choice is
    a fold over the six slots inside one array.
    """
    entry = F.struct(F.col("slot"), (-F.col("games")).alias("less"), F.col("item_id"))
    all_ = slots.groupBy("champion").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<struct<slot:int,less:bigint,item_id:int>>").alias("shown"))

    def step(acc, k):
        here = F.slice(F.filter("entries", lambda e: (e["slot"] == k) & ~F.array_contains(acc["taken"], e["item_id"])), 1, SHOWN)
        return F.struct(F.concat(acc["taken"], F.transform(F.slice(here, 1, 1), lambda e: e["item_id"])).alias("taken"), F.concat(acc["shown"], here).alias("shown"))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(SLOTS)), start, step, lambda acc: acc["shown"])
    out = all_.select("champion", F.posexplode(chosen).alias("n", "e")).select("champion", "e.slot", "n", "e.item_id", (-F.col("e.less")).alias("games"))
    place = F.row_number().over(Window.partitionBy("champion", "slot").orderBy("n"))
    return out.select("champion", "slot", place.alias("choice"), "item_id", "games")
