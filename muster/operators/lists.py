"""What lists of statistics show: orders, ranks, bands, meters, tabs and pages.

A list has a row for each champion, item, augment, pair or ranked player of a
page, hundreds at most except for the ladder, whose positions come with its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns that a list may be sorted by; for some the least is best.
LEAST_BEST = {"tier": False, "rank": True, "top3": False, "top1": False, "avg": True, "play_rate": False, "games": False}
COLUMNS = {"tier": "score", "rank": "rank_position", "top3": "top3_rate", "top1": "top1_rate", "avg": "avg_placement", "play_rate": "play_rate", "games": "games"}
#: Width of the meter's best bar, of its worst, and of all bars where all are equal.
METER_BEST, METER_WORST, METER_FLAT = 92.0, 3.0, 50.0


def order(key: str, best_first: bool = True) -> Column:
    """The order of a list by ``key``, from the best value or from the worst."""
    rising = LEAST_BEST[key] == best_first
    c = F.round(F.col(COLUMNS[key]), 9)  # sums in another order are ties
    return c.asc_nulls_last() if rising else c.desc_nulls_last()


def sorted_list(rows: DataFrame, tie: str, key: str = "tier", best_first: bool = True) -> DataFrame:
    return rows.orderBy(order(key, best_first), tie)


def page(sorted_rows: DataFrame, size: int, number: int = 1) -> DataFrame:
    """The rows of one page of a sorted list; the first has number 1."""
    return sorted_rows.offset(size * (number - 1)).limit(size)


def ranked(scored: DataFrame, tie: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``scored`` with its position by tier score and the length of its list."""
    own = Window.partitionBy(*(by or [F.lit(0)]))
    return scored.withColumn("position", F.row_number().over(own.orderBy(order("tier"), tie))).withColumn("total", F.count(F.lit(1)).over(own))


def podium(scored: DataFrame, tie: str, first: int = 3, rest: int = 5) -> DataFrame:
    """The best of a list: those on the podium and those beside it."""
    best = ranked(scored, tie).where(F.col("position") <= first + rest)
    return best.withColumn("on_podium", F.col("position") <= first)


def band_starts(rows: DataFrame, tier: str, *by: str) -> DataFrame:
    """``rows`` in the order ``by`` whose ``tier`` is not that of the row before.

    Where bands are runs of this order, the first row of each band is its least:
    that needs no window over the whole list.
    """
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*by))
    return rows.groupBy(F.col(tier).alias("_band")).agg(first.alias("r")).select("r.*")


def placement_meter(rows: DataFrame) -> DataFrame:
    """``rows`` with the width of a bar that shows avg_placement between the list's worst and best."""
    ends = rows.agg(F.min("avg_placement").alias("_best"), F.max("avg_placement").alias("_worst"))
    out = rows.crossJoin(F.broadcast(ends))  # one row
    width = F.col("_worst") - F.col("_best")
    bar = F.least(F.lit(METER_BEST), F.greatest(F.lit(METER_WORST), (F.col("_worst") - F.col("avg_placement")) / width * METER_BEST))
    return out.withColumn("meter", F.when(width > 0, bar).otherwise(F.lit(METER_FLAT))).drop("_best", "_worst")


def swing_order(rows: DataFrame, timing: DataFrame, key: str, later: bool = True) -> DataFrame:
    """All ``rows`` by the swing that ``timing`` has for them; those without one are last either way."""
    s = F.round("swing", 9)
    return rows.join(timing.select(key, "swing"), key, "left").orderBy(s.desc_nulls_last() if later else s.asc_nulls_last(), key)


def item_tabs(rows: DataFrame) -> DataFrame:
    """Items with the tab that shows them: all but prismatic ones are legendary."""
    return rows.withColumn("tab", F.when(F.col("kind") == "prismatic", "prismatic").otherwise("legendary"))


def augment_tabs(rows: DataFrame, ref_augments: DataFrame) -> DataFrame:
    """Augments with the tab that shows them; those without a known tier are gold."""
    tier = ref_augments.select(F.col("id").alias("augment_id"), F.col("tier").alias("tab"))
    return rows.join(tier, "augment_id", "left").fillna("gold", ["tab"])
