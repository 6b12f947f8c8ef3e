"""Tiers of a ladder of given size, by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a point of rating that one task orders.
STEPS = 4

#: The parts of the ladder below Master, in percent.
SHARES = (("Diamond", 4.0), ("Emerald", 13.0), ("Platinum", 18.0), ("Gold", 24.0), ("Silver", 21.0), ("Bronze", 16.0), ("Iron", 3.4))


def positions(rated: DataFrame, value: str, ties: list[Column]) -> DataFrame:
    """``rated`` with rank_position, by ``value`` from the greatest and then ``ties``, and the ladder's size.

    Positions follow from counts of the better buckets of ``value``, so no task sorts the whole ladder.
    """
    r = rated.withColumn("bucket", F.floor(F.col(value) * STEPS).cast("int"))
    sizes = r.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))  # a row for each part of a point
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("size"))
    inside = Window.partitionBy("bucket").orderBy(F.desc(value), *ties)
    return r.join(sizes, "bucket").withColumn("rank_position", (F.col("before") + F.row_number().over(inside)).cast("int")).drop("bucket", "before")


def _round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5)


def ladder_tier(position: Column, size: Column) -> Column:
    """Tier of a position from 1 on; the top three tiers have fixed shares with limits."""
    top = [
        ("Challenger", F.least(F.lit(10), F.greatest(F.lit(1), _round(size * 0.01)))),
        ("Grandmaster", F.least(F.lit(15), F.greatest(F.lit(1), _round(size * 0.015)))),
        ("Master", F.greatest(F.lit(1), _round(size * 0.01))),
    ]
    out, end = None, F.lit(0)
    for name, n in top:
        end = end + n
        out = F.when(position <= end, name) if out is None else out.when(position <= end, name)
    rest, total, upto = size - end, sum(p for _, p in SHARES), 0.0
    for name, percent in SHARES:
        upto += percent
        out = out.when(position <= end + _round(rest * upto / total), name)
    return out.otherwise("Iron")


def skill_bucket(tier: Column) -> Column:
    """1 for the best tiers to 5, 0 for the unranked."""
    return (F.when(tier.isin("Challenger", "Grandmaster", "Master"), 1).when(tier.isin("Diamond", "Emerald"), 2).when(tier == "Platinum", 3)
            .when(tier == "Gold", 4).when(tier.isin("Silver", "Bronze", "Iron"), 5).otherwise(0))
