"""Additive counters and the one place where rates are made of them.

Operators group and return counters, as sums recombine exactly and averages do
not; ``with_rates`` turns them into rates at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP3 = 3
PLAYERS = 18


def counters(where: Column | None = None, prefix: str = "") -> list[Column]:
    """games, top1_wins, top3_wins, placement_sum, of rows for which ``where`` holds."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    p = F.col("placement")
    return [
        F.count_if(hit).alias(f"{prefix}games"), F.count_if(hit & (p == 1)).alias(f"{prefix}top1_wins"), F.count_if(hit & (p <= TOP3)).alias(f"{prefix}top3_wins"),
        F.coalesce(F.sum(F.when(hit, p)), F.lit(0)).cast("long").alias(f"{prefix}placement_sum"),
    ]


def added() -> list[Column]:
    """The sums of counters that were grouped more finely."""
    return [F.sum(c).cast("long").alias(c) for c in ("games", "top1_wins", "top3_wins", "placement_sum")]


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_rates(df: DataFrame, denominator: Column) -> DataFrame:
    g = F.col("games")
    return df.select(
        "*", share(F.col("top3_wins"), g).alias("top3_rate"), share(F.col("top1_wins"), g).alias("top1_rate"),
        share(F.col("placement_sum"), g).alias("avg_placement"), share(g, denominator).alias("play_rate"),
    )
