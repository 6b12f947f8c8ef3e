"""Runs whose whole inventory comes from anvils: prismatic and excluded items only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.arrays import contained_in
from muster.functions.counters import counters, share


def with_anvil(rows: DataFrame, ref_items: DataFrame) -> DataFrame:
    """``rows`` with anvil; an empty inventory counts, an unknown item does not."""
    free = ref_items.where("category IN ('prismatic', 'excluded')").agg(F.collect_list("id").alias("free"))
    return rows.crossJoin(F.broadcast(free)).withColumn("anvil", contained_in(F.col("items"), F.col("free"))).drop("free")  # one row


def anvil_champions(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("champion").agg(*counters(F.col("anvil")), F.count(F.lit(1)).alias("total_games"))
    return out.where("games > 0")


def anvil_overall(rows: DataFrame) -> DataFrame:
    return rows.where("anvil").agg(F.countDistinct("match_id").alias("total_matches"), *counters())


def _opened(rows: DataFrame, openers: tuple[int, ...]) -> DataFrame:
    return rows.withColumn("opener", F.try_element_at("augments", F.lit(1))).where(F.col("opener").isin(*openers))


def anvil_openers(rows: DataFrame, openers: tuple[int, ...]) -> DataFrame:
    return _opened(rows, openers).groupBy("opener").agg(*counters(F.col("anvil"), "anvil_"), *counters(~F.col("anvil"), "bought_"))


def anvil_opener_champions(rows: DataFrame, openers: tuple[int, ...], min_games: int) -> DataFrame:
    return _opened(rows, openers).where("anvil").groupBy("opener", "champion").agg(*counters()).where(F.col("games") >= min_games)


def opener_comparison(openers: DataFrame, noise: float = 0.002) -> DataFrame:
    """What an anvil run changes for each opener, and whether that is more than noise."""
    rate = lambda p, c: share(F.col(f"{p}_{c}"), F.col(f"{p}_games"))
    out = openers.select("opener", *[(rate("anvil", c) - rate("bought", c)).alias(f"delta_{n}") for n, c in (("top1", "top1_wins"), ("top3", "top3_wins"), ("placement", "placement_sum"))])
    return out.withColumn("verdict", F.when(F.abs("delta_top3") <= noise, "same").when(F.col("delta_top3") > 0, "better").otherwise("worse"))


def champion_anvil_summary(rows: DataFrame, openers: tuple[int, ...], shardblade: int) -> DataFrame:
    """Each champion's anvil runs: results, share with the blade, and runs opened on an anvil augment."""
    opened = F.coalesce(F.try_element_at("augments", F.lit(1)).isin(*openers), F.lit(False))
    out = rows.where("anvil").groupBy("champion").agg(
        *counters(), F.count_if(F.array_contains("items", shardblade)).alias("blades"), *counters(opened, "stat_"), *counters(~opened, "other_"))
    return out.withColumn("blade_rate", share(F.col("blades"), F.col("games"))).withColumn("avg_placement", share(F.col("placement_sum"), F.col("games"))).drop("blades")
