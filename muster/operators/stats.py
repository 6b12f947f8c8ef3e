"""Champion and augment statistics of one patch."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.arrays import without
from muster.functions.counters import PLAYERS, counters, with_rates
from muster.functions.patches import patch_key
from muster.operators.views import patch_match_count

#: Standard deviation of a placement drawn from 1..6, and how many standard errors a move must have.
SIGMA, ERRORS = math.sqrt(35 / 12), 3
TIMING_SLOTS, TIMING_MIN = 3, 30


def champion_stats(rows: DataFrame) -> DataFrame:
    places = F.array(*[F.count_if(F.col("placement") == i) for i in range(1, 7)]).alias("placement_counts")
    return rows.groupBy("champion").agg(*counters(), places)


def champion_rates(rows: DataFrame) -> DataFrame:
    """Champion counters with rates; a match has eighteen picks."""
    total = patch_match_count(rows)
    out = with_rates(champion_stats(rows).crossJoin(F.broadcast(total)), F.col("matches") * PLAYERS)  # one row
    return out.drop("matches", "placement_counts").orderBy(F.desc("top3_rate"), "champion")


def placement_shares(rows: DataFrame) -> DataFrame:
    """Share of each placement of a champion's games, and the scale of its bars."""
    shares = F.transform("placement_counts", lambda c: c / F.col("games"))
    out = champion_stats(rows).select("champion", F.posexplode(shares).alias("place", "share"))
    scale = F.greatest(F.lit(0.3), F.max("share").over(Window.partitionBy("champion")))
    return out.select("champion", (F.col("place") + 1).alias("placement"), "share", (F.col("share") / scale).alias("bar"))


def previous_patch_champion_totals(published: DataFrame, archive: DataFrame, patch: str) -> DataFrame:
    """Totals of the newest known patch before ``patch``: from published rows, else from the archive."""
    known = archive.select("patch").union(published.select("patch")).distinct()
    older = known.where(patch_key(F.col("patch")) < patch_key(F.lit(patch)))
    prev = older.orderBy(patch_key(F.col("patch")).desc()).limit(1)
    live = published.join(F.broadcast(prev), "patch", "left_semi").groupBy("patch", "champion").agg(
        F.count(F.lit(1)).alias("games"), F.sum("placement").cast("long").alias("placement_sum"))
    old = archive.join(F.broadcast(prev), "patch", "left_semi").groupBy("patch", "champion").agg(
        F.sum("games").cast("long").alias("games"), F.sum("placement_sum").cast("long").alias("placement_sum"))
    return live.unionByName(old.join(live.select("patch").distinct(), "patch", "left_anti"))


def champion_movers(now: DataFrame, before: DataFrame, errors: float = ERRORS) -> DataFrame:
    """Champions whose mean placement moved by more than ``errors`` standard errors, largest move first."""
    b = before.select("champion", F.col("games").alias("games_before"), F.col("placement_sum").alias("sum_before"))
    out = now.select("champion", "games", "placement_sum").join(b, "champion").where("games > 0 AND games_before > 0")
    out = out.withColumn("avg_placement", F.col("placement_sum") / F.col("games")).withColumn("avg_before", F.col("sum_before") / F.col("games_before"))
    out = out.withColumn("delta", F.col("avg_placement") - F.col("avg_before"))
    noise = errors * SIGMA * F.sqrt(1 / F.col("games") + 1 / F.col("games_before"))
    return out.where(F.abs("delta") > noise).select("champion", "games", "games_before", "avg_placement", "avg_before", "delta").orderBy(F.abs("delta").desc(), "champion")


def excluded_ids(ref: DataFrame) -> DataFrame:
    """One row: the array of excluded ids of a dimension (empty if none)."""
    return ref.where("category = 'excluded'").agg(F.collect_list("id").alias("excluded"))


def picked_augments(rows: DataFrame, ref_augments: DataFrame) -> DataFrame:
    """One row for each augment in ``rows`` that is not excluded."""
    bad = ref_augments.where("category = 'excluded'").select(F.col("id").alias("augment_id"))
    return rows.withColumn("augment_id", F.explode("augments")).join(F.broadcast(bad), "augment_id", "left_anti")  # a dimension


def augment_stats(rows: DataFrame, ref_augments: DataFrame) -> DataFrame:
    return picked_augments(rows, ref_augments).groupBy("augment_id").agg(*counters())


def augment_rates(rows: DataFrame, ref_augments: DataFrame) -> DataFrame:
    """Augment counters with rates, best first."""
    out = augment_stats(rows, ref_augments).crossJoin(F.broadcast(patch_match_count(rows)))  # one row
    return with_rates(out, F.col("matches") * PLAYERS).drop("matches").orderBy(F.desc("top3_rate"), "augment_id")


def champion_augment_stats(rows: DataFrame, ref_augments: DataFrame, min_games: int) -> DataFrame:
    return picked_augments(rows, ref_augments).groupBy("champion", "augment_id").agg(*counters()).where(F.col("games") >= min_games)


def augment_timing(rows: DataFrame, ref_augments: DataFrame, slots: int = TIMING_SLOTS) -> DataFrame:
    """Counters by the place of an augment among a player's picks, excluded ones left out first."""
    r = rows.crossJoin(F.broadcast(excluded_ids(ref_augments)))  # one row
    r = r.select("placement", F.posexplode(F.slice(without(F.col("augments"), F.col("excluded")), 1, slots)).alias("slot", "augment_id"))
    return r.groupBy((F.col("slot") + 1).alias("slot"), "augment_id").agg(*counters())


def augment_timing_swing(timing: DataFrame, slots: int = TIMING_SLOTS, least: int = TIMING_MIN) -> DataFrame:
    """How much better an augment does when picked late than early, against all
    augments that were picked often enough in every slot."""
    g = timing.groupBy("augment_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("slot") == k, F.col(c))), F.lit(0)).cast("long").alias(f"{c}_{k}")
        for k in range(1, slots + 1) for c in ("games", "top3_wins")])
    for k in range(1, slots + 1):
        g = g.where(F.col(f"games_{k}") >= least)
    every = Window.partitionBy(F.lit(0))  # one row for each augment
    rate = lambda k: F.col(f"top3_wins_{k}") / F.col(f"games_{k}")
    base = lambda k: F.sum(f"top3_wins_{k}").over(every) / F.sum(f"games_{k}").over(every)
    swing = (rate(slots) - base(slots)) - (rate(1) - base(1))
    return g.select("augment_id", *[rate(k).alias(f"rate_{k}") for k in range(1, slots + 1)], swing.alias("swing")).orderBy(F.desc("swing"), "augment_id")
