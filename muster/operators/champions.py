"""The document of each champion, for all champions in one pass over each relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.counters import PLAYERS, with_rates
from muster.functions.tiers import tier_scores
from muster.operators import anvil, builds, combos, items, stats
from muster.operators.views import patch_match_count

#: Games that an item or augment needs in a champion's lists, in its lists of anvil runs, and a pair in its pairs.
LIST_MIN, ANVIL_MIN, COMBO_MIN = 5, 3, 10
#: Augments shown of each rarity, prismatic items, those of anvil runs, pairs kept and shown of each category.
TOP_AUGMENTS, TOP_PRISMATIC, TOP_ANVIL, COMBOS_KEPT, COMBOS_SHOWN = 5, 6, 3, 60, 10
_TIERS = ("tier_placement", "tier_top3", "tier_top1")


def champion_item_grid(rows: DataFrame, ref_items: DataFrame, keep: Column | None = None) -> DataFrame:
    """The item grid of each champion, of the items for which ``keep`` (of item_id, kind) holds."""
    held = items.acquisitions(rows, ref_items)
    held = held.where(keep) if keep is not None else held
    return held.groupBy("champion", "item_id", "kind", "landmark", "skill_bucket").agg(*items.cell())


def champion_items(rows: DataFrame, ref_items: DataFrame, levels: DataFrame, keep: Column | None = None) -> DataFrame:
    """Each champion's items, corrected by ``levels``, the landmark baselines of all champions."""
    return items.item_adjusted_stats(champion_item_grid(rows, ref_items, keep), levels, ("champion",))


def packed_items(adjusted: DataFrame, least: int) -> DataFrame:
    """One row for each champion: items of ``least`` games or more, most games first, corrected values to 1e-4."""
    four = lambda c: (F.floor(F.col(c) * 10_000 + 0.5) / 10_000).alias(c)
    entry = F.struct((-F.col("games")).alias("less"), "item_id", "games", "top1_wins", "top3_wins", "placement_sum", *[four(c) for c in _TIERS])
    out = adjusted.where(F.col("games") >= least).groupBy("champion").agg(F.array_sort(F.collect_list(entry)).alias("list"))
    return out.select("champion", F.transform("list", lambda e: e.dropFields("less")).alias("list"))


def packed_augments(found: DataFrame, least: int) -> DataFrame:
    """One row for each champion: augments of ``least`` games or more, most games first."""
    entry = F.struct((-F.col("games")).alias("less"), "augment_id", "games", "top1_wins", "top3_wins", "placement_sum")
    out = found.where(F.col("games") >= least).groupBy("champion").agg(F.array_sort(F.collect_list(entry)).alias("list"))
    return out.select("champion", F.transform("list", lambda e: e.dropFields("less")).alias("list"))


def top_prismatic_items(adjusted: DataFrame, n: int) -> DataFrame:
    """Each champion's best prismatic items by tier score."""
    scored = tier_scores(adjusted.where("kind = 'prismatic'"), ["champion"], basis=("tier_placement", "tier_top1", "tier_top3"))
    best = Window.partitionBy("champion").orderBy(F.desc(F.round("score", 9)), "item_id")
    return scored.withColumn("position", F.row_number().over(best)).where(F.col("position") <= n)


def top_augments(found: DataFrame, ref_augments: DataFrame, n: int = TOP_AUGMENTS) -> DataFrame:
    """Each champion's best augments of each rarity by tier score."""
    rarity = ref_augments.select(F.col("id").alias("augment_id"), F.col("tier").alias("rarity"))
    scored = tier_scores(found.join(rarity, "augment_id"), ["champion", "rarity"])
    best = Window.partitionBy("champion", "rarity").orderBy(F.desc(F.round("score", 9)), "augment_id")
    return scored.withColumn("position", F.row_number().over(best)).where(F.col("position") <= n)


def _listed(rows: DataFrame, order: tuple[str, ...], fields: tuple[str, ...], name: str) -> DataFrame:
    """One row for each champion: its ``rows`` as an array in ``order``."""
    out = rows.groupBy("champion").agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("l"))
    return out.select("champion", F.transform("l", lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(name))


def combo_lists(best: DataFrame) -> DataFrame:
    """One row for each champion: all its best pairs and those that are shown first."""
    fields = ("category", "position", "a", "b", "games", "top1_wins", "top3_wins", "placement_sum")
    kept = _listed(best, ("category", "position"), fields, "all_combos")
    return kept.withColumn("champion_combos", F.filter("all_combos", lambda c: c["position"] <= COMBOS_SHOWN))


def champion_documents(rows: DataFrame, ref_items: DataFrame, ref_augments: DataFrame, openers: tuple[int, ...], shardblade: int, stored_combos: DataFrame | None = None) -> DataFrame:
    """One document for each champion that was played.

    Pairs cost the most and change slowly: those of an earlier pass (``combo_lists``)
    are taken as they are where given.
    """
    levels = items.landmark_levels(items.item_acquisitions(rows, ref_items))
    base = with_rates(stats.champion_stats(rows).crossJoin(F.broadcast(patch_match_count(rows))), F.col("matches") * PLAYERS)  # one row
    base = base.withColumnRenamed("matches", "total_matches")
    free = anvil.with_anvil(rows, ref_items).where("anvil")
    every, in_anvil = champion_items(rows, ref_items, levels), champion_items(free, ref_items, levels, F.col("kind") == "prismatic")
    augments = stats.champion_augment_stats(rows, ref_augments, LIST_MIN)
    parts = [
        packed_items(every, LIST_MIN).withColumnRenamed("list", "all_items"),
        packed_items(in_anvil, ANVIL_MIN).withColumnRenamed("list", "anvil_items"),
        packed_augments(augments, LIST_MIN).withColumnRenamed("list", "all_augments"),
        packed_augments(stats.champion_augment_stats(free, ref_augments, ANVIL_MIN), ANVIL_MIN).withColumnRenamed("list", "anvil_augments"),
        _listed(top_augments(augments, ref_augments), ("rarity", "position"), ("rarity", "position", "augment_id", "games"), "top_augments"),
        _listed(top_prismatic_items(every, TOP_PRISMATIC), ("position",), ("position", "item_id", "games"), "top_prismatic"),
        _listed(top_prismatic_items(in_anvil, TOP_ANVIL), ("position",), ("position", "item_id", "games"), "anvil_top_prismatic"),
        _listed(builds.build_selection(builds.build_slots(rows, ref_items)), ("slot", "choice"), ("slot", "choice", "item_id", "games"), "item_build"),
        anvil.champion_anvil_summary(anvil.with_anvil(rows, ref_items), openers, shardblade).select("champion", F.struct(
            "games", "top1_wins", "top3_wins", "avg_placement", "blade_rate", "stat_games", "stat_top3_wins", "other_games", "other_top3_wins").alias("anvil")),
    ]
    if stored_combos is None:
        stored_combos = combo_lists(combos.top_combos(combos.combos(rows, ref_items, ref_augments, COMBO_MIN, ("champion",)), COMBOS_KEPT, ("champion",)))
    out = base
    for part in [*parts, stored_combos]:
        out = out.join(part, "champion", "left")
    return out
