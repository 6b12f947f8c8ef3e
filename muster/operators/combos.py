"""Pairs of things that one player held together.

Pairs are made inside the row, so a participation never leaves its task before
partial aggregation; a self-join would shuffle every pick twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.arrays import pairs
from muster.functions.counters import PLAYERS, counters, with_rates
from muster.operators.stats import excluded_ids
from muster.functions.tiers import tier_scores

#: Codes of augments start here, those of items are below.
AUGMENT = 1 << 22


def _picks(rows: DataFrame, ref_items: DataFrame, ref_augments: DataFrame) -> DataFrame:
    base = ref_items.select(F.coalesce("canonical_id", "id").alias("base"), "id").join(
        ref_items.select(F.col("id").alias("base"), "category"), "base", "left")
    forms = base.agg(
        F.map_from_entries(F.collect_list(F.struct("id", "base"))).alias("forms"),
        F.collect_list(F.when(F.col("category").isin("excluded", "boots"), F.col("id"))).alias("never"))
    bad = excluded_ids(ref_augments)
    r = rows.crossJoin(F.broadcast(forms)).crossJoin(F.broadcast(bad))  # one row each
    items = F.transform(F.filter("items", lambda i: ~F.array_contains("never", i)), lambda i: F.coalesce(F.try_element_at("forms", i), i).cast("long"))
    augments = F.transform(F.filter("augments", lambda a: ~F.array_contains("excluded", a)), lambda a: (a + AUGMENT).cast("long"))
    return r.withColumn("codes", F.concat(items, augments))


def combos(rows: DataFrame, ref_items: DataFrame, ref_augments: DataFrame, min_games: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Counters of each pair of codes a < b, for all rows or for each value of ``by``."""
    p = _picks(rows, ref_items, ref_augments).select(*by, "placement", F.explode(pairs(F.col("codes"))).alias("p"))
    # one number for both codes keeps the grouping in generated code
    p = p.select(*by, "placement", (F.col("p.a") * (1 << 23) + F.col("p.b")).alias("pair"))
    out = p.groupBy(*by, "pair").agg(*counters()).where(F.col("games") >= min_games)
    a, b = F.shiftright("pair", 23), F.col("pair").bitwiseAND((1 << 23) - 1)
    kind = F.when(b < AUGMENT, "item-item").when(a >= AUGMENT, "augment-augment").otherwise("item-augment")
    return out.select(*by, a.cast("int").alias("a"), b.cast("int").alias("b"), kind.alias("category"), "games", "top1_wins", "top3_wins", "placement_sum")


def combo_probe(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("games"), F.lit(0)).cast("long").alias("occurrences"))


def top_combos(found: DataFrame, per_category: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The best pairs of each category by tier score."""
    scored = tier_scores(found, [*by, "category"])
    best = Window.partitionBy(*by, "category").orderBy(F.desc(F.round("score", 9)), "a", "b")
    return scored.withColumn("position", F.row_number().over(best)).where(F.col("position") <= per_category)


def combo_rates(found: DataFrame, matches: DataFrame, per_category: int = 200) -> DataFrame:
    """The best pairs of each category with rates; a match has eighteen chances for a pair."""
    best = top_combos(found, per_category).drop("score").crossJoin(F.broadcast(matches))  # one row
    return with_rates(best, F.col("matches") * PLAYERS).drop("matches")
