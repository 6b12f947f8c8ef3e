"""Item statistics and their correction for the moment of purchase.

An item that is bought late is bought by players who live long.  Its results
are therefore compared with the mean of all purchases at the same landmark (the
n-th purchase, or the number of prismatic items held) and skill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.counters import with_rates

CELL_MIN = 40
#: Purchase ranks of each band, and acquisitions that an item needs in each.
BANDS, BAND_MIN = (("early", 1, 2), ("mid", 3, 3), ("late", 4, 99)), 60
_SUMS = ("n", "placement_sum", "top1_wins", "top3_wins")


def acquisitions(rows: DataFrame, ref_items: DataFrame) -> DataFrame:
    """One row for each item held: its base form, kind, landmark (null if unknown)."""
    prismatic = ref_items.where("category = 'prismatic'").agg(F.collect_list("id").alias("prismatic"))
    forms = ref_items.select(F.col("id").alias("raw_id"), F.coalesce("canonical_id", "id").alias("base_id"))
    forms = forms.join(ref_items.select(F.col("id").alias("base_id"), "category"), "base_id", "left")
    r = rows.crossJoin(F.broadcast(prismatic))  # one row
    r = r.select("champion", "skill_bucket", "placement", "item_order", F.size(F.filter("items", lambda i: F.array_contains("prismatic", i))).alias("held"), F.explode("items").alias("raw_id"))
    r = r.join(F.broadcast(forms), "raw_id", "left").where("NOT (category <=> 'excluded')")  # a dimension
    item = F.coalesce("base_id", "raw_id")
    rank = F.coalesce(F.nullif(F.array_position("item_order", item), F.lit(0)), F.nullif(F.array_position("item_order", F.col("raw_id")), F.lit(0)))
    special = F.col("category").eqNullSafe("prismatic")
    return r.select(
        "champion", item.alias("item_id"), F.when(special, "prismatic").otherwise("bought").alias("kind"),
        F.when(special, F.col("held")).otherwise(rank).cast("int").alias("landmark"), "skill_bucket", "placement",
    )


def cell() -> list[F.Column]:
    p = F.col("placement")
    return [F.count(F.lit(1)).alias("n"), F.sum(p).cast("long").alias("placement_sum"), F.count_if(p == 1).alias("top1_wins"), F.count_if(p <= 3).alias("top3_wins")]


def _sums() -> list[F.Column]:
    return [F.sum(c).cast("long").alias(c) for c in _SUMS]


def item_acquisitions(rows: DataFrame, ref_items: DataFrame) -> DataFrame:
    """The grid item x kind x landmark x skill; all item statistics are sums of its cells."""
    return acquisitions(rows, ref_items).groupBy("item_id", "kind", "landmark", "skill_bucket").agg(*cell())


def landmark_baselines(grid: DataFrame) -> DataFrame:
    return grid.where("landmark IS NOT NULL").groupBy("kind", "landmark", "skill_bucket").agg(*_sums())


def landmark_levels(grid: DataFrame) -> DataFrame:
    """The baselines at three levels at once: with skill, without, and by kind only."""
    g = grid.where("landmark IS NOT NULL")
    out = g.groupingSets([[F.col("kind"), F.col("landmark"), F.col("skill_bucket")], [F.col("kind"), F.col("landmark")], [F.col("kind")]],
                         F.col("kind"), F.col("landmark"), F.col("skill_bucket"))
    return out.agg(F.grouping_id().cast("int").alias("level"), *_sums())


def item_raw_stats(grid: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return grid.groupBy(*by, "item_id", "kind").agg(*_sums()).withColumnRenamed("n", "games")


def item_adjusted_stats(grid: DataFrame, levels: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Raw counters of each item, of each ``by``, and its placement and rates with the landmarks' effect taken out.

    ``levels`` are the baselines to compare with, those of ``grid`` itself if not given.
    """
    levels = landmark_levels(grid) if levels is None else levels
    mean = lambda p: [(F.col(c) / F.col("n")).alias(f"{p}_{c}") for c in _SUMS[1:]]
    fine = levels.where("level = 0").where(F.col("n") >= CELL_MIN).select("kind", "landmark", "skill_bucket", *mean("fine"))
    coarse = levels.where("level = 1").select("kind", "landmark", *mean("coarse"))
    overall = levels.where("level = 3").select("kind", *mean("all"))
    known = grid.where("landmark IS NOT NULL").join(fine, ["kind", "landmark", "skill_bucket"], "left").join(coarse, ["kind", "landmark"])
    gap = lambda c: F.sum(F.col(c) - F.col("n") * F.coalesce(f"fine_{c}", f"coarse_{c}")).alias(f"gap_{c}")
    gaps = known.groupBy(*by, "item_id", "kind").agg(F.sum("n").alias("known"), *[gap(c) for c in _SUMS[1:]])
    out = item_raw_stats(grid, by).join(gaps, [*by, "item_id", "kind"], "left").join(overall, "kind", "left")

    def tier(c: str, low: int, high: int) -> F.Column:
        fixed = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col(f"all_{c}") + F.col(f"gap_{c}") / F.col("known")))
        return F.when((F.col("known") > 0) & F.col(f"all_{c}").isNotNull(), fixed).otherwise(F.col(c) / F.col("games"))

    return out.select(*by, "item_id", "kind", "games", *_SUMS[1:], tier("placement_sum", 1, 6).alias("tier_placement"),
                      tier("top3_wins", 0, 1).alias("tier_top3"), tier("top1_wins", 0, 1).alias("tier_top1"))


def item_timing_swing(grid: DataFrame, least: int = BAND_MIN) -> DataFrame:
    """How much better a bought item does late than early, against all eligible items."""
    g = grid.where("kind = 'bought' AND landmark IS NOT NULL")
    g = g.groupBy("item_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("landmark").between(lo, hi), F.col(c))), F.lit(0)).cast("long").alias(f"{c}_{name}")
        for name, lo, hi in BANDS for c in ("n", "top3_wins")])
    for name, _, _ in BANDS:
        g = g.where(F.col(f"n_{name}") >= least)
    every = Window.partitionBy(F.lit(0))  # one row for each item
    rate = lambda b: F.col(f"top3_wins_{b}") / F.col(f"n_{b}")
    base = lambda b: F.sum(f"top3_wins_{b}").over(every) / F.sum(f"n_{b}").over(every)
    return g.select("item_id", *[rate(n).alias(f"rate_{n}") for n, _, _ in BANDS], ((rate("late") - base("late")) - (rate("early") - base("early"))).alias("swing"))


def item_rates(grid: DataFrame, matches: DataFrame) -> DataFrame:
    raw = item_raw_stats(grid).crossJoin(F.broadcast(matches))  # one row
    return with_rates(raw, F.col("matches") * 18).drop("matches").orderBy(F.desc("top3_rate"), "item_id")
