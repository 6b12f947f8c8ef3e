"""Clean and published participations, patches and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.patches import patch_key
from muster.sources.fixtures import AFK_ITEMS, Season


def afk_teams(participants: DataFrame) -> DataFrame:
    """Teams of which a member bought an item that marks leaving."""
    left = F.arrays_overlap("items", F.array(*map(F.lit, AFK_ITEMS)))
    return participants.where(left).select("match_id", "subteam_id").distinct()


def participants_clean(s: Season) -> DataFrame:
    """Participations of the teams that nobody left; the written season marks the others."""
    return s.participants.where("NOT team_left").drop("team_left")


def patch_options(s: Season, min_matches: int = 5) -> DataFrame:
    """Patches with enough matches, newest first."""
    seen = s.matches.where(F.col("patch").isNotNull() & F.col("ingested"))
    seen = seen.groupBy("patch").agg(F.count(F.lit(1)).alias("matches"), F.max("game_creation").alias("newest"))
    return seen.where(F.col("matches") >= min_matches).orderBy(patch_key(F.col("patch")).desc())


def published_patches(s: Season, min_matches: int = 5) -> DataFrame:
    return patch_options(s, min_matches).limit(2).select("patch")


def participants_published(s: Season, min_matches: int = 5) -> DataFrame:
    """Clean rows of the two newest patches with enough matches."""
    return participants_clean(s).join(F.broadcast(published_patches(s, min_matches)), "patch", "left_semi")  # two rows


def patch_rows(s: Season, patch: str) -> DataFrame:
    """Clean rows of one patch, whether published or archived; only that patch is read."""
    return participants_clean(s).where(F.col("patch") == patch)


def patch_match_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("match_id").alias("matches"))


def patch_context(s: Season, at_least: int) -> DataFrame:
    """The two newest patches and which of them is shown first: the newest, unless it
    has fewer matches than ``at_least`` and there is another."""
    top = patch_options(s).limit(2).withColumn("age", F.row_number().over(Window.orderBy(patch_key(F.col("patch")).desc())))  # two rows
    both = Window.partitionBy(F.lit(0))
    young = F.max(F.when(F.col("age") == 1, F.col("matches"))).over(both) < at_least
    shown = F.when(young & (F.count(F.lit(1)).over(both) > 1), 2).otherwise(1)
    return top.select("patch", "matches", (F.col("age") == shown).alias("is_default"))


def site_totals(s: Season) -> DataFrame:
    a = s.matches.where("ingested").agg(F.count(F.lit(1)).alias("total_matches"))
    b = s.participants.agg(F.countDistinct("champion").alias("total_champions"))
    c = s.players.agg(F.count(F.lit(1)).alias("total_players"))
    return a.crossJoin(b).crossJoin(c)  # one row each
