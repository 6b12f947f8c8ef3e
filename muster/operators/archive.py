"""Archiving: matches of patches that are not published any more become totals of their players."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.players import archive_merge, career_totals

PUBLISHED = 2


@dataclass(frozen=True)
class Step:
    """What one archive step leaves: totals, the audit by patch, matches with their stamp, and the rows that stay."""

    totals: DataFrame
    audit: DataFrame
    matches: DataFrame
    rows: DataFrame


def choose(matches: DataFrame, rating_rows: DataFrame, published: DataFrame, most: int) -> DataFrame:
    """match_id, patch of the next matches to archive, ``most`` of them.

    They are ingested, of a known patch that is not published, not archived, and
    have rating rows built since they were ingested.  Nothing is chosen unless
    two patches are published, as it is not known then what is old.
    """
    fresh = rating_rows.select("match_id", "built_at")
    old = matches.where(F.col("archived_at").isNull() & F.col("ingested_at").isNotNull() & F.col("patch").isNotNull())
    old = old.join(fresh, "match_id").where(F.col("built_at") >= F.col("ingested_at"))
    known = published.select("patch").distinct()
    enough = known.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PUBLISHED).select()
    chosen = old.join(F.broadcast(known), "patch", "left_anti").crossJoin(F.broadcast(enough))  # two rows, one row
    return chosen.orderBy("match_id").limit(most).select("match_id", "patch")


def archive_step(matches: DataFrame, rows: DataFrame, totals: DataFrame, audit: DataFrame, chosen: DataFrame, now: Column) -> Step:
    """Adds the chosen matches' clean participations to ``totals`` and ``audit`` and takes all their rows away.

    ``rows`` are participations with ``team_left``; ``totals`` are by player,
    champion and patch; ``audit`` has patch, participations, rows_written.
    """
    ids = chosen.select("match_id")
    gone = rows.where(~F.col("team_left")).drop("patch").join(chosen, "match_id")
    counted = career_totals(gone)
    step = counted.groupBy("patch").agg(F.sum("games").cast("long").alias("participations"), F.count(F.lit(1)).alias("rows_written"))
    audited = audit.unionByName(step).groupBy("patch").agg(*[F.sum(c).cast("long").alias(c) for c in ("participations", "rows_written")])
    stamped = matches.join(ids.withColumn("_now", F.lit(True)), "match_id", "left")
    stamped = stamped.withColumn("archived_at", F.when(F.col("_now"), now).otherwise(F.col("archived_at"))).drop("_now")
    return Step(archive_merge(totals, gone), audited, stamped, rows.join(ids, "match_id", "left_anti"))
