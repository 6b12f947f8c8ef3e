"""Matches as they arrive, in four tables: players, participations, matches, in this order.

A batch of participations with their match, player and name is kept so that a
reader who sees a match as ingested sees all of it, and so that running a batch again
changes nothing:

1. participations of archived matches are skipped,
2. new players get ids, which stay theirs, and known ones the name of their latest match,
3. participations are put in place of older versions of themselves,
4. the match is stamped as ingested, last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.surrogate import Dictionary
from muster.sources.shared import written
from muster.streaming.ingest import Upserts, unarchived


class MatchStore:
    """``batch`` rows: match_id, game_creation, puuid, riot_id, subteam_id, placement, champion, arrived_at."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.ids = Dictionary(spark, f"{self.path}/ids")
        self.names = Upserts(spark, f"{self.path}/names", ["puuid"], ["game_creation", "match_id"], buckets)
        self.participations = Upserts(spark, f"{self.path}/participations", ["match_id", "player_id"], ["ingested_at"], buckets)
        self.matches = Upserts(spark, f"{self.path}/matches", ["match_id"], ["ingested_at"], buckets)

    def players(self) -> DataFrame:
        """id, puuid, riot_id."""
        names = self.names.rows()
        ids = self.ids.rows().select("id", F.col("key").alias("puuid"))
        return ids.join(names.select("puuid", "riot_id"), "puuid", "left").select("id", "puuid", "riot_id") if names is not None else ids.withColumn("riot_id", F.lit(None).cast("string"))

    def persist(self, batch: DataFrame, batch_id: int, archived: DataFrame | None = None) -> None:
        """Keeps ``batch`` as number ``batch_id``; ``archived`` (match_id, archived_at) are matches whose rows are gone on purpose."""
        if archived is not None:
            batch = unarchived(batch, archived)
        batch = written(batch, "arriving")
        ids = self.ids.add(batch, "puuid", batch_id)
        seen = batch.where("riot_id IS NOT NULL").groupBy("puuid").agg(F.max_by(F.struct("riot_id", "game_creation", "match_id"), F.struct("game_creation", "match_id")).alias("n"))
        self.names.put(seen.select("puuid", "n.*"), batch_id)
        rows = batch.join(ids.withColumnRenamed("key", "puuid"), "puuid").withColumnsRenamed({"id": "player_id", "arrived_at": "ingested_at"})
        self.participations.put(rows.select("match_id", "player_id", "game_creation", "subteam_id", "placement", "champion", "ingested_at"), batch_id)
        stamped = rows.groupBy("match_id").agg(F.min("game_creation").alias("game_creation"), F.max("ingested_at").alias("ingested_at"))
        self.matches.put(stamped, batch_id)
