"""Incremental maintenance of participations and rating rows.

Matches arrive at least once and in any order.  Streams deduplicate within two
hours of event time; what arrives later still meets an idempotent sink, where
of several versions of a match the last one built counts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.functions.counters import counters
from muster.operators.players import latest_name
from muster.operators.ratings import packed_matches
from muster.sources.shared import remove, written

LATE = "2 hours"
PARTICIPATION = "match_id string, patch string, game_creation timestamp, ingested_at timestamp, player_id int, subteam_id int, placement int, champion string"

PACKED = "match_id string, game_creation timestamp, players array<int>, subteams array<int>, placements array<int>, built_at timestamp"


def participations(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A stream of participations from the Parquet files that arrive at ``path``, so many files at a time."""
    return spark.readStream.schema(PARTICIPATION).option("maxFilesPerTrigger", files).parquet(path)


def once(stream: DataFrame) -> DataFrame:
    """Each participation once, however often it is delivered within two hours."""
    return stream.withWatermark("ingested_at", LATE).dropDuplicatesWithinWatermark(["match_id", "player_id"])


def champion_counts(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Champion counters of each window of ingestion; a window is final when its late data is."""
    rows = stream.withWatermark("ingested_at", LATE).groupBy(F.window("ingested_at", width), "patch", "champion").agg(*counters())
    return rows.select("window.start", "window.end", "patch", "champion", "games", "top1_wins", "top3_wins", "placement_sum")


class Upserts:
    """A table of which the newest version of each key counts.

    Rows are kept by bucket of the first key column and by batch: a batch that is
    written again replaces its own files (dynamic partition overwrite) and nothing
    else, and no job overwrites what another has written.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.version, self.buckets = spark, path.rstrip("/"), keys, version, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # ``buckets`` numbers at most

    def stored(self) -> DataFrame | None:
        """All rows that ever came, with bucket and batch."""
        return read_or_none(self.spark, self.path)

    def put(self, rows: DataFrame, batch_id: int) -> None:
        replace(rows.withColumns({"bucket": self.bucket(), "batch": F.lit(batch_id).cast("long")}), self.path, "bucket", "batch")

    def _newest(self, rows: DataFrame, *keep: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in (*self.keys, "bucket", "batch")]
        newest = F.max_by(F.struct(*fields), F.struct(*self.version, "batch"))
        return rows.groupBy(*keep, *self.keys).agg(newest.alias("r")).select(*self.keys, "r.*", *keep)

    def rows(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The newest version of each key, of some ``buckets`` only if given."""
        every = self.stored()
        if every is None:
            return None
        return self._newest(every if buckets is None else every.where(F.col("bucket").isin(buckets)))

    def compact(self, batch_id: int) -> None:
        """Puts the batches up to ``batch_id`` together, under that number.  A job that dies midway
        leaves some rows twice, which count once; run it again."""
        every = self.stored()
        old = [r[0] for r in every.where(F.col("batch") < batch_id).select("batch").distinct().collect()]
        merged = written(self._newest(every.where(F.col("batch") <= batch_id), "bucket").withColumn("batch", F.lit(batch_id).cast("long")), "merged")
        replace(merged, self.path, "bucket", "batch")
        for b in range(self.buckets):
            for k in old:
                remove(self.spark, f"{self.path}/bucket={b}/batch={k}")


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # nothing there yet
        return None


def replace(df: DataFrame, path: str, *by: str) -> None:
    """Writes ``df`` in place of the partitions that it has rows of."""
    df.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


class RatingRows:
    """Packed matches (rating rows), kept up to date from participations that arrive in any order.

    ``parts`` keeps all participations that ever came, by bucket of matches and
    batch: a batch that is written again replaces its own files.  ``rows`` keeps one
    row for each match, by bucket.  A batch packs the matches that it touches anew from
    all their stored participations, so it does not matter how a match is cut into
    batches, and overwrites the buckets of those matches only (dynamic partition
    overwrite).  ``state`` remembers the watermark and the last full sweep, as a log.

    Rows can always be made from parts.  If a job dies while it replaces buckets, the
    stream runs that batch again, and a full sweep packs whatever rows are missing.
    """

    SWEEP, MARGIN = "6 hours", LATE

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, clean: Callable[[DataFrame], DataFrame] = lambda rows: rows):
        self.spark, self.path, self.clean = spark, path.rstrip("/"), clean
        self.parts = Upserts(spark, f"{self.path}/parts", ["match_id", "player_id"], ["ingested_at"], buckets)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` sink for participations."""
        self.parts.put(batch, batch_id)
        every = self.parts.stored()
        if every is not None:
            self._pack(every.where(F.col("batch") == batch_id).select("match_id").distinct())

    def participations(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version of each player's participation in each match."""
        return self.parts.rows(buckets)

    def _pack(self, matches: DataFrame) -> int:
        """Packs ``matches`` (match_id, distinct) anew and gives their number."""
        touched = self.parts.touched(matches)
        if not touched:
            return 0
        rows = self.clean(self.participations(touched).join(matches, "match_id", "left_semi"))
        built = rows.groupBy("match_id").agg(F.max("ingested_at").alias("built_at"))
        fresh = packed_matches(rows.withColumn("game_creation", F.max("game_creation").over(Window.partitionBy("match_id")))).join(built, "match_id")
        fresh = written(fresh, "packed")
        have = read_or_none(self.spark, f"{self.path}/rows")
        every = fresh.withColumn("bucket", self.parts.bucket())
        if have is not None:
            # a match of which nothing is left after cleaning has no row
            every = every.unionByName(have.where(F.col("bucket").isin(touched)).join(matches, "match_id", "left_anti").select(*every.columns))
        every = written(every, "buckets")
        left = {r[0] for r in every.select("bucket").distinct().collect()}
        replace(every, f"{self.path}/rows", "bucket")
        for b in set(touched) - left:  # cleaning took the last match of this bucket
            remove(self.spark, f"{self.path}/rows/bucket={b}")
        return fresh.count()

    def rows(self) -> DataFrame:
        """match_id, game_creation, players, subteams, placements, built_at of every match."""
        have = read_or_none(self.spark, f"{self.path}/rows")
        return have.drop("bucket") if have is not None else self.spark.createDataFrame([], PACKED)

    def todo(self, matches: DataFrame, since: Column | None = None) -> DataFrame:
        """Ingested matches (match_id, ingested_at) without rating rows, or with older ones.

        With ``since``, a watermark, only matches ingested after it are looked at.
        """
        if since is not None:
            matches = matches.where(F.col("ingested_at") > since)
        matches, have = matches.where("ingested_at IS NOT NULL"), read_or_none(self.spark, f"{self.path}/rows")
        if have is None:
            return matches.select("match_id")
        out = matches.join(have.select("match_id", "built_at"), "match_id", "left")
        return out.where(F.col("built_at").isNull() | (F.col("built_at") < F.col("ingested_at"))).select("match_id")

    def state(self) -> tuple[datetime | None, datetime | None]:
        """(watermark, time of the last full sweep), null before the first run."""
        log = read_or_none(self.spark, f"{self.path}/state")
        last = log.agg(F.max("watermark"), F.max("swept")).first() if log is not None else (None, None)
        return last[0], last[1]

    def sync(self, matches: DataFrame, started: datetime) -> int:
        """The periodic job over ``matches`` (match_id, ingested_at): packs what has no row or an
        older one.  It looks at what was ingested after the watermark, two hours before the
        last run, and every six hours at everything.  Gives the number of matches packed.
        """
        watermark, swept = self.state()
        full = swept is None or started - swept > timedelta(hours=int(self.SWEEP.split()[0]))
        todo = self.todo(matches, None if full or watermark is None else F.lit(watermark))
        packed = self._pack(written(todo.distinct(), "todo"))
        log = [(started - timedelta(hours=int(self.MARGIN.split()[0])), started if full else swept)]
        self.spark.createDataFrame(log, "watermark timestamp, swept timestamp").coalesce(1).write.mode("append").parquet(f"{self.path}/state")
        return packed

    def compact(self, batch_id: int) -> None:
        """Puts the stored participations of batches up to ``batch_id`` together."""
        self.parts.compact(batch_id)


def touched_counts(rows: DataFrame, changed: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` (player_id, games) with those of the players of ``changed`` matches counted anew from all rating ``rows``."""
    players = changed.select(F.explode("players").alias("player_id")).distinct()
    seen = rows.select(F.explode("players").alias("player_id")).join(players, "player_id", "left_semi")
    new = seen.groupBy("player_id").agg(F.count(F.lit(1)).alias("games"))
    return counts.join(players, "player_id", "left_anti").unionByName(new)


def new_names(players: DataFrame, seen: DataFrame) -> DataFrame:
    """``players`` (id, puuid, riot_id, ...) with the latest name that ``seen`` (puuid, riot_id, game_creation, match_id) has where it is another."""
    latest = latest_name(seen.where("riot_id IS NOT NULL")).withColumnRenamed("riot_id", "_name")
    return players.join(latest, "puuid", "left").withColumn("riot_id", F.coalesce("_name", "riot_id")).drop("_name").select(*players.columns)


def unarchived(arriving: DataFrame, matches: DataFrame) -> DataFrame:
    """Arriving participations without those of matches that are archived, whose rows must not come back."""
    return arriving.join(matches.where("archived_at IS NOT NULL").select("match_id"), "match_id", "left_anti")


def start_sync(stream: DataFrame, rows: RatingRows, checkpoint: str):
    """Starts the query that keeps ``rows`` up to date."""
    return stream.writeStream.foreachBatch(rows.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
