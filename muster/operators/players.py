"""Careers, favourites and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.functions.counters import added, counters, with_rates


def career_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("player_id", "champion", "patch").agg(*counters())


def archive_merge(archive: DataFrame, gone: DataFrame) -> DataFrame:
    """The archive with the counters of participations that are archived now added."""
    return archive.unionByName(career_totals(gone)).groupBy("player_id", "champion", "patch").agg(*added())


def rolled_patches(archive: DataFrame) -> DataFrame:
    return archive.groupBy("patch").agg(F.sum("games").cast("long").alias("participations"), F.count(F.lit(1)).alias("rows_written"))


def player_profile(live: DataFrame, archive: DataFrame, player_id: int) -> DataFrame:
    """A player's champions over live and archived games, most played first."""
    mine = live.where(F.col("player_id") == player_id).groupBy("champion").agg(*counters())
    old = archive.where(F.col("player_id") == player_id).select("champion", "games", "top1_wins", "top3_wins", "placement_sum")
    out = mine.unionByName(old).groupBy("champion").agg(*added())
    return with_rates(out, F.sum("games").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("games"), "champion")  # one player's champions


def player_top_champions(raw: DataFrame, archive: DataFrame, top: int = 3) -> DataFrame:
    """Each player's most played champions; live games count as they are, clean or not."""
    live = raw.groupBy("player_id", "champion").agg(F.count(F.lit(1)).alias("games"))
    old = archive.groupBy("player_id", "champion").agg(F.sum("games").cast("long").alias("games"))
    both = live.unionByName(old).groupBy("player_id", "champion").agg(F.sum("games").alias("games"))
    best = Window.partitionBy("player_id").orderBy(F.desc("games"), "champion")
    both = both.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top)
    out = both.groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("n", "champion"))).alias("c"))
    return out.select("player_id", F.col("c.champion").alias("champions"))


def leaderboard_top(ratings: DataFrame, rows: int = 1000) -> DataFrame:
    return ratings.orderBy("rank_position").limit(rows)


def leaderboard_rates(ratings: DataFrame, total_matches: DataFrame, rows: int = 1000) -> DataFrame:
    """The top of the ladder with rates, where the play rate is of all matches, and the ladder's length."""
    size = ratings.agg(F.count(F.lit(1)).alias("ranked_players"))
    out = leaderboard_top(ratings, rows).crossJoin(F.broadcast(total_matches)).crossJoin(F.broadcast(size))  # one row each
    return with_rates(out, F.col("total_matches"))


def leaderboard_search(ratings: DataFrame, text: str, rows: int = 25) -> DataFrame:
    """Players whose name contains ``text`` in any case; all characters are literal."""
    found = ratings.where(F.contains(F.lower("riot_id"), F.lit(text.lower()))) if len(text) > 1 else ratings.limit(0)
    return found.orderBy("rank_position").limit(rows)


def find_player(players: DataFrame, riot_id: str) -> DataFrame:
    return players.where(F.lower("riot_id") == riot_id.lower()).select("puuid", "riot_id").limit(1)


def rating_players(players: DataFrame, min_games: int, after: int = 0, page: int = 1000) -> DataFrame:
    out = players.where((F.col("games") >= min_games) & (F.col("id") > after)).orderBy("id").limit(page)
    return out.select(F.col("id").alias("player_id"), "puuid", F.coalesce("riot_id", "puuid").alias("riot_id"), "games")


def player_rank(ratings: DataFrame, puuid: str) -> DataFrame:
    total = ratings.agg(F.count(F.lit(1)).alias("ranked_players"))
    return ratings.where(F.col("puuid") == puuid).select("puuid", "rank_position", "tier").crossJoin(F.broadcast(total))  # one row


def player_counts(packed: DataFrame) -> DataFrame:
    """Games of each player from packed matches."""
    return packed.select(F.explode("players").alias("player_id")).groupBy("player_id").agg(F.count(F.lit(1)).alias("games"))


def latest_name(seen: DataFrame) -> DataFrame:
    """The name that each player had in their latest match."""
    return seen.groupBy("puuid").agg(F.max_by("riot_id", F.struct("game_creation", "match_id")).alias("riot_id"))


def match_cards(rows: DataFrame) -> DataFrame:
    """One row for each match: teams by placement, each with its players."""
    teams = rows.groupBy("match_id", "subteam_id").agg(F.min("placement").alias("placement"), F.array_sort(F.collect_list(F.struct("player_id", "champion"))).alias("members"))
    out = teams.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("placement", "subteam_id", "members"))).alias("teams"))
    return out
