"""The statistics as SQL table functions: ``SELECT * FROM champion_stats('16.19')``.

``register`` makes views of a season and temporary functions over them.  A function's
body is plain SQL over its parameters that Spark puts into the caller's plan, so a
patch given as a literal reads that patch's folder only, and columns that are not
asked for are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from muster.functions.counters import PLAYERS, TOP3
from muster.operators import views
from muster.operators.stats import TIMING_SLOTS
from muster.sources.fixtures import Season

_COUNTERS = "games BIGINT, top1_wins BIGINT, top3_wins BIGINT, placement_sum BIGINT"
_COUNT = f"count(*) AS games, count_if(placement = 1) AS top1_wins, count_if(placement <= {TOP3}) AS top3_wins, CAST(sum(placement) AS BIGINT) AS placement_sum"
_RATES = "top3_rate DOUBLE, top1_rate DOUBLE, avg_placement DOUBLE, play_rate DOUBLE"
_RATE = "top3_wins / games AS top3_rate, top1_wins / games AS top1_rate, placement_sum / games AS avg_placement, games / total AS play_rate"
_PICKS = """(SELECT champion, placement, explode(augments) AS augment_id FROM season_participants WHERE patch = p) picks
    LEFT ANTI JOIN season_excluded_augments e ON e.id = augment_id"""
_TEAMS = """(SELECT min(placement) AS placement, array_sort(collect_list(role)) AS roles FROM season_participants
    LEFT JOIN season_champions c ON lower(c.id) = lower(champion) WHERE patch = p GROUP BY match_id, subteam_id HAVING count(*) = 3 AND count(role) = 3)"""
#: name: (parameters, columns, body)
FUNCTIONS = {
    "champion_stats": ("p STRING", f"champion STRING, {_COUNTERS}", f"SELECT champion, {_COUNT} FROM season_participants WHERE patch = p GROUP BY champion"),
    "champion_rates": (
        "p STRING", f"champion STRING, {_COUNTERS}, {_RATES}",
        f"""SELECT champion, games, top1_wins, top3_wins, placement_sum, {_RATE} FROM (SELECT champion, {_COUNT} FROM season_participants WHERE patch = p GROUP BY champion)
            CROSS JOIN (SELECT {PLAYERS} * count(DISTINCT match_id) AS total FROM season_participants WHERE patch = p)"""),
    "champion_placement_counts": (
        "p STRING", "champion STRING, placement_counts ARRAY<BIGINT>",
        f"SELECT champion, array({', '.join(f'count_if(placement = {i})' for i in range(1, 7))}) FROM season_participants WHERE patch = p GROUP BY champion"),
    "augment_stats": ("p STRING", f"augment_id INT, {_COUNTERS}", f"SELECT augment_id, {_COUNT} FROM {_PICKS} GROUP BY augment_id"),
    "champion_augment_stats": (
        "p STRING, least BIGINT DEFAULT 5", f"champion STRING, augment_id INT, {_COUNTERS}",
        f"SELECT * FROM (SELECT champion, augment_id, {_COUNT} FROM {_PICKS} GROUP BY champion, augment_id) WHERE games >= least"),
    "augment_timing": (
        "p STRING", f"slot INT, augment_id INT, {_COUNTERS}",
        f"""SELECT slot + 1, augment_id, {_COUNT} FROM (
                SELECT placement, posexplode(slice(array_except(augments, (SELECT collect_list(id) FROM season_excluded_augments)), 1, {TIMING_SLOTS})) AS (slot, augment_id)
                FROM season_participants WHERE patch = p) GROUP BY slot, augment_id"""),
    "comp_archetypes": ("p STRING, least BIGINT", f"roles ARRAY<STRING>, {_COUNTERS}", f"SELECT * FROM (SELECT roles, {_COUNT} FROM {_TEAMS} GROUP BY roles) WHERE games >= least"),
    "patch_match_count": ("p STRING", "matches BIGINT", "SELECT count(DISTINCT match_id) FROM season_participants WHERE patch = p"),
    "patch_options": (
        "least BIGINT DEFAULT 5", "patch STRING, matches BIGINT, newest TIMESTAMP_NTZ",
        "SELECT * FROM (SELECT patch, count(*) AS matches, max(game_creation) AS newest FROM season_matches WHERE ingested AND patch IS NOT NULL GROUP BY patch) WHERE matches >= least"),
    "site_totals": (
        "", "total_matches BIGINT, total_champions BIGINT, total_players BIGINT",
        "SELECT (SELECT count(*) FROM season_matches WHERE ingested), (SELECT count(DISTINCT champion) FROM season_every), (SELECT count(*) FROM season_players)"),
    "leaderboard_top": (
        "n INT DEFAULT 1000", "puuid STRING, riot_id STRING, games BIGINT, top3_wins BIGINT, top1_wins BIGINT, placement_sum BIGINT, rank_position INT, tier STRING, mu DOUBLE",
        "SELECT puuid, riot_id, games, top3_wins, top1_wins, placement_sum, rank_position, tier, mu FROM season_ratings WHERE rank_position <= n"),
    "player_rank": (
        "player STRING", "puuid STRING, rank_position INT, tier STRING, ranked_players BIGINT",
        "SELECT puuid, rank_position, tier, n FROM season_ratings CROSS JOIN (SELECT count(*) AS n FROM season_ratings) WHERE puuid = player"),
    "find_player": ("name STRING", "puuid STRING, riot_id STRING", "SELECT puuid, riot_id FROM season_players WHERE lower(riot_id) = lower(name)"),
}


def register(s: Season) -> SparkSession:
    """The season's session, with its views and all functions."""
    spark = s.participants.sparkSession
    given = {
        "season_participants": views.participants_clean(s), "season_every": s.participants, "season_matches": s.matches, "season_players": s.players, "season_ratings": s.ratings,
        "season_champions": s.ref_champions, "season_excluded_augments": s.ref_augments.where("category = 'excluded'").select("id"),
    }
    for name, df in given.items():
        df.createOrReplaceTempView(name)
    for name, (parameters, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return spark


def call(s: Season, query: str) -> DataFrame:
    return register(s).sql(query)
