"""Team compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.counters import counters, with_rates


def comp_archetypes(rows: DataFrame, ref_champions: DataFrame, min_teams: int) -> DataFrame:
    """Counters of the sorted roles of full teams whose roles are all known."""
    roles = ref_champions.select(F.lower("id").alias("_id"), "role")
    r = rows.join(F.broadcast(roles), F.lower("champion") == F.col("_id"), "left")  # a dimension
    teams = r.groupBy("match_id", "subteam_id").agg(
        F.min("placement").alias("placement"), F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_list("role")).alias("roles"))
    teams = teams.where((F.col("members") == 3) & (F.size("roles") == 3))
    return teams.groupBy("roles").agg(*counters()).where(F.col("games") >= min_teams)


def full_teams(rows: DataFrame) -> DataFrame:
    teams = rows.groupBy("match_id", "subteam_id").agg(F.array_sort(F.collect_list("champion")).alias("champions"))
    return teams.where(F.size("champions") == 3)


def comp_coverage(rows: DataFrame, usable: int) -> DataFrame:
    """How often trios and duos of champions repeat; one row."""
    trios = full_teams(rows).groupBy("champions").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("champions")
    duo = F.explode(F.array(F.struct(c[0].alias("a"), c[1].alias("b")), F.struct(c[0].alias("a"), c[2].alias("b")), F.struct(c[1].alias("a"), c[2].alias("b"))))
    duos = trios.select(duo.alias("d"), "n").groupBy("d").agg(F.sum("n").alias("n"))
    left = trios.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_teams"), F.count(F.lit(1)).alias("distinct_trios"), F.count_if(F.col("n") > 1).alias("repeated_trios"))
    right = duos.agg(F.count(F.lit(1)).alias("distinct_duos"), F.count_if(F.col("n") >= usable).alias("usable_duos"))
    return left.crossJoin(right)  # one row each


def comp_rates(rows: DataFrame, ref_champions: DataFrame, min_teams: int) -> DataFrame:
    total = full_teams(rows).agg(F.count(F.lit(1)).alias("teams"))
    out = comp_archetypes(rows, ref_champions, min_teams).crossJoin(F.broadcast(total))  # one row
    return with_rates(out, F.col("teams")).drop("teams")
