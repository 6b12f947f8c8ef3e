"""Every query by name, over the season derived from the driver's tables.

Doubles are rounded to six places: engines add in different orders.
"""

from __future__ import annotations

import datetime
import functools
from collections.abc import Callable

from pyarrow import fs

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.functions import tiers
from muster.functions.ladder import skill_bucket
from muster.functions.arrays import canonical
from muster.functions.patches import patch_of
from muster.functions.text import folded, plain_text
from muster.operators import anvil, archive as archiving, builds, champions, combos, comps, crawl, diff, items, limiter, lists, players, ratings, stats, surrogate, views
from muster.plans import sqlfunctions
from muster.sources import documents, lookup, paged
from muster.sources.fixtures import OPENERS, Season, load
from muster.sources.shared import new_folder
from muster.streaming import ingest, ordered, persist

PATCH, BEFORE, OLD = "16.19", "16.18", ("16.8", "16.9")
NOW = "2026-01-02 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f: Callable[[Season], DataFrame]) -> Callable[[Season], DataFrame]:
    """Registers a query over the season."""
    _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(load(spark, sf_dir)))
    return f


def table_query(f: Query) -> Query:
    """Registers a query over the driver's tables."""
    _QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def joined(c: str | F.Column) -> F.Column:
    return F.array_join(c, ",")


def stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def current(s: Season) -> DataFrame:
    return views.patch_rows(s, PATCH)


def archive(s: Season) -> DataFrame:
    return players.career_totals(views.participants_clean(s).where(F.col("patch").isin(*OLD)))


def grid(s: Season) -> DataFrame:
    return items.item_acquisitions(current(s), s.ref_items)


@query
def participants_clean(s):
    out = views.participants_clean(s)
    return out.select("match_id", "player_id", "patch", "subteam_id", "placement", "champion", "skill_bucket", joined("items").alias("items"), joined("augments").alias("augments"), joined("item_order").alias("item_order"))


@query
def participants_published(s):
    return views.participants_published(s).groupBy("patch").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("match_id").alias("matches"))


@query
def afk_teams(s):
    return views.afk_teams(s.participants)


@query
def skill_buckets(s):
    return s.ratings.groupBy(skill_bucket(F.col("tier")).alias("skill_bucket")).agg(F.count(F.lit(1)).alias("players"))


@query
def patch_options(s):
    return views.patch_options(s).select("patch", "matches", stamp("newest").alias("newest"))


@query
def patch_context(s):
    return views.patch_context(s, 5000)


@query
def patch_match_count(s):
    return views.patch_match_count(current(s))


@query
def site_totals(s):
    return views.site_totals(s)


@query
def champion_stats(s):
    return stats.champion_stats(current(s)).drop("placement_counts")


@query
def champion_placement_counts(s):
    return stats.champion_stats(current(s)).select("champion", joined("placement_counts").alias("placement_counts"))


@query
def champion_rates(s):
    return stats.champion_rates(current(s))


@query
def champion_placement_shares(s):
    return stats.placement_shares(current(s))


@query
def previous_patch_champion_totals(s):
    return stats.previous_patch_champion_totals(views.participants_published(s), archive(s), PATCH)


@query
def previous_patch_archived(s):
    return stats.previous_patch_champion_totals(views.participants_published(s), archive(s), BEFORE)


@query
def champion_movers(s):
    before = stats.champion_stats(views.patch_rows(s, BEFORE))
    return stats.champion_movers(stats.champion_stats(current(s)), before, 1.0)


@query
def augment_stats(s):
    return stats.augment_stats(current(s), s.ref_augments)


@query
def champion_augment_stats(s):
    return stats.champion_augment_stats(current(s), s.ref_augments, 5)


@query
def augment_timing(s):
    return stats.augment_timing(current(s), s.ref_augments)


@query
def augment_timing_swing(s):
    return stats.augment_timing_swing(stats.augment_timing(current(s), s.ref_augments))


@query
def item_acquisitions(s):
    return grid(s)


@query
def landmark_baselines(s):
    return items.landmark_baselines(grid(s))


@query
def landmark_grouping_sets(s):
    return items.landmark_levels(grid(s))


@query
def item_raw_stats(s):
    return items.item_raw_stats(grid(s))


@query
def item_rates(s):
    return items.item_rates(grid(s), views.patch_match_count(current(s)))


@query
def item_adjusted_stats(s):
    return items.item_adjusted_stats(grid(s))


@query
def item_timing_swing(s):
    return items.item_timing_swing(grid(s), 20)


@query
def anvil_champions(s):
    return anvil.anvil_champions(anvil.with_anvil(current(s), s.ref_items))


@query
def anvil_overall(s):
    return anvil.anvil_overall(anvil.with_anvil(current(s), s.ref_items))


@query
def anvil_openers(s):
    return anvil.anvil_openers(anvil.with_anvil(current(s), s.ref_items), OPENERS)


@query
def anvil_opener_champions(s):
    return anvil.anvil_opener_champions(anvil.with_anvil(current(s), s.ref_items), OPENERS, 1)


@query
def anvil_opener_comparison(s):
    return anvil.opener_comparison(anvil.anvil_openers(anvil.with_anvil(current(s), s.ref_items), OPENERS))


@query
def champion_anvil_summary(s):
    return anvil.champion_anvil_summary(anvil.with_anvil(current(s), s.ref_items), OPENERS, 1007)


@query
def comp_archetypes(s):
    return comps.comp_archetypes(current(s), s.ref_champions, 5).withColumn("roles", joined("roles"))


@query
def comp_coverage(s):
    return comps.comp_coverage(current(s), 8)


@query
def comp_rates(s):
    return comps.comp_rates(current(s), s.ref_champions, 5).withColumn("roles", joined("roles"))


@query
def combo_stats(s):
    return combos.combos(current(s), s.ref_items, s.ref_augments, 5)


@query
def combo_probe(s):
    return combos.combo_probe(combos.combos(current(s), s.ref_items, s.ref_augments, 5))


@query
def combo_top_by_category(s):
    return combos.top_combos(combos.combos(current(s), s.ref_items, s.ref_augments, 5), 20).drop("score")


@query
def champion_combos(s):
    return combos.combos(current(s), s.ref_items, s.ref_augments, 3, ("champion",))


@query
def build_slots(s):
    return builds.build_slots(current(s), s.ref_items)


@query
def build_selection(s):
    return builds.build_selection(builds.build_slots(current(s), s.ref_items))


def levels(s: Season) -> DataFrame:
    return items.landmark_levels(grid(s))


def free(s: Season) -> DataFrame:
    return anvil.with_anvil(current(s), s.ref_items).where("anvil")


def scored_champions(s: Season) -> DataFrame:
    return tiers.tier_scores(stats.champion_rates(current(s)))


@query
def champion_item_grid(s):
    return champions.champion_item_grid(current(s), s.ref_items, F.col("kind") == "prismatic")


@query
def champion_items(s):
    packed_ = champions.packed_items(champions.champion_items(current(s), s.ref_items, levels(s)), champions.LIST_MIN)
    return packed_.select("champion", F.posexplode("list").alias("pos", "i")).select("champion", "pos", "i.*")


@query
def champion_anvil_items(s):
    packed_ = champions.packed_items(champions.champion_items(free(s), s.ref_items, levels(s), F.col("kind") == "prismatic"), 1)
    return packed_.select("champion", F.posexplode("list").alias("pos", "i")).select("champion", "pos", "i.*")


@query
def champion_top_prismatics(s):
    return champions.top_prismatic_items(champions.champion_items(current(s), s.ref_items, levels(s)), champions.TOP_PRISMATIC).select("champion", "position", "item_id", "games")


@query
def champion_top_augments(s):
    return champions.top_augments(stats.champion_augment_stats(current(s), s.ref_augments, 3), s.ref_augments).select("champion", "rarity", "position", "augment_id", "games")


@query
def champion_documents(s):
    docs = champions.champion_documents(current(s), s.ref_items, s.ref_augments, OPENERS, 1007)
    ids = lambda c, f: joined(F.transform(c, lambda e: e[f])).alias(c)
    return docs.select("champion", "total_matches", "games", "top3_rate", "play_rate", ids("all_items", "item_id"), ids("all_augments", "augment_id"), ids("top_prismatic", "item_id"),
                       F.col("anvil.games").alias("anvil_games"), F.col("anvil.blade_rate").alias("blade_rate"), F.size("champion_combos").alias("combos_shown"))


def _part_lines(part: str, fields: tuple[str, ...]) -> F.Column:
    entry = lambda e: F.concat_ws(",", F.lit(part), *[e[f].cast("string") for f in fields])
    return F.coalesce(F.transform(part, entry), F.array().cast("array<string>"))


@query
def champion_document_parts(s):
    """Every list and number of the champion documents, an entry to a line."""
    docs = champions.champion_documents(current(s), s.ref_items, s.ref_augments, OPENERS, 1007)
    docs = docs.withColumn("totals", F.array(F.struct("total_matches", "games", "top1_wins", "top3_wins", "placement_sum", *[F.round(c, 6).alias(c) for c in ("top3_rate", "top1_rate", "avg_placement", "play_rate")])))
    docs = docs.withColumn("anvil", F.filter(F.array("anvil"), lambda x: x.isNotNull()))
    parts = {
        "totals": ("games", "top1_wins", "top3_wins", "placement_sum", "total_matches"), "all_items": ("item_id", "games"), "anvil_items": ("item_id", "games"), "all_augments": ("augment_id", "games"),
        "anvil_augments": ("augment_id", "games"), "top_augments": ("rarity", "position", "augment_id", "games"), "top_prismatic": ("position", "item_id", "games"),
        "anvil_top_prismatic": ("position", "item_id", "games"), "item_build": ("slot", "choice", "item_id", "games"), "anvil": ("games", "top1_wins", "top3_wins", "stat_games", "stat_top3_wins", "other_games", "other_top3_wins"),
        "all_combos": ("category", "position", "a", "b", "games", "top1_wins", "top3_wins", "placement_sum"), "champion_combos": ("category", "position", "a", "b", "games"),
    }
    lines = [_part_lines(c, fields) for c, fields in parts.items()]
    return docs.select("champion", F.explode(F.concat(*lines)).alias("line"))


@query
def champion_list_ranks(s):
    return lists.ranked(scored_champions(s), "champion").select("champion", "position", "total")


@query
def home_podium(s):
    return lists.podium(scored_champions(s), "champion").select("champion", "position", "on_podium")


@query
def placement_meters(s):
    return lists.placement_meter(stats.champion_rates(current(s))).select("champion", "meter")


@query
def list_sort_keys(s):
    rows = scored_champions(s)
    every = Window.partitionBy(F.lit(0))  # one row for each champion
    at = lambda k, best: F.row_number().over(every.orderBy(lists.order(k, best), "champion"))
    keys = [k for k in lists.COLUMNS if k != "rank"]
    return rows.select("champion", *[at(k, True).alias(f"best_{k}") for k in keys], *[at(k, False).alias(f"worst_{k}") for k in keys])


@query
def list_page(s):
    return lists.page(lists.sorted_list(scored_champions(s), "champion", "games"), 20, 2).select("champion", "games")


@query
def ladder_band_starts(s):
    return lists.band_starts(s.ratings.select("puuid", "rank_position", "tier"), "tier", "rank_position")


@query
def augment_swing_order(s):
    rows = stats.augment_stats(current(s), s.ref_augments)
    timing = stats.augment_timing_swing(stats.augment_timing(current(s), s.ref_augments))
    out = lists.swing_order(rows.select("augment_id", "games"), timing, "augment_id")
    return out.select("augment_id", F.row_number().over(Window.orderBy(F.round("swing", 9).desc_nulls_last(), "augment_id")).alias("position"))  # one row for each augment


@query
def list_tabs(s):
    a = lists.item_tabs(items.item_raw_stats(grid(s))).select(F.lit("items").alias("list"), F.col("item_id").alias("id"), "tab")
    return a.unionByName(lists.augment_tabs(stats.augment_stats(current(s), s.ref_augments), s.ref_augments).select(F.lit("augments").alias("list"), F.col("augment_id").alias("id"), "tab"))


@query
def tier_scores(s):
    return tiers.tier_scores(stats.champion_stats(current(s)).drop("placement_counts")).select("champion", "games", "score")


@query
def tier_letters(s):
    scored = tiers.tier_scores(stats.champion_stats(current(s)).drop("placement_counts")).withColumn("view", F.lit("champions"))
    return tiers.tier_letters(scored, ["view"], ["champion"])


@query
def item_tiers(s):
    scored = tiers.tier_scores(items.item_adjusted_stats(grid(s)), ["kind"], basis=("tier_placement", "tier_top1", "tier_top3"))
    return scored.select("item_id", "kind", "games", "score")


@query
def stat_scale(s):
    return tiers.stat_scale(stats.champion_stats(current(s)))


@query
def stat_verdicts(s):
    rows = stats.champion_stats(current(s)).drop("placement_counts")
    return tiers.verdicts(rows, tiers.stat_scale(rows)).select("champion", "top3_verdict", "top1_verdict", "placement_verdict")


def packed(s: Season) -> DataFrame:
    return ratings.packed_matches(views.participants_clean(s))


@query
def rating_matches_packed(s):
    return packed(s).select("match_id", *[joined(c).alias(c) for c in ("players", "subteams", "placements")])


@query
def rating_match_update(s):
    prior = s.ratings.select(F.col("id").alias("player_id"), "mu", F.lit(ratings.SIGMA * 0.8).alias("sigma"))
    return ratings.match_update(current(s), prior)


@query
def rating_replay(s):
    return ratings.replay(packed(s))


@query
def rating_ladder(s):
    return ratings.ladder(ratings.replay(packed(s)))


@query
def rating_entourage(s):
    return ratings.entourage(views.participants_clean(s), s.ratings.withColumnRenamed("id", "player_id"))


@query
def ladder_positions(s):
    return ratings.ladder(s.ratings.drop("rank_position", "tier").withColumnRenamed("id", "player_id")).select("player_id", "games", "mu", "rank_position")


@query
def ladder_tiers(s):
    ranked = ratings.ladder(s.ratings.drop("rank_position", "tier").withColumnRenamed("id", "player_id"))
    return ranked.groupBy("tier").agg(F.count(F.lit(1)).alias("players"), F.min("rank_position").alias("first"), F.max("rank_position").alias("last"))


@query
def player_counts(s):
    return players.player_counts(packed(s))


@query
def player_profile(s):
    return players.player_profile(views.participants_published(s), archive(s), 61)


@query
def player_top_champions(s):
    return players.player_top_champions(s.participants.where(~F.col("patch").isin(*OLD)), archive(s)).withColumn("champions", joined("champions"))


@query
def leaderboard_top(s):
    return players.leaderboard_top(s.ratings, 100).select("puuid", "riot_id", "games", "top3_wins", "top1_wins", "placement_sum", "rank_position", "tier", "mu")


@query
def leaderboard_search(s):
    return players.leaderboard_search(s.ratings, "PLAYER 1").select("puuid", "riot_id", "rank_position")


@query
def find_player(s):
    return players.find_player(s.players, "player 61#euw")


@query
def rating_players(s):
    return players.rating_players(s.players, 3, 20, 100)


@query
def player_rank(s):
    return players.player_rank(s.ratings, "P0061")


@query
def career_archive_merge(s):
    clean = views.participants_clean(s)
    first = players.career_totals(clean.where(F.col("patch") == OLD[0]))
    return players.archive_merge(first, clean.where(F.col("patch").isin(*OLD)))


@query
def rolled_patches(s):
    return players.rolled_patches(archive(s))


@query
def latest_name_per_player(s):
    name = F.when(F.col("player_id") % 4 != 0, F.concat(F.lit("n"), F.col("player_id"), F.lit("#"), F.col("patch")))
    return players.latest_name(s.participants.select(F.col("player_id").alias("puuid"), name.alias("riot_id"), "game_creation", "match_id"))


@query
def match_cards(s):
    cards = players.match_cards(current(s))
    team = lambda t: F.concat_ws(":", t["placement"].cast("string"), t["subteam_id"].cast("string"), F.array_join(F.transform(t["members"], lambda m: m["champion"]), "+"))
    return cards.select("match_id", F.array_join(F.transform("teams", team), ";").alias("teams"))


@query
def patch_interval_join(s):
    dated = s.matches.where(F.col("mn") % 3 != 0)
    out = crawl.deduce_patches(s.matches.where(F.col("mn") % 3 == 0), crawl.patch_windows(dated))
    return out.select("match_id", "patch_deduced")


@query
def new_match_ids(s):
    return crawl.new_match_ids(s.matches, s.matches.where(F.col("ingested") & (F.col("mn") % 2 == 0)))


@query
def refdata_canonical_items(s):
    """Games of each item that was held, under its base form and with its category."""
    held = current(s).select(F.explode("items").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("held"))
    return held.join(F.broadcast(s.ref_items), "id", "left").select("id", F.coalesce("canonical_id", "id").alias("base_id"), "category", "held")  # a dimension


@table_query
def entity_search(spark, sf_dir):
    """The first names of parts and customers that contain a text, parts first."""
    read = lambda t, c: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("kind"), F.col(c).alias("name"))
    every = read("part", "p_name").unionByName(read("customer", "c_name"))
    return every.where(F.contains(folded(F.col("name")), F.lit("01"))).distinct().orderBy(F.col("kind").desc(), "name").limit(8)


#: Searches over names with accents, signs that are wildcards elsewhere, and two letters.
SEARCHES = ("ELAN#0000001", "0% c", "_c", "\\", "é", "mer#00000013", "no such name", "én", "1")


def odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    before = F.element_at(F.array(*map(F.lit, ("Élan", "50% ", "a_", "b\\", "ÉN "))), (k % 5).cast("int") + 1)
    name = F.when(k % 5 == 0, F.concat(before, F.substring("c_name", 9, 99))).otherwise(F.concat(before, F.col("c_name")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", name.alias("name"))


@table_query
def name_index_search(spark, sf_dir):
    """All customers whose name contains one of several texts, by the index."""
    index = lookup.NameIndex(spark, new_folder(spark, "names"), "c_custkey", "name")
    index.build(odd_names(spark, sf_dir))
    found = [index.search(text).select(F.lit(text).alias("sought"), "c_custkey", "name") for text in SEARCHES]
    return functools.reduce(DataFrame.unionByName, found)


@query
def point_lookup(s):
    """A player by name, and their matches, from tables laid out for lookups."""
    spark = s.players.sparkSession
    root = new_folder(spark, "points")
    lookup.write_points(s.players.withColumn("name_key", F.lower("riot_id")), f"{root}/players", "name_key", ("puuid",))
    lookup.write_points(views.participants_clean(s).select("player_id", "match_id", "champion", "placement"), f"{root}/participations", "player_id", ("match_id",))
    player = lookup.point(spark, f"{root}/players", "name_key", "player 61#euw").select("id", "puuid")
    return player.join(lookup.point(spark, f"{root}/participations", "player_id", 61), F.col("id") == F.col("player_id")).select("puuid", "match_id", "champion", "placement")


@query
def surrogate_ids(s):
    """Ids of players after three loads of matches, the second run twice: how many each load brings, and that they have no gaps."""
    spark = s.participants.sparkSession
    seen = s.participants.select(F.concat(F.lit("P"), F.lpad(F.col("player_id").cast("string"), 4, "0")).alias("puuid"), "match_id")
    ids = surrogate.Dictionary(spark, new_folder(spark, "ids"))
    loads = [seen.where(F.substring_index("match_id", "_", -1).cast("int") % 40 == 0), seen.where(F.substring_index("match_id", "_", -1).cast("int") % 4 == 0), seen]
    for k in (0, 1, 1, 2):
        ids.add(loads[k], "puuid", k)
    return ids.rows().select(F.col("key").alias("puuid"), "id", F.col("batch").cast("int").alias("load"))


@query
def match_persist(s):
    """Players with their latest names and matches with their stamps after two overlapping loads, without archived matches."""
    spark = s.participants.sparkSession
    mn = F.substring_index("match_id", "_", -1).cast("int")
    at = F.expr("TIMESTAMP'2026-01-01 00:00:00'")
    name = F.when(F.col("player_id") % 4 != 0, F.concat(F.lit("n"), F.col("player_id"), F.lit("#"), F.col("patch")))
    rows = s.participants.select("match_id", F.col("game_creation").cast("timestamp").alias("game_creation"), F.concat(F.lit("P"), F.lpad(F.col("player_id").cast("string"), 4, "0")).alias("puuid"),
                                 name.alias("riot_id"), "subteam_id", "placement", "champion", (at + F.make_dt_interval(secs=mn)).alias("arrived_at"))
    archived = s.matches.select("match_id", F.when(F.col("mn") % 9 == 4, at).alias("archived_at"))
    store = persist.MatchStore(spark, new_folder(spark, "store"), 8)
    loads = [rows.where(mn % 3 != 0), rows.where(mn % 3 != 1)]
    for k in (0, 1, 1):
        store.persist(loads[k], k, archived)
    kept = store.participations.rows().groupBy("player_id").agg(F.count(F.lit(1)).alias("games"), F.sum("placement").cast("long").alias("placement_sum"))
    return store.players().join(kept, F.col("id") == F.col("player_id")).select("puuid", "riot_id", "games", "placement_sum")


@query
def patch_boundary_search(s):
    """Where patches begin by bisection, with a third of the versions unknown."""
    m = s.matches.select("match_id", "game_creation", F.when(F.col("mn") % 3 != 1, F.col("patch")).alias("patch"), "mn")
    # the fixture's dates are in no order of patches, so a match's number is its time
    timed = m.select("match_id", (F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'") + F.make_dt_interval(mins=7 * F.col("mn"))).alias("game_creation"), "patch")
    found = crawl.patch_boundaries(timed, ["16.9", "16.18", "16.19", "16.20"])
    return found.select("patch", "position", stamp("starts_at").alias("starts_at"), stamp("previous_at").alias("previous_at"), "minutes")


@table_query
def history_pages(spark, sf_dir):
    """Match histories of customers, newest first, read from a paged service in batch and as a stream: rows of each list by both."""
    paged.register(spark)
    root = new_folder(spark, "history")
    history = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 16).cast("int").alias("list"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"),
                                                                    F.concat(F.lit("M_"), F.col("o_orderkey")).alias("match_id"))
    last = history.agg(F.max("at")).first()[0] or 0
    cut = last // 2
    options = {"service": "muster.sources.paged.HistoryFiles", "path": root, "page_size": "200", "max_pages": "100000", "partitions": "4"}

    def add(rows: DataFrame, until: int) -> None:
        rows.repartition("list").write.mode("append").partitionBy("list").parquet(root)
        files, path = fs.FileSystem.from_uri(root)
        with files.open_output_stream(f"{path}/latest") as f:
            f.write(str(until).encode())

    out = new_folder(spark, "streamed")
    for rows, until in ((history.where(F.col("at") < cut), cut), (history.where(F.col("at") >= cut), last + 1)):
        add(rows, until)
        stream = spark.readStream.format("pages").options(**options).load()
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    batch = spark.read.format("pages").options(**options).load()
    streamed = spark.read.schema(batch.schema).parquet(f"{out}/rows")
    count = lambda df, name: df.groupBy("list").agg(F.count(F.lit(1)).alias(name), F.max("match_id").alias(f"{name}_last"), F.sum("at").alias(f"{name}_sum"))
    return count(batch, "read").join(count(streamed, "streamed"), "list", "full")


@query
def snapshot_diff(s):
    leaf = lambda df: df.select(F.col("champion").alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in ("games", "placement_sum")])).alias("l")).select("key", "l.path", "l.value")
    return diff.snapshot_diff(leaf(stats.champion_stats(views.patch_rows(s, BEFORE))), leaf(stats.champion_stats(current(s))))


@query
def augment_rates(s):
    return stats.augment_rates(current(s), s.ref_augments)


@query
def combo_rates(s):
    return combos.combo_rates(combos.combos(current(s), s.ref_items, s.ref_augments, 5), views.patch_match_count(current(s)), 20)


@query
def leaderboard_rates(s):
    total = s.matches.where("ingested").agg(F.count(F.lit(1)).alias("total_matches"))
    return players.leaderboard_rates(s.ratings, total, 50).select("puuid", "rank_position", "ranked_players", "top3_rate", "top1_rate", "avg_placement", "play_rate")


@query
def rating_matches_page(s):
    after = (datetime.datetime(1995, 1, 20), "M_000010")
    return ratings.rating_matches(packed(s), after, 30).select("match_id", joined("players").alias("players"))


@query
def evolved_items(s):
    forms = {1056: 1036, 1057: 1037, 1058: 1038, 1059: 1039}
    return current(s).select("match_id", "player_id", joined(canonical(F.col("items"), forms)).alias("items"))


@query
def deduced_patches(s):
    version = F.when(F.col("mn") % 5 == 0, "").when(F.col("mn") % 7 != 0, F.col("game_version"))
    return s.matches.select("match_id", patch_of(version, F.lit("16.1")).alias("patch"))


def archive_matches(s: Season) -> tuple[DataFrame, DataFrame]:
    """Matches as the archive step sees them, and when their rating rows were built: every third before the match was ingested."""
    at = lambda x: F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'") + F.make_dt_interval(secs=x)
    mn = F.col("mn")
    m = s.matches.select("match_id", "mn", "patch", F.when(F.col("ingested"), at(mn)).alias("ingested_at"), F.when(mn % 4 == 1, at(mn * 2)).alias("archived_at"))
    return m.drop("mn"), m.select("match_id", F.when(mn % 3 == 0, at(mn - 1)).otherwise(at(mn + 1)).alias("built_at"))


def archive_step(s: Season) -> archiving.Step:
    matches, built = archive_matches(s)
    chosen = archiving.choose(matches, built, views.published_patches(s), 100)
    return archiving.archive_step(matches, s.participants, archive(s), players.rolled_patches(archive(s)), chosen, F.expr(f"TIMESTAMP_NTZ'{NOW}'"))


@query
def archive_totals(s):
    return archive_step(s).totals


@query
def archive_audit(s):
    return archive_step(s).audit


@query
def archive_stamps(s):
    step = archive_step(s)
    left = step.rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("rows_left"))
    return step.matches.join(left, "match_id", "left").select("match_id", stamp("archived_at").alias("archived_at"), F.coalesce("rows_left", F.lit(0)).alias("rows_left"))


@query
def match_documents(s):
    """Match documents made of the season, parsed again."""
    slot = lambda c, i: F.coalesce(F.get(c, i), F.lit(0))
    p = F.struct(F.concat(F.lit("P"), F.lpad(F.col("player_id").cast("string"), 4, "0")).alias("puuid"), F.lit("").alias("riotIdGameName"), F.col("champion").alias("championName"), F.col("subteam_id").alias("playerSubteamId"), "placement",
                 *[slot("augments", i - 1).alias(f"playerAugment{i}") for i in range(1, 7)], *[slot("items", i).alias(f"item{i}") for i in range(7)])
    docs = current(s).groupBy("match_id").agg(F.collect_list(p).alias("participants")).select(F.to_json(F.struct(
        F.struct(F.col("match_id").alias("matchId")).alias("metadata"), F.struct(F.lit(1_700_000_000_000).alias("gameCreation"), "participants").alias("info"))).alias("document"))
    return documents.participants(docs).select("match_id", "puuid", "riot_id", "champion", "subteam_id", "placement", joined("augments").alias("augments"), joined("items").alias("items"))


def champion_payloads(s: Season) -> DataFrame:
    rows = views.participants_published(s).groupBy("patch", "champion").agg(F.count(F.lit(1)).alias("games"), F.sum("placement").cast("long").alias("placement_sum"))
    return rows.select(F.concat(F.lit("champion:"), "champion", F.lit("@"), "patch").alias("key"), F.to_json(F.struct(F.struct("games", "placement_sum").alias("stat"))).alias("payload"))


DOCUMENT_PATHS = {"games": ("$.stat.games", "long"), "placement_sum": ("$.stat.placement_sum", "long")}


@query
def stored_documents(s):
    """Champion statistics as stored JSON documents, and two fields read back from those of one patch."""
    return documents.projected(champion_payloads(s), f"champion:%@{PATCH}", DOCUMENT_PATHS)


@query
def shredded_documents(s):
    """The same from documents that are stored as variants, whose fields are columns in the files."""
    spark = s.participants.sparkSession
    root = new_folder(spark, "documents")
    documents.write_shredded(champion_payloads(s), root)
    return documents.shredded(spark, root, f"champion:%@{PATCH}", DOCUMENT_PATHS)


@table_query
def reference_etl(spark, sf_dir):
    """Items and augments from documents made of parts, a document for each size of part; a tenth of the items has a category by hand."""
    part, k = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey")
    curated = part.where(k % 10 == 3).select(k.cast("int").alias("id"), F.lit("boots").alias("category"))
    item = F.struct(F.col("p_name").alias("name"), F.create_map(F.lit("30"), k % 3 != 0, F.lit("11"), F.lit(True)).alias("maps"))
    shop = part.groupBy("p_size").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(k.cast("string"), item))).alias("data"))).alias("document"))
    rarity = F.element_at(F.array(*map(F.lit, ("kSilver", "kGold", "kPrismatic", "kBronze", "kOther"))), (k % 5).cast("int") + 1)
    folder = F.element_at(F.array(*map(F.lit, ("/x/Cherry/a.png", "/x/kiwi/b.png", "/x/strawberry/cherry/c.png", "/x/other/d.png"))), (k % 4).cast("int") + 1)
    augment = F.struct(k.alias("id"), F.when(k % 7 != 0, F.col("p_name")).otherwise("").alias("nameTRA"), rarity.alias("rarity"), folder.alias("augmentSmallIconPath"))
    picks = part.groupBy("p_size").agg(F.to_json(F.collect_list(augment)).alias("document"))
    shown = lambda df, kind, tier: df.select(F.lit(kind).alias("kind"), "id", "name", tier.alias("tier"), "category")
    return shown(documents.reference_items(shop, curated), "item", F.lit(None).cast("string")).unionByName(shown(documents.reference_augments(picks, curated), "augment", F.col("tier")))


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    at = lambda x: F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'") + F.make_dt_interval(secs=x)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("Q"), F.lpad(k.cast("string"), 7, "0")).alias("puuid"), (k % 3).cast("int").alias("priority"),
        F.when(k % 4 != 0, at(k * 7919 % 86400)).alias("last_crawled_at"), at(k * 31 % 5000).alias("discovered_at"), (k % 7).cast("int").alias("error_count"),
        F.when(k % 11 == 0, at(43200 + k % 40000)).alias("requested_at"))


@table_query
def crawl_queue_pick(spark, sf_dir):
    return crawl.pick_players(crawl_queue(spark, sf_dir), 60, F.expr(f"TIMESTAMP_NTZ'{NOW}'"))


@table_query
def queue_after_visits(spark, sf_dir):
    queue = crawl_queue(spark, sf_dir)
    visits = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 5 < 2").select(
        F.concat(F.lit("Q"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("puuid"), (F.col("c_custkey") % 5 == 0).alias("ok"))
    out = crawl.after_visits(queue, visits, F.expr(f"TIMESTAMP_NTZ'{NOW}'"))
    return out.select("puuid", "error_count", stamp("last_crawled_at").alias("last_crawled_at"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")


#: Two requests in half a day, five in five days.
REQUEST_LIMITS = ((2, 43_200), (5, 432_000))


@table_query
def rate_limit_waits(spark, sf_dir):
    return limiter.limited(requests(spark, sf_dir), "user_id", REQUEST_LIMITS)


@table_query
def rate_limit_refusals(spark, sf_dir):
    return limiter.limited(requests(spark, sf_dir), "user_id", REQUEST_LIMITS, 86_400)


@table_query
def rate_limit_paced(spark, sf_dir):
    return limiter.paced(requests(spark, sf_dir), "user_id", REQUEST_LIMITS).select("event_id", "user_id", (F.col("go") - F.col("t")).alias("wait_us"))


def queue_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games and ladder positions of two thirds of the queue and of some who are not in it."""
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 12 == 1, F.lit("Z")).otherwise(F.lit("Q")), F.lpad(k.cast("string"), 7, "0"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(k % 3 != 2).select(name.alias("puuid"), (k * 13 % 50).alias("games"), (k * 7 % 1009).cast("int").alias("rank_position"))


@table_query
def queue_promoted(spark, sf_dir):
    return crawl.promote_tracked(crawl_queue(spark, sf_dir), queue_players(spark, sf_dir), 20).select("puuid", "priority", "error_count")


@table_query
def queue_ladder_top(spark, sf_dir):
    return crawl.mark_ladder_top(crawl_queue(spark, sf_dir), queue_players(spark, sf_dir), 300).select("puuid", "priority", "error_count")


@table_query
def requested_players(spark, sf_dir):
    return crawl.pick_requested(crawl_queue(spark, sf_dir), 25).select("puuid")


@table_query
def timeline_item_order(spark, sf_dir):
    flag = F.col("l_returnflag")
    kind = F.when(flag == "R", "ITEM_SOLD").when(flag == "A", "ITEM_UNDO").otherwise("ITEM_PURCHASED")
    events = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_linenumber", kind.alias("type"), (F.col("l_partkey") % 60 + 1000).cast("int").alias("item_id"))
    return crawl.timeline_item_order(events, ["l_orderkey"], ["l_shipdate", "l_linenumber"]).withColumn("item_order", joined("item_order"))


@table_query
def timeline_documents(spark, sf_dir):
    """Timeline documents made of line items, one frame for each, parsed and replayed."""
    flag = F.col("l_returnflag")
    kind = F.when(flag == "R", "ITEM_SOLD").when(flag == "A", "ITEM_UNDO").otherwise("ITEM_PURCHASED")
    item = (F.col("l_partkey") % 60 + 1000).cast("int")
    e = F.struct("l_shipdate", "l_linenumber", kind.alias("type"), F.when(flag != "A", item).alias("itemId"), F.when(flag == "A", item).alias("beforeId"), (F.col("l_orderkey") % 18).cast("int").alias("participantId"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("mn", F.expr("l_orderkey div 18"))
    frames = lines.groupBy("mn").agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: F.struct(F.array(x).alias("events"))).alias("frames"))
    docs = frames.select(F.to_json(F.struct(F.struct(F.col("mn").cast("string").alias("matchId")).alias("metadata"), F.struct("frames").alias("info"))).alias("document"))
    orders = crawl.timeline_item_order(documents.timeline_events(docs), ["match_id", "participant"], ["position"])
    return orders.select((F.col("match_id").cast("long") * 18 + F.col("participant")).alias("l_orderkey"), joined("item_order").alias("item_order"))


@table_query
def admission_control(spark, sf_dir):
    return crawl.admitted(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", 3, 86_400)


@table_query
def admission_stream(spark, sf_dir):
    """Events as a stream of files that each hold all times, and a last one that lets the watermark pass them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    root = new_folder(spark, "admission")
    events.repartition(3, "event_id").write.parquet(f"{root}/in")
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), "ts")
    closing.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    out = ordered.admitted_stream(stream, 3, 86_400, "90 days")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").where("event_id >= 0")


@query
def rating_rows_incremental(s):
    """Rating rows after four batches, which cut every match in three and come out of order, one of them twice."""
    rows = s.participants.select("match_id", "patch", "game_creation", F.to_timestamp(F.lit(NOW)).alias("ingested_at"), "player_id", "subteam_id", "placement", "champion", "team_left")
    store = ingest.RatingRows(rows.sparkSession, new_folder(rows.sparkSession, "rating"), 16, lambda r: r.where("NOT team_left"))
    third = F.pmod(F.xxhash64("match_id", "player_id"), F.lit(3))
    for k in (2, 0, 2, 1):
        store.merge(rows.where(third == k), k)
    return store.rows().select("match_id", *[joined(c).alias(c) for c in ("players", "subteams", "placements")])


@table_query
def sliding_rate_window(spark, sf_dir):
    return crawl.sliding_counts(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts"), ["user_id"], 86_400).drop("ts")


@table_query
def accent_fold_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.where(F.contains(folded(F.col("text")), F.lit("ecole")) | F.contains(folded(F.col("text")), F.lit("elle"))).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))


#: Queries that call the SQL functions; each gives what the query of the same name without ``sql_`` gives.
SQL_CALLS = {
    "champion_stats": f"SELECT * FROM champion_stats('{PATCH}')",
    "champion_rates": f"SELECT * FROM champion_rates('{PATCH}')",
    "champion_placement_counts": f"SELECT champion, array_join(placement_counts, ',') AS placement_counts FROM champion_placement_counts('{PATCH}')",
    "augment_stats": f"SELECT * FROM augment_stats('{PATCH}')",
    "champion_augment_stats": f"SELECT * FROM champion_augment_stats('{PATCH}')",
    "augment_timing": f"SELECT * FROM augment_timing('{PATCH}')",
    "comp_archetypes": f"SELECT array_join(roles, ',') AS roles, * EXCEPT (roles) FROM comp_archetypes('{PATCH}', 5)",
    "patch_match_count": f"SELECT * FROM patch_match_count('{PATCH}')",
    "patch_options": "SELECT patch, matches, date_format(newest, 'yyyy-MM-dd HH:mm:ss') AS newest FROM patch_options()",
    "site_totals": "SELECT * FROM site_totals()",
    "leaderboard_top": "SELECT * FROM leaderboard_top(100)",
    "player_rank": "SELECT * FROM player_rank('P0061')",
    "find_player": "SELECT * FROM find_player('player 61#euw')",
}
for _name, _call in SQL_CALLS.items():
    _QUERIES[f"sql_{_name}"] = lambda spark, sf_dir, call=_call: rounded(sqlfunctions.call(load(spark, sf_dir), call))


@table_query
def html_to_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", plain_text(F.col("html")).alias("text"))
