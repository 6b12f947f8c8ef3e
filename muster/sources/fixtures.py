"""A season of ranked matches derived from the driver's star-schema tables.

The rules are those of FIXTURES.md: eighteen consecutive orders are one match,
an order is a participation, its line items are the purchases.

The season is derived once and written to the shared folder, participations by
patch, so that a query about one patch reads that patch and the columns it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.functions.arrays import ordered_by_first
from muster.functions.ladder import ladder_tier, positions, skill_bucket
from muster.sources.shared import Versions, exists, new_folder

PATCHES = ("16.8", "16.9", "16.18", "16.19")
AFK_ITEMS = (220008, 220009, 220010, 220011)
EXCLUDED_AUGMENTS = (5, 13)
OPENERS = (3, 7, 11, 19)
ROLES = ("Assassin", "Fighter", "Mage", "Marksman", "Support", "Tank")


@dataclass(frozen=True)
class Season:
    """The relations that every operator starts from.

    ``participants`` has the player's skill_bucket, and ``team_left``: whether a member of the team left.
    """

    matches: DataFrame
    participants: DataFrame
    players: DataFrame
    ratings: DataFrame
    ref_items: DataFrame
    ref_augments: DataFrame
    ref_champions: DataFrame


def ref_items(spark: SparkSession) -> DataFrame:
    n = F.col("id") - 1000
    shop = spark.range(1000, 1060).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("Item "), n).alias("name"),
        F.when(n <= 3, "boots").when(n <= 15, "prismatic").when(n <= 18, "excluded").alias("category"),
        F.when(n >= 56, F.col("id") - 20).cast("int").alias("canonical_id"),
    )
    afk = spark.range(AFK_ITEMS[0], AFK_ITEMS[-1] + 1).select(
        F.col("id").cast("int").alias("id"), F.lit("Away").alias("name"), F.lit("excluded").alias("category"), F.lit(None).cast("int").alias("canonical_id")
    )
    return shop.unionByName(afk)


def ref_augments(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(1, 31).select(
        i.cast("int").alias("id"), F.concat(F.lit("Augment "), i).alias("name"),
        F.when(i % 3 == 0, "silver").when(i % 3 == 1, "gold").otherwise("prismatic").alias("tier"),
        F.when(i.isin(*EXCLUDED_AUGMENTS), "excluded").alias("category"),
    )


def ref_champions(spark: SparkSession) -> DataFrame:
    name = F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 2, "0"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("id") % 6).cast("int") + 1)
    return spark.range(48).select(F.when(F.col("id") % 2 == 0, F.lower(name)).otherwise(name).alias("id"), name.alias("name"), role.alias("role"))


def _patch(mn: str) -> F.Column:
    """The patch of match number ``mn``: the season, up to ``last``, falls into equal parts."""
    return F.element_at(F.array(*map(F.lit, PATCHES)), F.expr(f"1 + (({mn}) * 4) div (1 + last)").cast("int"))


def derive(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> Season:
    """The season as lazy relations over the driver's tables; participants of the patches ``only``, if given."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    o = orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", (F.round(F.col("o_totalprice") * 100)).cast("long").alias("cents"),
        F.expr("o_orderkey div 18").alias("mn"), (key % 18).alias("slot"),
    )
    o = o.withColumn("subteam_id", F.expr("1 + ((slot * 5 + mn) % 18) div 3").cast("int"))
    last = o.agg(F.max("mn").alias("last"))
    matches = (
        o.groupBy("mn").agg(F.min("o_orderdate").alias("game_creation"), F.count(F.lit(1)).alias("members")).crossJoin(F.broadcast(last))
        .select(
            F.concat(F.lit("M_"), F.lpad(F.col("mn").cast("string"), 6, "0")).alias("match_id"), "mn", "game_creation",
            _patch("mn").alias("patch"), (F.col("members") == 18).alias("ingested"),
        )
        .withColumn("game_version", F.concat("patch", F.lit(".817.5716")))
    )
    teams = o.groupBy("mn", "subteam_id").agg(F.sum("cents").alias("cents"))
    order = Window.partitionBy("mn").orderBy(F.desc("cents"), "subteam_id")
    teams = teams.select("mn", "subteam_id", F.row_number().over(order).alias("placement"))

    if only is not None:
        lines = lines.crossJoin(F.broadcast(last)).where(_patch("l_orderkey div 18").isin(only))
    got = lines.groupBy("l_orderkey").agg(
        F.collect_list(F.struct((F.col("l_partkey") % 60 + 1000).cast("int").alias("item"), F.col("l_shipdate").alias("shipped"),
                                (F.col("l_suppkey") % 30 + 1).cast("int").alias("augment"),
                                (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000).alias("picked"))).alias("ls")
    )
    base = lambda i: F.when(i >= 1056, i - 20).otherwise(i)
    bought = F.filter("ls", lambda x: ~x["item"].between(1004, 1018))
    items = F.array_sort(F.array_distinct(F.coalesce(F.transform("ls", lambda x: x["item"]), F.array().cast("array<int>"))))
    part = o.join(teams, ["mn", "subteam_id"]).join(matches, "mn").where("ingested")
    chosen = part if only is None else part.where(F.col("patch").isin(only))
    participants = chosen.join(got, key == F.col("l_orderkey"), "left").select(
        "match_id", "patch", "game_creation", (F.col("slot") * 20 + cust % 20).cast("int").alias("player_id"), "subteam_id", "placement",
        F.concat(F.lit("C"), F.lpad(((cust + 7 * (key % 11)) % 48).cast("string"), 2, "0")).alias("champion"),
        F.when(key % 211 == 0, F.concat(items, F.array(F.lit(AFK_ITEMS[0])))).otherwise(items).alias("items"),
        F.when(key % 5 != 0, F.coalesce(ordered_by_first(bought, lambda x: base(x["item"]), lambda x: x["shipped"]), F.array().cast("array<int>"))).alias("item_order"),
        F.slice(F.coalesce(ordered_by_first(F.col("ls"), lambda x: x["augment"], lambda x: x["picked"]), F.array().cast("array<int>")), 1, 6).alias("augments"),
    )
    played = part.groupBy((F.col("slot") * 20 + cust % 20).cast("int").alias("id")).agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("placement") == 1).alias("top1_wins"), F.count_if(F.col("placement") <= 3).alias("top3_wins"),
        F.sum("placement").cast("long").alias("placement_sum"),
    )
    puuid = F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 4, "0"))
    rid = F.when(F.col("id") % 10 != 9, F.concat(F.lit("Player "), F.col("id"), F.lit("#EUW")))
    players = played.select("id", puuid.alias("puuid"), rid.alias("riot_id"), "games")
    mu = 25 + (3.5 - F.col("placement_sum") / F.col("games"))
    ladder = positions(played.withColumn("mu", mu), "mu", [F.desc("games"), F.asc("id")])
    ratings = ladder.select("id", puuid.alias("puuid"), F.coalesce(rid, puuid).alias("riot_id"), "games", "top1_wins", "top3_wins", "placement_sum", "mu",
                            "rank_position", ladder_tier(F.col("rank_position"), F.col("size")).alias("tier"))
    return Season(matches, participants, players, ratings, ref_items(spark), ref_augments(spark), ref_champions(spark))


def with_skill(participants: DataFrame, ratings: DataFrame) -> DataFrame:
    """``participants`` with skill_bucket (0 for the unrated) and ``team_left``."""
    bucket = ratings.select(F.col("id").alias("player_id"), skill_bucket(F.col("tier")).alias("skill_bucket"))
    gone = F.arrays_overlap("items", F.array(*map(F.lit, AFK_ITEMS)))
    rows = participants.join(bucket, "player_id", "left").fillna(0, ["skill_bucket"])
    return rows.withColumn("team_left", F.coalesce(F.max(gone).over(Window.partitionBy("match_id", "subteam_id")), F.lit(False)))


#: Seasons that have been written: (application, folder) -> (its files' times, where, the relations).
_written: dict[tuple[str, str], tuple[tuple, str, Season]] = {}


def _times(spark: SparkSession, sf_dir: str) -> tuple:
    """When the tables that a season is made of were last changed."""
    out = []
    for name in ("orders", "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((status.getModificationTime(), status.getLen()))
    return tuple(out)


def fingerprints(spark: SparkSession, sf_dir: str, ratings: DataFrame) -> DataFrame:
    """patch, print: what the participations of each patch depend on, as sums of row hashes.

    That is the rows of orders and line items whose keys fall into the patch, and the
    skill of its players; each is one scan with a partial sum, joined with nothing but ratings.
    """
    orders, lines = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem"))
    last = F.broadcast(orders.agg(F.max(F.expr("o_orderkey div 18")).alias("last")))  # one row
    of = lambda key: _patch(f"{key} div 18").alias("patch")
    skill = ratings.select("id", skill_bucket(F.col("tier")).alias("skill"))
    player = ((F.col("o_orderkey") % 18) * 20 + F.col("o_custkey") % 20).alias("id")
    parts = [
        orders.crossJoin(last).select(of("o_orderkey"), F.xxhash64("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").alias("h")),
        lines.crossJoin(last).select(of("l_orderkey"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("h")),
        orders.crossJoin(last).select(of("o_orderkey"), player).distinct().join(skill, "id").select("patch", F.xxhash64("id", "skill").alias("h")),
    ]
    sums = [p.groupBy("patch").agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(k)) for k, p in enumerate(parts)]
    every = sums[0].unionByName(sums[1]).unionByName(sums[2]).where("patch IS NOT NULL")
    return every.groupBy("patch").agg(F.xxhash64(F.to_json(F.array_sort(F.collect_list(F.struct("part", "n", F.col("h").cast("string").alias("h")))))).alias("print"))


_MANIFEST = "name string, patch string, print long, version int"


def refresh(spark: SparkSession, sf_dir: str, root: str | None = None) -> str:
    """Derives the season of ``sf_dir`` into a new shared folder, or what has changed of it since it
    was written to ``root``.

    Players, ratings and matches are small and written anew; participations of those
    patches only whose fingerprint is another.  Everything goes to folders of this
    version, and a manifest, a few rows that are written last, says which version of
    each part is the current one.  So readers see the season before or after, and those
    of the version before read on.
    """
    root = root or new_folder(spark, "season")
    manifests = Versions(spark, root)
    before = manifest(spark, root)
    version = 1 + max((r["version"] for r in before), default=0)
    s = derive(spark, sf_dir)
    for name in ("players", "ratings", "matches"):
        getattr(s, name).write.mode("overwrite").parquet(f"{root}/{name}/version={version}")
    ratings = spark.read.schema(SCHEMAS["ratings"]).parquet(f"{root}/ratings/version={version}")
    now = fingerprints(spark, sf_dir, ratings).collect()  # a row for each patch
    old = {r["patch"]: r for r in before if r["name"] == "participants"}
    changed = [r["patch"] for r in now if r["patch"] not in old or old[r["patch"]]["print"] != r["print"]]
    if changed:
        rows = with_skill((s if len(changed) == len(now) else derive(spark, sf_dir, changed)).participants, ratings)
        # stretches of match ids of one patch to a file
        rows.repartitionByRange("patch", "match_id").withColumn("version", F.lit(version)).write.mode("append").partitionBy("patch", "version").parquet(f"{root}/participants")
    entries = [("participants", r["patch"], r["print"], version if r["patch"] in changed else old[r["patch"]]["version"]) for r in now]
    entries += [(name, None, None, version) for name in ("players", "ratings", "matches")]
    manifests.write("manifest", spark.createDataFrame(entries, _MANIFEST).coalesce(1))
    _written[spark.sparkContext.applicationId, sf_dir] = (_times(spark, sf_dir), root, opened(spark, root))
    return root


def manifest(spark: SparkSession, root: str) -> list:
    """Which version of each part of the season at ``root`` is the current one."""
    found = Versions(spark, root).read("manifest")
    return found.collect() if found is not None else []  # a row for each patch and relation


def opened(spark: SparkSession, root: str) -> Season:
    """The current version of the season at ``root``."""
    parts, read = manifest(spark, root), {}
    for name in SCHEMAS:
        folders = [f"{root}/{name}/" + (f"patch={r['patch']}/" if r["patch"] else "") + f"version={r['version']}" for r in parts if r["name"] == name]
        found = [f for f in folders if exists(spark, f)]  # a patch of incomplete matches only has none
        rows = spark.read.schema(SCHEMAS[name]).option("basePath", f"{root}/{name}").parquet(*found) if found else spark.createDataFrame([], SCHEMAS[name])
        read[name] = rows.drop("version")
    return Season(**read, ref_items=ref_items(spark), ref_augments=ref_augments(spark), ref_champions=ref_champions(spark))


def load(spark: SparkSession, sf_dir: str) -> Season:
    """The written season of ``sf_dir``; it is brought up to date first if the tables have changed since."""
    key = (spark.sparkContext.applicationId, sf_dir)
    times, root, _ = _written.get(key, (None, None, None))
    if root is None or not exists(spark, f"{root}/manifest"):
        refresh(spark, sf_dir)
    elif times != _times(spark, sf_dir):
        refresh(spark, sf_dir, root)
    return _written[key][2]


#: Columns of the written relations.
SCHEMAS = {
    "matches": "match_id string, mn long, game_creation timestamp_ntz, patch string, ingested boolean, game_version string",
    "participants": "match_id string, player_id int, game_creation timestamp_ntz, subteam_id int, placement int, champion string, items array<int>, item_order array<int>, augments array<int>, "
                    "skill_bucket int, team_left boolean, patch string",
    "players": "id int, puuid string, riot_id string, games long",
    "ratings": "id int, puuid string, riot_id string, games long, top1_wins long, top3_wins long, placement_sum long, mu double, rank_position int, tier string",
}
