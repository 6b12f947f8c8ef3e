"""Match, timeline and reference documents in JSON as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SLOTS = ", ".join([*(f"playerAugment{i} int" for i in range(1, 7)), *(f"item{i} int" for i in range(7))])
#: What is read of a match document and of a timeline document; other fields are skipped by the parser.
MATCH = ("metadata struct<matchId string>, info struct<gameCreation long, queueId int, gameVersion string, participants array<struct<"
         "puuid string, riotIdGameName string, riotIdTagline string, championName string, playerSubteamId int, placement int, kills int, deaths int, assists int, "
         + ", ".join(x.replace(" ", ": ") for x in _SLOTS.split(", ")) + ">>>")
TIMELINE = "metadata struct<matchId string>, info struct<frames array<struct<events array<struct<type string, timestamp long, participantId int, itemId int, beforeId int, afterId int>>>>>"
#: Icon folders of the mode and the name of another mode, the map whose items count, names of rarities in the source and here, and the one for any other.
ICON_FOLDERS, OTHER_MODE = ("cherry", "kiwi"), "strawberry"
ITEM_MAP, TIERS, OTHER_TIER = "30", {"kSilver": "silver", "kGold": "gold", "kPrismatic": "prismatic", "kBronze": "silver", "kEventChoice": "prismatic"}, "gold"


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``document`` and ``file`` of JSON files, one document a file, or one a line with ``lines``."""
    return spark.read.text(path, wholetext=not lines).select(F.col("value").alias("document"), F.col("_metadata.file_path").alias("file"))


def sorted_out(documents: DataFrame, schema: str, needed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Documents that can be read, and the others with a ``reason``, for quarantine: those that are no
    JSON of the ``schema`` and those that lack a ``needed`` field."""
    d = F.from_json("document", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    lacking = [F.when(F.col(f"_d.{c}").isNull(), F.lit(f"no {c}")) for c in needed]
    reason = F.coalesce(F.when(F.col("_d").isNull() | F.col("_d._corrupt").isNotNull(), F.lit("malformed")), *lacking)
    marked = documents.withColumn("_d", d).withColumn("reason", reason).drop("_d")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


#: Fields without which a match or a timeline document is of no use.
MATCH_NEEDS, TIMELINE_NEEDS = ("metadata.matchId", "info.gameCreation", "info.participants"), ("metadata.matchId", "info.frames")


def held(prefix: str, slots: range, of: str) -> Column:
    """The ids in numbered slots; an empty slot holds 0."""
    return F.filter(F.array(*[F.col(f"{of}.{prefix}{i}") for i in slots]), lambda x: x > 0)


def participants(documents: DataFrame) -> DataFrame:
    """One row for each participant of match documents (column ``document``, JSON text)."""
    d = documents.select(F.from_json("document", MATCH).alias("d"))
    p = d.select("d.metadata.matchId", F.timestamp_millis("d.info.gameCreation").alias("game_creation"), F.col("d.info.gameVersion").alias("game_version"), F.explode("d.info.participants").alias("p"))
    name = F.concat_ws("#", F.nullif(F.col("p.riotIdGameName"), F.lit("")), "p.riotIdTagline")
    return p.select(
        F.col("matchId").alias("match_id"), "game_creation", "game_version", "p.puuid", F.when(F.length(F.coalesce("p.riotIdGameName", F.lit(""))) > 0, name).alias("riot_id"),
        F.col("p.championName").alias("champion"), F.col("p.playerSubteamId").alias("subteam_id"), "p.placement", "p.kills", "p.deaths", "p.assists",
        held("playerAugment", range(1, 7), "p").alias("augments"), held("item", range(7), "p").alias("items"))


def timeline_events(documents: DataFrame) -> DataFrame:
    """Item events of timeline documents: match_id, participant, position among all events, at, type, item_id.

    The item that undoing takes away is the one before the undo.
    """
    d = documents.select(F.from_json("document", TIMELINE).alias("d"))
    e = d.select("d.metadata.matchId", F.posexplode(F.flatten(F.transform("d.info.frames", lambda f: F.coalesce(f["events"], F.array().cast(
        "array<struct<type:string,timestamp:bigint,participantId:int,itemId:int,beforeId:int,afterId:int>>"))))).alias("position", "e"))
    item = F.when(F.col("e.type") == "ITEM_UNDO", F.col("e.beforeId")).otherwise(F.col("e.itemId"))
    return e.where(F.col("e.type").startswith("ITEM_") & item.isNotNull()).select(
        F.col("matchId").alias("match_id"), F.col("e.participantId").alias("participant"), "position", F.col("e.timestamp").alias("at"), "e.type", item.alias("item_id"))


def with_curated(rows: DataFrame, curated: DataFrame) -> DataFrame:
    """``rows`` with the category that ``curated`` (id, category) gives them by hand."""
    return rows.join(curated.select("id", "category"), "id", "left")


def reference_items(document: DataFrame, curated: DataFrame) -> DataFrame:
    """Items of the map from the shop's document (column ``document``: ``data`` by id)."""
    d = document.select(F.explode(F.from_json("document", "data map<string, struct<name: string, maps: map<string, boolean>>>")["data"]).alias("id", "i"))
    rows = d.where(F.coalesce(F.try_element_at("i.maps", F.lit(ITEM_MAP)), F.lit(False))).select(F.col("id").cast("int").alias("id"), "i.name")
    return with_curated(rows, curated)


def reference_champions(document: DataFrame) -> DataFrame:
    """Champions; the first of their tags is their role."""
    d = document.select(F.explode(F.from_json("document", "data map<string, struct<id: string, name: string, tags: array<string>>>")["data"]).alias("k", "c"))
    return d.select("c.id", "c.name", F.try_element_at("c.tags", F.lit(1)).alias("role"))


def reference_augments(document: DataFrame, curated: DataFrame) -> DataFrame:
    """Augments with a name whose icon is of one of the mode's folders; other modes use the same ids."""
    d = document.select(F.explode(F.from_json("document", "array<struct<id: int, nameTRA: string, rarity: string, augmentSmallIconPath: string>>")).alias("a"))
    path = F.coalesce("a.augmentSmallIconPath", F.lit(""))
    ours = path.rlike(f"(?i)/({'|'.join(ICON_FOLDERS)})/") & ~F.contains(F.lower(path), F.lit(OTHER_MODE)) & (F.length(F.coalesce("a.nameTRA", F.lit(""))) > 0)
    names = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    rows = d.where(ours).select("a.id", F.col("a.nameTRA").alias("name"), F.coalesce(F.try_element_at(names, F.col("a.rarity")), F.lit(OTHER_TIER)).alias("tier"))
    return with_curated(rows, curated)


def write_shredded(stored: DataFrame, path: str) -> None:
    """Writes documents (key, payload in JSON) as variants, sorted by key: the fields that
    documents have in common become columns of their own in the files.  A payload that is
    no JSON stays as text in ``malformed``."""
    v = F.try_parse_json("payload")
    rows = stored.select("key", v.alias("v"), F.when(v.isNull(), F.col("payload")).alias("malformed"))
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def shredded(spark: SparkSession, path: str, pattern: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """As ``projected``, of documents that ``write_shredded`` wrote; only the columns of the paths are read."""
    return _values(spark.read.parquet(path).where(F.col("key").like(pattern)), paths)


def _values(rows: DataFrame, paths: dict[str, tuple[str, str]]) -> DataFrame:
    return rows.select("key", *[F.try_variant_get("v", path, kind).alias(name) for name, (path, kind) in paths.items()])


def projected(stored: DataFrame, pattern: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Parts of stored documents (key, payload in JSON) whose key is like ``pattern``: column: (path, type)."""
    return _values(stored.where(F.col("key").like(pattern)).select("key", F.try_parse_json("payload").alias("v")), paths)
