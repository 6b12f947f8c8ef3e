import os

from pyspark.sql import functions as F

from muster.operators import crawl
from muster.sources import documents

FILES = os.path.join(os.path.dirname(__file__), "fixtures")


def test_match_files_and_quarantine(spark):
    every = documents.read_documents(spark, f"{FILES}/matches")
    good, bad = documents.sorted_out(every, documents.MATCH, documents.MATCH_NEEDS)
    reasons = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()}
    assert reasons == {"cut.json": "malformed", "error.json": "no metadata.matchId", "without.json": "no info.participants", "empty.json": "malformed"}
    rows = {r["puuid"]: r for r in documents.participants(good).collect()}
    assert set(rows) == {"p1", "p2"} and good.count() == 2
    one, two = rows["p1"], rows["p2"]
    assert (one["riot_id"], one["augments"], one["items"], one["subteam_id"], one["placement"], one["kills"]) == ("Ann#X1", [5, 9], [1001, 1036, 1055], 1, 2, 3)
    assert (two["riot_id"], two["augments"], two["items"], two["kills"], two["game_version"]) == (None, [], [], None, "16.19.817.5716")


def test_timeline_files(spark):
    good, bad = documents.sorted_out(documents.read_documents(spark, f"{FILES}/timelines"), documents.TIMELINE, documents.TIMELINE_NEEDS)
    assert [(r["file"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()] == [("cut.json", "malformed")]
    events = documents.timeline_events(good)
    assert {r["type"] for r in events.collect()} == {"ITEM_PURCHASED", "ITEM_DESTROYED", "ITEM_UNDO", "ITEM_SOLD"}
    # undone and sold items go; consumables and shards never count; destroyed ones (parts of an upgrade) stay
    order = {(r["match_id"], r["participant"]): r["item_order"] for r in crawl.timeline_item_order(events, ["match_id", "participant"], ["position"]).collect()}
    assert order == {("M_1", 1): [1001], ("M_1", 2): []}


def test_lines_of_documents(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"metadata": {"matchId": "a"}, "info": {"gameCreation": 1, "participants": []}}\nno json\n')
    good, bad = documents.sorted_out(documents.read_documents(spark, str(tmp_path), lines=True), documents.MATCH, documents.MATCH_NEEDS)
    assert good.count() == 1 and [r["document"] for r in bad.collect()] == ["no json"]


def test_paths_of_shredded_documents_read_their_own_columns(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.to_json(F.struct(F.struct((F.col("id") % 7).alias("games"), F.repeat(F.lit("x"), F.lit(100)).alias("blob")).alias("stat"))).alias("payload"))
    rows = rows.unionByName(spark.createDataFrame([("k_bad", "{"), ("k_odd", '{"stat": {"games": "many"}}'), ("k_none", "{}"), ("z", "1")], "key string, payload string"))
    documents.write_shredded(rows, f"{tmp_path}/v")
    paths = {"games": ("$.stat.games", "long")}
    got = documents.shredded(spark, f"{tmp_path}/v", "k%", paths)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:string,v:struct<0:bigint>>" in plan
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, documents.projected(rows, "k%", paths).collect()), key=str)
    assert [r["malformed"] for r in spark.read.parquet(f"{tmp_path}/v").where("malformed IS NOT NULL").collect()] == ["{"]
