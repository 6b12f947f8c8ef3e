import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from muster.operators import crawl, limiter
from muster.plans.publish import publish
from muster.sources.fixtures import load
from muster.sources.snapshots import SnapshotStore
from muster.streaming import ingest, ordered

START = dt.datetime(2026, 1, 1)


def rows(match, placement_shift=0, minute=0):
    return [(f"M_{match}", "16.19", START, START + dt.timedelta(minutes=minute), p, 1 + p // 3, 1 + (p // 3 + placement_shift) % 6, f"C{p % 5}") for p in range(18)]


def packed(store):
    return {r["match_id"]: r for r in store.rows().collect()}


def test_rating_rows_take_the_last_version_once(spark, tmp_path):
    inbox, store = f"{tmp_path}/in", ingest.RatingRows(spark, f"{tmp_path}/rows", 4)
    for batch in (rows(1) + rows(1) + rows(2), rows(1, 1, 30)):
        spark.createDataFrame(batch, ingest.PARTICIPATION).coalesce(1).write.mode("append").parquet(inbox)
        ingest.start_sync(ingest.participations(spark, inbox), store, f"{tmp_path}/cp").awaitTermination()
    got = packed(store)
    assert set(got) == {"M_1", "M_2"} and got["M_1"]["players"] == list(range(18))
    assert got["M_1"]["placements"][0] == 2 and got["M_2"]["placements"][0] == 1
    seen = spark.createDataFrame([("M_1", START), ("M_2", START + dt.timedelta(hours=9)), ("M_3", START)], "match_id string, ingested_at timestamp")
    assert sorted(r[0] for r in store.todo(seen).collect()) == ["M_2", "M_3"]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 1, 0, 2, 0)])
def test_a_match_that_comes_in_parts(spark, tmp_path, order):
    """Participations of every match are spread over three batches, which come in any order, some of them twice."""
    store = ingest.RatingRows(spark, f"{tmp_path}/rows", 4)
    whole = [r for m in range(7) for r in rows(m)]
    parts = [[r for i, r in enumerate(whole) if i % 3 == k] for k in range(3)]
    for k in order:
        store.merge(spark.createDataFrame(parts[k], ingest.PARTICIPATION), k)
    got = packed(store)
    assert len(got) == 7 and store.rows().count() == 7
    for m in range(7):
        r = got[f"M_{m}"]
        assert r["players"] == list(range(18)) and r["placements"] == [x[6] for x in rows(m)] and r["subteams"] == [x[5] for x in rows(m)]


def test_a_stream_that_cuts_matches_at_files(spark, tmp_path):
    store = ingest.RatingRows(spark, f"{tmp_path}/rows", 4)
    whole = [r for m in range(3) for r in rows(m)]
    for k in range(4):
        spark.createDataFrame(whole[k::4], ingest.PARTICIPATION).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.participations(spark, f"{tmp_path}/in", 1)
    ingest.start_sync(stream, store, f"{tmp_path}/cp").awaitTermination()
    assert {m: len(r["players"]) for m, r in packed(store).items()} == {f"M_{m}": 18 for m in range(3)}
    assert spark.read.parquet(f"{tmp_path}/rows/parts").select("batch").distinct().count() == 4
    before = packed(store)
    store.compact(3)
    assert spark.read.parquet(f"{tmp_path}/rows/parts").select("batch").distinct().count() == 1 and store.participations().count() == 54
    store.merge(spark.createDataFrame(rows(1, 2, 60), ingest.PARTICIPATION), 4)
    assert {m: r for m, r in packed(store).items() if m != "M_1"} == {m: r for m, r in before.items() if m != "M_1"}
    assert packed(store)["M_1"]["placements"][0] == 3


def test_sync_repairs_lost_and_late_rows(spark, tmp_path):
    store = ingest.RatingRows(spark, f"{tmp_path}/rows", 64, clean=lambda r: r.where("subteam_id != 6"))
    store.merge(spark.createDataFrame(rows(1) + rows(2) + rows(3), ingest.PARTICIPATION), 0)
    assert all(len(r["players"]) == 15 for r in packed(store).values())
    at = lambda h: START + dt.timedelta(hours=h)
    matches = lambda **times: spark.createDataFrame(list(times.items()), "match_id string, ingested_at timestamp")
    every = matches(M_1=START, M_2=START, M_3=START, M_9=None)
    assert store.state() == (None, None) and store.sync(every, at(1)) == 0
    assert store.state() == (at(-1), at(1))
    # rows of one bucket are lost: only what was ingested after the watermark is found, until the next full sweep
    lost = spark.read.parquet(f"{tmp_path}/rows/rows").where("match_id = 'M_2'").first()["bucket"]
    shutil.rmtree(f"{tmp_path}/rows/rows/bucket={lost}")
    assert "M_2" not in packed(store)
    assert store.sync(every.withColumn("ingested_at", F.expr("ingested_at - INTERVAL 5 HOURS")), at(2)) == 0
    assert store.sync(every.withColumn("ingested_at", F.expr("ingested_at - INTERVAL 5 HOURS")), at(8)) >= 1
    assert set(packed(store)) == {"M_1", "M_2", "M_3"} and store.state() == (at(6), at(8))
    # a row older than its match is packed again
    assert store.sync(matches(M_1=at(9)), at(9)) == 1


def test_rating_rows_of_nothing(spark, tmp_path):
    store = ingest.RatingRows(spark, f"{tmp_path}/rows")
    store.merge(spark.createDataFrame([], ingest.PARTICIPATION), 0)
    assert [r[0] for r in store.todo(spark.createDataFrame([("M_1", START)], "match_id string, ingested_at timestamp")).collect()] == ["M_1"]


def run_to_memory(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    spark.createDataFrame(rows(1) + rows(1) + rows(2), ingest.PARTICIPATION).write.parquet(f"{tmp_path}/in")
    out = run_to_memory(spark, ingest.once(ingest.participations(spark, f"{tmp_path}/in")), "once")
    assert out.count() == 36
    counts = run_to_memory(spark, ingest.champion_counts(ingest.participations(spark, f"{tmp_path}/in")), "counts", "complete")
    assert counts.agg(F.sum("games")).first()[0] == 54


def shuffled_files(spark, path, rows, schema, files=4, seed=1):
    """Rows in random order, spread over files; then one row far in the future, which lets the watermark pass all others."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)


def far(spark, path, row, schema):
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


EVENT = "event_id long, user_id long, ts timestamp"


@pytest.fixture
def small_frames(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


def events(count, seed, seconds):
    rng = random.Random(seed)
    return [(i, rng.choice([1, 1, 1, 2, 3]), START + dt.timedelta(seconds=rng.randrange(seconds))) for i in range(count)]


def test_admission_of_shuffled_events_over_many_frames(spark, tmp_path, small_frames):
    given = events(200, 1, 2000)
    shuffled_files(spark, f"{tmp_path}/ev", given, EVENT)
    far(spark, f"{tmp_path}/ev", (-1, 9, START + dt.timedelta(days=9)), EVENT)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/ev")
    got = {r["event_id"]: r["admitted"] for r in run_to_memory(spark, ordered.admitted_stream(stream, late="1 hour"), "admitted").collect()}
    want = {r["event_id"]: r["admitted"] for r in crawl.admitted(spark.createDataFrame(given, EVENT), "user_id").collect()}
    assert {k: v for k, v in got.items() if k >= 0} == want and 20 < sum(want.values()) < 200


@pytest.mark.parametrize("max_wait", [None, 90])
def test_limiter_of_shuffled_events(spark, tmp_path, small_frames, max_wait):
    limits, given = ((2, 30), (5, 200)), events(120, 2, 1500)
    shuffled_files(spark, f"{tmp_path}/ev", given, EVENT)
    far(spark, f"{tmp_path}/ev", (-1, 9, START + dt.timedelta(days=9)), EVENT)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/ev")
    got = {r["event_id"]: r["wait_us"] for r in run_to_memory(spark, ordered.limited_stream(stream, limits, max_wait, "1 hour"), f"limited{max_wait}").collect()}
    want = {r["event_id"]: r["wait_us"] for r in limiter.limited(spark.createDataFrame(given, EVENT), "user_id", limits, max_wait).collect()}
    assert {k: v for k, v in got.items() if k >= 0} == want


def test_inventory_of_shuffled_events(spark, tmp_path, small_frames):
    rng = random.Random(3)
    kinds = ["ITEM_PURCHASED"] * 3 + ["ITEM_SOLD", "ITEM_UNDO", "LEVEL_UP"]
    given = [(m, START + dt.timedelta(seconds=rng.randrange(600)), i, rng.choice(kinds), 1000 + rng.randrange(8)) for m in (1, 2, 3) for i in range(60)]
    schema = "match long, ts timestamp, position long, type string, item_id int"
    shuffled_files(spark, f"{tmp_path}/ev", given, schema)
    far(spark, f"{tmp_path}/ev", (9, START + dt.timedelta(days=9), 0, "ITEM_SOLD", 1), schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/ev")
    out = run_to_memory(spark, ordered.inventory_stream(stream, "match", "1 hour"), "inventory")
    got = {r["match"]: r["o"] for r in out.where("match < 9").groupBy("match").agg(F.max_by("item_order", "t").alias("o")).collect()}
    want = {r["match"]: r["item_order"] for r in crawl.timeline_item_order(spark.createDataFrame(given, schema), ["match"], ["ts", "position"]).collect()}
    assert got == want


def test_state_of_idle_keys_goes(spark, tmp_path):
    for k, rows_ in enumerate([events(30, 5, 100), [(-1, 9, START + dt.timedelta(days=1))], [(-2, 9, START + dt.timedelta(days=2))], [(-3, 9, START + dt.timedelta(days=3))]]):
        spark.createDataFrame(rows_, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ev")
        stream = ordered.admitted_stream(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/ev"))
        q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 4  # of the last key only: one held event and its timer


def test_publish(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    keys = publish(load(spark, "/root/testdata/sf0.001"), store)
    assert {"site", "leaderboard", "movers", "champions@16.19", "champions@16.18", "combos@16.19", "builds@16.19"} <= set(keys)
    assert store.read("champions@16.19", lambda: None).count() > 0


def test_touched_players_and_late_matches(spark, tmp_path):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    rows = spark.createDataFrame([("m1", [1, 2]), ("m2", [2, 3])], "match_id string, players array<int>")
    counts = spark.createDataFrame([(1, 1), (2, 1), (9, 5)], "player_id int, games long")
    got = ingest.touched_counts(rows, rows.where("match_id = 'm2'"), counts)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 1), (9, 5)]
    players = spark.createDataFrame([(1, "p", "old"), (2, "q", "same")], "id int, puuid string, riot_id string")
    seen = spark.createDataFrame([("p", "new", at(2), "m"), ("p", "older", at(1), "m"), ("q", None, at(3), "m")], "puuid string, riot_id string, game_creation timestamp, match_id string")
    assert sorted(map(tuple, ingest.new_names(players, seen).collect())) == [(1, "p", "new"), (2, "q", "same")]
    matches = spark.createDataFrame([("m1", at(1)), ("m2", None)], "match_id string, archived_at timestamp")
    assert [r["match_id"] for r in ingest.unarchived(rows, matches).collect()] == ["m2"]
