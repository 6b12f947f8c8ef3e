import os
import time

import pytest
from pyspark.sql import functions as F

from muster.plans import sqlfunctions
from muster.sources import fixtures
from muster.sources.shared import Versions
from muster.sources.snapshots import SnapshotStore

DATA = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_readers_go_on_reading_what_they_opened(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.write("v@1", spark.range(3))
    before = store.read("v@1", lambda: None)
    store.write("v@1", spark.range(5))
    assert ids(before) == [0, 1, 2] and ids(store.read("v@1", lambda: None)) == [0, 1, 2, 3, 4]
    store.write("v@1", spark.range(7))
    assert ids(store.read("v@1", lambda: None)) == list(range(7)) and len(os.listdir(f"{tmp_path}/s/view=v/patch=1")) == 2
    assert store.is_fresh("v@1", 1) and not store.is_fresh("v@1", 0) and not store.is_fresh("w", 1)
    store.write("w", spark.range(1))
    assert store.prune({"w"}) == ["v@1"] and store.has("w") and not store.has("v@1")


def test_a_job_that_fails_leaves_the_view(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    store.write("v", spark.range(3))
    with pytest.raises(Exception, match="boom"):
        store.write("v", spark.range(9).withColumn("x", F.when(F.col("id") > 7, F.raise_error(F.lit("boom"))).otherwise("y")))
    assert ids(store.read("v", lambda: None)) == [0, 1, 2]
    store.write("v", spark.range(2))
    assert ids(store.read("v", lambda: None)) == [0, 1]
    assert Versions(spark, f"file://{tmp_path}/none").read("x") is None


@pytest.fixture
def own_tables(spark, tmp_path):
    def write(change_orders=lambda o: o, change_lines=lambda x: x):
        for name, change in (("orders", change_orders), ("lineitem", change_lines)):
            time.sleep(0.01)
            change(spark.read.parquet(f"{DATA}/{name}.parquet")).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")

    write()
    return str(tmp_path), write


def parts(spark, root):
    return {r["patch"] or r["name"]: r["version"] for r in fixtures.manifest(spark, root)}


def same(a, b):
    key = [F.col(c) for c in sorted(a.columns)]
    return sorted(map(str, a.select(key).collect())) == sorted(map(str, b.select(key).collect()))


def test_only_changed_patches_are_derived_again(spark, own_tables):
    folder, write = own_tables
    root = fixtures.refresh(spark, folder)
    first = fixtures.load(spark, folder)
    old = first.participants.where("patch = '16.18'").count()
    assert parts(spark, root) == dict.fromkeys([*fixtures.PATCHES, "players", "ratings", "matches"], 1)
    # one line item of a match of the third patch gets another part; ratings do not depend on line items
    key = spark.read.parquet(f"{DATA}/orders.parquet").agg(F.max("o_orderkey")).first()[0] * 6 // 10
    write(change_lines=lambda x: x.withColumn("l_partkey", F.when(F.expr("l_orderkey div 18") == key // 18, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))))
    second = fixtures.load(spark, folder)
    assert parts(spark, root) == {**dict.fromkeys(fixtures.PATCHES, 1), "16.18": 2, "players": 2, "ratings": 2, "matches": 2}
    want = fixtures.with_skill(fixtures.derive(spark, folder).participants, second.ratings)
    assert same(second.participants, want.select(*second.participants.columns))
    # who has opened the season before reads on
    assert first.participants.where("patch = '16.18'").count() == old and first.ratings.count() == second.ratings.count()
    fixtures.refresh(spark, folder, root)
    assert parts(spark, root)["16.18"] == 2


def test_changed_orders_reach_all_that_depends_on_them(spark, own_tables):
    folder, write = own_tables
    fixtures.refresh(spark, folder)
    write(change_orders=lambda o: o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 3).otherwise(F.col("o_totalprice"))))
    now = fixtures.load(spark, folder)
    fresh = fixtures.opened(spark, fixtures.refresh(spark, folder))
    for name in ("participants", "ratings", "players", "matches"):
        assert same(getattr(now, name), getattr(fresh, name)), name


def test_sql_functions_read_one_patch_and_the_columns_they_need(spark):
    out = sqlfunctions.call(fixtures.load(spark, DATA), "SELECT champion, games FROM champion_stats('16.19') WHERE games > 1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "(patch" in plan and "16.19)" in plan and "PartitionFilters: [isnotnull(patch" in plan
    scan = plan[plan.index("ReadSchema") :].split("\n")[0]
    assert "champion" in scan and "items" not in scan and "placement" not in scan
    assert out.count() > 10


def test_sql_functions_with_defaults_and_columns_as_arguments(spark):
    s = sqlfunctions.register(fixtures.load(spark, DATA))
    assert s.sql("SELECT count(*) FROM leaderboard_top(n => 7)").first()[0] == 7
    every = s.sql("SELECT o.patch, count(*) AS n FROM patch_options(1) o, LATERAL champion_stats(o.patch) GROUP BY o.patch").collect()
    assert len(every) == 4 and all(r["n"] > 10 for r in every)
    assert s.sql("SELECT * FROM find_player('nobody')").count() == 0 and s.sql("SELECT * FROM champion_stats(NULL)").count() == 0
