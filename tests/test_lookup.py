import random

import pytest
from pyspark.sql import functions as F

from muster.operators import players
from muster.sources import lookup


def rows_read(df):
    """Rows that the scans of a plan without exchanges gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "Adaptive" in plan.getClass().getSimpleName():
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def names():
    rng = random.Random(1)
    letters = "abcAÉéÀ%_\\ #1ñ"
    return [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))) for i in range(1500)] + [(9000, None), (9001, "aa"), (9002, "Élan%_\\"), (9003, "Élan%_\\")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = lookup.NameIndex(spark, f"{tmp_path_factory.mktemp('names')}/i", "id", "name")
    at.build(spark.createDataFrame(names(), "id long, name string"))
    return at


def test_search_equals_the_scan(index):
    rng = random.Random(2)
    every = [n for _, n in names() if n]
    sought = ["%", "_\\", "a%", "É", "él", "ÉLAN", "lan%_", "1#", "#1", "aaaa", "zz", "", "\\ ", "Àñ1"]
    sought += [n[k : k + rng.randrange(2, 6)] for n in rng.sample([n for n in every if len(n) > 7], 12) for k in (0, 3)]
    for text in sought:
        want = sorted(i for i, n in names() if n is not None and len(text) > 1 and text.lower() in n.lower())
        assert sorted(r["id"] for r in index.search(text).collect()) == want, text


def test_search_reads_its_own_postings(spark, tmp_path):
    at = lookup.NameIndex(spark, f"{tmp_path}/i", "id", "name")
    rows = spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("name"))
    at.build(rows)
    every = spark.read.parquet(f"{tmp_path}/i/grams").count()
    found, n = at.postings(rows.where("id = 77").first()["name"][:6])
    assert n == 4 and rows_read(found) < every / 4
    assert [r["id"] for r in at.search(rows.where("id = 77").first()["name"][:12]).collect()] == [77]


def test_points_skip_all_files_but_one(spark, tmp_path):
    n = 40_000
    rows = spark.range(n).select(F.sha1(F.col("id").cast("string")).alias("key"), F.md5(F.col("id").cast("string")).alias("puuid"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    lookup.write_points(rows, f"{tmp_path}/p", "key", ("puuid",))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{tmp_path}/p").select(F.input_file_name()).distinct().count()
    wanted = rows.where("id = 123").first()
    by_key = lookup.point(spark, f"{tmp_path}/p", "key", wanted["key"])
    # the files are not sorted by puuid, so only its Bloom filters tell which can hold it
    by_puuid = lookup.point(spark, f"{tmp_path}/p", "puuid", wanted["puuid"])
    assert files == 4 and by_key.collect() == by_puuid.collect() == [wanted]
    assert rows_read(by_key) < n / 3 and rows_read(by_puuid) < n / 3
    # absent values within the range of all files: nothing is read
    assert rows_read(lookup.point(spark, f"{tmp_path}/p", "puuid", "8" * 32)) == 0


def test_leaderboard_search_by_index(spark, tmp_path, index):
    ladder = spark.createDataFrame([(i, f"P{i}", n, i) for i, n in names()], "id long, puuid string, riot_id string, rank_position long")
    at = lookup.NameIndex(spark, f"{tmp_path}/l", "id", "riot_id")
    at.build(ladder)
    for text in ("a%", "É1", "x"):
        want = players.leaderboard_search(ladder, text).collect()
        assert at.search(text).orderBy("rank_position").limit(25).select(*ladder.columns).collect() == want
