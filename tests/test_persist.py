import datetime as dt
import random
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from muster.operators import crawl
from muster.operators.surrogate import Dictionary, numbered
from muster.sources import paged
from muster.streaming.persist import MatchStore

START = dt.datetime(2026, 1, 1)
ROW = "match_id string, game_creation timestamp, puuid string, riot_id string, subteam_id int, placement int, champion string, arrived_at timestamp"


def test_numbers_without_gaps(spark):
    rows = spark.range(5000).selectExpr("md5(string(id)) AS key", "id AS x")
    got = numbered(rows, "key", "n", 100).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(100, 5100)) and [r["key"] for r in got] == sorted(r["key"] for r in got)
    assert numbered(rows.limit(0), "key", "n").count() == 0


def test_ids_stay_and_go_on(spark, tmp_path):
    ids = Dictionary(spark, f"{tmp_path}/ids")
    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "k string")
    rows = lambda df: {r["key"]: r["id"] for r in df.collect()}
    assert rows(ids.add(keys("b", "a", "b", None), "k", 0)) == {"a": 0, "b": 1}
    want = {"a": 0, "b": 1, "0": 2, "c": 3}
    assert rows(ids.add(keys("c", "a", "0"), "k", 1)) == want
    assert rows(ids.add(keys("c", "a", "0"), "k", 1)) == want and rows(ids.add(keys(), "k", 2)) == want
    assert rows(ids.add(keys("zz"), "k", 3)) == {**want, "zz": 4}


def batch(matches, minute, name="n"):
    at = lambda m: START + dt.timedelta(hours=m)
    return [(f"M_{m}", at(m), f"P{(m + p) % 9}", None if p == 2 else f"{name}{(m + p) % 9}@{m}", p // 2, 1 + (p + minute) % 3, f"C{p}", START + dt.timedelta(days=3, minutes=minute)) for m in matches for p in range(6)]


def test_four_steps(spark, tmp_path):
    store = MatchStore(spark, f"{tmp_path}/s", 4)
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    archived = spark.createDataFrame([("M_3", START), ("M_1", None)], "match_id string, archived_at timestamp")
    store.persist(frame(batch([1, 2, 3], 1)), 0, archived)
    assert {r["match_id"] for r in store.matches.rows().collect()} == {"M_1", "M_2"} and store.participations.rows().count() == 12
    state = lambda: [sorted(map(str, x.collect())) for x in (store.players(), store.participations.rows(), store.matches.rows())]
    first = {r["puuid"]: r["id"] for r in store.players().collect()}
    store.persist(frame(batch([2, 5], 7, "new")), 1, archived)
    once = state()
    store.persist(frame(batch([2, 5], 7, "new")), 1, archived)
    assert state() == once
    now = {r["puuid"]: r for r in store.players().collect()}
    assert all(now[p]["id"] == i for p, i in first.items()) and sorted(r["id"] for r in now.values()) == list(range(len(now)))
    # the name of the latest match; of matches at the same time the later version
    assert now["P5"]["riot_id"] == "new5@5" and now["P2"]["riot_id"] == "new2@2" and now["P4"]["riot_id"] == "n4@1"
    two = {r["player_id"]: r for r in store.participations.rows().where("match_id = 'M_2'").collect()}
    assert len(two) == 6 and all(r["ingested_at"] == START + dt.timedelta(days=3, minutes=7) for r in two.values())
    assert store.matches.rows().where("match_id = 'M_2'").first()["ingested_at"] == START + dt.timedelta(days=3, minutes=7)


def test_participations_come_before_the_stamp(spark, tmp_path, monkeypatch):
    store = MatchStore(spark, f"{tmp_path}/s", 4)
    monkeypatch.setattr(store.matches, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        store.persist(spark.createDataFrame(batch([1], 1), ROW), 0)
    assert store.matches.rows() is None and store.participations.rows().count() == 6


def plain_boundary(patches, target):
    key = lambda p: tuple(map(int, p.split(".")))
    lo, hi = 0, len(patches)
    while lo < hi:
        mid = (lo + hi) // 2
        if patches[mid] is not None and key(patches[mid]) >= key(target):
            hi = mid
        else:
            lo = mid + 1
    return lo


def test_boundaries_with_unknown_versions(spark):
    rng = random.Random(1)
    known = sorted((rng.choice(["15.24", "16.9", "16.10", "16.11"]) for _ in range(300)), key=lambda p: tuple(map(int, p.split("."))))
    patches = [None if rng.random() < 1 / 3 else p for p in known]
    rows = [(f"M_{i}", START + dt.timedelta(minutes=5 * i), p) for i, p in enumerate(patches)]
    rng.shuffle(rows)
    targets = ["15.24", "16.9", "16.10", "16.11", "16.12"]
    found = {r["patch"]: r for r in crawl.patch_boundaries(spark.createDataFrame(rows, "match_id string, game_creation timestamp, patch string"), targets).collect()}
    want = {t: plain_boundary(patches, t) for t in targets}
    assert {t: r["position"] for t, r in found.items()} == {t: i for t, i in want.items() if i < len(patches)}
    assert all(r["starts_at"] == START + dt.timedelta(minutes=5 * r["position"]) and r["minutes"] == (5 if r["position"] else None) for r in found.values())


class Numbers:
    """Lists of the numbers below 10, 20, ..; a number is also its time."""

    SCHEMA = "list int, n int"

    def __init__(self, options):
        self.n = int(options.get("lists", 4))

    def lists(self):
        return self.n

    def page(self, number, start, count, since, until):
        rows = [(number, i) for i in range(10 * (number + 1)) if (since is None or i >= since) and (until is None or i < until)]
        return rows[start : start + count]

    def latest(self):
        return 25


def pages(spark, **options):
    paged.register(spark)
    return spark.read.format("pages").options(service="tests.test_persist.Numbers", **options)


@pytest.mark.parametrize("size", [1, 7, 10, 1000])
def test_every_page_is_asked_for(spark, size):
    got = sorted(map(tuple, pages(spark, page_size=size, partitions=3).load().collect()))
    assert got == [(k, i) for k in range(4) for i in range(10 * (k + 1))]


def test_a_list_with_too_many_pages_is_an_error(spark):
    assert pages(spark, page_size=10, max_pages=4).load().count() == 100
    with pytest.raises(Exception, match="list 3 has more than 3 pages of 10 rows"):
        pages(spark, page_size=10, max_pages=3).load().count()
    assert pages(spark, lists=0).load().count() == 0


def test_pages_as_a_stream(spark, tmp_path):
    paged.register(spark)
    stream = spark.readStream.format("pages").options(service="tests.test_persist.Numbers", page_size=4, since=5).load()
    for _ in range(2):  # the second run finds nothing new
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == [(k, i) for k in range(4) for i in range(5, min(25, 10 * (k + 1)))]


def test_a_page_of_a_history_costs_its_own_rows(tmp_path):
    rng = random.Random(3)
    rows = [(3, rng.randrange(20_000), f"M_{i}") for i in range(50_000)]
    (tmp_path / "list=3").mkdir()
    for k in (0, 1):  # two files, times and ids in any order, many equal times
        pq.write_table(pa.table({"at": [r[1] for r in rows[k::2]], "match_id": [r[2] for r in rows[k::2]]}), tmp_path / "list=3" / f"{k}.parquet")
    service = paged.HistoryFiles({"path": f"file://{tmp_path}"})
    for since, until in ((None, None), (5000, None), (None, 5000), (4000, 19_000), (20_000, None)):
        want = sorted((r for r in rows if (since is None or r[1] >= since) and (until is None or r[1] < until)), reverse=True)
        assert service.page(3, 0, 7, since, until) == want[:7] and service.page(3, max(0, len(want) - 3), 7, since, until) == want[-3:] and service.page(3, 0, 60_000, since, until) == want
        tracemalloc.start()
        assert service.page(3, 1200, 20, since, until) == want[1200:1220]
        assert tracemalloc.get_traced_memory()[1] < 50_000  # a list of all rows takes 400,000 bytes
        tracemalloc.stop()
    assert service.lists() == 4 and service.page(2, 0, 7, None, None) == []
