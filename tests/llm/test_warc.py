import random

import pytest
from pyspark.sql import functions as F

from muster.llm import warc

SCHEMA = "record_id long, kind string, url string, at long, headers map<string,string>, digest string"


@pytest.mark.parametrize("a,b", [
    ("http://www.A.example:80/x/?b=2&a=1&utm_source=q#f", "https://a.example/x?a=1&b=2"), ("http://m.a.example", "//a.example/"), ("https://a.example:443/x?ref=1", "http://a.example/x"),
])
def test_same_page(spark, a, b):
    got = spark.createDataFrame([(a,), (b,), (None,), ("no url",)], "u string").select(warc.canonical_url(F.col("u")).alias("k")).collect()
    assert got[0]["k"] == got[1]["k"] is not None and got[2]["k"] is None and got[3]["k"] is None


def test_resolution_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECES", 5)
    rng = random.Random(9)
    rows = []
    for i in range(400):
        headers = {k: v for k, v in (("etag", rng.choice(['"a"', 'W/"a"', '"b"', None])), ("last-modified", rng.choice(["m", "n", None])), ("content-length", "3"), ("x", str(i))) if v}
        rows.append((i, rng.choice(["response", "revisit", "revisit"]), rng.choice(["http://hot.example/", "http://hot.example", f"http://x.example/{i % 9}", None]), rng.choice([None, *range(60)]), rng.choice([headers, headers, None]), rng.choice(["d", "e", None])))
    path = f"{tmp_path}/log"
    spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).repartition(3).write.parquet(path)
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.read.parquet(path)).collect()}
    canon = lambda u: u and u.rstrip("/")
    for i, kind, url, at, headers, digest in rows:
        if kind == "response":
            assert i not in got
            continue
        best = max(((a, j) for j, k, u, a, *_ in rows if k == "response" and u and at is not None and a is not None and canon(u) == canon(url) and a < at), default=None)
        r = got[i]
        assert r["response_id"] == (best and best[1]) and r["key"] == "clash"
        if best is None:
            assert r["verdict"] == "no_response" and r["headers"] is None
            continue
        old, new = rows[best[1]][4] or {}, headers or {}
        weak = lambda t: t and t.removeprefix("W/")
        pairs = [(weak(new.get("etag")), weak(old.get("etag"))), (new.get("last-modified"), old.get("last-modified")), (digest, rows[best[1]][5])]
        same = next((a == b for a, b in pairs if a and b), None)
        assert r["verdict"] == {None: "no_validator", True: "resolved", False: "mismatch"}[same]
        assert r["headers"] == ((old | {k: v for k, v in new.items() if k != "content-length"}) if same else None)
    assert warc.resolve_revisits(spark.read.parquet(path).limit(0)).count() == 0


def test_repeated_rows(spark, tmp_path):
    tag = lambda t: {"etag": t}
    rows = [
        (1, "response", "http://a/", 10, tag('"1"'), "d", b"one"), (1, "response", "http://a/x", 30, tag('"9"'), "d", b"other URL"), (1, "response", "http://a/", 20, tag('"2"'), "d", b"two"),
        (7, "revisit", "http://a/", 15, tag('"1"'), None, None), (7, "revisit", "http://a/", 25, tag('"2"'), None, None), (7, "revisit", "http://a/x", 25, tag('"9"'), None, None),
        (8, "revisit", "http://a/x", 35, tag('"9"'), None, None), (9, "revisit", None, 25, tag('"2"'), None, None),
    ]
    want = [(7, 15, 1, 10, "resolved", b"one"), (7, 25, None, None, "no_response", None), (7, 25, 1, 20, "resolved", b"two"), (8, 35, 1, 30, "resolved", b"other URL"), (9, 25, None, None, "no_response", None)]
    for times in (1, 2, 3):
        path = f"{tmp_path}/log{times}"
        spark.createDataFrame(rows * times, SCHEMA + ", body binary").repartition(3).write.parquet(path)
        log = spark.read.parquet(path)
        out = warc.resolve_revisits(log, bodies=True).collect()
        got = [(r["record_id"], r["at"], r["response_id"], r["response_at"], r["verdict"], r["body"] and bytes(r["body"])) for r in out]
        assert sorted(got, key=repr) == sorted(want * times, key=repr)
    # of unequal rows with one id, URL and time the largest digest and headers count
    rows = [(1, "response", "http://a/", 10, {"x": x}, d) for x, d in (("a", "d"), ("b", "d"), ("z", "c"), ("y", None))] + [(2, "revisit", "http://a/", 15, None, "d")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/ties")
    assert [r["headers"] for r in warc.resolve_revisits(spark.read.parquet(f"{tmp_path}/ties")).collect()] == [{"x": "b"}]


def test_null_ids_and_clashing_names(spark, tmp_path):
    tag = {"etag": '"1"'}
    rows = [(None, "response", "http://a/", 10, tag, "d"), (None, "revisit", "http://a/", 15, tag, None), (None, "revisit", "http://a/", 5, tag, None), (3, "request", "http://a/", 12, tag, "d")]
    log = spark.createDataFrame(rows, SCHEMA)
    names = ("row", "own", "old", "new", "id", "key", "piece", "_kept", "_digest", "response_row", "best", "verdict", "response_id")
    for n in names:
        log = log.withColumn(n, F.lit("mine"))
    log.write.parquet(f"{tmp_path}/log")
    out = warc.resolve_revisits(spark.read.parquet(f"{tmp_path}/log"))
    got = {r["at"]: r for r in out.collect()}
    assert (got[15]["verdict"], got[15]["response_at"], got[15]["response_id"], got[5]["verdict"]) == ("resolved", 10, None, "no_response")
    assert all(got[t][n] == "mine" for t in got for n in names[:-2]) and len(out.columns) == len(set(out.columns))


def test_records_of_files_are_resolved(spark, tmp_path):
    records = [
        {"record_id": "urn:1", "kind": "response", "url": "http://a/x", "date": "2026-01-01T00:00:00Z", "headers": {"ETag": '"1"', "X": "old"}, "body": b"the page", "digest": "sha1:A"},
        {"record_id": "urn:2", "kind": "revisit", "url": "https://www.a/x/", "date": "2026-01-02T00:00:00Z", "headers": {"ETag": 'W/"1"', "X": "new"}},
        {"record_id": "urn:3", "kind": "revisit", "url": "http://a/x", "date": "no date", "headers": {"ETag": '"1"'}},
    ]
    for k, r in enumerate(records):
        (tmp_path / f"{k}.warc.gz").write_bytes(warc.warc_bytes(r))
    got = {r["record_id"]: r for r in warc.resolve_revisits(warc.timed(warc.read_warc(spark, f"{tmp_path}/*.warc.gz")), bodies=True).collect()}
    assert bytes(got["urn:2"]["body"]) == b"the page" and got["urn:2"]["headers"] == {"etag": 'W/"1"', "x": "new"} and got["urn:3"]["verdict"] == "no_response"


def test_files_round_trip(spark, tmp_path):
    records = [
        {"record_id": "urn:1", "kind": "response", "url": "http://a/", "date": "2026-01-01T00:00:00Z", "headers": {"ETag": '"1"'}, "body": b"x\r\n\r\nWARC/1.1\r\n" * 3, "digest": "sha1:A"},
        {"record_id": "urn:2", "kind": "revisit", "url": "http://a/", "date": "2026-01-02T00:00:00Z", "headers": {"ETag": '"1"'}},
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.warc_bytes, records)))
    got = sorted(warc.read_warc(spark, f"{tmp_path}/*.warc.gz").collect(), key=lambda r: r["record_id"])
    assert [(r["record_id"], r["kind"], r["headers"], r["body"] and bytes(r["body"])) for r in got] == [("urn:1", "response", {"etag": '"1"'}, records[0]["body"]), ("urn:2", "revisit", {"etag": '"1"'}, None)]
    assert got[0]["status"] == "200 OK" and got[1]["status"] == "304 Not Modified" and list(warc.parse_warc(b"")) == []


def test_one_wrong_date_leaves_pieces_even(spark):
    from muster.llm import warc

    seen = []
    real = warc.stored
    warc.stored = lambda df, name="t": (out := real(df, name), seen.append((name, out)))[0]
    try:
        rows = [(i, "response" if i % 3 else "revisit", f"id{i}", 1_750_000_000_000_000 + i, "http://hot/") for i in range(4000)] + [(9999, "response", "old", 0, "http://other/")]
        found = warc._answers(spark.createDataFrame(rows, "row long, kind string, id string, at long, key string")).collect()
    finally:
        warc.stored = real
    assert all(r["response_row"] == r["row"] - 1 for r in found) and len(found) == len([i for i in range(1, 4000) if i % 3 == 0])
    sizes = sorted(r["count"] for r in dict(seen)["told"].groupBy("key", "piece").count().where("key = 'http://hot/'").collect())
    assert len(sizes) > 200 and sizes[-1] < 5 * sizes[len(sizes) // 2]
