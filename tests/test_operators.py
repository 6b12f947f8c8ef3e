import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from muster.functions.arrays import canonical, contained_in, pairs, without
from muster.functions.ladder import SHARES, ladder_tier
from muster.functions.patches import patch_key, patch_of
from muster.functions.text import plain_text, resolved_lines, riot_id, with_values
from muster.functions.tiers import LETTERS, letters
from muster.operators import crawl, diff, pieces, ratings
from muster.sources.snapshots import SnapshotStore


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<int>")


def test_arrays(spark):
    assert one(spark, without(array(5, 1, 5, 1), array(5))) == [1, 1]
    assert one(spark, contained_in(array(), array(1))) is True
    assert one(spark, contained_in(array(2), array(1))) is False
    assert one(spark, canonical(array(1, 1, 9, 2, 4), {9: 4})) == [1, 1, 4, 2]
    assert one(spark, canonical(array(1, 1, 2), {9: 4})) == [1, 1, 2]
    assert [tuple(p) for p in one(spark, pairs(array(3, 1, 2, 2)))] == [(1, 3), (1, 2), (1, 2), (2, 3), (2, 3)] or len(one(spark, pairs(array(3, 1, 2, 2)))) == 5


def test_patches(spark):
    assert one(spark, patch_key(F.lit("16.18")) > patch_key(F.lit("16.9"))) is True
    assert one(spark, patch_of(F.lit("16.18.817.5716"), F.lit("16.1"))) == "16.18"
    assert one(spark, patch_of(F.lit(""), F.lit("16.1"))) == "16.1"
    assert one(spark, patch_of(F.lit(None).cast("string"), F.lit("16.1"))) == "16.1"


def test_ladder_tiers_cover_the_ladder(spark):
    for size in (1, 2, 3, 7, 50, 333, 2000):
        rows = spark.range(1, size + 1).select(ladder_tier(F.col("id"), F.lit(size)).alias("t")).collect()
        order = ["Challenger", "Grandmaster", "Master", *[n for n, _ in SHARES]]
        places = [order.index(r["t"]) for r in rows]
        assert places == sorted(places) and len(places) == size


def test_text(spark):
    assert one(spark, plain_text(F.lit("<p>a&nbsp;&lt;b</p><li>c<br/> d %i:x_1% </li>"))) == "a <b\n• c\nd"
    values = F.create_map(F.lit("dmg"), F.array(F.lit(0.125), F.lit(3.0)))
    assert one(spark, with_values(F.lit("@Dmg*100@ and @Dmg@ and @No@"), values)) == "12.5 and 0.13 and @No@"
    assert one(spark, resolved_lines(F.lit("a\n@x@ b\nc"))) == "a\nc"
    assert tuple(one(spark, riot_id(F.lit(" Ann #X1 ")))) == ("Ann", "X1")
    assert tuple(one(spark, riot_id(F.lit("Ann")))) == ("Ann", "EUW")
    assert tuple(one(spark, riot_id(F.lit("Ann# ")))) == ("Ann", "EUW") and tuple(one(spark, riot_id(F.lit("\tA n#x#y\n")))) == ("A n", "x#y")
    assert one(spark, riot_id(F.lit(" "))) is None and one(spark, riot_id(F.lit(" #EUW"))) is None and one(spark, riot_id(F.lit(None).cast("string"))) is None


def test_letters_are_monotone():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 173):
        s = rng.normal(size=n)
        places = [LETTERS.index(t) for t in letters(s)[np.argsort(-s)]]
        assert places == sorted(places)
    assert set(letters(np.zeros(4))) == {"B"}


def inventory_by_hand(events):
    out = []
    for kind, item in events:
        if kind == "ITEM_PURCHASED":
            out.append(item)
        elif item in out:
            del out[len(out) - 1 - out[::-1].index(item)]
    return list(dict.fromkeys(out))


def test_inventory(spark):
    rng = random.Random(5)
    runs = [[(rng.choice(["ITEM_PURCHASED", "ITEM_PURCHASED", "ITEM_UNDO", "ITEM_SOLD"]), rng.randrange(4)) for _ in range(rng.randrange(9))] for _ in range(40)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "i int, e array<struct<type:string,item_id:int>>")
    got = {r["i"]: r["x"] for r in df.select("i", crawl.inventory(F.col("e")).alias("x")).collect()}
    assert got == {i: inventory_by_hand(r) for i, r in enumerate(runs)}


def test_admission(spark):
    rng = random.Random(6)
    times = sorted({rng.randrange(4000) for _ in range(300)})
    rows = [(i, rng.randrange(3), t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t long").select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"))
    got = {r["event_id"]: r["admitted"] for r in crawl.admitted(df, "user_id").collect()}
    inside = {}
    for i, u, t in rows:
        recent = [x for x in inside.get(u, []) if x > t - 120]
        assert got[i] == (len(recent) < 5)
        inside[u] = recent + [t] if len(recent) < 5 else recent


def test_admission_in_sessions_and_pieces(spark, monkeypatch):
    rng = random.Random(16)
    for n, most, spread in ((2, 3, 9000), (7, 2, 60_000), (400, 3, 9000)):
        monkeypatch.setattr(pieces, "PIECES", n)
        rows = [(i, rng.choice([1, 1, 1, 1, 2, None]), rng.randrange(spread) if i % 60 else None) for i in range(600)] + [(1000 + i, 3, 120 * i) for i in range(9)]
        df = spark.createDataFrame(rows, "event_id long, user_id long, t long").select("event_id", "user_id", F.timestamp_seconds("t").alias("ts"))
        out = crawl.admitted(df, "user_id", most)
        plan = out._jdf.queryExecution().toString()
        assert "collect_list" not in plan and "MapInArrow" in plan  # no array of all events of a user
        got = {r["event_id"]: (r["user_id"], r["admitted"]) for r in out.collect()}
        assert len(got) == len(rows)
        inside = {}
        for i, u, t in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[0])):
            recent = [x for x in inside.get(u, []) if t is not None and x > t - 120]
            assert got[i] == (u, t is None or len(recent) < most)
            if t is not None:
                inside[u] = recent + [t] if len(recent) < most else recent


def test_rating_update_agrees_with_replay(spark):
    rng = random.Random(7)
    rows, packs = [], []
    for m in range(6):
        people = rng.sample(range(40), 18)
        places = rng.sample([1, 2, 3, 4, 5, 5], 6)
        rows += [(f"M_{m}", p, k // 3, places[k // 3]) for k, p in enumerate(people)]
        packs.append([(f"M_{m}", m, people, [k // 3 for k in range(18)], [places[k // 3] for k in range(18)])])
    prior = spark.createDataFrame([(p, 20.0 + p / 4, 6.0) for p in range(30)], "player_id int, mu double, sigma double")
    update = ratings.match_update(spark.createDataFrame(rows, "match_id string, player_id int, subteam_id int, placement int"), prior)
    got = {(r["match_id"], r["player_id"]): (r["mu"], r["sigma"]) for r in update.collect()}
    known = {p: (20.0 + p / 4, 6.0) for p in range(30)}
    for m, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        teams = [[known.get(p, (ratings.MU, ratings.SIGMA)) for _, p, t, _ in group if t == k] for k in range(6)]
        after = ratings.rate(teams, [next(pl for _, _, t, pl in group if t == k) for k in range(6)])
        for k in range(6):
            for (_, p, _, _), (mu, sigma) in zip([r for r in group if r[2] == k], after[k]):
                assert math.isclose(got[m, p][0], mu, abs_tol=1e-9) and math.isclose(got[m, p][1], sigma, abs_tol=1e-9)


def test_replay_recovers_skill_whatever_the_order_of_rows(spark):
    rng = random.Random(8)
    skill = {p: rng.gauss(0, 1) for p in range(60)}
    packs = []
    for m in range(150):
        people = rng.sample(range(60), 18)
        teams = [people[3 * k : 3 * k + 3] for k in range(6)]
        order = sorted(range(6), key=lambda k: -sum(skill[p] for p in teams[k]) + rng.gauss(0, 1))
        place = {k: i + 1 for i, k in enumerate(order)}
        packs.append((f"M_{m:04}", m, people, [k // 3 for k in range(18)], [place[k // 3] for k in range(18)]))
    schema = "match_id string, game_creation long, players array<int>, subteams array<int>, placements array<int>"
    a = {r["player_id"]: r["mu"] for r in ratings.replay(spark.createDataFrame(packs, schema)).collect()}
    rng.shuffle(packs)
    assert a == {r["player_id"]: r["mu"] for r in ratings.replay(spark.createDataFrame(packs, schema)).collect()}
    assert np.corrcoef([skill[p] for p in a], [a[p] for p in a])[0, 1] > 0.8


def test_replay_is_a_stream_of_matches(spark):
    rng = random.Random(18)
    packs = []
    for m in range(240):
        people = rng.sample(range(30), 6)
        pool = "ABC"[m % 3]
        packs.append((f"{pool}_{m:04}", m // 2, [p + 100 * (m % 3) for p in people], [k // 2 for k in range(6)], [rng.randrange(1, 5) for _ in range(3) for _ in range(2)]))
    packs.append(("D_1", 5, [900], [0], [1]))  # no opponents
    schema = "match_id string, game_creation long, players array<int>, subteams array<int>, placements array<int>"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "7")
    try:
        out = ratings.replay(spark.createDataFrame(packs, schema))
        assert "InPandas" not in out._jdf.queryExecution().toString()  # no pool in one frame
        got = {r["player_id"]: tuple(r)[1:] for r in out.collect()}
    finally:
        spark.conf.unset(key)
    mu, games, wins = {}, {}, {}
    for k in range(ratings.PASSES):
        sigma = {}
        for _, _, players, teams, places in sorted(packs, key=lambda r: (r[1], r[0])):
            if len(players) < 2:
                continue
            sides = [[p for p, t in zip(players, teams) if t == x] for x in range(3)]
            place = [places[2 * x] for x in range(3)]
            after = ratings.rate([[(mu.get(p, ratings.MU), sigma.get(p, ratings.SIGMA)) for p in s] for s in sides], place)
            for side, values, q in zip(sides, after, place):
                for p, (m, s) in zip(side, values):
                    mu[p], sigma[p] = m, s
                    if k == 0:
                        games[p], wins[p] = games.get(p, 0) + 1, wins.get(p, 0) + (q == 1)
    assert {p: v[:4] for p, v in got.items()} == {p: (mu[p], sigma[p], games[p], wins[p]) for p in mu}


def snapshot(spark, docs):
    import json

    return diff.leaves(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "key string, payload string"))


def test_snapshot_differences(spark):
    import pytest

    with pytest.raises(ValueError):
        diff.compare_all(snapshot(spark, {}), snapshot(spark, {}))
    a, b = ({"champion:ahri": {"allItems": [[447108, 746, 147, 426, 2426, x]]}} for x in (3.2079, 3.2081))
    found = diff.snapshot_diff(snapshot(spark, a), snapshot(spark, b)).collect()
    assert [(r["path"], r["kind"]) for r in found] == [("allItems.0.5", "difference")]
    close = [{"k": {"x": v}} for v in (0.6537151791587511, 0.6537151791587509)]
    assert diff.compare_all(*[snapshot(spark, x) for x in close])["differences"] == 0
    assert diff.compare_all(snapshot(spark, {"k": {"x": 1}}), snapshot(spark, {"k": {"x": 1, "y": 2}}))["differences"] == 1
    assert diff.compare_all(snapshot(spark, {"a": {"x": 1}}), snapshot(spark, {"a": {"x": 1}, "b": {"x": 1}}))["differences"] == 1


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    df = spark.range(3)
    assert store.read("champions@16.19", lambda: df).count() == 3 and not store.has("champions@16.19")
    store.write("champions@16.19", df.limit(2))
    store.write("site", df)
    assert store.read("champions@16.19", lambda: df).count() == 2
    assert store.is_fresh("site", 1) and not store.is_fresh("site", 0) and not store.is_fresh("none", 1)
    assert store.prune({"site"}) == ["champions@16.19"] and store.has("site")


def test_request_player(spark):
    q = spark.createDataFrame([("a", 0, None, None, 0), ("b", 2, None, None, 0)], "puuid string, priority int, last_crawled_at timestamp, requested_at timestamp, error_count int")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = {r["puuid"]: r for r in crawl.request_player(q, "a", now).collect()}
    assert rows["a"]["priority"] == 1 and rows["a"]["requested_at"] is not None and rows["b"]["requested_at"] is None
    assert {r["puuid"] for r in crawl.request_player(q, "z", now).collect()} == {"a", "b", "z"}


def test_build_selection_is_greedy(spark):
    from muster.operators import builds

    rng = random.Random(11)
    rows = [(f"C{c}", slot, item, rng.randrange(1, 6)) for c in range(4) for slot in range(1, 7) for item in rng.sample(range(9), 6)]
    got = builds.build_selection(spark.createDataFrame(rows, "champion string, slot int, item_id int, games long")).collect()
    want = []
    for c in range(4):
        taken = set()
        for slot in range(1, 7):
            here = sorted((-g, i) for n, s, i, g in rows if n == f"C{c}" and s == slot and i not in taken)[:3]
            want += [(f"C{c}", slot, k + 1, i, -g) for k, (g, i) in enumerate(here)]
            taken |= {i for _, i in here[:1]}
    assert sorted(tuple(r) for r in got) == sorted(want)


def letters_by_hand(scores):
    """k-means on a sorted list, clusters that are near made one, and letters by the cluster's mean."""
    xs = sorted(scores)
    n, spread = len(xs), xs[-1] - xs[0]
    if n == 1 or spread < 1e-9:
        cluster = [0] * n
    else:
        k = min(5, n)
        centres, cluster = [xs[int((c + 0.5) * n / k)] for c in range(k)], None
        for _ in range(50):
            new = [min(range(k), key=lambda c: (abs(x - centres[c]), c)) for x in xs]
            if new == cluster:
                break
            cluster = new
            centres = [sum(m) / len(m) if (m := [x for x, c in zip(xs, cluster) if c == j]) else centres[j] for j in range(k)]
    groups = [[x for x, c in zip(xs, cluster) if c == j] for j in dict.fromkeys(cluster)]
    mean = lambda g: sum(g) / len(g)
    while True:
        near = next((i for i in range(len(groups) - 1) if mean(groups[i + 1]) - mean(groups[i]) < 0.08 * spread), None)
        if near is None:
            break
        groups[near : near + 2] = [groups[near] + groups[near + 1]]
    middle = mean(xs)
    deviation = math.sqrt(sum((x - middle) ** 2 for x in xs) / n)
    of = {}
    for g in groups:
        z = 0.0 if deviation < 1e-9 else (mean(g) - middle) / deviation
        of.update(dict.fromkeys(g, LETTERS[sum(z < c for c in (0.84, 0.25, -0.25, -0.84))]))
    return [of[x] for x in scores]


def test_letters_against_brute_force():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 6, 20, 48, 173):
        for _ in range(20):
            x = np.round(rng.choice([rng.normal(size=n), rng.random(n), np.repeat(0.5, n)]), 3)
            assert list(letters(x)) == letters_by_hand(list(x))


def test_number_and_text(spark):
    from muster.functions.text import number

    got = [one(spark, number(F.lit(x))) for x in (3.0, 12.5, 0.125, 0.1, 1e9, 123456789.256, -1.5, 0.0)]
    assert got == ["3", "12.5", "0.13", "0.1", "1000000000", "123456789.26", "-1.5", "0"]
    assert one(spark, plain_text(F.lit("a<br>\n\n<p>b</p>\n\n\n<div>c</div> &amp;lt; <RULES>d</RULES>"))) == "a\n\nb\n\nc\n&lt; d"
    values = F.create_map(F.lit("a"), F.array(F.lit(2.0)), F.lit("b_1"), F.array(F.lit(0.333)))
    assert one(spark, with_values(F.lit("@A@@b_1*100@ x @ @a@"), values)) == "233.3 x @ 2"
    assert one(spark, resolved_lines(F.lit("@x@ a\nb\nc @y@"))) == "b" and one(spark, with_values(F.lit("none"), values)) == "none"


def test_reference_documents(spark, tmp_path):
    import json

    from muster.sources import documents
    from muster.sources.snapshots import write_dimension

    doc = lambda x: spark.createDataFrame([(json.dumps(x),)], "document string")
    curated = spark.createDataFrame([(1, "boots"), (7, "excluded")], "id int, category string")
    shop = {"data": {"1": {"name": "Shoes", "maps": {"11": True, "30": True}}, "2": {"name": "Old", "maps": {"30": False}}, "3": {"name": "Other", "maps": {"11": True}}, "4": {"name": "Bare"}}}
    assert sorted(map(tuple, documents.reference_items(doc(shop), curated).collect())) == [(1, "Shoes", "boots")]
    heroes = {"data": {"A": {"id": "A", "name": "Aa", "tags": ["Mage", "Tank"]}, "B": {"id": "B", "name": "Bb", "tags": []}}}
    assert sorted(map(tuple, documents.reference_champions(doc(heroes)).collect())) == [("A", "Aa", "Mage"), ("B", "Bb", None)]
    icons = "/x/assets/%s/i.png"
    list_ = [
        {"id": 7, "nameTRA": "Seven", "rarity": "kBronze", "augmentSmallIconPath": icons % "Cherry"}, {"id": 8, "nameTRA": "Eight", "rarity": "kNew", "augmentSmallIconPath": icons % "KIWI"},
        {"id": 9, "nameTRA": "", "rarity": "kGold", "augmentSmallIconPath": icons % "Kiwi"}, {"id": 10, "nameTRA": "Ten", "rarity": "kGold", "augmentSmallIconPath": icons % "Kiwi/Strawberry"},
        {"id": 11, "nameTRA": "Eleven", "rarity": "kGold"}, {"id": 12, "nameTRA": "Twelve", "rarity": "kEventChoice", "augmentSmallIconPath": icons % "kiwi"},
    ]
    found = documents.reference_augments(doc(list_), curated)
    assert sorted(map(tuple, found.collect())) == [(7, "Seven", "silver", "excluded"), (8, "Eight", "gold", None), (12, "Twelve", "prismatic", None)]
    write_dimension(found, f"{tmp_path}/augments")
    write_dimension(found.where("id = 7"), f"{tmp_path}/augments")
    assert spark.read.parquet(f"{tmp_path}/augments").count() == 1


def test_match_and_timeline_documents(spark):
    import json

    from muster.sources import documents

    match = {"metadata": {"matchId": "M"}, "info": {"gameCreation": 1_700_000_000_000, "gameVersion": "16.18.1", "extra": 1, "participants": [
        {"puuid": "p", "riotIdGameName": "Ann", "riotIdTagline": "EUW", "championName": "C", "playerSubteamId": 2, "placement": 1, "kills": 3, "deaths": 0, "assists": 1, "playerAugment1": 5, "playerAugment3": 9, "item0": 0, "item6": 1001},
        {"puuid": "q", "riotIdGameName": "", "riotIdTagline": "X", "championName": "D", "playerSubteamId": 1, "placement": 2}]}}
    docs = spark.createDataFrame([(json.dumps(match),), (None,), ("{broken",)], "document string")
    got = {r["puuid"]: r for r in documents.participants(docs).collect()}
    assert (got["p"]["augments"], got["p"]["items"], got["p"]["riot_id"], got["q"]["riot_id"], got["q"]["items"]) == ([5, 9], [1001], "Ann#EUW", None, [])
    event = lambda t, **k: {"type": t, "timestamp": 5, "participantId": 1, **k}
    line = {"metadata": {"matchId": "M"}, "info": {"frames": [
        {"events": [event("ITEM_PURCHASED", itemId=1001), event("LEVEL_UP"), event("ITEM_PURCHASED", itemId=220_003)]}, {}, {"events": [event("ITEM_PURCHASED", itemId=2144), event("ITEM_PURCHASED", itemId=1002)]},
        {"events": [event("ITEM_UNDO", beforeId=1002, afterId=0), event("ITEM_PURCHASED", itemId=1003), event("ITEM_DESTROYED", itemId=1001)]}]}}
    events = documents.timeline_events(spark.createDataFrame([(json.dumps(line),)], "document string"))
    assert events.count() == 7
    assert crawl.timeline_item_order(events, ["match_id", "participant"], ["position"]).first()["item_order"] == [1001, 1003]


def test_archive_needs_two_published_patches(spark):
    from muster.operators import archive

    m = spark.sql("SELECT * FROM VALUES ('a', '16.1', TIMESTAMP_NTZ'2026-01-01 00:00:00', CAST(NULL AS TIMESTAMP_NTZ)), ('b', NULL, TIMESTAMP_NTZ'2026-01-01 00:00:00', NULL), ('c', '16.3', TIMESTAMP_NTZ'2026-01-01 00:00:00', NULL) "
                  "AS t(match_id, patch, ingested_at, archived_at)")
    built = m.select("match_id", F.col("ingested_at").alias("built_at"))
    patches = lambda *x: spark.createDataFrame([(p,) for p in x], "patch string")
    assert [r["match_id"] for r in archive.choose(m, built, patches("16.3", "16.2"), 9).collect()] == ["a"]
    assert archive.choose(m, built, patches("16.3"), 9).count() == 0 and archive.choose(m, built, patches("16.3", "16.2"), 0).count() == 0


def test_lists(spark):
    from muster.operators import lists

    rows = spark.createDataFrame([("a", 3.0, 1.0), ("b", 3.0, 2.0), ("c", 3.0, None)], "k string, avg_placement double, score double")
    assert {r["meter"] for r in lists.placement_meter(rows).collect()} == {50.0}
    assert [r["k"] for r in lists.sorted_list(rows, "k").collect()] == ["b", "a", "c"]
    assert [r["k"] for r in lists.page(lists.sorted_list(rows, "k", "avg"), 2, 2).collect()] == ["c"]
    swing = spark.createDataFrame([("b", 0.5), ("a", 0.7)], "k string, swing double")
    assert [[r["k"] for r in lists.swing_order(rows, swing, "k", later).collect()] for later in (True, False)] == [["a", "b", "c"], ["b", "a", "c"]]
    spread = lists.placement_meter(spark.createDataFrame([(2.0,), (3.0,), (4.0,)], "avg_placement double")).collect()
    assert [r["meter"] for r in spread] == [92.0, 46.0, 3.0]


def test_queue_after_visits(spark):
    q = spark.sql("SELECT * FROM VALUES ('a', 3, TIMESTAMP_NTZ'2026-01-01 00:00:00'), ('b', 4, NULL), ('c', 1, NULL) AS t(puuid, error_count, last_crawled_at)")
    visits = spark.createDataFrame([("a", True), ("b", False)], "puuid string, ok boolean")
    got = {r["puuid"]: (r["error_count"], str(r["last_crawled_at"])) for r in crawl.after_visits(q, visits, F.expr("TIMESTAMP_NTZ'2026-01-02 00:00:00'")).collect()}
    assert got == {"a": (0, "2026-01-02 00:00:00"), "b": (5, "2026-01-02 00:00:00"), "c": (1, "None")}


def test_leaves_of_nested_documents(spark):
    doc = {"k": {"a": [[1, {"b": "x]}"}], []], "c": None, "d": {"e": {"f": {"g": True}}}, 'q"{': 2}}
    got = {(r["path"], r["value"]) for r in diff.leaves(snapshot_rows(spark, doc)).collect()}
    assert {("a.0.0", "1"), ("a.0.1.b", "x]}"), ("d.e.f.g", "true"), ('q"{', "2")} <= got


def test_leaves_at_any_depth(spark):
    import json

    deep, path = {"x": 1, "\\\\": "\\"}, []
    for i in range(21):  # more than one plan's levels, with brackets and backslashes in texts and names
        deep, path = ({"n": deep, "\\": '{"[\\'} if i % 2 else [deep, "}\\"]), [("n" if i % 2 else "0"), *path]
    rows = spark.createDataFrame([("k", json.dumps(deep))], "key string, payload string")
    got = {(r["path"], r["value"]) for r in diff.leaves(rows, levels=6).collect()}
    assert (".".join([*path, "x"]), "1") in got and not any(v and v.startswith(("{\"n", "[[", "[{")) for _, v in got)
    assert len(got) == 23 and got == {(r["path"], r["value"]) for r in diff.leaves(rows, levels=40).collect()}


def snapshot_rows(spark, documents):
    import json

    return spark.createDataFrame([(k, json.dumps(v)) for k, v in documents.items()], "key string, payload string")
