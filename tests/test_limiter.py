import datetime as dt
import random

import pytest

from muster.operators import crawl, limiter, pieces

START = dt.datetime(2026, 1, 1)
EVENT = "event_id long, user_id long, ts timestamp"


def loop(arrivals, limits, max_wait):
    """The queue as it runs: in whole milliseconds, looking at the windows again after each wait."""
    gone, out, free = [], [], 0
    for arrival in arrivals:
        now = max(arrival, free)
        deadline = None if max_wait is None else now + max_wait
        while True:
            wait = 0
            for n, w in limits:
                inside = [t for t in gone if now - t < w]
                if len(inside) >= n:
                    wait = max(wait, w - (now - inside[0]) + 1)
            if not wait:
                gone.append(now)
                out.append(now - arrival)
                break
            if deadline is not None and now + wait > deadline:
                out.append(None)
                break
            now += wait
        free = now
    return out


def closed_form(arrivals, limits):
    """A request follows the n-th before it by w and a millisecond at least."""
    go = []
    for a in arrivals:
        go.append(max([a, *go[-1:], *(go[-n] + w + 1 for n, w in limits if len(go) >= n)]))
    return go


def given(seed, count, seconds, users=(1, 1, 1, 1, 2, 3)):
    rng = random.Random(seed)
    return [(i, rng.choice(users), START + dt.timedelta(milliseconds=1000 * rng.randrange(seconds) + rng.choice([0, 0, 1, 999]))) for i in range(count)]


def by_user(events):
    out = {}
    for i, user, ts in sorted(events, key=lambda e: (e[2], e[0])):
        out.setdefault(user, []).append((i, round((ts - START).total_seconds() * 1000)))
    return out


LIMITS = [((2, 3), (5, 20)), ((3, 10), (4, 14), (5, 17)), ((2, 5),), ((20, 1), (100, 120)), ((1, 2), (7, 9))]


@pytest.mark.parametrize("limits", [LIMITS[0], LIMITS[1], LIMITS[4]])
def test_paced_against_the_recursion(spark, monkeypatch, limits):
    monkeypatch.setattr(pieces, "PIECES", 7)
    events = given(len(limits), 300, 200)
    got = {r["event_id"]: r["go"] for r in limiter.paced(spark.createDataFrame(events, EVENT), "user_id", limits).collect()}
    epoch = round(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    for rows in by_user(events).values():
        for (i, _), go in zip(rows, closed_form([t for _, t in rows], [(n, w * 1000) for n, w in limits])):
            assert got[i] == (go + epoch) * 1000


@pytest.mark.parametrize(("limits", "max_wait"), [(LIMITS[0], None), (LIMITS[0], 4), (LIMITS[1], 15), (LIMITS[2], 0)])
def test_limited_against_the_loop(spark, monkeypatch, limits, max_wait):
    monkeypatch.setattr(pieces, "PIECES", 5)
    events = given(max_wait or 99, 300, 400)
    got = {r["event_id"]: r["wait_us"] for r in limiter.limited(spark.createDataFrame(events, EVENT), "user_id", limits, max_wait).collect()}
    for rows in by_user(events).values():
        wanted = loop([t for _, t in rows], [(n, w * 1000) for n, w in limits], None if max_wait is None else max_wait * 1000)
        assert [got[i] for i, _ in rows] == [None if x is None else x * 1000 for x in wanted]


def test_blocks_of_a_long_queue(spark):
    """More requests of one key than a block holds, all at once."""
    n = 25_000
    events = spark.range(n).selectExpr("id AS event_id", "1L AS user_id", "timestamp_micros(1767225600000000 + (id div 1000) * 1000) AS ts")
    got = [r["go"] for r in limiter.paced(events, "user_id", ((3, 1), (10, 5))).orderBy("event_id").collect()]
    assert got == [(x * 1000) + 1767225600000000 for x in closed_form([i // 1000 for i in range(n)], [(3, 1000), (10, 5000)])]


def test_events_without_time_or_key(spark):
    events = spark.createDataFrame([(1, None, START), (2, None, START), (3, None, START), (4, 5, None), (5, None, None)], EVENT)
    got = {r["event_id"]: r["wait_us"] for r in limiter.limited(events, "user_id", ((2, 3),)).collect()}
    assert got == {1: 0, 2: 0, 3: 3_001_000, 4: 0, 5: 0}
    assert limiter.limited(events.limit(0), "user_id").count() == 0 and limiter.paced(events.limit(0), "user_id").count() == 0


def test_one_outlier_leaves_pieces_even(spark):
    events = [(i, 1, START + dt.timedelta(seconds=i)) for i in range(4000)] + [(9999, 1, dt.datetime(1970, 1, 2)), (9998, 2, START)]
    e = spark.createDataFrame(events, EVENT).selectExpr("event_id", "user_id AS k", "unix_micros(ts) AS t")
    sizes = sorted(r["count"] for r in pieces.with_pieces(e, "k", "t").where("k = 1").groupBy("piece").count().collect())
    assert len(sizes) > 200 and sizes[-1] < 5 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("most", [0, 3])
def test_admission_over_pieces(spark, monkeypatch, most):
    monkeypatch.setattr(pieces, "PIECES", 9)
    events = [*given(3, 300, 600), (900, 1, dt.datetime(1970, 1, 2))]
    got = {r["event_id"]: r["admitted"] for r in crawl.admitted(spark.createDataFrame(events, EVENT), "user_id", most, 20).collect()}
    for rows in by_user(events).values():
        recent = []
        for i, t in rows:
            recent = [x for x in recent if t - x < 20_000]
            assert got[i] == (len(recent) < most)
            if got[i]:
                recent.append(t)
