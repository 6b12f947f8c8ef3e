import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import runs
from muster.llm.queries import op13_periodic_runs
from muster.llm.textwords import mix


def brute(words, least=12):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if length >= max(least, 2 * p):
                best.setdefault((start, length), p)
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def hashed(words):
    return mix(np.array(words, np.uint64) + np.uint64(1))


def documents(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.choice([0, 1, 5, 11, 12, 13, 30, 80, 200])
        d = [rng.randrange(rng.choice([1, 2, 2, 3, 20, 1000])) for _ in range(n)]
        if rng.random() < 0.6 and n > 3:
            a = rng.randrange(n)
            p = rng.randrange(1, n + 1 - a)
            d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
        yield d


@pytest.mark.parametrize("least", [4, 7, 12])
def test_runs_of_many_documents(least):
    docs = list(documents(least, 1500))
    found = runs.runs_of([hashed(d) for d in docs], least)
    for d, rows in zip(docs, found):
        assert [tuple(r) for r in rows.tolist()] == brute(d, least)


def test_grid_in_several_steps_and_arrays_in_several_groups(monkeypatch):
    docs = list(documents(1, 300))
    whole = [r.tolist() for r in runs.runs_of([hashed(d) for d in docs])]
    monkeypatch.setattr(runs, "PLACES", 16)
    monkeypatch.setattr(runs, "GROUP_WORDS", 50)
    assert [r.tolist() for r in runs.runs_of([hashed(d) for d in docs])] == whole


def test_extensions_against_a_plain_count():
    rng = random.Random(2)
    s = np.array([rng.randrange(2) for _ in range(300)] + [9])
    i, j = np.array([(a, b) for a in range(0, 300, 3) for b in range(1, 300, 7) if a != b]).T
    plain = [next(k for k in range(301) if s[a + k] != s[b + k]) for a, b in zip(i, j)]
    assert runs.Extensions(s).between(i, j).tolist() == plain


def test_long_text_of_one_word(spark):
    text = " ".join(["x"] * 200_000)
    row = runs.with_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 200_000, 1)] and row["collapsed"] == "x"


def expected(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute(w)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    rest = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())


def test_query_against_plain_python(spark, tmp_path, edge):
    rows = [(i, t) for i, t, _, _ in edge if t is None or len(t) < 100_000]
    rows += [(i, " ".join(f"w{x}" for x in d)) for i, d in enumerate(documents(5, 200))]
    rows += [(7, "a b " * 30), (None, "a  b\n" * 30), (7, "a b " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, (expected(i, t) for i, t in rows)))


def test_empty_tables_and_clashing_names(spark, stored_docs, edge):
    docs = stored_docs(edge, [("runs", F.lit("old")), ("Collapsed", F.lit(1)), ("__text", F.lit("kept"))])
    out = runs.with_runs(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "__text", "runs", "collapsed"] and out.count() == len(edge)
    assert out.where("__text = 'kept'").count() == len(edge)
    assert runs.with_runs(stored_docs([])).count() == 0
