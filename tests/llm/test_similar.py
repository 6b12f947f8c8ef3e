import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import graph, jaccard, suffixes
from tests.llm.conftest import near_copies

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def root(parent, x):
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else {tuple(w)} if w else set()


def brute(texts, n, percent):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(parent, i), root(parent, j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), root(parent, i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,percent,leaf,block,seed", [(3, 90, 16, 500, 1), (5, 80, 2, 6, 2), (3, 60, 2, 9, 3)])
def test_components(stored_docs, monkeypatch, n, percent, leaf, block, seed):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GROUP", 7)
    texts = near_copies(seed) + [None, "", " ", "a", "A", "b c", "B C", "b c"]
    docs = stored_docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(docs, n, percent, leaf=leaf, pivots=2, rounds=2).collect()}
    assert got == dict(enumerate(brute(texts, n, percent)))


def test_a_chain_is_no_region(stored_docs, monkeypatch):
    words = [f"w{i * 7919 % 10_007}" for i in range(1000)]
    texts = [" ".join(words[3 * i : 3 * i + 60]) for i in range(300)]
    sizes, real = [], jaccard.stored

    def seen(df, name="t"):
        out = real(df, name)
        if name in ("members", "regions", "seen"):
            sizes.append(out.groupBy("cell").agg(F.countDistinct("key").alias("n")).agg(F.max("n")).first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "stored", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(stored_docs([(i, t, "en", "s") for i, t in enumerate(texts)]), 3, 90).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute(texts, 3, 90))} and set(got.values()) == {0} and max(sizes) < 60


@pytest.mark.parametrize("leaf,rounds", [(4, 0), (4, 3), (16, 4)])
def test_dense_and_far_cells(stored_docs, monkeypatch, leaf, rounds):
    rng = random.Random(leaf + rounds)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    common = [f"c{i}" for i in range(90)]
    texts = [" ".join([*common, *(f"x{rng.randrange(10**6)}" for _ in range(9))]) for _ in range(40)]  # all at some 0.18 from one another
    texts += [" ".join([*common, *(f"y{j}" for j in range(k))]) for k in range(12)]  # the first are linked, and with some of the next
    texts += [" ".join(["rare words here", *(f"z{rng.randrange(10**6)}" for _ in range(30))]) for _ in range(40)]  # far from one another
    texts += [t + " more" for t in texts[::9]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(stored_docs([(i, t, "en", "s") for i, t in enumerate(texts)]), 3, 90, leaf=leaf, pivots=3, rounds=rounds).collect()}
    assert got == dict(enumerate(brute(texts, 3, 90)))


def test_rare_shingles_do_not_hide_common_ones(stored_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_BITS", 10, raising=False)
    monkeypatch.setattr(jaccard, "TABLE_BITS", (10, 22), raising=False)
    monkeypatch.setattr(jaccard, "PART", 256, raising=False)
    rows, real = [], jaccard.stored

    def seen(df, name="t"):
        out = real(df, name)
        if name == "members":
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", seen)
    # twelve documents share a passage of eight words, all else is in one document only
    texts = [" ".join([*(f"p{i // 12}_{j}" for j in range(8)), *(f"u{i}_{j}" for j in range(100))]) for i in range(4000)]
    got = jaccard.join_components(stored_docs([(i, t, "en", "s") for i, t in enumerate(texts)]), 3, 90).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, 106, i) for i in range(4000)} and rows[0] < 200


def test_table_of_counts(stored_docs):
    texts = [f"a b c d{i % 400} e{i}" for i in range(1500)] + [None, "a b c"]
    docs = stored_docs([(i, t, "en", "s") for i, t in enumerate(texts)]).withColumn("row", F.col("doc_id")).select("row", "doc_id", F.col("text").cast("binary").alias("text"))
    bits = jaccard.table_bits(docs.count())
    want = np.zeros(1 << bits, np.int64)
    for _, words in jaccard.hashed_docs(docs.select("text").toArrow().column(0).combine_chunks(), lower=True):
        np.add.at(want, jaccard._entry(jaccard.shingle_set(words, 3), bits), 1)
    got = jaccard._counts(jaccard._profile(docs, 3, bits), bits)
    assert (got == want).all() and got.max() >= 1501 and got.sum() == 3 * 1500 + 1
    assert [jaccard.table_bits(n) for n in (0, 1 << 14, (1 << 14) + 1, 256_410, 1 << 30)] == [16, 16, 17, 20, 22]


def test_sieve_keeps_all_partners():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 90).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, rng.integers(60, 200))) for _ in range(60)]
    labels, blocks = np.arange(60) // 2, np.arange(60) % 2
    for own in (blocks, 0 * blocks):
        may = jaccard._may_link([jaccard.signature(s) for s in sets], np.array([len(s) for s in sets]), labels, own, 80)
        for i in range(60):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if labels[i] != labels[j] and (own[i] != own[j] or not own.any()) and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                    assert may[i] and may[j]


def test_one_of_each(stored_docs, edge):
    docs = stored_docs(edge, [("row", F.lit(0)), ("point", F.lit(1))])
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, (r["doc_id"] for r in out.collect()))) == sorted(map(repr, [1, 2, 3, None, 4, 6, 7, 8, None]))
    assert jaccard.one_of_each(stored_docs([])).count() == 0


def test_bound_is_below_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        d = 1 - len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert jaccard.distance_bound(jaccard.signature(a), jaccard.signature(b), len(a), len(b)) <= d + 1e-12


def test_graph(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(80)]
    parent = {v: v for e in edges for v in e}
    for a, b in edges:
        if a != b:
            x, y = root(parent, a), root(parent, b)
            parent[max(x, y)] = min(x, y)
    got = {r["v"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root(parent, v) == got.get(v, v) for v in parent)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def spans(texts, least):
    seen, words = collections.defaultdict(set), [WORD.findall(t or "") for t in texts]
    for i, w in enumerate(words):
        for j in range(len(w) - least + 1):
            seen[tuple(w[j : j + least])].add(i)
    out = set()
    for i, w in enumerate(words):
        covered = sorted({j + k for j in range(len(w) - least + 1) if len(seen[tuple(w[j : j + least])]) > 1 for k in range(least)})
        for j, c in enumerate(covered):
            if not j or covered[j - 1] != c - 1:
                start = c
            if j + 1 == len(covered) or covered[j + 1] != c + 1:
                out.add((i, start, c + 1))
    return out


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    parts = [[rng.choice(vocabulary) for _ in range(rng.choice([12, 20, 60]))] for _ in range(6)]
    texts = []
    for _ in range(150):
        x = []
        for _ in range(rng.choice([1, 2, 3])):
            p, a = rng.choice(parts), rng.randrange(6)
            x += [rng.choice(vocabulary) for _ in range(rng.randrange(15))] + p[a : len(p) - rng.randrange(6)]
        texts.append(" ".join(x + ["z"] * rng.choice([0, 0, 0, 30])))
    return texts


@pytest.mark.parametrize("least,group,batch,hot", [(12, 8192, 2048, 1 << 17), (15, 7, 16, 30), (8, 40, 64, 1)])
def test_repeated_passages(stored_docs, monkeypatch, least, group, batch, hot):
    monkeypatch.setattr(suffixes, "GROUP", group)
    monkeypatch.setattr(suffixes, "HOT", hot)  # all grams by broadcast, some, or none
    monkeypatch.setattr(suffixes, "BATCH", batch)
    texts = passages(least) + [None, "", " ", "a b"]
    got = suffixes.repeated_passages(stored_docs([(i, t, "en", "s") for i, t in enumerate(texts)]), least).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in got} == spans(texts, least)
    assert all(r["n_words"] == r["end_word"] - r["start_word"] for r in got)


def test_cutting(stored_docs, edge):
    shared = " ".join(f"s{i}" for i in range(60))
    docs = stored_docs(edge + [(50, f"é one {shared}\ntwo", "en", "a"), (51, f"three {shared}", "en", "a")], [("row", F.lit(1)), ("spans", F.lit(2))])
    out = suffixes.without_repeats(docs)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs.columns and texts[50] == "é one two" and texts[51] == "three " and texts[1] is None
    assert suffixes.repeated_passages(stored_docs([])).count() == 0
