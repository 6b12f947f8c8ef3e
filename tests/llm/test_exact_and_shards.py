import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from muster.llm import exact_dedup, mixing, sharding
from muster.llm.store import shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def index(spark):
    return exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/index", 4)


def test_decisions_by_hand(spark, stored_docs, edge):
    docs = stored_docs(edge)
    groups = collections.defaultdict(list)
    for i, t, *_ in edge:
        groups[(t or "").translate(LOWER)].append(i)
    rows = exact_dedup.decisions(docs, index(spark)).collect()
    assert len(rows) == len(edge)
    for t, ids in groups.items():
        digest = hashlib.sha256(t.encode()).digest()
        own = [r for r in rows if bytes(r["digest"]) == digest]
        best = max((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) == own[0]["group_size"] and sum(r["kept"] for r in own) == 1
        assert all(r["keep_id"] == best for r in own) and next(r for r in own if r["kept"])["doc_id"] == best


def test_index_persists_and_grows(spark, stored_docs):
    path = f"{shared_dir(spark)}/index"
    first, second = stored_docs([(1, "a", "", ""), (2, "b", "", "")]), stored_docs([(9, "A", "", ""), (3, "c", "", "")])
    assert exact_dedup.dedup(first, exact_dedup.DigestIndex(spark, path, 4)).count() == 2
    later = exact_dedup.DigestIndex(spark, path, 4)  # as a new session would open it
    assert [r["doc_id"] for r in exact_dedup.dedup(second, later).collect()] == [3]
    assert later.unbucketed().count() == 3
    assert exact_dedup.dedup(stored_docs([(7, "B", "", "")]), later).count() == 0
    assert exact_dedup.DigestIndex(spark, path).buckets == 4
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, path, 8)
    later.compact(6)
    later.close()
    grown = exact_dedup.DigestIndex(spark, path, 6)
    assert grown.rows().count() == 3 and exact_dedup.dedup(stored_docs([(8, "C", "", ""), (9, "d", "", "")]), grown).collect()[0]["doc_id"] == 9


def test_compacted_index_is_neither_shuffled_nor_sorted(spark, stored_docs):
    own = index(spark)
    for i in range(3):
        exact_dedup.dedup(stored_docs([(10 * i + k, f"t{10 * i + k}", "", "") for k in range(10)]), own).count()
    own.compact()
    assert len(own.rows().inputFiles()) == len({f.rsplit("_", 1)[1] for f in own.rows().inputFiles()}) <= 4
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        batch = spark.range(5).select(F.unhex(F.sha2(F.concat(F.lit("t"), "id").cast("string"), 256)).alias("digest"))
        joined = batch.join(own.rows().select("digest").hint("merge"), "digest", "left_anti")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Sort [") == 1 and "SortMergeJoin" in plan and joined.count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    own.close()


def test_a_batch_that_runs_again(spark, stored_docs):
    own = index(spark)
    first, later = stored_docs([(i, f"t{i % 7}", "", "") for i in range(20)]), stored_docs([(100 + i, f"t{i}", "", "") for i in range(9)])
    rows = lambda docs, name: sorted(map(tuple, exact_dedup.decisions(docs, own, name).select("doc_id", "keep_id", "group_size", "kept").collect()))
    want, after = rows(first, "monday"), rows(later, "tuesday")
    assert sum(k for *_, k in want) == 7 and [d for d, *_, k in after if k] == [107, 108] and after[0] == (100, 14, 1, False)
    # as a job whose driver died after the append would do it
    assert rows(first, "monday") == want and rows(later, "tuesday") == after and own.rows().count() == 9
    own.close()


def test_the_index_is_joined_with_groups_only(spark, stored_docs, monkeypatch):
    own = index(spark)
    exact_dedup.dedup(stored_docs([(i, f"t{i}", "", "") for i in range(50)]), own).count()
    own.compact()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plans, real = [], exact_dedup.stored
    monkeypatch.setattr(exact_dedup, "stored", lambda df, name="t": (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name))[1])
    try:
        out = exact_dedup.decisions(stored_docs([(i, f"t{i % 60}", "", "") for i in range(300)]), own)
        plan = dict(plans)["groups"]
        index_scans = [x for x in plan.split("\n") if "Bucketed: true" in x]
        # two exchanges and sorts, of the batch's groups for each join; none of the index
        assert len(index_scans) == 2 and plan.count("Exchange") == plan.count("Sort [") == 2
        assert "Bucketed: true" not in out._jdf.queryExecution().executedPlan().toString() and out.where("kept").count() == 10
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    own.close()


def test_hot_rows_are_spread(spark, stored_docs, monkeypatch):
    docs = stored_docs([(None, "same words here", "en", "a")] * 4000 + [(i, "x y", "en", "b") for i in range(50)])
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 100)
    seen = []
    real = mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name="t": (out := real(df, name), seen.append((name, out)))[0])
    taken = mixing.mix_report(docs).agg(F.sum("taken")).first()[0]
    first = next(df for name, df in seen if name == "level0")
    assert taken and max(r["count"] for r in first.groupBy("block", "source").count().collect()) < 200
    shards = sharding.shard_documents(docs)
    plan = shards._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r["count"] for r in shards.groupBy("shard").count().collect()} <= {101, 102}


def test_no_python_and_a_merge_join(spark, stored_docs):
    plan = exact_dedup.decisions(stored_docs([(1, "a", "", "")]), index(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SortMergeJoin" in plan


def test_dedup_keeps_columns_with_clashing_names(spark, stored_docs, edge):
    docs = stored_docs(edge, [("row", F.lit(1)), ("digest", F.lit("d")), ("kept", F.lit(None).cast("string"))])
    out = exact_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == len({(t or "").translate(LOWER) for _, t, *_ in edge})
    assert exact_dedup.dedup(stored_docs([])).count() == 0


def test_shards(spark, stored_docs, edge):
    docs = stored_docs(edge + [(100 + i, f"t{i % 50}", "en", "s") for i in range(990)])
    a = sharding.shard_documents(docs).collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
    b = sharding.shard_documents(docs).collect()
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert sorted(a, key=repr) == sorted(b, key=repr)
    sizes = collections.Counter(r["shard"] for r in a)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(40):
        assert sorted(r["slot"] for r in a if r["shard"] == k) == list(range(sizes[k]))
    by_id = {i: (t or "") for i, t, *_ in edge if i}
    for r in a:
        if r["doc_id"] in by_id:
            t = by_id[r["doc_id"]].encode()
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "rows", None)
    assert sharding.shard_documents(stored_docs([])).count() == 0


def test_matrix_has_the_margins():
    m = sharding.draw_matrix([5, 0, 300, 17], 40, 3)
    assert m.sum(1).tolist() == [5, 0, 300, 17] and set(m.sum(0)) <= {8, 9}


def test_shuffle_looks_uniform(spark):
    df = spark.range(8000)
    rows = sharding.shuffle_to_shards(df, "id", 8, 5).collect()
    for k in range(8):
        ids = [r["id"] for r in rows if r["shard"] == k]
        assert abs(sum(ids) / len(ids) - 4000) < 350
        first = [r["id"] for r in rows if r["shard"] == k and r["slot"] < 500]
        assert abs(sum(first) / len(first) - 4000) < 500
    # rows by stretch of 1000 ids and shard, and pairs that keep their order, as in a uniform shuffle
    cells = collections.Counter((r["id"] // 1000, r["shard"]) for r in rows)
    assert sum((cells[i, k] - 125) ** 2 / 125 for i in range(8) for k in range(8)) < 90  # 49 degrees of freedom
    place = {r["id"]: (r["shard"], r["slot"]) for r in rows}
    assert abs(sum(place[i] < place[i + 1] for i in range(7999)) / 7999 - 0.5) < 0.03
    assert abs(sum(place[i][0] == place[i + 1][0] for i in range(7999)) / 7999 - 0.125) < 0.02


def water_fill(sizes, weights, total):
    targets, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while total > 1e-9 and open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if total * weights[s] / w >= 2 * sizes[s]}
        if not over:
            return targets | {s: total * weights[s] / w for s in open_}
        for s in over:
            targets[s] = 2.0 * sizes[s]
            total -= 2 * sizes[s]
        open_ -= over
    return targets


def test_mixing(spark, stored_docs, edge, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = edge + [(100 + i, "w " * (1 + i * 7 % 40), "en", "hot" if i % 3 else f"s{i % 11}") for i in range(600)]
    docs = stored_docs(rows)
    out = mixing.mix_report(docs).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count("")
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want = water_fill({s: sizes[s] for s in names if sizes[s]}, weights, 1.5 * sum(sizes.values()))
    taken = collections.Counter()
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want.get(r["source"], 0.0)) < 1e-6 * max(1, r["target"])
        taken[r["source"]] += r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(size(t) for _, t, _, x in rows if x == s)
    assert sorted(out, key=repr) == sorted(mixing.mix_report(docs).collect(), key=repr)
    assert mixing.mix(docs).count() == sum(r["copies"] for r in out) and mixing.mix(docs).columns == docs.columns
    assert mixing.mix(stored_docs([])).count() == 0


def test_pivotal_is_fair():
    import numpy as np

    total = np.zeros(9)
    for seed in range(4000):
        done, left = mixing.pivotal([0.3] * 9, [1, 2, 3, 1, 2, 3, 1, 2, 3], np.random.default_rng(seed))
        assert sum(0 < f < 1 for f in done) == (left is not None)
        total += done
    assert abs(total / 4000 - 0.3).max() < 0.04
