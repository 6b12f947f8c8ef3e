import pytest

from muster.llm import exact_dedup, jaccard, mixing, suffixes
from muster.llm import quality
from muster.llm.store import as_table, with_row_id

KEY = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def moving(spark, tmp_path):
    """A table of files of uneven length, which every read packs into other partitions."""
    words = lambda i: " ".join(f"w{i * 7919 % 613}x{j * i % 89}" for j in range(60))
    rows = [(i, words(i), "en", "ab"[i % 2]) for i in range(200)]
    rows += [(1000 + i, words(i).upper() if i % 2 else words(i) + " more", "en", "a") for i in range(0, 200, 5)]
    path = f"{tmp_path}/docs"
    for k in range(9):
        part = [r for i, r in enumerate(rows) if i % 45 in range(k * (k + 1) // 2, (k + 1) * (k + 2) // 2)]
        spark.createDataFrame(part, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark.read.parquet(path)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset(KEY)


def test_row_ids_of_two_reads(spark, moving):
    got = []
    for cores in (1, 2, 6):
        spark.conf.set(KEY, str(cores))
        got.append({r["doc_id"]: r["row"] for r in with_row_id(moving.select("doc_id", "text"), "row").select("row", "doc_id").collect()})
    assert got[0] == got[1] == got[2] and len(set(got[0].values())) == len(got[0]) == 240
    made = with_row_id(spark.range(10).toDF("doc_id"), "row")
    assert made.select("row").distinct().count() == 10 and sorted(made.collect()) == sorted(made.collect())


def test_operators_over_two_reads(spark, moving, monkeypatch):
    spark.conf.set(KEY, "1")
    text = {r["doc_id"]: r["text"] for r in moving.collect()}
    stored = exact_dedup.stored

    def moved(df, name="t"):
        out = stored(df, name)
        spark.conf.set(KEY, str(int(spark.conf.get(KEY)) % 6 + 1))
        return out

    for module in (exact_dedup, jaccard, mixing, suffixes):
        monkeypatch.setattr(module, "stored", moved)
    best = {}
    for i, t in text.items():
        best[t.lower()] = max(i, best.get(t.lower(), i))
    assert sorted(r["doc_id"] for r in exact_dedup.dedup(moving).collect()) == sorted(best.values())
    wanted = {r["doc_id"]: r["copies"] for r in mixing.mix_report(moving).collect()}
    mixed = [r["doc_id"] for r in mixing.mix(moving).collect()]
    assert len(mixed) == sum(wanted.values()) and all(mixed.count(i) == wanted[i] for i in text)

    sets = {i: {tuple(t.lower().split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in text.items()}
    group = {i: i for i in text}
    for i in text:
        for j in text:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(moving, 5, 80).collect()) == sorted(set(group.values()))

    windows = {}
    for i, t in text.items():
        w = t.split()
        for j in range(len(w) - 49):
            windows.setdefault(tuple(w[j : j + 50]), set()).add(i)
    covered = {i: set() for i in text}
    for i, t in text.items():
        w = t.split()
        for j in range(len(w) - 49):
            if len(windows[tuple(w[j : j + 50])]) > 1:
                covered[i].update(range(j, j + 50))
    cut = {r["doc_id"]: r["text"].split() for r in suffixes.without_repeats(moving).collect()}
    assert cut == {i: [x for j, x in enumerate(t.split()) if j not in covered[i]] for i, t in text.items()}


def test_tables_that_are_not_files(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    docs = spark.range(300, numPartitions=5).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 29), x -> concat('w', (id % 250 * 31 + x * 17) % 997))) AS text", "'en' AS lang", "'s' AS source")
    assert docs.repartition(7).transform(exact_dedup.dedup).select("text").distinct().count() == 250
    assert quality.keep_good(docs.repartition(3)).count() == 300 and as_table(docs).count() == 300
    kept = jaccard.one_of_each(docs.repartition(4))
    assert kept.count() == kept.select("text").distinct().count() <= 250


def test_row_ids_need_no_join(spark, moving, monkeypatch):
    from muster.llm import store

    monkeypatch.setattr(store, "SMALL", 0)
    plan = with_row_id(moving, "row")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_row_ids_where_every_hash_clashes(spark, moving, monkeypatch):
    from muster.llm import store

    monkeypatch.setattr(store, "SEEDS", 0)
    for small in (0, 200_000):
        monkeypatch.setattr(store, "SMALL", small)
        rows = with_row_id(moving, "row").select("row").collect()
        assert len({r["row"] for r in rows}) == len(rows) == 240
