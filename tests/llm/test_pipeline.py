import base64
import collections
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from muster.llm import oracle, queries
from tests.llm.test_exact_and_shards import LOWER, water_fill
from tests.llm.test_similar import WORD, brute

DATA = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    out = corpus_pipeline.run(spark, DATA).select("doc_id", "source", "n_tokens").collect()
    assert out and {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = {r["doc_id"] for r in queries.op5_quality_rules(spark, DATA).where("kept").collect()}
    assert {r["doc_id"] for r in out} <= kept


def corpus():
    """Prose of two sources with exact and near copies, junk, empty and null rows, repeats."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega", "theta")) + str(rng.randrange(400)) for _ in range(n))
    rows = [(i, prose(rng.randrange(20, 90)), "en" if i % 3 else None, ("a", "b", "c", None)[i % 4]) for i in range(160)]
    rows += [(200 + i, rows[i][1].upper(), "en", "b") for i in range(0, 160, 8)]  # exact copies but for case
    for i in range(0, 160, 5):  # near copies
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((400 + i, " ".join([*words, "more"]), "en", "a"))
    rows += [(600 + i, "## $$ %% " * 20 + prose(20), "en", "a") for i in range(6)] + [(700, None, "en", "a"), (701, "", None, None), (702, "short text", "en", "a"), (None, prose(40), "en", "c")]
    return rows + rows[3:9] + [(None, rows[-1][1], "en", "c")]


def test_every_stage_by_hand(spark, stored_docs):
    clash = ("row", "v", "copies", "point", "m", "kept")
    docs = stored_docs(corpus(), [(c, F.lit("mine")) for c in clash])
    given = docs.collect()
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "step")
        steps.append(docs.collect())
        assert docs.columns[: len(given[0])] == given[0].__fields__ and all(r[c] == "mine" for r in steps[-1] for c in clash)
    count = lambda rows: collections.Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    good, single, apart, mixed, coded = steps

    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(i, *tuple(r)[1:4]) for i, r in enumerate(given)])
    judged = [given[i] for i, kept in duck.sql(f"SELECT doc_id, kept FROM ({oracle.QUALITY})").fetchall() if kept]
    assert count(good) == count(judged) and 0 < len(good) < len(given)

    groups = collections.defaultdict(list)
    for r in good:
        groups[r["text"].translate(LOWER)].append(r["doc_id"])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert {r["text"].translate(LOWER): r["doc_id"] for r in single} == best and len(single) == len(best) and count(single) <= count(good)

    known = sorted(single, key=lambda r: (r["doc_id"] is None, r["doc_id"]))  # the smallest doc_id of a group stays, null last
    roots = {root for _, root in brute([r["text"] for r in known], 5, 80)}
    assert count(apart) == count(known[i] for i in roots) and len(apart) < len(single)

    words = lambda r: len(WORD.findall(r["text"] or ""))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in apart:
        sizes[r["source"]] += words(r)
    for r in mixed:
        taken[r["source"]] += words(r)
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    want = water_fill({s: sizes[s] for s in names}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    assert all(n <= 2 and k in count(apart) for k, n in count(mixed).items())
    assert all(abs(taken[s] - want[s]) <= max(words(r) for r in apart if r["source"] == s) for s in names)

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert count(coded) == count(mixed) and all(r["input_ids"] == library.encode_ordinary(r["text"]) and r["n_tokens"] == len(r["input_ids"]) for r in coded)


def test_empty_table(spark, stored_docs):
    docs = stored_docs([])
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "step")
        assert docs.count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)
