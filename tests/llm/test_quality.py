import collections
import re

import numpy as np
from pyspark.sql import functions as F

from muster.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), base


def report(docs):
    return quality.quality_report(docs).collect()


def test_counts(stored_docs, edge):
    rows = edge + [(20, "a b c d e f a b c d e g\n" * 2 + "x\x1cy\x85z #|%", "en", "a"), (21, "same line\nsame line\n\n \nother", "en", "a")]
    got = report(stored_docs(rows))
    key = lambda x: repr(x)
    assert sorted([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got], key=key) == sorted([(i, *by_hand(t)) for i, t, *_ in rows], key=key)
    assert all(not r["kept"] for r in got if r["base_failed"]) and report(stored_docs([])) == []


def prose(rng, n=60, mark=""):
    return " ".join(f"w{rng.integers(500)}{mark if rng.random() < 0.7 else ''}" for _ in range(n))


def test_thresholds_follow_the_group(stored_docs):
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng), "en", "plain") for i in range(900)] + [(1000 + i, prose(rng, mark="%%"), "en", "plain") for i in range(20)]
    rows += [(2000 + i, prose(rng, mark="%%"), "en", "marked") for i in range(300)] + [(3000, prose(rng, mark="%%"), "en", "tiny"), (3001, prose(rng), None, None)]
    names = ("m", "row", "v", "kept", "base_failed", "_lang", "_source", "_fences", "high_symbols")
    docs = stored_docs(rows, [(n, F.lit("mine")) for n in names])
    kept = {r["doc_id"]: r["kept"] for r in report(docs)}
    assert all(kept[i] for i in range(900)) and not any(kept[1000 + i] for i in range(20)) and all(kept[2000 + i] for i in range(300)) and kept[3001]
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {i for i, k in kept.items() if k}
    assert all(r[n] == "mine" for r in out.limit(20).collect() for n in names)


def test_both_fences_bind(stored_docs):
    rng = np.random.default_rng(6)
    rows = [(i, "\n".join(prose(rng, 12) for _ in range(8)), "en", "plain") for i in range(400)]
    letters = " ".join(chr(97 + rng.integers(26)) for _ in range(90))
    lines = [prose(rng, 12) for _ in range(12)]
    rows += [(1000, letters, "en", "plain"), (1001, " ".join("x" * rng.integers(9, 14) for _ in range(90)), "en", "plain")]
    rows += [(1002, "\n".join([*lines, *(["a b"] * 9)]), "en", "plain"), (1003, "\n".join([*lines, "a b", "a b"]), "en", "plain"), (1004, letters, "xx", "single")]
    got = {r["doc_id"]: r for r in report(stored_docs(rows))}
    assert all(got[i]["kept"] for i in [*range(400), 1003]) and not any(got[i]["kept"] or got[i]["base_failed"] for i in (1000, 1001))
    assert got[1002]["n_dup_lines"] == 8 and not got[1002]["kept"] and got[1002]["base_failed"] is False and not got[1004]["kept"]


def test_sketches_merge_and_are_near(spark):
    rng = np.random.default_rng(5)
    xs = rng.lognormal(size=5000)
    rows = [(None, "s" if i % 2 else None, (10_000, int(10_000 * x), 0, 1, 0, 0)) for i, x in enumerate(xs)]
    fields = ",".join(f"{c}:bigint" for c in quality._COUNTS)
    df = spark.createDataFrame(rows, f"lang string, source string, m struct<{fields}>")
    ps = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    q = quality.quantiles(quality.sketches(df, "m"), [], ps).where("ratio = 'word_length'").first()
    for got, p in ((q["q1"], 25), (q["q2"], 50), (q["q3"], 75)):
        assert abs(got / np.percentile(xs, p) - 1) < 0.03
    a, b = quality.sketches(df.where("source = 's'"), "m"), quality.sketches(df.where("source IS NULL"), "m")
    assert quality.quantiles(a.unionByName(b), [], ps).where("ratio = 'word_length'").first() == q
