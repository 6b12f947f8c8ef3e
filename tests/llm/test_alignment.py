import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import alignment
from muster.llm.queries import op11_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = " \n\t ▁́ab<|endoftext|>日本é\U0001f600.,'s0123\x00\x1c　"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.Aligner(A, B)


def plain(text, libraries):
    """Ids of A and B, groups and links of a whole text, by the libraries and all pairs of byte ranges."""
    a, b, known = libraries
    if not text:
        return [], [], "", []
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    words = [[known.bytes_a[i] for i in ids_a], [known.bytes_b[i] for i in ids_b]]
    if any(b"".join(w) != f" {text}".encode() for w in words):
        return [], [], "", []
    ends = [[sum(map(len, w[: k + 1])) for k in range(len(w))] for w in words]
    both, groups, lo = sorted(set(ends[0]) & set(ends[1])), [], 0
    for e in both:
        groups.append("|".join(",".join(str(i) for i, x in zip(ids, own) if lo < x <= e) for ids, own in zip((ids_a, ids_b), ends)))
        lo = e
    starts = [[e - len(x) for e, x in zip(own, w)] for own, w in zip(ends, words)]
    links = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b)) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])]
    return ids_a, ids_b, ";".join(groups), links


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    words = ["tokenizer", "naïve", "don't", "日本語", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "x" * 30, "12345", "..."]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    return [*out, " ", "  ", " a ", "a  b", "a ", "\n", "", None]


def test_alignment_against_the_libraries_on_whole_texts(spark, libraries):
    rows = list(enumerate(texts()))
    got = alignment.with_alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    some = 0
    for r in got:
        a, b, groups, links = plain(r["text"], libraries)
        assert (r["n_a"], r["n_b"], r["groups"], r["n_links"]) == (len(a), len(b), groups, len(links)), r["text"]
        assert r["n_groups"] == (groups.count(";") + 1 if groups else 0)
        assert dict(zip(r["pairs"], r["times"])) == Counter(x << 32 | y for x, y in links)
        some += bool(a)
    assert some > 500


@pytest.mark.parametrize("hot", [1, 40, 1 << 17])
def test_query_against_counts_of_all_pairs(spark, tmp_path, libraries, edge, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)  # all pairs in the shuffle, some, or none
    rows = [(i, t) for i, t, _, _ in edge if t is None or len(t) < 10_000] + list(enumerate(texts()[::9], 100)) + [(5, "the cat and the dog")] * 3
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = [(i, *plain(t, libraries)) for i, t in rows]
    count = Counter(p for *_, links in found for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    want = [(i, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "") for i, a, b, groups, links in found]
    got = op11_token_alignment(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_remembered_parts_are_bounded(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    aligner = alignment.Aligner(A, B)
    for k in range(100):
        parts = [f" w{k * 7 + j}" for j in range(20)] + [" " + "y" * 100]
        aligner.learn([parts])
        assert [aligner.young[p] for p in parts] == [libraries[2].aligned([p])[0] for p in parts]
        aligner.forget()
        assert len(aligner.young) <= 71 and all(len(p) <= alignment.LONGEST for p in aligner.old)


def test_empty_tables_clashing_names_and_very_long_texts(spark, stored_docs, edge):
    docs = stored_docs(edge, [("pairs", F.lit("old")), ("N_A", F.lit(1)), ("row", F.lit("kept"))])
    out = alignment.with_alignment(docs, A, B)
    assert out.columns == ["doc_id", "text", "lang", "source", "row", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    rows = out.collect()
    assert len(rows) == len(edge) and all(r["n_links"] == max(0, r["n_a"] + r["n_b"] - r["n_groups"]) == sum(r["times"]) for r in rows)
    assert max(r["n_a"] for r in rows) > 30_000
    assert alignment.with_alignment(stored_docs([]), A, B).count() == 0


def test_parts_that_nothing_spells_do_not_spoil_others(libraries):
    aligner = alignment.Aligner(A, B)
    parts = [f" w{k}" for k in range(300)] + [" a▁b", " x▁"]
    aligner.learn([parts, [" end "], [" \n"]])
    assert [p for p in parts if aligner.young[p] is None] == [" a▁b", " x▁"]
    assert all(aligner.young[p] == libraries[2].aligned([p])[0] for p in [*parts[:300], " end "])


def test_models_whose_cuts_are_not_proven():
    with pytest.raises(ValueError):
        alignment.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)
