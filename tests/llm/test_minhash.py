import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from muster.llm import jaccard, minhash
from muster.llm.queries import op12_b_bit_minhash
from muster.llm.textwords import mix

from .conftest import near_copies


def shingles(text, n):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    """Component of every row: the smallest id that is reachable, by a search over all pairs."""
    sets, group = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def sets_of(similarity, rng, size=400):
    """Two sets of random hashes whose similarity is as given."""
    both = round(size * similarity)
    every = mix(np.array([rng.randrange(2**63) for _ in range(size)], np.uint64))
    half = both + (size - both) // 2
    return np.sort(every[:half]), np.sort(np.concatenate([every[:both], every[half:]]))


def test_estimates_and_bands():
    rng = random.Random(4)
    for similarity in (0.2, 0.5, 0.8, 0.95):
        pairs = [sets_of(similarity, rng) for _ in range(300)]
        least = [minhash.minima([p[k] for p in pairs]) for k in (0, 1)]
        agree = (least[0] == least[1]).mean()
        guess = minhash.estimated(*map(minhash.signatures, least))
        shared = (minhash.band_keys(least[0]) == minhash.band_keys(least[1])).any(1).mean()
        assert abs(agree - similarity) < 0.02 and abs(guess.mean() - similarity) < 0.02 and guess.std() < 0.06
        assert abs(shared - (1 - (1 - similarity**minhash.ROWS) ** minhash.BANDS)) < 0.06


def test_minima_of_long_sets_are_minima(monkeypatch):
    rng = random.Random(5)
    sets = [mix(np.array([rng.randrange(2**62) for _ in range(n)], np.uint64)) for n in (1, 700, 3, 40, 2000)]
    whole = minhash.minima(sets)
    monkeypatch.setattr(minhash, "STEP", 64)
    assert (minhash.minima(sets) == whole).all()
    assert (whole[3] == (sets[3][:, None] * minhash._FACTORS + minhash._TERMS).min(0)).all()


@pytest.mark.parametrize(("leaf", "pivots"), [(16, 8), (2, 1)])
def test_components_against_all_pairs(stored_docs, leaf, pivots):
    rows = list(enumerate(near_copies(leaf, groups=8, most=60)))
    random.Random(0).shuffle(rows)
    docs = stored_docs([(i, t, "en", "a") for i, t in rows])
    got = minhash.near_components(docs, 2, 80, leaf, pivots).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 2, 80))


def test_a_chain_of_edits_in_one_cell(stored_docs, monkeypatch):
    """Neighbours in the chain are linked, ends are far apart; a small block parts it."""
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(90):
        words[(7 * k) % 60] = f"n{k}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join([*words[:20], *(f"z{k}x{j}" for j in range(40))])) for k in range(40)]
    got = minhash.near_components(stored_docs([(i, t, "en", "a") for i, t in rows]), 2, 80, 2, 1).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 2, 80))


def test_query_on_edges(spark, tmp_path, edge):
    rows = [(i, t) for i, t, _, _ in edge]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_b_bit_minhash(spark, str(tmp_path)).collect()
    want = [(i, n, c, i == c) for i, n, c in brute(rows, 2, 80)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_documents_without_words_alone_in_what_is_profiled_at_once(stored_docs):
    assert minhash.signatures(minhash.minima([])).shape == (0, minhash._SIZE * minhash.BITS // 64)
    last = " ".join(f"w{i}" for i in range(16 * minhash.STEP + 2))  # more shingles than are held: nothing, or no words, follow it in its batch
    for rows in ([(0, last)], [(0, last), (1, None)], [(0, None), (1, " ")]):
        got = minhash.near_components(stored_docs([(i, t, "en", "a") for i, t in rows]).coalesce(1), 2, 80).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == [(i, len(shingles(t, 2)), i) for i, t in rows]


def test_empty_tables_clashing_names_and_copies(stored_docs, edge):
    docs = stored_docs(edge, [("row", F.lit("kept")), ("key", F.lit(1)), ("point", F.lit(2))])
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns and out.where("row = 'kept'").count() == out.count()
    # the five rows without words, the one word, two of the three equal ones go, and the others
    assert out.count() == len(edge) - 2
    assert minhash.near_components(stored_docs([])).count() == 0
    with pytest.raises(ValueError):
        minhash.near_components(docs, 5, 70)
