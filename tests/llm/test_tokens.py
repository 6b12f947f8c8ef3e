import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm import bpe, token_counts

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_counts_are_the_library_s(stored_docs, edge):
    rng = random.Random(1)
    texts = ["".join(rng.choice([" ", "  ", "\n", "a", "é", "'s", "12", "<|endoftext|>", "!", "\t", "\xa0", "word"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = edge + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    t = Tokenizer.from_file(JSON)
    want = sorted((i or -1, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows)
    got = token_counts.token_counts(stored_docs(rows), JSON).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert token_counts.token_counts(stored_docs([]), JSON).count() == 0


def test_splices_and_widens(stored_docs, monkeypatch):
    monkeypatch.setattr(token_counts, "HUGE", 200)
    monkeypatch.setattr(token_counts, "OVERLAP", 80)
    monkeypatch.setattr(token_counts, "CHUNK", 300)
    rng = random.Random(2)
    kinds = [["a", "b"], [" ", "\n", "  "], ["é", " ", "x1", "'re", "<|endoftext|>"], [" word", ", ", "12 "], ["!?", "z"]]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(700)) for _ in range(6)] + ["".join(rng.choice(k) for _ in range(700)) for k in kinds]
    t = Tokenizer.from_file(JSON)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(stored_docs([(i, x, "", "") for i, x in enumerate(texts)]), JSON).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken_s(stored_docs, edge, encoding):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é日!'s 1\n") for _ in range(rng.randrange(200))) for _ in range(200)]
    rows = edge + [(100 + i, t, "en", "s") for i, t in enumerate(texts)]
    got = bpe.token_digests(stored_docs(rows), RANKS, PATTERN).collect()
    want = []
    for i, x, *_ in rows:
        ids = encoding.encode_ordinary(x or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)


def test_round_trip(stored_docs, edge, monkeypatch):
    monkeypatch.setattr(bpe, "LISTED", 100)
    docs = stored_docs(edge, [("n_tokens", F.lit("old"))])
    out = bpe.encode_documents(docs, RANKS, PATTERN)
    assert set(docs.columns) < set(out.columns)
    for r in out.withColumn("back", bpe.decoded(F.col("input_ids"), RANKS)).collect():
        assert bytes(r["back"]).decode() == (r["text"] or "") and r["n_tokens"] == len(r["input_ids"])
    assert bpe.token_digests(stored_docs([]), RANKS, PATTERN).count() == 0


def test_perfect_hash_is_minimal():
    v = bpe._memory(RANKS).vocabulary
    assert len({v.hash.slot(k) for k in v.ranks}) == len(v.ranks) == v.hash.n
    assert all(v.whole(k) == r for k, r in list(v.ranks.items())[::97]) and v.whole(b"no such pre-token") is None
