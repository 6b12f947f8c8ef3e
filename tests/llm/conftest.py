import itertools
import random

import pytest

_numbers = itertools.count()


@pytest.fixture
def stored_docs(spark, tmp_path):
    """Writes (doc_id, text, lang, source) rows and reads them back, so that they are a stored table."""

    def write(rows, extra=(), schema="doc_id long, text string, lang string, source string"):
        path = f"{tmp_path}/docs{next(_numbers)}"
        df = spark.createDataFrame(rows, schema)
        for name, value in extra:
            df = df.withColumn(name, value)
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return write


EDGE = [
    (1, None, "en", None), (2, "", None, "a"), (3, " \t\n", "en", "a"), (None, "x", "en", "a"), (4, "One two THREE", "en", "b"),
    (5, "one TWO three", "en", "b"), (5, "one TWO three", "en", "b"), (6, "é É ß <|endoftext|>   日本 \U0001f600", "fr", "c"), (7, "w" * 70_000, "en", "c"),
    (8, " ".join(f"word{i % 977}" for i in range(30_000)), "en", "c"), (None, None, None, None),
]


@pytest.fixture
def edge():
    return EDGE


def near_copies(seed, groups=6, most=25, words=300):
    """Texts in groups of edited copies, some below, some above any threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 40, 90]))]
        for _ in range(rng.choice([2, most])):
            x = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            out.append(" ".join(x))
    return out
