"""Every query with SQL is compared with DuckDB on the smallest tables."""

import duckdb
import pytest

from muster.plans.oracle import oracle_sql
from muster.plans.queries import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    fix = lambda v: round(v + 0.0, 5) if isinstance(v, float) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = queries()[name](spark, DATA)
    want = duck.sql(oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got.select(*cols).collect()) == plain(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
