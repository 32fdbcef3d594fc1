"""Every query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from veloria import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = _sorted([tuple(_norm(r[c]) for c in columns) for r in df.collect()])
    result = db.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = _sorted([tuple(_norm(r[names.index(c)]) for c in columns) for r in result.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x)) for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_is_named_once():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
