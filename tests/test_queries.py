"""Every governance query equals its SQL in DuckDB over the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from attestor.plans.catalogue import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not SF.exists(), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr) == got
