"""Operators that SQL can express give the same rows in DuckDB."""

from pathlib import Path

import duckdb
import pytest
from evigraph.llm.oracles import ORACLES
from evigraph.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.execute(ORACLES[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    order = [have.index(c) for c in cols]
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
