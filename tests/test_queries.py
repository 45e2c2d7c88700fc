"""Every registered query with SQL gives the same values in DuckDB; the entry has rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from evigraph.plans import build_queries, cascade_queries, contract_queries, more_queries, plan_queries, profile_queries, rule_queries, star_queries, text_queries

SF = "/root/testdata/sf0.001"
CORE = {**text_queries.SQL, **star_queries.SQL, **plan_queries.SQL, **more_queries.SQL, **rule_queries.SQL, **profile_queries.SQL, **build_queries.SQL, **cascade_queries.SQL, **contract_queries.SQL}


def value(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([value(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    rel = con.execute(CORE[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    want = sorted(([value(r[have.index(c)]) for c in cols] for r in rel.fetchall()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
