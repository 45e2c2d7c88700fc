"""Queries against their SQL on tables in which names repeat under other keys."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
KEYS = {"customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """The folder of a copy with every row of the star tables again under keys of its own, and its tables in DuckDB."""
    folder, con = tmp_path_factory.mktemp("twice"), duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        rows = f"SELECT * FROM '{p}'"
        if p.stem in KEYS:
            rows += f" UNION ALL SELECT * REPLACE ({', '.join(f'{c} + 1000000 AS {c}' for c in KEYS[p.stem])}) FROM '{p}'"
        con.execute(f"COPY ({rows}) TO '{folder / p.name}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{folder / p.name}'")
    return str(folder), con


def test_relation_gate_takes_the_last_of_a_name(spark, twice):
    folder, con = twice
    got = entry.queries()["relation_gate"](spark, folder)
    want = con.execute(entry.oracle_sql()["relation_gate"])
    cols = [d[0] for d in want.description]
    shown = lambda rows: sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert shown(tuple(r) for r in got.select(*cols).collect()) == shown(want.fetchall())
