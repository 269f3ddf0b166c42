"""Every query against its SQL in DuckDB, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from siltstone.plans import medallion, oracle, queries

QUERIES, SQL = queries.QUERIES | medallion.QUERIES, oracle.SQL | medallion.SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(([r[i] for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, want.fetchall())
