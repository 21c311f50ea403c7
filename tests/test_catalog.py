"""Every registered query of the engine against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from lodestone.catalog_more import ORACLES, REGISTERED

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        where = f"{SF}/{f}/*.parquet" if os.path.isdir(f"{SF}/{f}") else f"{SF}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{where}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(r[i] for i in order) for r in rows]
    return sorted(columns), sorted(shown, key=repr)


def test_all_have_sql():
    assert REGISTERED.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", list(REGISTERED))
def test_against_sql(spark, tables, name):
    df = REGISTERED[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = tables.execute(ORACLES[name])
    want = rows_of([d[0] for d in want.description], want.fetchall())
    assert got == want
    assert got[1] or name in ("match_none", "parser_lone_negative")
    assert all(math.isfinite(x) for r in got[1] for x in r if isinstance(x, float))
