"""Every registered raster query against its SQL, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from rastrel import catalog
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql_agrees(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(catalog.ORACLES[name]).columns)
    want = sorted(map(plain, duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()), key=repr)
    got = sorted(map(plain, df.select(*columns).collect()), key=repr)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"morph_pair", "morph_frame"}))
def test_others_run(spark, name):
    rows = catalog.QUERIES[name](spark, DATA).collect()
    assert rows and all(v == v for r in rows[:100] for v in r)
