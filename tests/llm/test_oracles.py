from pathlib import Path

import duckdb
import pytest

from rastrel.llm import queries
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(con.sql(queries.ORACLES[name]).columns)
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want and want
