"""What raster queries share: rounding, registration, and the SQL of the rasters they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, and the SQL that gives its rows."""
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def told(df: DataFrame, keys: tuple[str, ...], digits: int = 6, **columns: Column | str) -> DataFrame:
    """The keys and rounded columns of df."""
    return df.select(*keys, *(rounded(c, digits).alias(n) for n, c in columns.items()))


# SQL of the rasters, as common table expressions; each is read once and none joins a table with itself.
EMB = """emb AS MATERIALIZED (SELECT vec_id AS image_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
  (CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5 AS v FROM embeddings, range(64) AS t(i))"""
PAIRS = EMB + """, pairs AS MATERIALIZED (SELECT image_id // 2 AS pair_id, y, x, max(v) FILTER (image_id % 2 = 0) AS v0, max(v) FILTER (image_id % 2 = 1) AS v1
  FROM emb GROUP BY ALL HAVING count(*) = 2)"""
RGB = """rgb AS MATERIALIZED (SELECT vec_id // 3 AS image_id, y, x, max(v) FILTER (vec_id % 3 = 0) AS r, max(v) FILTER (vec_id % 3 = 1) AS g, max(v) FILTER (vec_id % 3 = 2) AS b
  FROM (SELECT vec_id, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, least(greatest(CAST(embedding[i + 1] AS DOUBLE) + 0.5, 0), 1) AS v FROM embeddings, range(64) AS t(i))
  GROUP BY ALL HAVING count(*) = 3)"""
EVT = """evt AS (SELECT g.image_id, g.y, g.x, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM
  (SELECT event_type AS image_id, CAST(i // 24 AS INT) AS y, CAST(i % 24 AS INT) AS x FROM (SELECT DISTINCT event_type FROM events), range(720) AS t(i)) g
  LEFT JOIN (SELECT event_type AS image_id, day(ts) - 1 AS y, hour(ts) AS x, count(*) AS n FROM events GROUP BY ALL) s
  ON g.image_id = s.image_id AND g.y = s.y AND g.x = s.x)"""
FIELD = "((3 * x + 5 * y) % 7 - 3) / 4.0 AS vx, ((5 * x + 3 * y) % 7 - 3) / 4.0 AS vy"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def boxes(source: str, keys: str, sums: dict[str, str], radius: int = 2) -> str:
    """A SELECT of every pixel with sums over its clipped square, by a band join."""
    parts = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    return f"""SELECT a.{keys}, a.y, a.x, {parts} FROM {source} a JOIN {source} b ON a.{keys} = b.{keys}
  AND b.y BETWEEN a.y - {radius} AND a.y + {radius} AND b.x BETWEEN a.x - {radius} AND a.x + {radius} GROUP BY ALL"""
