"""Documents that every corpus operator has to take: nulls, empty and long texts, ties, repeats, and a clashing column."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SCHEMA)


def odd(spark: SparkSession) -> DataFrame:
    """Columns text, key, hash and kind clash with names that operators use inside."""
    long = " ".join(f"word{i} über {i * 7919 % 10007}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, "no id here"), (None, None), (7, " \n\t "), (8, "日本語のテキスト"), (9, "a"), (10, "\x00�🙂 é")]
    return documents(spark, rows).selectExpr("*", "'x' AS key", "1 AS hash", "2 AS kind", "3 AS start", "'y' AS fp", "5 AS component_id", "6 AS shard")


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
