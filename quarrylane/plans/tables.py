"""Inputs of the queries: the driver's tables as catalogs, statement corpora and lists in line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.session import table

#: Statements inside texts: from a keyword at a line's start or behind a tag over its continuation lines.
STATEMENT = r"(?m)(?:^|>)[ \t]*((?:SELECT|INSERT INTO|UPDATE|DELETE FROM|MERGE INTO)\s(?:[^\n<`]|< )*(?:\n(?:[ \t]+|(?:FROM|JOIN|WHERE|AND|SET|VALUES)\s)(?:[^\n<`]|< )+)*)"

STATEMENTS_SQL = f"""
SELECT source AS mapper, 's' || doc_id || '_' || n AS id, lower(split_part(trim(sql), ' ', 1)) AS type, sql FROM (
  SELECT source, doc_id, unnest(range(1, len(found) + 1)) AS n, unnest(found) AS sql
  FROM (SELECT source, doc_id, regexp_extract_all(text, '{STATEMENT}', 1) AS found FROM documents WHERE text IS NOT NULL) WHERE len(found) > 0)
"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mapper, id, type, sql: every SQL statement in the documents' texts."""
    found = table(spark, sf_dir, "documents").filter("text is not null").select("source", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(STATEMENT), F.lit(1))).alias("n", "sql"))
    return found.select(
        F.col("source").alias("mapper"),
        F.concat(F.lit("s"), F.col("doc_id"), F.lit("_"), F.col("n") + 1).alias("id"),
        F.lower(F.split_part(F.trim("sql"), F.lit(" "), F.lit(1))).alias("type"),
        "sql",
    )


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysed columns as a catalog: owner_name, table_name, column_name, col_no, data_type, col_comment, rec_id."""
    return table(spark, sf_dir, "column_rec").select("rec_id", "owner_name", "table_name", "column_name", "col_no", "data_type", "col_comment")


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def literal(x: object) -> str:
    """x as an SQL literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def values_sql(columns: str, rows: list[tuple]) -> str:
    """The rows as an SQL sub-query with the names of columns ('a int, b string')."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names}))"
