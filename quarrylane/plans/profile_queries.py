"""Queries of catalogs and profiles (A, D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import profile
from quarrylane.plans.tables import catalog_columns, values, values_sql
from quarrylane.session import table

CODES = {"lineitem": ["l_returnflag", "l_linestatus"], "orders": ["o_orderstatus", "o_orderpriority"], "customer": ["c_mktsegment"], "part": ["p_brand"], "events": ["event_type"], "token_match": ["via"], "documents": ["doc_kind", "lang"]}
FLAGS = {"lineitem": ["l_linestatus", "l_returnflag"], "term": ["privacy", "encrypt", "is_std"], "word": ["is_std", "is_classifier"]}
LENGTHS = [
    ("customer", "c_name", "VARCHAR2(100)"), ("customer", "c_mktsegment", "VARCHAR2(20)"), ("part", "p_name", "VARCHAR2(200)"), ("part", "p_type", "CHAR(50)"),
    ("word", "physical", "VARCHAR2(200)"), ("word", "expire", "VARCHAR2(60)"), ("term", "data_scale", "VARCHAR2(50)"), ("supplier", "s_name", "VARCHAR2(55)"),
]
LENGTH_COLUMNS = "table_name string, column_name string, data_type string"


def long_of(spark: SparkSession, sf_dir: str, of: dict[str, list[str]]) -> DataFrame:
    out = None
    for t, cs in of.items():
        one = profile.long_values(table(spark, sf_dir, t), t, cs)
        out = one if out is None else out.unionByName(one)
    return out


def long_sql(of: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}" for t, cs in of.items() for c in cs)


def d8_code_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.code_profile(long_of(spark, sf_dir, CODES))


D8 = f"""
WITH v AS ({long_sql(CODES)}), c AS (SELECT table_name, column_name, value, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT table_name, column_name, CAST(sum(n) AS BIGINT) AS total_rows, count(value) AS distinct_count, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS null_count FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY n DESC, value) AS rank FROM c WHERE value IS NOT NULL)
SELECT * FROM r JOIN t USING (table_name, column_name) WHERE rank <= 50"""


def d9_flag_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.flag_profile(long_of(spark, sf_dir, FLAGS))


D9 = f"""
SELECT table_name, column_name, count(*) AS total_rows, count(*) FILTER (value IS NULL) AS null_count,
  count(*) FILTER (value NOT IN ('Y','N','1','0','TRUE','FALSE')) AS abnormal_rows,
  count(DISTINCT value) FILTER (value NOT IN ('Y','N','1','0','TRUE','FALSE')) AS abnormal_values
FROM ({long_sql(FLAGS)}) GROUP BY ALL"""


def d10_column_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = values(spark, LENGTH_COLUMNS, LENGTHS)
    out = None
    for t in dict.fromkeys(r[0] for r in LENGTHS):
        one = profile.column_usage(table(spark, sf_dir, t), t, [r[1] for r in LENGTHS if r[0] == t])
        out = one if out is None else out.unionByName(one)
    return profile.usage_findings(out, declared)


D10 = f"""
WITH u AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS total_rows, round_even((count(*) - count({c})) / count(*) * 100, 1) AS null_ratio, max(length({c})) AS max_length FROM {t}" for t, c, _ in LENGTHS)}),
d AS (SELECT *, TRY_CAST(nullif(regexp_extract(data_type, '\\((\\d+)', 1), '') AS INT) AS defined_length FROM {values_sql(LENGTH_COLUMNS, LENGTHS)})
SELECT table_name, column_name, total_rows, null_ratio, max_length, defined_length, null_ratio = 100 AS is_unused,
  coalesce(defined_length > 3 * max_length AND defined_length >= 50 AND max_length > 0, false) AS is_oversized
FROM u JOIN d USING (table_name, column_name) WHERE is_unused OR is_oversized"""


def d2_type_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.type_drift(catalog_columns(spark, sf_dir))


D2 = """
SELECT column_name, array_to_string(list_sort(list(DISTINCT data_type)), '|') AS types, count(*) AS table_count, count(DISTINCT data_type) AS n_types
FROM column_rec WHERE data_type IS NOT NULL GROUP BY column_name HAVING count(DISTINCT data_type) > 1"""


def own_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's columns once, with the first column number."""
    return catalog_columns(spark, sf_dir).groupBy("table_name", "column_name").agg(F.min("col_no").alias("col_no"))


OWN = "(SELECT table_name, column_name, min(col_no) AS col_no FROM column_rec GROUP BY ALL)"


def d3_prefix_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.prefix_outliers(own_columns(spark, sf_dir))


D3 = f"""
WITH o AS (SELECT *, CASE WHEN instr(column_name, '_') > 0 THEN split_part(column_name, '_', 1) END AS part FROM {OWN}),
t AS (SELECT table_name, count(*) AS total_columns FROM o GROUP BY ALL),
p AS (SELECT table_name, part, count(*) AS n, min(col_no) AS first_no FROM o WHERE part IS NOT NULL GROUP BY ALL),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY n DESC, first_no, part) = 1),
f AS (SELECT b.*, total_columns FROM b JOIN t USING (table_name) WHERE total_columns >= 3 AND n / total_columns >= 0.4 AND n < total_columns)
SELECT f.table_name, f.part AS dominant_prefix, round_even(f.n / total_columns, 2) AS prefix_ratio, total_columns, f.n AS conforming_columns,
  string_agg(column_name, ',' ORDER BY col_no, column_name) AS outliers
FROM f JOIN o ON o.table_name = f.table_name AND coalesce(o.part, '') <> f.part GROUP BY ALL"""


def d4_suffix_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.suffix_histogram(own_columns(spark, sf_dir))


D4 = f"""
WITH o AS (SELECT CASE WHEN instr(column_name, '_') > 0 THEN '_' || split_part(column_name, '_', -1) ELSE '(no suffix)' END AS suffix, table_name || '.' || column_name AS example FROM {OWN}),
r AS (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY example) AS r, count(*) OVER (PARTITION BY suffix) AS n FROM o)
SELECT suffix, n, string_agg(example, ',' ORDER BY example) AS examples FROM r WHERE r <= 5 GROUP BY ALL"""




def d5_code_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code columns, by the reference's endings and those of this estate."""
    return profile.named_like(own_columns(spark, sf_dir), profile.CODE_SUFFIXES + ("_CDE", "_CTG")).select("table_name", "column_name", "col_no")


def d6_flag_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.named_like(own_columns(spark, sf_dir), profile.FLAG_SUFFIXES + ("_IND",)).select("table_name", "column_name", "col_no")


def like_sql(suffixes: tuple[str, ...]) -> str:
    return f"SELECT table_name, column_name, col_no FROM {OWN} WHERE regexp_matches(upper(column_name), '({'|'.join(suffixes)})$')"


def d13_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


D13 = """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total
FROM orders GROUP BY o_orderpriority"""


def d14_analysis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estate in one row: columns, tables, owners, matched columns and mean confidence."""
    return table(spark, sf_dir, "column_rec").agg(
        F.count("*").alias("n_columns"),
        F.count_distinct("table_name").alias("n_tables"),
        F.count_distinct("owner_name").alias("n_owners"),
        F.count(F.when(F.col("confidence") > 0, 1)).alias("n_matched"),
        F.count(F.when(F.trim("col_comment") != "", 1)).alias("n_commented"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"),
    )


D14 = """
SELECT count(*) AS n_columns, count(DISTINCT table_name) AS n_tables, count(DISTINCT owner_name) AS n_owners, count(*) FILTER (confidence > 0) AS n_matched,
  count(*) FILTER (trim(col_comment) <> '') AS n_commented, round(avg(confidence), 6) AS mean_confidence FROM column_rec"""


def a3_column_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with their first comment, in column order."""
    c = catalog_columns(spark, sf_dir)
    comments = c.filter("trim(col_comment) <> ''").groupBy("table_name", "column_name").agg(F.min_by("col_comment", "rec_id").alias("comment"))
    return own_columns(spark, sf_dir).join(comments, ["table_name", "column_name"], "left")


A3 = f"""
SELECT o.table_name, o.column_name, o.col_no, c.comment FROM {OWN} o LEFT JOIN
(SELECT table_name, column_name, arg_min(col_comment, rec_id) AS comment FROM column_rec WHERE trim(col_comment) <> '' GROUP BY ALL) c
ON o.table_name = c.table_name AND o.column_name = c.column_name"""


def a1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of each owner with their numbers of columns."""
    return catalog_columns(spark, sf_dir).groupBy("owner_name", "table_name").agg(F.count_distinct("column_name").alias("n_columns"))


A1 = "SELECT owner_name, table_name, count(DISTINCT column_name) AS n_columns FROM column_rec GROUP BY ALL"

QUERIES = {f.__name__: f for f in (d8_code_profile, d9_flag_profile, d10_column_usage, d2_type_drift, d3_prefix_outliers, d4_suffix_hist, d5_code_columns, d6_flag_columns, d13_histogram, d14_analysis_stats, a1_tables, a3_column_metadata)}
SQL = {
    "d8_code_profile": D8, "d9_flag_profile": D9, "d10_column_usage": D10, "d2_type_drift": D2, "d3_prefix_outliers": D3, "d4_suffix_hist": D4,
    "d5_code_columns": like_sql(profile.CODE_SUFFIXES + ("_CDE", "_CTG")), "d6_flag_columns": like_sql(profile.FLAG_SUFFIXES + ("_IND",)),
    "d13_histogram": D13, "d14_analysis_stats": D14, "a1_tables": A1, "a3_column_metadata": A3,
}
