"""Queries over documents made of the generated corpus: mapper files, merged corpora, indexes and retrieval documents (A, B, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import graph, vectors
from quarrylane.operators import statements as st
from quarrylane.plans.shape_queries import B10, PAIRS, SHAPES, T_CRUD, T_JOINS, b10_shapes, corpus, filled_sql, mined
from quarrylane.plans.tables import catalog_columns
from quarrylane.sources import mapper

TAGS = {"merge": "update"}


def mapper_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a mapper file for each table of the corpus, with its statements as CDATA and one behind a condition."""
    s = corpus(spark, sf_dir)
    tag = F.when(F.col("type") == "merge", "update").otherwise(F.col("type"))
    one = F.concat(F.lit("  <"), tag, F.lit(' id="'), F.col("id"), F.lit('"><![CDATA['), F.col("sql"), F.lit("\n]]></"), tag, F.lit(">\n"))
    own = s.withColumn("t", F.regexp_replace("id", "_[0-9]+$", "")).select("t", "id", one.alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda y: y["x"]), "")
    extra = F.concat(F.lit('  <select id="dyn">SELECT 1 FROM '), F.col("t"), F.lit('<where><if test="a != null">AND X = #{a}</if><if test="b">AND Y = #{b}</if></where></select>\n'))
    # a file holds one table's shapes, whose number is fixed
    return own.groupBy("t").agg(body.alias("body")).select(F.concat(F.lit("m/"), "t", F.lit(".xml")).alias("path"), F.concat(F.lit('<?xml version="1.0"?>\n<mapper namespace="ns.'), "t", F.lit('">\n'), "body", extra, F.lit("</mapper>")).alias("content"))


def a14_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of the mapper files, cleaned."""
    return mapper.statements(mapper_files(spark, sf_dir)).filter("id <> 'dyn'").select("path", "namespace", "id", "type", "sql")


CLEAN = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '--[^\n]*', ' ', 'g'), '[#$]\{{[^}}]*\}}', '?', 'g'), '\s+', ' ', 'g'))"
BRACES = lambda x: f"replace(replace({x}, '{{{{', '{{'), '}}}}', '}}')"
A14 = f"WITH pairs AS MATERIALIZED (SELECT * FROM {PAIRS}) " + " UNION ALL ".join(
    f"SELECT 'm/' || t || '.xml' AS path, 'ns.' || t AS namespace, t || '_{n:02d}' AS id, '{TAGS.get(s.type, s.type)}' AS type, {CLEAN(BRACES(filled_sql(s.sql)))} AS sql FROM pairs" for n, s in enumerate(SHAPES)
)


def b20_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths of the statement behind conditions, of every mapper file."""
    return mapper.expanded(mapper_files(spark, sf_dir)).filter("id = 'dyn'").select("path", "path_no", "label", "sql")


B20 = f"""
SELECT 'm/' || t || '.xml' AS path, x.n AS path_no, x.l AS label, 'SELECT 1 FROM ' || t || x.s AS sql
FROM (SELECT t, unnest([{{'n': 0, 'l': 'max', 's': ' WHERE X = #{{a}}AND Y = #{{b}}'}}, {{'n': 1, 'l': 'min', 's': ''}}]) AS x FROM {PAIRS})"""


def a17_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.corpus_totals(corpus(spark, sf_dir))


COUNT = {k: sum(s.type == k for s in SHAPES) for k in ("select", "insert", "update", "delete", "procedure", "merge")}
A17 = f"SELECT count(DISTINCT substr(t, 4, 4)) AS n_mappers, count(*) * {len(SHAPES)} AS n_statements, {', '.join(f'count(*) * {n} AS n_{k}' for k, n in COUNT.items())} FROM {PAIRS}"


def _dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus(spark, sf_dir)
    odd = F.substring("mapper", 5, 1) < "M"
    return st.merged_corpora({"one": st.read(s.filter(odd)), "two": st.read(s.filter(~odd)), "three": st.read(s)})


def a18_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joins of three corpora, of which one holds the others."""
    return st.merged_edges(_dirs(spark, sf_dir)).select(F.least("table1", "table2").alias("table_a"), F.greatest("table1", "table2").alias("table_b"), "source_dirs", "n_statements").groupBy("table_a", "table_b", "source_dirs").agg(F.count("*").alias("n_pairs"), F.sum("n_statements").alias("n_statements"))


A18 = f"""
WITH e AS (SELECT *, least(table1 || '.' || column1, table2 || '.' || column2) AS x, greatest(table1 || '.' || column1, table2 || '.' || column2) AS y, least(table1, table2) AS table_a, greatest(table1, table2) AS table_b FROM {T_JOINS}),
d AS (SELECT *, CASE WHEN substr(mapper, 5, 1) < 'M' THEN 'one' ELSE 'two' END AS dir FROM e UNION ALL SELECT *, 'three' FROM e),
n AS (SELECT table_a, table_b, x, y, array_to_string(list_sort(list(DISTINCT dir)), ',') AS source_dirs, count(DISTINCT dir || mapper || '#' || id) AS n FROM d GROUP BY ALL)
SELECT table_a, table_b, source_dirs, count(*) AS n_pairs, sum(n) AS n_statements FROM n GROUP BY ALL"""


def a18_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.merged_usage(_dirs(spark, sf_dir))


A18U = f"SELECT table_name, 2 * count(*) FILTER (main) AS as_main_count, 2 * count(*) FILTER (joined) AS as_join_count, 1 + count(DISTINCT substr(mapper, 5, 1) < 'M') AS n_dirs FROM {T_CRUD} GROUP BY table_name"


def b16_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every statement of the corpus uses, by its key."""
    return st.statement_index(mined(spark, sf_dir)).filter("tables <> ''").select("key", "tables")


B16 = f"SELECT mapper || '#' || id AS key, array_to_string(list_sort(list(DISTINCT table_name)), ',') AS tables FROM {T_CRUD} GROUP BY 1"


def schema_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = catalog_columns(spark, sf_dir).select("table_name", F.concat(F.lit("about "), "table_name").alias("table_comment"), "column_name", "col_no", "data_type")
    keys = c.groupBy("table_name").agg(F.min_by("column_name", F.struct("col_no", "column_name")).alias("detail")).select("table_name", F.lit("PK").alias("kind"), "detail")
    return c, keys


def i1_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables, overviews, groups of columns and constraints as documents for retrieval."""
    return vectors.schema_documents(*schema_parts(spark, sf_dir)).select("table_name", "kind", "chunk", "text")


I1 = """
WITH o AS (SELECT table_name, column_name, min(col_no) AS col_no, trim(column_name || ' ' || coalesce(min(data_type), '')) AS line FROM column_rec GROUP BY table_name, column_name),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY col_no, column_name) AS pos, count(*) OVER (PARTITION BY table_name) AS n FROM o),
k AS (SELECT table_name, arg_min(column_name, (col_no, column_name)) AS d FROM column_rec GROUP BY table_name)
SELECT table_name, CASE WHEN n <= 30 THEN 'whole' ELSE 'columns' END AS kind, c AS chunk, CASE WHEN n <= 30 THEN table_name || ' - about ' || table_name ELSE table_name END || ': ' || lines AS text
FROM (SELECT table_name, n, c, string_agg(line, ', ' ORDER BY pos) AS lines FROM (SELECT *, CAST(floor((pos - 1) / 30) AS BIGINT) AS c FROM r) AS q GROUP BY table_name, n, c)
UNION ALL SELECT table_name, 'overview', 0, table_name || ' - about ' || table_name || ': ' || n || ' columns' FROM r WHERE n > 30 GROUP BY table_name, n
UNION ALL SELECT table_name, 'constraints', 0, table_name || ': PK ' || d FROM k"""


def i2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the corpus as documents for retrieval, with the tables that they name."""
    m = mined(spark, sf_dir)
    usage = st.table_usage(m).select("table_name", "n_statements")
    return vectors.query_documents(b10_shapes(spark, sf_dir), st.table_crud(m), usage).select("kind", "part", "chunk", "tables")


I2 = f"""
WITH e AS ({B10}), l AS (
  SELECT 'relation' AS kind, table1 AS part, table1 || '.' || column1 || ' = ' || table2 || '.' || column2 || ' (' || join_type || ')' AS line, [table1, table2] AS ts, 15 AS size FROM e
  UNION ALL SELECT 'query', mapper, id || ': ' || string_agg(table_name || '(' || crud || ')', ', ' ORDER BY table_name || '(' || crud || ')'), list(table_name), 5 FROM {T_CRUD} GROUP BY mapper, id
  UNION ALL SELECT 'usage', table_name, table_name, [table_name], 1 FROM {T_CRUD} GROUP BY table_name),
r AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY kind, part ORDER BY line) - 1) / size) AS BIGINT) AS chunk FROM l)
SELECT kind, part, chunk, array_to_string(list_sort(list_distinct(flatten(list(ts)))), ',') AS tables FROM r GROUP BY kind, part, chunk"""


def c9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagram's line for each pair of joined tables."""
    e = b10_shapes(spark, sf_dir)
    pairs_ = graph.grouped_pairs(e).withColumn("cardinality", F.lit("N:M"))
    return graph.mermaid(pairs_)


C9 = f"""
WITH x AS (SELECT least(table1, table2) AS table_a, greatest(table1, table2) AS table_b, CASE WHEN table1 > table2 THEN column2 || '=' || column1 ELSE column1 || '=' || column2 END AS p FROM ({B10})),
y AS (SELECT table_a, table_b, array_to_string(list_sort(list(DISTINCT p)), ' / ') AS ps FROM x GROUP BY table_a, table_b)
SELECT table_a, table_b, '    ' || table_a || ' }}o--o{{ ' || table_b || ' : "' || ps || '"' AS line FROM y"""

QUERIES = {f.__name__: f for f in (a14_shapes, a17_totals, a18_merged, a18_usage, b16_index, b20_shapes, c9_lines, i1_documents, i2_documents)}
SQL = {"a14_shapes": A14, "a17_totals": A17, "a18_merged": A18, "a18_usage": A18U, "b16_index": B16, "b20_shapes": B20, "c9_lines": C9, "i1_documents": I1, "i2_documents": I2}
