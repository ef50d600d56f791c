"""Queries of the statement corpus (B, F) and its graph (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import graph
from quarrylane.operators import statements as st
from quarrylane.plans.tables import STATEMENTS_SQL, catalog_columns, statements, values, values_sql
from quarrylane.session import cut, table

S = f"({STATEMENTS_SQL})"
NOISE = r"regexp_replace(regexp_replace(regexp_replace(sql, '/\*[\s\S]*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '''(?:''''|[^''])*''', ' ', 'g')"
EDGES_SQL = rf"""
(SELECT regexp_extract(sql, 'FROM\s+(\w+)\s+a', 1) AS t1, regexp_extract(sql, 'a\.(\w+)\s*=\s*b\.', 1) AS c1,
  regexp_extract(sql, 'JOIN\s+(\w+)\s+b', 1) AS t2, regexp_extract(sql, '=\s*b\.(\w+)', 1) AS c2, mapper, id
 FROM {S} WHERE regexp_matches(sql, 'FROM\s+\w+\s+a\s+JOIN\s+\w+\s+b\s+ON\s+a\.\w+\s*=\s*b\.\w+') AND t1 <> t2)"""


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.read(statements(spark, sf_dir))


def b1_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("mapper", "id", st.stripped(F.col("sql")).alias("sql"))


def a16_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("mapper", "id", st.cleaned(F.col("sql")).alias("sql"))


A16 = rf"""SELECT mapper, id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql, '/\*[\s\S]*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '[#$]\{{[^}}]*\}}', '?', 'g'), '<[/!?A-Za-z][^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS sql FROM {S}"""


def b2_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("mapper", "id", "type", st.crud_letters(F.col("sql")).alias("crud"))


B2 = rf"""
WITH n AS (SELECT mapper, id, type, regexp_replace(upper({NOISE}), '\bFOR\s+UPDATE\b', ' ', 'g') AS s FROM {S})
SELECT mapper, id, type, CASE WHEN regexp_matches(s, '\bINSERT\b') THEN 'C' ELSE '' END || CASE WHEN regexp_matches(s, '\bSELECT\b') THEN 'R' ELSE '' END
  || CASE WHEN regexp_matches(s, '\bUPDATE\b') THEN 'U' ELSE '' END || CASE WHEN regexp_matches(s, '\bDELETE\b') THEN 'D' ELSE '' END AS crud FROM n"""


def b3_table_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table_crud(mined(spark, sf_dir))


# each statement of this corpus names its tables behind these words, and each table once in one role
B3 = rf"""
WITH w AS (
  SELECT mapper, id, regexp_extract(sql, 'INSERT INTO (\w+)', 1) AS t, 'C' AS l FROM {S}
  UNION ALL SELECT mapper, id, regexp_extract(sql, '^UPDATE (\w+)', 1), 'U' FROM {S}
  UNION ALL SELECT mapper, id, regexp_extract(sql, 'DELETE FROM (\w+)', 1), 'D' FROM {S}
  UNION ALL SELECT mapper, id, unnest(regexp_extract_all(regexp_replace(sql, 'DELETE FROM', '', 'g'), '(?:FROM|JOIN)\s+(\w+)', 1)), 'R' FROM {S})
SELECT mapper, id, t AS table_name, min(l) FILTER (l <> 'R') IS NULL AS r, CASE WHEN r THEN 'R' ELSE array_to_string(list_sort(list(DISTINCT l) FILTER (l <> 'R')), '') END AS crud
FROM w WHERE t <> '' GROUP BY mapper, id, t"""
B3 = f"SELECT mapper, id, table_name, crud FROM ({B3})"


def b5_column_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.column_usage(mined(spark, sf_dir))


# each statement of this corpus names its columns at these places
B5 = rf"""
WITH s AS (SELECT mapper, id, sql, regexp_extract(sql, '^UPDATE (\w+)', 1) AS u, regexp_extract(sql, 'INSERT INTO (\w+)', 1) AS i, regexp_extract(sql, 'FROM\s+(\w+)', 1) AS f, regexp_extract(sql, 'JOIN\s+(\w+)\s+b', 1) AS j FROM {S}),
c AS (
  SELECT mapper, id, f AS table_name, unnest(regexp_extract_all(regexp_extract(sql, '^SELECT([^=]*?)FROM', 1), '\ba\.(\w+)', 1)) AS column_name, 'R' AS op FROM s WHERE j <> ''
  UNION ALL SELECT mapper, id, j, unnest(regexp_extract_all(regexp_extract(sql, '^SELECT([^=]*?)FROM', 1), '\bb\.(\w+)', 1)), 'R' FROM s WHERE j <> ''
  UNION ALL SELECT mapper, id, i, unnest(regexp_extract_all(regexp_extract(sql, 'INSERT INTO \w+\s*\(([^)]*)\)', 1), '\w+')), 'C' FROM s WHERE i <> ''
  UNION ALL SELECT mapper, id, f, unnest(regexp_extract_all(regexp_extract(sql, '\)\s*SELECT\s+([^()]*?)\s+FROM', 1), '\b[A-Z]\w*')), 'R' FROM s WHERE i <> ''
  UNION ALL SELECT mapper, id, u, unnest(regexp_extract_all(regexp_extract(sql, 'SET (.*?) WHERE', 1), '(\w+) =', 1)), 'U' FROM s WHERE u <> '')
SELECT DISTINCT mapper, id, table_name, column_name, op FROM c"""


def b10_join_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.join_edges(mined(spark, sf_dir)).select("table1", "column1", "table2", "column2", "join_type", "n_sources", "sources")


B10 = f"""
WITH e AS (SELECT *, CASE WHEN (t1, c1) <= (t2, c2) THEN t1 || '.' || c1 || '=' || t2 || '.' || c2 ELSE t2 || '.' || c2 || '=' || t1 || '.' || c1 END AS k FROM {EDGES_SQL})
SELECT arg_min(t1, (mapper, id)) AS table1, arg_min(c1, (mapper, id)) AS column1, arg_min(t2, (mapper, id)) AS table2, arg_min(c2, (mapper, id)) AS column2,
  'INNER JOIN' AS join_type, count(*) AS n_sources, string_agg(mapper || '#' || id, ',' ORDER BY mapper, id) AS sources FROM e GROUP BY k"""


def b11_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table_usage(mined(spark, sf_dir))


B11 = rf"""
WITH m AS (SELECT mapper, id, type, sql, CASE WHEN sql LIKE 'INSERT%' THEN regexp_extract(sql, 'INSERT INTO (\w+)', 1) WHEN sql LIKE 'UPDATE%' THEN regexp_extract(sql, '^UPDATE (\w+)', 1)
  WHEN sql LIKE 'DELETE%' THEN regexp_extract(sql, 'DELETE FROM (\w+)', 1) ELSE regexp_extract(sql, 'FROM\s+(\w+)', 1) END AS main,
  list_distinct(list_concat(regexp_extract_all(sql, '(?:INTO|FROM|JOIN)\s+(\w+)', 1), regexp_extract_all(sql, '^UPDATE (\w+)', 1))) AS ts,
  regexp_extract_all(sql, 'JOIN\s+(\w+)', 1) AS js FROM {S}),
t AS (SELECT *, unnest(ts) AS table_name FROM m)
SELECT table_name, count(*) FILTER (type = 'select') AS select_count, count(*) FILTER (type = 'insert') AS insert_count, count(*) FILTER (type = 'update') AS update_count,
  count(*) FILTER (type = 'delete') AS delete_count, count(*) FILTER (table_name = main) AS as_main_count, count(*) FILTER (list_contains(js, table_name) AND table_name <> main) AS as_join_count,
  count(DISTINCT mapper) AS n_mappers, count(*) AS n_statements FROM t GROUP BY table_name"""

CALLS = [
    ("m1", "c1", "procedure", "{CALL PKG_A.RUN(?)}"), ("m1", "c2", "select", "BEGIN pkg_b.step(1); pkg_c.x(2); END;"), ("m1", "c3", "update", "EXEC own.pkg.go(1) CALL other(2)"),
    ("m1", "c4", "select", "BEGIN DBMS_OUTPUT.PUT_LINE('x'); END;"), ("m1", "c5", "select", ""),
]
CALL_COLUMNS = "mapper string, id string, type string, sql string"
CALL_ROWS = [("m1", "c1", 0, "PKG_A.RUN"), ("m1", "c2", 0, "PKG_B.STEP"), ("m1", "c3", 0, "OTHER"), ("m1", "c3", 1, "OWN.PKG.GO")]


def b4_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.procedure_calls(st.read(values(spark, CALL_COLUMNS, CALLS)))


def b15_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).select("mapper", "id", st.masked_binds(F.col("sql")).alias("sql"))


B15 = rf"SELECT mapper, id, regexp_replace(regexp_replace(sql, '#\{{\s*([\w.]+)[^}}]*\}}', ':\1', 'g'), '\$\{{[^}}]*\}}', 'DUMMY_IDENT', 'g') AS sql FROM {S}"


def b17_crud_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.rolled_up(b3_table_crud(spark, sf_dir), ["mapper"])


B17 = f"""
WITH c AS ({B3}), l AS (SELECT mapper, table_name, unnest(string_split(crud, '')) AS x FROM c)
SELECT mapper, table_name, CASE WHEN bool_or(x = 'C') THEN 'C' ELSE '' END || CASE WHEN bool_or(x = 'R') THEN 'R' ELSE '' END || CASE WHEN bool_or(x = 'U') THEN 'U' ELSE '' END || CASE WHEN bool_or(x = 'D') THEN 'D' ELSE '' END AS crud
FROM l WHERE x <> '' GROUP BY ALL"""


def f_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.lint(statements(spark, sf_dir))


LINT = f"""
WITH s AS (SELECT mapper, id, type, upper(sql) AS u FROM {S})
SELECT mapper, id, type, 'MISSING_WHERE' AS rule, 'CRITICAL' AS severity FROM s WHERE type IN ('update', 'delete') AND NOT regexp_matches(u, '\\bWHERE\\b')
""" + "".join(f"UNION ALL SELECT mapper, id, type, '{r}', '{v}' FROM s WHERE regexp_matches(u, '{p.replace(chr(39), chr(39) * 2)}')\n" for r, v, p in st.LINT_RULES)


def f12_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.worst(f_lint(spark, sf_dir))


F12 = f"""
SELECT mapper, id, min(CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END) AS worst, count(*) AS n
FROM ({LINT}) GROUP BY mapper, id ORDER BY worst, n DESC, mapper, id LIMIT 20"""


def f_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.lint_summary(f_lint(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: the tables that the corpus joins."""
    return b10_join_edges(spark, sf_dir).select(F.col("table1").alias("src"), F.col("table2").alias("dst"))


PAIRS_SQL = f"(SELECT t1 AS node, t2 AS other FROM {EDGES_SQL} UNION SELECT t2, t1 FROM {EDGES_SQL})"


def c1_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


def c3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(edges(spark, sf_dir))


C3 = f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT node, other FROM {PAIRS_SQL}),
r(node, root) USING KEY (node) AS (
  SELECT node, least(node, min(other)) FROM p GROUP BY node
  UNION SELECT p.node, min(r.root) FROM r JOIN p ON p.other = r.node JOIN recurring.r AS old ON old.node = p.node WHERE r.root < old.root GROUP BY p.node)
SELECT node, root AS component FROM r"""


def c4_bounded_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    return graph.bounded_groups(e, graph.components(e), size=5)


def c6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog's tables that no statement joins, thirty by thirty."""
    own = catalog_columns(spark, sf_dir).select(F.col("table_name").alias("node")).distinct()
    return graph.chunks(own.join(graph.degrees(edges(spark, sf_dir)), "node", "left_anti"), 30)


C6 = f"SELECT node, CAST(floor((row_number() OVER (ORDER BY node) - 1) / 30) AS BIGINT) AS chunk FROM (SELECT DISTINCT table_name AS node FROM column_rec) WHERE node NOT IN (SELECT node FROM {PAIRS_SQL})"


def c7_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of the most statements in each mapper."""
    counted = b3_table_crud(spark, sf_dir).groupBy("mapper", "table_name").agg(F.count("*").alias("cnt"))
    return graph.top_nodes(counted, "mapper", "table_name")


C7 = f"""
WITH c AS (SELECT mapper, table_name, count(*) AS cnt FROM ({B3}) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY mapper ORDER BY cnt DESC, table_name) AS rank FROM c QUALIFY rank <= 3"""


def c8_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = cut(edges(spark, sf_dir))
    mentioned = b11_usage(spark, sf_dir).select(F.col("table_name").alias("node"))
    own = catalog_columns(spark, sf_dir).select(F.col("table_name").alias("node"))
    return graph.classified(own, graph.degrees(e), mentioned, graph.hubs(e, threshold=2))


DEGREE = f"(SELECT node, count(*) AS degree FROM {PAIRS_SQL} GROUP BY node)"
C8 = f"""
WITH s AS (SELECT DISTINCT table_name AS node FROM column_rec), d AS {DEGREE}, m AS (SELECT DISTINCT table_name AS node FROM ({B11})), n AS (SELECT node FROM s UNION SELECT node FROM m)
SELECT n.node, CASE WHEN s.node IS NOT NULL AND degree >= 2 THEN 'common' WHEN s.node IS NOT NULL AND degree > 0 THEN 'with_joins' WHEN s.node IS NOT NULL AND m.node IS NOT NULL THEN 'in_xml_no_join'
  WHEN s.node IS NOT NULL THEN 'not_in_xml' ELSE 'xml_only' END AS category
FROM n LEFT JOIN s ON n.node = s.node LEFT JOIN d ON n.node = d.node LEFT JOIN m ON n.node = m.node"""


def c10_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's joins, where a column is a key if its table has it at the first place."""
    keys = catalog_columns(spark, sf_dir).groupBy("table_name").agg(F.min_by("column_name", F.struct("col_no", "column_name")).alias("column_name"))
    return graph.cardinality(b10_join_edges(spark, sf_dir).select("table1", "column1", "table2", "column2", "join_type"), keys)


C10 = f"""
WITH k AS (SELECT table_name, arg_min(column_name, (col_no, column_name)) AS column_name FROM column_rec GROUP BY table_name), e AS ({B10})
SELECT table1, column1, table2, column2, join_type, CASE WHEN a.table_name IS NOT NULL AND b.table_name IS NOT NULL THEN '1:1' WHEN a.table_name IS NOT NULL OR b.table_name IS NOT NULL THEN '1:N' ELSE 'N:M' END AS cardinality
FROM e LEFT JOIN k a ON a.table_name = table1 AND a.column_name = column1 LEFT JOIN k b ON b.table_name = table2 AND b.column_name = column2"""


def c11_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.grouped_pairs(b10_join_edges(spark, sf_dir))


C11 = f"""
SELECT least(table1, table2) AS table_a, greatest(table1, table2) AS table_b,
  array_to_string(list_sort(list(DISTINCT CASE WHEN table1 > table2 THEN column2 || '=' || column1 ELSE column1 || '=' || column2 END)), ' / ') AS columns,
  array_to_string(list_sort(list(DISTINCT join_type)), ' / ') AS join_types, count(*) AS n_joins FROM ({B10}) GROUP BY ALL"""


QUERIES = {
    f.__name__: f
    for f in (
        b1_stripped, a16_cleaned, b2_crud, b3_table_crud, b4_procedures, b5_column_usage, b10_join_edges, b11_usage, b15_binds, b17_crud_rollup, f_lint, f12_worst, f_summary,
        c1_degree, c3_components, c4_bounded_groups, c6_chunks, c7_top3, c8_classify, c10_cardinality, c11_pairs,
    )
}
SQL = {
    "b1_stripped": f"SELECT mapper, id, {NOISE} AS sql FROM {S}", "a16_cleaned": A16, "b2_crud": B2, "b3_table_crud": B3, "b4_procedures": f"SELECT * FROM {values_sql('mapper string, id string, pos int, procedure_name string', CALL_ROWS)}",
    "b5_column_usage": B5, "b10_join_edges": B10, "b11_usage": B11, "b15_binds": B15, "b17_crud_rollup": B17, "f_lint": LINT, "f12_worst": F12,
    "f_summary": f"SELECT rule, severity, count(*) AS hits, count(DISTINCT mapper) AS mappers FROM ({LINT}) GROUP BY ALL",
    "c1_degree": f"SELECT * FROM {DEGREE}", "c3_components": C3, "c6_chunks": C6, "c7_top3": C7, "c8_classify": C8, "c10_cardinality": C10, "c11_pairs": C11,
}
