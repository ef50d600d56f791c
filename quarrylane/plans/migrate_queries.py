"""Queries of mappers and migration (A14, A27, B20, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import migrate as mig
from quarrylane.operators import statements as st
from quarrylane.plans.statement_queries import B3, B5, mined
from quarrylane.plans.tables import catalog_columns, statements, values, values_sql
from quarrylane.session import table
from quarrylane.sources import mapper

MAPPER = """<?xml version="1.0"?><!DOCTYPE mapper PUBLIC "-//x" "y.dtd">
<mapper namespace="com.x.order">
  <sql id="cols">o.ORD_NO, o.CUST_NO</sql>
  <select id="find">SELECT <include refid="cols"/> FROM TB_ORD o /* note */
    <where><if test="no != null">AND o.ORD_NO = #{no}</if>
      <choose><when test="a">AND o.A = 1</when><when test="b">AND o.B &lt; 2</when><otherwise>AND o.C = 3</otherwise></choose></where></select>
  <update id="put">UPDATE TB_ORD <set><if test="x">X = #{x},</if><if test="y">Y = ${y},</if></set> WHERE ORD_NO IN <foreach collection="l" item="i" open="(" separator="," close=")">#{i}</foreach></update>
</mapper>"""
BROKEN = '<mapper namespace="bad"><select id="q1">SELECT A FROM TB_A WHERE A < 5 AND B <> 2</select><delete id="q2">DELETE FROM TB_B</delete>'
IBATIS = """<sqlMap namespace="old"><select id="s">SELECT * FROM T <dynamic prepend="WHERE"><isNotNull property="a" prepend="AND">a = #a#</isNotNull><isEqual property="k" compareValue="Y" prepend="AND">k = $k$</isEqual></dynamic></select></sqlMap>"""
FILES = [("m/order.xml", MAPPER), ("m/bad.xml", BROKEN), ("m/old.xml", IBATIS)]
STATEMENT_ROWS = [
    ("m/order.xml", "com.x.order", "find", "select", "SELECT o.ORD_NO, o.CUST_NO FROM TB_ORD o AND o.ORD_NO = ? AND o.A = 1 AND o.B < 2 AND o.C = 3"),
    ("m/order.xml", "com.x.order", "put", "update", "UPDATE TB_ORD X = ?, Y = ?, WHERE ORD_NO IN ?"),
    ("m/bad.xml", "bad", "q1", "select", "SELECT A FROM TB_A WHERE A < 5 AND B <> 2"),
    ("m/bad.xml", "bad", "q2", "delete", "DELETE FROM TB_B"),
    ("m/old.xml", "old", "s", "select", "SELECT * FROM T a = #a# k = $k$"),
]
PATH_ROWS = [
    ("find", 0, "max", "SELECT o.ORD_NO, o.CUST_NO FROM TB_ORD o /* note */ WHERE o.ORD_NO = #{no} AND o.A = 1"),
    ("find", 1, "min", "SELECT o.ORD_NO, o.CUST_NO FROM TB_ORD o /* note */ WHERE o.C = 3"),
    ("find", 2, "choose[0]/when[1]", "SELECT o.ORD_NO, o.CUST_NO FROM TB_ORD o /* note */ WHERE o.ORD_NO = #{no} AND o.B < 2"),
    ("find", 3, "choose[0]/otherwise", "SELECT o.ORD_NO, o.CUST_NO FROM TB_ORD o /* note */ WHERE o.ORD_NO = #{no} AND o.C = 3"),
    ("put", 0, "max", "UPDATE TB_ORD SET X = #{x},Y = ${y} WHERE ORD_NO IN (#{i})"),
    ("put", 1, "min", "UPDATE TB_ORD WHERE ORD_NO IN"),
    ("s", 0, "max", "SELECT * FROM T WHERE a = #{a} AND k = ${k}"),
    ("s", 1, "min", "SELECT * FROM T"),
]


def files(spark: SparkSession) -> DataFrame:
    return values(spark, "path string, content string", FILES)


def a14_mapper_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapper.statements(files(spark))


def b20_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapper.expanded(files(spark)).select("id", "path_no", "label", "sql")


def raw_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat mapping of the catalog's columns: some renamed, some blank, some dropped."""
    c = catalog_columns(spark, sf_dir).groupBy("table_name", "column_name").agg(F.min("col_no").alias("no"), F.min(F.struct("rec_id", "data_type"))["data_type"].alias("data_type"))
    column = F.when(F.col("no") % 11 == 0, "DROP").when(F.col("no") % 3 == 0, "").otherwise(F.concat("column_name", F.lit("_N")))
    new = F.when(F.col("table_name").rlike("_MST[0-9]+$") & (F.col("no") % 2 == 0), F.concat(F.lit("TN_"), F.substring("table_name", 4, 99))).otherwise("")
    return c.select(F.col("table_name").alias("as_is_table"), F.col("column_name").alias("as_is_column"), F.col("data_type").alias("as_is_type"), new.alias("to_be_table"), column.alias("to_be_column"), F.when(F.col("no") % 5 == 0, "DATE").alias("to_be_type"))


RAW = """(SELECT table_name AS as_is_table, column_name AS as_is_column, arg_min_null(data_type, rec_id) AS as_is_type,
  CASE WHEN regexp_matches(table_name, '_MST[0-9]+$') AND min(col_no) % 2 = 0 THEN 'TN_' || substr(table_name, 4) ELSE '' END AS to_be_table,
  CASE WHEN min(col_no) % 11 = 0 THEN 'DROP' WHEN min(col_no) % 3 = 0 THEN '' ELSE column_name || '_N' END AS to_be_column, CASE WHEN min(col_no) % 5 = 0 THEN 'DATE' END AS to_be_type
  FROM column_rec GROUP BY table_name, column_name)"""
MAP = f"""(SELECT r.*, CASE WHEN tc = 'DROP' THEN NULL WHEN tt <> '' THEN tt ELSE coalesce(n.new_table, r.as_is_table) END AS to_be_table, CASE WHEN tc = 'DROP' THEN NULL WHEN tc <> '' THEN tc ELSE r.as_is_column END AS to_be_column
  FROM (SELECT upper(trim(as_is_table)) AS as_is_table, upper(trim(as_is_column)) AS as_is_column, as_is_type, upper(to_be_table) AS tt, upper(to_be_column) AS tc, to_be_type FROM {RAW}) r
  LEFT JOIN (SELECT upper(as_is_table) AS as_is_table, min(upper(to_be_table)) AS new_table FROM {RAW} WHERE to_be_table <> '' GROUP BY 1) n USING (as_is_table))"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.flat_mapping(raw_mapping(spark, sf_dir))


def a27_flat_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir)


def full_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mig.with_conversions(flat(spark, sf_dir))
    return mig.mapping_kind(m.withColumn("value_map", F.when(F.col("as_is_column").endswith("_IND"), F.create_map(F.lit("Y"), F.lit("1"), F.lit("N"), F.lit("0")))))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus rewritten by the mapping of the tables it names."""
    used = mined(spark, sf_dir).select(F.explode("tables.name").alias("as_is_table")).distinct()
    return mig.rewritten(statements(spark, sf_dir), full_mapping(spark, sf_dir).join(used, "as_is_table", "left_semi"))


def g1_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).select("mapper", "id", "to_be_sql", "status", F.array_join("warnings", "; ").alias("warnings"))


def g10_value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = mig.mapped_values(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": "DONE", "O": "OPEN"}, "OTHER")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


G10 = "SELECT CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'OPEN' ELSE CASE WHEN o_orderstatus IS NOT NULL THEN 'OTHER' END END AS o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def g14_unknown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the statements that the catalog lacks."""
    found = mig.static_issues(statements(spark, sf_dir), catalog_columns(spark, sf_dir).select("table_name", "column_name"))
    return found.filter("code = 'UNKNOWN_TABLE'").select("mapper", "id", "place")


def g17_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.table_impact(mined(spark, sf_dir), flat(spark, sf_dir))


G17 = f"""
WITH t AS (SELECT as_is_table, coalesce(min(to_be_table), '<dropped>') AS to_be_table FROM {MAP} GROUP BY 1), u AS ({B3})
SELECT t.as_is_table, t.to_be_table, count(DISTINCT mapper || '#' || id) AS n_statements, count(DISTINCT mapper) AS n_mappers FROM t LEFT JOIN u ON u.table_name = t.as_is_table GROUP BY ALL"""


def g17_column_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.column_impact(mined(spark, sf_dir), flat(spark, sf_dir))


G17C = f"""
WITH r AS (SELECT DISTINCT mapper, id, table_name, column_name FROM ({B5}))
SELECT m.as_is_table, m.as_is_column, coalesce(m.to_be_table || '.' || m.to_be_column, '<dropped>') AS to_be, count(r.id) AS n_statements
FROM {MAP} m LEFT JOIN r ON r.table_name = m.as_is_table AND r.column_name = m.as_is_column GROUP BY ALL"""


def g18_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of two of three columns against the whole catalog."""
    m = flat(spark, sf_dir).filter("to_be_column is null or to_be_column <> as_is_column")
    return mig.schema_mismatch(m, catalog_columns(spark, sf_dir).select(F.upper("table_name").alias("table_name"), F.upper("column_name").alias("column_name")))


G18 = f"""
WITH m AS (SELECT DISTINCT as_is_table, as_is_column FROM {MAP} WHERE to_be_column IS NULL OR to_be_column <> as_is_column), s AS (SELECT DISTINCT upper(table_name) AS as_is_table, upper(column_name) AS as_is_column FROM column_rec)
SELECT 'NOT_IN_SCHEMA' AS code, as_is_table || '.' || as_is_column AS place FROM m ANTI JOIN s USING (as_is_table, as_is_column)
UNION ALL SELECT 'NOT_MAPPED', as_is_table || '.' || as_is_column FROM (SELECT * FROM s SEMI JOIN m USING (as_is_table)) ANTI JOIN m USING (as_is_table, as_is_column)"""


def g20_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.derived_schema(flat(spark, sf_dir))


G20 = f"""
SELECT to_be_table AS table_name, to_be_column AS column_name, arg_min(coalesce(to_be_type, as_is_type), as_is_table || '.' || as_is_column) AS data_type FROM {MAP} WHERE to_be_column IS NOT NULL GROUP BY 1, 2"""


PAIRS = [("VARCHAR2(8)", "DATE"), ("VARCHAR2(14)", "TIMESTAMP"), ("VARCHAR2(20)", "NUMBER(10)"), ("CHAR(8)", "DATE"), ("NUMBER", "VARCHAR2(3)"), ("DATE", "TIMESTAMP"), ("VARCHAR2(30)", "VARCHAR2(60)"), (None, "DATE")]
PAIR_ROWS = [
    ("VARCHAR2(8)", "DATE", "TO_CHAR({src}, 'YYYYMMDD')"), ("VARCHAR2(14)", "TIMESTAMP", "TO_CHAR({src}, 'YYYYMMDDHH24MISS')"), ("VARCHAR2(20)", "NUMBER(10)", "TO_CHAR({src})"), ("CHAR(8)", "DATE", "TO_CHAR({src}, 'YYYYMMDD')"),
    ("NUMBER", "VARCHAR2(3)", "TO_NUMBER({src})"), ("DATE", "TIMESTAMP", "CAST({src} AS TIMESTAMP)"), ("VARCHAR2(30)", "VARCHAR2(60)", None), (None, "DATE", None),
]


def g24_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mig.with_conversions(values(spark, "as_is_type string, to_be_type string", PAIRS))
    return m.select("as_is_type", "to_be_type", F.col("where_").alias("where_form"))


def b18_statement_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's tables with their letters as one text: T(CU)."""
    c = st.table_crud(mined(spark, sf_dir))
    return c.groupBy("mapper", "id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("table_name", F.lit("("), "crud", F.lit(")")))), ", ").alias("tables"))


B18 = f"SELECT mapper, id, string_agg(table_name || '(' || crud || ')', ', ' ORDER BY table_name || '(' || crud || ')') AS tables FROM ({B3}) GROUP BY mapper, id"

QUERIES = {
    f.__name__: f
    for f in (
        a14_mapper_statements, a27_flat_mapping, b18_statement_crud, b20_paths, g1_rewrite, g10_value_map, g14_unknown_tables, g17_impact, g17_column_impact, g18_mismatch, g20_schema, g24_conversions,
    )
}
SQL = {
    "a14_mapper_statements": f"SELECT * FROM {values_sql('path string, namespace string, id string, type string, sql string', STATEMENT_ROWS)}",
    "a27_flat_mapping": f"SELECT as_is_table, as_is_column, as_is_type, to_be_table, to_be_column, to_be_type FROM {MAP}", "b18_statement_crud": B18,
    "b20_paths": f"SELECT * FROM {values_sql('id string, path_no int, label string, sql string', PATH_ROWS)}",
    "g10_value_map": G10, "g14_unknown_tables": f"SELECT mapper, id, table_name AS place FROM ({B3}) WHERE table_name NOT IN (SELECT table_name FROM column_rec)", "g17_impact": G17, "g17_column_impact": G17C, "g18_mismatch": G18, "g20_schema": G20,
    "g24_conversions": f"SELECT * FROM {values_sql('as_is_type string, to_be_type string, where_form string', PAIR_ROWS)}",
}
