"""Short operators, each on a few rows."""

from pyspark.sql import functions as F

from quarrylane.operators import dictionary, graph, lineage, migrate, naming, profile, vectors
from quarrylane.operators import statements as st
from quarrylane.sources import catalog


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


EDGE = "table1 string, column1 string, table2 string, column2 string, join_type string"


def test_edges_and_corpora(spark):
    e = frame(spark, EDGE, [("A", "X", "B", "X", "INNER JOIN"), ("A", "X", "C", "Y", "INNER JOIN")])
    assert rows(profile.join_name_mismatch(e)) == [("A", "X", "C", "Y", "INNER JOIN")]
    assert rows(st.known_edges(e, frame(spark, "table_name string", [("A",), ("B",), ("A",)])).select("table1", "table2")) == [("A", "B")]
    c = frame(spark, "mapper string, id string", [("m", "1")])
    assert rows(st.merged_corpora({"x": c, "y": c})) == [("m", "1", "x"), ("m", "1", "y")]


def test_structure_report(spark):
    cols = frame(spark, "table_name string, column_name string, col_no int, data_type string", [("T", "CUST_NM", 1, "A"), ("T", "CUST_CD", 2, "A"), ("T", "USE_YN", 3, "B"), ("U", "CUST_NM", 1, "B")])
    r = profile.structure_report(cols, frame(spark, EDGE, []), cols.select("table_name", "column_name"))
    assert [x["column_name"] for x in r["type_inconsistency"].collect()] == ["CUST_NM"]
    assert [(x["table_name"], x["dominant_prefix"], x["outliers"]) for x in r["naming_pattern"].collect()] == [("T", "CUST", "USE_YN")]
    assert [x["column_name"] for x in r["code_columns"].collect()] == ["CUST_CD"] and [x["column_name"] for x in r["yn_columns"].collect()] == ["USE_YN"]
    assert r["join_column_mismatch"].count() == 0 and r["identifier_pattern"].count() == 3
    p = profile.code_profile(profile.long_values(cols, "t", ["data_type"]))
    assert [x["line"] for x in profile.report_rows(p).orderBy("rank").collect()] == ["| A | 2 | 50.0% |", "| B | 2 | 50.0% |"]


def test_budget_top_and_orders(spark):
    d = frame(spark, "g string, o int, cost int", [("a", 1, 5), ("a", 2, 5), ("a", 3, 1), ("b", 1, 99)])
    assert rows(graph.within_budget(d, "g", ["o"], "cost", 10).select("g", "o")) == [("a", 1), ("a", 2)]
    assert rows(lineage.top_of(d, "g", [F.desc("cost"), F.col("o")], 1).select("g", "o")) == [("a", 1), ("b", 1)]
    m = lineage.ranked_matches([frame(spark, "k string, v string", [("x", "b"), ("x", "a")]), frame(spark, "k string, v string", [("x", "0"), ("y", "c")])], "k", "v")
    assert rows(m) == [("x", "a", 0), ("y", "c", 1)]
    w = lineage.worth_reading(frame(spark, "name string, body string", [("getX", "y" * 200), ("run", "y" * 200), ("go", "short price"), ("no", "short")]), ["price"])
    assert rows(w.select("name")) == [("go",), ("run",)]


def test_chunks_upserts_and_heads(spark):
    c = vectors.line_chunks(frame(spark, "m string, o int, line string", [("m", i, f"l{i}") for i in range(5)]), "m", "o", 2)
    assert rows(c) == [("m", 0, 2, "l0\nl1"), ("m", 1, 2, "l2\nl3"), ("m", 2, 1, "l4")]
    old, new = frame(spark, "id string, v int", [("a", 1), ("b", 1)]), frame(spark, "id string, v int", [("b", 2), ("c", 2)])
    assert rows(vectors.upserted(old, new)) == [("a", 1), ("b", 2), ("c", 2)]
    h = frame(spark, "n int, text string", [(2, "x" * 300), (1, "x" * 250), (3, "y")])
    assert rows(vectors.first_by_text(h, "n").select("n")) == [(1,), (3,)]
    q = frame(spark, "query_id bigint, vec_id bigint, distance double", [(1, 5, 0.2), (1, 6, 0.1)])
    assert [(r["collection"], r["vec_id"]) for r in vectors.merged_nearest({"s": q, "t": q}, 2).orderBy("rank").collect()] == [("s", 6), ("t", 6)]


def test_words_of_sources(spark):
    code = "// skip camelDead\nconst userName = 'quoted'; /* gone */ function loadOrder() { return userName; }"
    got = rows(naming.source_words(frame(spark, "path string, content string", [("a.js", code), ("b.js", None)])))
    assert [w for w, _ in got] == ["NAME", "ORDER", "USER"]
    merged = naming.word_category(naming.merged_words(frame(spark, "word string, source string", [("ORDER", "TABLE:T"), ("CUST", "TABLE:T")]), frame(spark, "word string, source string", [("ORDER", "FE:a"), ("USER", "FE:a")])))
    assert {(r["word"], r["db_count"], r["fe_count"], r["category"]) for r in merged.collect()} == {("ORDER", 1, 1, "both"), ("CUST", 1, 0, "db_only"), ("USER", 0, 1, "fe_only")}


def test_types_values_and_comments(spark):
    t = frame(spark, "t string, l string, s string, w string", [("varchar2", "20", None, "VARCHAR2(20)"), ("NUMBER", "15", "2", "NUMBER(15,2)"), ("NUMBER", "15", "0", "NUMBER(15)"), ("DATE", "7", None, "DATE"), ("CHAR(3)", "9", None, "CHAR(3)"), ("", "1", None, None), (None, None, None, None)])
    assert all(r[0] == r[1] for r in t.select(dictionary.composed_type(F.col("t"), F.col("l"), F.col("s")), "w").collect())
    v = migrate.mapped_values(frame(spark, "c string", [("Y",), ("X",), (None,)]), "c", {"Y": "1"}, "9")
    assert rows(v) == [("1",), ("9",), (None,)]
    s = frame(spark, "q string, n array<string>", [("SELECT 1", ["a", "b"]), ("SELECT 2", [])]).select(migrate.commented(F.col("q"), F.col("n")))
    assert rows(s) == [("/* a; b */\nSELECT 1",), ("SELECT 2",)]
    out = frame(spark, "status string, warnings array<string>", [("AUTO", []), ("AUTO_WARN", ["w"]), ("NEEDS_LLM", []), ("PARSE_FAIL", [])])
    r = migrate.rates(out).first()
    assert (r["total"], r["auto"], r["automation_rate"]) == (4, 1, 0.5) and migrate.unresolved(out).count() == 3


def test_menu_table_and_schema_rows(spark):
    m = catalog.renamed_menu(frame(spark, "ID int, NM string", [(1, "a")]), {"program_id": "ID", "program_nm": "NM"})
    assert rows(m) == [("1", "a", None, None, None)]
    assert rows(catalog.spark_columns(frame(spark, "a int, b string", []), "t").select("column_id", "column_name", "data_type")) == [(1, "a", "int"), (2, "b", "string")]


def test_violations(spark):
    m = frame(spark, migrate.MAPPING, [("A", "X", None, "N", "P", None), ("A", "X", None, "N", "Q", None), ("A", "Y", None, "M", "P", None), ("B", "Z", None, "N", "P", None), ("B", "W", None, "N", "bad name", None)])
    assert {(r["code"], r["place"]) for r in migrate.mapping_violations(m).collect()} == {("DUPLICATE_SOURCE", "A.X"), ("DUPLICATE_TARGET", "N.P"), ("SPLIT_TABLE", "A"), ("BAD_NAME", "B.W")}
