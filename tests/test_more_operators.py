"""Operators on fixtures: mapping documents, static validation, endpoints and menus, retrieval documents, dictionary stores,
service adapters with a stub, layouts, modules and report files."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import adapters, dictionary, endpoints, lineage, migrate, sqlformat, sqltext, statements, vectors
from quarrylane.sources import catalog, files, modules, sheets, sinks


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- mapping documents

DOC = """
tables:
  - {type: rename, as_is: cust, to_be: customer}
  - {type: split, as_is: big, to_be: [big_a, big_b]}
  - {type: merge, as_is: [m1, m2], to_be: mm}
  - {type: drop, as_is: gone}
columns:
  - {as_is: {table: cust, column: addr}, to_be: [{column: a1, transform_select: "SUBSTR({src}, 1, 3)"}, {column: a2, transform_select: "SUBSTR({src}, 4)"}], reverse: "{a1} || {a2}"}
  - {as_is: [{table: cust, column: x}, {table: cust, column: y}], to_be: {column: xy}, transform: {combine: "{x} || {y}"}}
  - {as_is: {table: cust, column: yn}, to_be: {column: flag}, value_map: {Y: 1}, default: 0}
  - {as_is: {table: cust, column: old}, to_be: null}
"""
BAD = """
tables:
  - {type: rename, as_is: cust, to_be: customer}
  - {type: rename, as_is: cust, to_be: other}
columns:
  - {as_is: {table: cust, column: a}, to_be: [{column: a1}, {column: a2, transform_select: "F({other})"}]}
  - {as_is: [{table: cust, column: x}, {table: cust, column: y}], to_be: {column: xy}}
  - {as_is: {table: cust, column: b}, to_be: {column: c}, transform: {read: "TO_DATE({src}"}}
  - {as_is: {table: cust, column: b}, to_be: null, transform: {read: "X({src})"}}
  - {as_is: {table: none, column: d}, to_be: null}
  - {as_is: [{table: cust, column: p}, {table: cust, column: q}], to_be: {column: r}, transform: {combine: "{p} || {src}"}, value_map: {A: 1}}
"""


def test_mapping_documents_of_every_kind():
    got, wrong = sheets.load_mapping(DOC)
    assert wrong == [] and [(r["as_is_column"], r["kind"]) for r in got] == [("ADDR", "split"), ("X", "merge"), ("Y", "merge"), ("YN", "value_map"), ("OLD", "drop")]
    m = migrate.Mapping.of(got)
    assert migrate.rewrite("SELECT c.ADDR FROM cust c", m)["to_be_sql"] == "SELECT c.A1 || c.A2 FROM CUSTOMER c"
    assert migrate.rewrite("SELECT 1 FROM cust WHERE yn = 'Q'", m)["to_be_sql"] == "SELECT 1 FROM CUSTOMER WHERE FLAG = '0'"
    assert sheets.load_mapping(sheets.dump_mapping(got)) == (got, [])


def test_everything_wrong_with_a_mapping_is_reported():
    _, wrong = sheets.load_mapping(BAD)
    for part in ("cust is defined twice", "a1 of a split needs transform_select", "unknown placeholder other", "a merge needs transform.combine", "read: open parenthesis", "cust.b is mapped twice", "a dropped column has no transform", "table none isn't", "unknown placeholder src", "a value_map needs one column"):
        assert any(part in w for w in wrong), part


def test_columns_mapped_twice_are_refused():
    base = {"as_is_table": "T", "to_be_table": "N", "kind": "rename", "read": None, "write": None, "where_": None, "value_map": None, "as_is_column": "A"}
    same, other = base | {"to_be_column": "B"}, base | {"to_be_column": "C"}
    assert migrate.rewrite("SELECT A FROM T", migrate.Mapping.of([same, dict(same)]))["status"] == "AUTO"
    for order in ([same, other], [other, same]):
        got = migrate.rewrite("SELECT A FROM T", migrate.Mapping.of(order))
        assert (got["to_be_sql"], got["status"]) == ("SELECT A FROM N", "NEEDS_LLM")


def test_files_are_rewritten_alike_by_both_ways(spark):
    m = frame(spark, migrate.MAPPING, [("CUST", "NM", None, "CUSTOMER", "NAME", None), ("OTHER", "X", None, "", "Y", None)])
    m = migrate.mapping_kind(migrate.with_conversions(migrate.flat_mapping(m)).withColumn("value_map", F.create_map(F.lit("Y"), F.lit("1"))))
    f = frame(spark, "path string, content string", [("a", "<mapper><select id='x'>SELECT c.NM FROM CUST c WHERE c.NM = 'Y'</select></mapper>"), ("b", None), ("c", "<mapper/>")])
    one, two = (rows(migrate.rewritten_files(f, m, n)) for n in (100, 1))
    assert one == two and "c.NAME FROM CUSTOMER c WHERE c.NAME = '1'" in str(one)


def test_impact_report_of_a_broken_document(spark):
    s = frame(spark, "mapper string, id string, type string, sql string", [("m", "1", "select", "SELECT ADDR FROM CUST")])
    schema = frame(spark, "table_name string, column_name string", [("CUST", "ADDR"), ("CUST", "NEW")])
    got = migrate.impact_report(s, schema, DOC)
    assert ("CUST", "ADDR", "CUSTOMER", 1) not in rows(got["columns"]) and [r[2] for r in rows(got["tables"])] == [1] and ("NOT_MAPPED", "CUST.NEW") in rows(got["mismatch"])
    broken = migrate.impact_report(s, schema, "a: [")
    assert rows(broken["tables"]) == [] and len(rows(broken["errors"])) == 1


# ---- statements


@pytest.mark.parametrize(("sql", "why"), [("SELECT 1 FROM t", None), ("SELECT 1 FROM t FOR UPDATE", None), ("{ CALL P(?) }", None), ("SELECT 'x FROM t", "open quote"), ("SELECT (1 FROM t", "open parenthesis"), ("SELECT a) FROM t", "closing parenthesis without an opening one"), ("go", "no statement begins with GO"), ("SELECT a, FROM t", "nothing behind a comma"), ("SELECT a FROM", "nothing behind FROM"), ("", "empty statement"), (None, "empty statement"), ("-- x", "empty statement")])
def test_faults(sql, why):
    assert sqltext.fault(sql) == why


def test_references_are_resolved_by_scope():
    got = sqltext.references("SELECT a.X nm, (SELECT MAX(z.Q) FROM TZ z WHERE z.K = a.K) mx, COUNT(*) c FROM TA a, (SELECT T FROM TB) v WHERE a.D >= #{d} AND v.T = SYSDATE AND w.Z = 1")
    assert set(got) == {("A", "TA", "X", False), ("Z", "TZ", "Q", False), ("Z", "TZ", "K", False), ("A", "TA", "K", False), ("", "", "T", False), ("A", "TA", "D", False), ("V", "", "T", True), ("W", "", "Z", False)}
    assert sqltext.references("BEGIN x.y(1); END;") == [] and sqltext.references(None) == []


def test_comments_by_scope_and_policy(spark):
    notes = {("T", "A"): "이름", ("", "B"): "값"}
    sql = "SELECT t.A, B, 'A' FROM T t WHERE t.A = 1"
    assert migrate.annotate(sql, notes) == "SELECT t.A /* 이름 */, B /* 값 */, 'A' FROM T t WHERE t.A = 1"
    assert migrate.annotate(sql, notes, ("where",)) == "SELECT t.A, B, 'A' FROM T t WHERE t.A /* 이름 */ = 1"
    assert migrate.annotate("INSERT INTO T (A, C) VALUES (1, 2)", notes, ("insert",)) == "INSERT INTO T (A /* 이름 */, C) VALUES (1, 2)"
    assert migrate.annotate("UPDATE T SET A = B", notes, ("update",)) == "UPDATE T SET A /* 이름 */ = B"
    c = "table_name string, column_name string, comment string"
    src = {"mapping": frame(spark, c, [("t", "a", "m")]), "terms": frame(spark, c, [(None, "b", "w"), ("T", "A", "w")]), "schema": frame(spark, c, [("T", "C", "s"), ("T", "A", " ")])}
    assert rows(migrate.comment_sources(src, "mapping_first")) == [("T", "A", "m"), ("T", "C", "s"), (None, "B", "w")] and rows(migrate.comment_sources(src, "both"))[0] == ("T", "A", "w")
    s = frame(spark, "mapper string, id string, type string, sql string", [("m", "1", "select", sql), ("m", "2", "select", None), ("m", "3", "select", "SELECT Z FROM Y")])
    assert [r[3] for r in rows(migrate.annotated(s, migrate.comment_sources(src)))] == ["SELECT t.A /* m */, B /* w */, 'A' FROM T t WHERE t.A = 1", None, "SELECT Z FROM Y"]


def test_merged_corpora_keep_all_column_pairs(spark):
    s = "mapper string, id string, type string, sql string"
    a = frame(spark, s, [("m", "1", "select", "SELECT 1 FROM A a JOIN B b ON a.X = b.Y AND a.P = b.Q")])
    b = frame(spark, s, [("n", "1", "select", "SELECT 1 FROM B b JOIN A a ON b.Y = a.X"), ("n", "2", "update", "UPDATE A SET X = 1")])
    merged = statements.merged_corpora({"one": statements.read(a), "two": statements.read(b)})
    got = rows(statements.merged_edges(merged))
    assert [(r[0], r[1], r[2], r[3], r[5], r[6]) for r in got] == [("A", "P", "B", "Q", "one", 1), ("A", "X", "B", "Y", "one,two", 2)]
    assert rows(statements.merged_usage(merged)) == [("A", 2, 1, 2), ("B", 1, 1, 2)]
    assert rows(statements.corpus_totals(a.unionByName(b))) == [(2, 3, 2, 0, 1, 0, 0, 0)]
    assert rows(statements.statement_index(statements.read(b))) == [("n#1", "A,B", "R", ""), ("n#2", "A", "U", "")]


# ---- endpoints


def test_menu_matches_by_five_ways(spark):
    e = frame(spark, "url string", [("/a/list",), ("/api/one",), ("/api/two",), ("/api/three",), ("/api/four",), ("/api/none",), ("/a/list",), (None,)])
    menu = frame(spark, "program_id string, url string", [("P1", "/a/list"), ("P2", "/apps/one-screen"), ("P3", "/apps/two"), ("P4", "/apps/alias3"), ("P5", "/x/prefour9/y"), ("P6", None)])
    chain = frame(spark, "menu_url string, url string", [("/apps/one-screen", "/api/one")])
    api = frame(spark, "app string, url string", [("Two", "/api/two"), ("three", "/api/three"), ("four", "/api/four"), ("nine", "/api/none")])
    alias = frame(spark, "alias string, app string", [("alias3", "three")])
    assert rows(endpoints.menu_matches(e, menu, chain, api, alias, segment=2)) == [("/a/list", "P1", "url"), ("/api/four", "P5", "part_of_url"), ("/api/one", "P2", "import_chain"), ("/api/three", "P4", "alias"), ("/api/two", "P3", "app")]
    assert rows(endpoints.menu_matches(e, menu.limit(0), chain, api.limit(0), alias)) == []


def test_front_ends_without_a_back_end(spark):
    calls = frame(spark, "url string, screen string, trigger string", [("/a", "s1", "save"), ("/a", "s2", None), ("/b", "s1", "go"), ("/b", "s1", "go"), ("", "s", "x")])
    more = frame(spark, "url string, screen string, trigger string", [("/b", "s3", "run")])
    got = endpoints.front_map(calls, more)
    assert rows(got) == [("/a", "s1; s2", "s1: save"), ("/b", "s1; s3", "s1: go; s3: run")]
    assert [tuple(r)[:3] for r in endpoints.front_only(got, frame(spark, "url string", [("/a",)])).collect()] == [("/b", "s1; s3", "s1: go; s3: run")]
    routes = frame(spark, "app string, path string", [("Mat", "/apps/new-mat/x"), ("other", "/apps/mat/y")])
    assert rows(endpoints.bucket_aliases(routes, segment=2)) == [("mat", "mat"), ("new-mat", "mat"), ("other", "other")]


def test_back_ends_in_the_order_of_the_menu(spark):
    s = "url string, method string"
    menu = frame(spark, "url string, menu_no int", [("/b", 1), ("/a", 2)])
    got = endpoints.over_backends({"x": frame(spark, s, [("/a", "m1"), ("/z", "m2")]), "y": frame(spark, s, [("/b", "m3"), ("/a", "m1")])}, menu).collect()
    assert [(r["url"], r["backend"]) for r in got] == [("/b", "y"), ("/a", "x"), ("/a", "y"), ("/z", "x")]
    g = endpoints.by_screen(frame(spark, "n int, screen string", [(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "")]), "screen", ["n"]).collect()
    assert [r["n"] for r in g] == [1, 4, 3, 2, 5]


def test_chains_of_any_length_and_remote_calls(spark):
    calls = frame(spark, "src string, dst string", [(f"C.m{i}", f"C.m{i + 1}") for i in range(60)] + [("C.m60", "D.x"), ("D.x", "C.m0")])
    start = frame(spark, "node string", [("C.m0",)])
    got = dict((n, d) for _, n, d in rows(lineage.call_chain(start, calls, depth=1)))
    assert len(got) == 62 and got["C.m60"] == 0 and got["D.x"] == 1
    assert rows(endpoints.remote_reach(start, calls, frame(spark, "node string, remote string", [("D.x", "RFC_B"), ("C.m9", "RFC_A")]))) == [("C.m0", "RFC_A, RFC_B")]


def test_injected_classes_and_mappers(spark):
    f = frame(spark, "fqcn string, field string, type string, resolved string", [("a.C", "s", "OrdService", "b.OrdService"), ("a.C", "d", "OrdDao", None), ("a.C", "u", "Nope", None)])
    c = frame(spark, "fqcn string, class_name string", [("a.OrdService", "OrdService"), ("b.OrdService", "OrdService"), ("b.OrdDao", "OrdDao")])
    own = endpoints.injected(f, c)
    assert rows(own) == [("a.C", "d", "b.OrdDao"), ("a.C", "s", "b.OrdService")]
    roles = frame(spark, "fqcn string, role string", [("b.OrdDao", "mapper"), ("b.OrdService", "service")])
    assert rows(endpoints.class_mappers(own, roles, frame(spark, "fqcn string, namespace string", [("a.C", "ns.x"), ("a.C", "")]))) == [("a.C", "b.OrdDao"), ("a.C", "ns.x")]


PAGE = """<form name='f' action="/save.do"><a href='/list.do'>x</a><a href="style.css">y</a><script>
$.post('/p.do', 1); axios.get("/q"); callApi('/own'); location.href = '/go.do'; f.action='/act.do'; x.open('POST', '/xhr.do'); o = { url : "/u.do" }; if (location.href == '/no.do') {} </script>"""


def test_pages_name_urls_at_known_places(spark):
    got = rows(lineage.page_urls(frame(spark, "path string, content string", [("p", PAGE), ("n", None)]), ("callApi",)))
    assert [u for _, u in got] == sorted(["/save.do", "/list.do", "/p.do", "/q", "/own", "/go.do", "/act.do", "/xhr.do", "/u.do"])


# ---- retrieval documents


def test_schema_and_query_documents(spark):
    cols = [("A", "first", f"C{i:02d}", i, "NUMBER") for i in range(1, 36)] + [("B", None, "X", 1, None), ("B", None, "X", 1, None)]
    con = frame(spark, "table_name string, kind string, detail string", [("A", "PK", "C01"), ("A", "FK", "C02 -> B.X"), ("Z", "PK", "Q")])
    got = rows(vectors.schema_documents(frame(spark, "table_name string, table_comment string, column_name string, col_no int, data_type string", cols), con).select("table_name", "kind", "chunk", "text"))
    assert [g[:3] for g in got] == [("A", "columns", 0), ("A", "columns", 1), ("A", "constraints", 0), ("A", "overview", 0), ("B", "whole", 0)]
    assert got[2][3] == "A: FK C02 -> B.X; PK C01" and got[3][3] == "A - first: 35 columns" and got[4][3] == "B: X" and got[1][3].startswith("A: C31 NUMBER, ")
    e = frame(spark, "table1 string, column1 string, table2 string, column2 string, join_type string", [("A", f"C{i}", "B", "X", "JOIN") for i in range(16)])
    c = frame(spark, "mapper string, id string, table_name string, crud string", [("m", f"q{i}", "A", "R") for i in range(6)])
    got = vectors.query_documents(e, c, frame(spark, "table_name string, n int", [("A", 3)]))
    assert sorted((r["kind"], r["part"], r["chunk"], r["tables"]) for r in got.collect()) == [("query", "m", 0, "A"), ("query", "m", 1, "A"), ("relation", "A", 0, "A,B"), ("relation", "A", 1, "A,B"), ("usage", "A", 0, "A")]


def test_collections_are_written_anew(spark, tmp_path):
    t = frame(spark, "logical string, physical string, term_desc string", [("수량", "QTY", "몇 개"), ("수량", "QTY", None), (None, "X", "y")])
    texts = vectors.term_texts(t)
    assert rows(texts) == [("수량|QTY", "수량 몇 개")]
    vectors.rebuilt(texts, lambda ts: [[float(len(x)), 1.0] for x in ts], str(tmp_path / "c"))
    assert vectors.collection(spark, str(tmp_path / "c")).count() == 1


# ---- dictionaries

WORD = "word_id bigint, logical string, physical string, eng string, is_std int, is_classifier int, synonyms string, expire string"
WORDS = [(1, "고객", "CUST", "customer", 1, 0, None, None), (2, "번호", "NO", "number", 1, 1, "넘버", None), (3, "주문", "ORD", "order", 1, 0, None, None), (4, "고객번호", "CUSTNO", None, 0, 0, None, None)]
TERM = "term_id bigint, logical string, physical string, domain_name string, data_type string, data_length string, data_scale string, expire string"
TERMS = [(1, "주문번호", "ORD_NO", "번호", "VARCHAR2", "20", None, None), (2, "고객 번호", "CUST_NO", "번호", "VARCHAR2", "20", None, None), (3, "옛번호", "OLD_NO", "번호", "CHAR", "8", None, None)]


def test_segments_by_both_ways(spark):
    keys = dictionary.resolved(dictionary.candidates(frame(spark, WORD, WORDS), "20250101"))
    texts = frame(spark, "text string", [(t,) for t in ("고객번호", "주문고객넘버", "가나주문", "x", "", "고객고", "모름")])
    one, two = (rows(dictionary.segmented(texts, keys, most=n)) for n in (100, 1))
    got = {t: [(k["frag"], k["abbr"]) for k in ks] for t, ks in one}
    assert one == two and got["고객번호"] == [("고객번호", "CUSTNO")] and got["주문고객넘버"] == [("주문", "ORD"), ("고객", "CUST"), ("넘버", "NO")] and got["가나주문"] == [("가나", None), ("주문", "ORD")] and got["고객고"] == [("고객", "CUST")] and got["모름"] == [("모름", None)]


def test_types_are_inferred_from_the_last_classifier(spark):
    cols = frame(spark, "column_name string, col_comment string", [("A", "주문 고객 넘버"), ("B", "주문번호"), ("C", "주문 고객"), ("D", None)])
    got = {r["column_name"]: (r["tobe_name"], r["tier"], r["domain_name"], r["data_type"]) for r in dictionary.recommended(cols, frame(spark, WORD, WORDS), frame(spark, TERM, TERMS), "20250101").collect()}
    assert got["A"] == ("ORD_CUST_NO", "composed", "번호", "VARCHAR2(20)") and got["B"] == ("ORD_NO", "exact", "번호", "VARCHAR2(20)") and got["C"] == ("ORD_CUST", "composed", None, None) and got["D"][1] == "unmatched"


def test_probe_store_and_retrieval(spark, tmp_path):
    w, t = frame(spark, WORD, WORDS), frame(spark, TERM, TERMS)
    r = dictionary.probed("넘버", w, t, "20250101").first()
    assert (r["in_terms"], r["in_words"], r["resolved_logical"], r["matched_field"], r["abbr"], r["tobe_name"]) == (False, True, "번호", "synonym", "NO", "NO")
    assert dictionary.is_stale(spark, str(tmp_path / "d"), "v1")
    dictionary.saved(w, t, str(tmp_path / "d"), "v1")
    assert not dictionary.is_stale(spark, str(tmp_path / "d"), "v1") and dictionary.is_stale(spark, str(tmp_path / "d"), "v2")
    assert [x.count() for x in dictionary.loaded(spark, str(tmp_path / "d"))] == [4, 3]
    coll = frame(spark, "vec_id bigint, embedding array<float>", [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    got = dictionary.retrieved_terms(frame(spark, "query_id bigint, comment string", [(7, "고객 (x)"), (8, " "), (9, None)]), coll, lambda ts: [[1.0, 0.1] for _ in ts], k=1)
    assert [(r["query_id"], r["vec_id"]) for r in got.collect()] == [(7, 1)]


# ---- services


def service(fields):
    """A stub that answers every text of a batch by a function of the text."""
    return lambda texts: json.dumps([{"id": i} | fields(t) for i, t in enumerate(texts)], ensure_ascii=False)


def test_adapters_with_a_stub(spark):
    t = frame(spark, "table_name string, text string", [("A", "a"), ("B", "b")])
    assert rows(adapters.described_tables(t, service(lambda x: {"description": x * 2, "domain": "d"}))) == [("A", "aa", "d", True), ("B", "bb", "d", True)]
    e = frame(spark, "table1 string, column1 string, table2 string, column2 string", [("B", "Y", "A", "X")])
    rel = service(lambda x: {"relations": [{"column": "x", "table": "b", "target": "y"}, {"column": "z", "table": "b", "target": "y"}, {"column": "q", "table": "nope", "target": "y"}]} if x == "a" else {"relations": []})
    assert rows(adapters.proposed_relations(t, rel, e)) == [("A", "Z", "B", "Y")]
    w = frame(spark, "word string, text string, label string", [("CUST", "c", None), ("NO", "n", "번호")])
    assert rows(adapters.enriched_words(w, service(lambda x: {"label": "새", "definition": x}))) == [("CUST", "새", "c", False), ("NO", "번호", "n", True)]
    ddl = rows(adapters.proposed_ddl(frame(spark, "ddl_id string, text string", [("1", "x"), ("2", "y")]), service(lambda x: {"ddl": "CREATE TABLE tb_x (ID NUMBER(3))" if x == "x" else "no"})))
    assert ddl[0][3] is True and any("CASE" in i for i in ddl[0][2]) and ddl[1][3] is False
    s = frame(spark, "mapper string, id string, sql string", [("m", "1", "SELECT 1")])
    assert rows(adapters.reviewed(frame(spark, "mapper string, id string", [("m", "1")]), s, service(lambda x: {"review": "ok", "better": x}))) == [("m", "1", "ok", "SELECT 1")]
    assert rows(adapters.proposals(frame(spark, "place string, text string", [("p", "t")]), service(lambda x: {"proposal": "q", "reason": x}))) == [("p", "q", "t")]
    assert rows(adapters.discovered_patterns(frame(spark, "path string, text string", [("a", "1"), ("b", "2")]), service(lambda x: {"patterns": [{"kind": "k", "pattern": "p"}]}))) == [("k", "p", 2)]
    assert rows(adapters.screen_layouts(frame(spark, "path string, text string", [("a", "1")]), service(lambda x: {"elements": [{"row": 1, "col": 2, "kind": "input", "label": "l"}]}))) == [("a", 1, 2, "input", "l")]
    assert rows(adapters.converted_mapping(frame(spark, "line_id string, text string", [("1", "x"), ("2", "y")]), service(lambda x: {"as_is_table": "T", "as_is_column": "C" if x == "x" else ""}))) == [("T", "C", None, None, None, None)]


def test_url_patterns_without_a_service(spark):
    u = frame(spark, "url string", [("http://h/api/v1/ord/list",), ("/api/v1/cust/x?y=1",), ("/api/v1/ord",), (None,)])
    assert rows(adapters.url_patterns(u, frame(spark, "name string", [("ORD",)]))) == [("/api/v1", "^/api/v1(?=/|$)", 3)]
    assert rows(adapters.url_patterns(u.limit(0), frame(spark, "name string", [("x",)]))) == [("", None, None)]


def test_kept_answers_and_bundles(spark):
    m = frame(spark, "key string, body string", [("a", "// does it\nx();"), ("b", "y();"), ("c", "y();")])
    kept = m.filter("key = 'b'").select(lineage.body_hash(F.col("body")).alias("hash"), F.lit("kept").alias("summary"))
    seen = []

    def ask(texts):
        seen.append(texts)
        raise ValueError

    got = {r["key"]: (r["summary"], r["is_answer"]) for r in adapters.described_methods(m, ask, kept).collect()}
    assert got == {"a": ("does it", False), "b": ("kept", True), "c": ("kept", True)}
    b = adapters.bundles(frame(spark, "trigger string, key string", [("t", "k1"), ("t", "k2"), ("t", "k3")]), frame(spark, "key string, rank int, text string", [("k1", 2, "bb"), ("k2", 1, "aaa"), ("k3", 3, "cccc")]), budget=5)
    assert rows(b) == [("t", "aaa\nbb", 2, 1)]
    assert rows(adapters.described_triggers(b, service(lambda x: {"summary": x[:3], "validations": ["v"]}))) == [("t", "aaa", ["v"])]


def test_rewriting_by_a_service(spark):
    out = frame(spark, "mapper string, id string, sql string, to_be_sql string, status string", [("m", "1", "SELECT A FROM T", "SELECT A FROM T", "NEEDS_LLM"), ("m", "2", "SELECT B FROM T", "x", "NEEDS_LLM"), ("m", "3", "SELECT C FROM T", "y", "AUTO"), ("m", "4", "SELECT D FROM T", "z", "NEEDS_LLM")])
    mapping = frame(spark, "as_is_table string, as_is_column string, to_be_table string, to_be_column string", [("T", "A", "N", "A2"), ("U", "Q", "V", "W")])
    ask = service(lambda x: {"sql": "SELECT A2 FROM N" if "A FROM" in x else "SELECT (", "confidence": 0.5 if "B FROM" in x else 0.9} if "T.A -> N.A2" in x and "U.Q" not in x else {})
    assert rows(adapters.rewritten_by_service(out, mapping, ask)) == [("m", "1", "SELECT A2 FROM N", "LLM"), ("m", "2", "x", "UNRESOLVED"), ("m", "4", "z", "UNRESOLVED")]


# ---- layouts and modules


def test_layout_keeps_the_statement():
    sql = "select a.x, nvl(b.y, 0) y from t a left join u b on a.i = b.i where a.d between :x and :y and a.n = '한, 글' -- note\n order by a.x"
    got = sqlformat.layout(sql)
    assert got.split("\n")[:3] == ["select a.x", "     , nvl(b.y, 0) y", "  from t a"] and "   and a.n = '한, 글' -- note" in got and "between :x and :y" in got
    assert "".join(got.split()) == "".join(sql.split()) and sqlformat.layout("SELECT (1") == "SELECT (1" and sqlformat.layout(got) == got


def test_reindented_and_narrowed():
    assert sqlformat.reindented("\n      SELECT 1\n        FROM t\n\n") == "    SELECT 1\n      FROM t"
    assert sqlformat.localized_cdata("<![CDATA[ SELECT 1 FROM t WHERE a < 5 AND b = 'x' ]]>") == " SELECT 1 FROM t WHERE a <![CDATA[<]]> 5 AND b = 'x' "
    assert sqlformat.localized_cdata("SELECT 1") == "SELECT 1"


TS = '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@c": ["./src/c"],}}}'
APP = "import A from './a'; import B from '@/b/index'; import C from '@c'; import React from 'react';\nconst LABEL = 'Name';\nreturn <div>{ok && x ? (<Input name=\"nm\" label={LABEL} required onChange={() => go({a: 1})} />) : null}<Grid/></div>"
TABLE = "<table><tr><th>이름</th><td><Input name='nm'/> <Button id=\"go\">찾기</Button></td><th>날</th><td><DatePicker field='dt' onChange={(a) => b}/></td></tr><tr><th>빈</th><td>x</td></tr></table>"


def test_modules(spark):
    assert modules.path_aliases(TS) == [("@/", "src/"), ("@c", "src/c")] and modules.path_aliases("{") == []
    f = frame(spark, "path string, content string", [("src/app.jsx", APP), ("src/a.tsx", ""), ("src/b/index.js", ""), ("src/c/index.ts", ""), ("t.jsx", TABLE), ("n.jsx", None)])
    assert rows(modules.resolved_imports(f, modules.path_aliases(TS))) == [("src/app.jsx", "./a", "src/a.tsx"), ("src/app.jsx", "@/b/index", "src/b/index.js"), ("src/app.jsx", "@c", "src/c/index.ts")]
    own = {r["tag"]: (r["attrs"], r["condition"]) for r in modules.components(f).filter("path = 'src/app.jsx'").collect()}
    assert own["Input"] == ({"name": "nm", "label": "Name", "required": "true", "onChange": "() => go({a: 1})"}, "ok") and own["Grid"] == ({}, None)
    assert rows(modules.input_tables(f)) == [("t.jsx", 1, "날", "DatePicker", "dt"), ("t.jsx", 1, "이름", "Button", "go"), ("t.jsx", 1, "이름", "Input", "nm")]


# ---- catalogs, files and reports


def test_schema_of_views(spark):
    views = {
        "tables": frame(spark, "table_name string", [("A",), ("B",)]), "table_comments": frame(spark, "table_name string, comments string", [("A", "first"), ("B", None)]),
        "columns": frame(spark, "table_name string, column_id int, column_name string, data_type string, data_length int, data_precision int, data_scale int, nullable string", [("A", 1, "ID", "NUMBER", 22, 9, 0, "N"), ("B", 1, "X", "DATE", 7, None, None, "Y")]),
        "column_comments": frame(spark, "table_name string, column_name string, comments string", [("A", "ID", "key")]),
        "constraints": frame(spark, "constraint_name string, constraint_type string, r_constraint_name string", [("PK", "P", None)]), "constraint_columns": frame(spark, "constraint_name string, table_name string, column_name string, position int", [("PK", "A", "ID", 1)]),
        "indexes": frame(spark, "table_name string, index_name string, uniqueness string", [("A", "I", "UNIQUE")]), "index_columns": frame(spark, "table_name string, index_name string, column_name string, column_position int", [("A", "I", "ID", 1)]),
    }
    got = catalog.schema(views)
    assert rows(got["tables"]) == [("A", "first"), ("B", None)] and rows(catalog.table_comments(views["table_comments"])) == [("A", "first")]
    assert rows(catalog.constraint_lines(got)) == [("A", "INDEX", "I (ID) unique"), ("A", "PK", "ID")] and catalog.schema(views, ["B"])["columns"].count() == 1


def test_query_documents_are_read(spark):
    md = "### TB_A\n| A.X <-> B.Y | LEFT JOIN |\n| `TB_C` | 1 | 2 | 3 |\n| name | x | 2 |\n"
    f = frame(spark, "path string, content string", [("q.md", md)])
    assert rows(catalog.markdown_usage(f)) == [("q.md", "TB_C", [1, 2, 3])] and [r[0] for r in rows(catalog.markdown_tables(f))] == ["A", "B", "TB_A", "TB_C"]
    s = frame(spark, "path string, content string", [("s.md", "## a\n| x | NUMBER | N | | |\n")])
    assert rows(catalog.schema_lookup(s)) == [("A", "X")]


def test_scripts_are_left_out_only_where_asked(spark, tmp_path):
    (tmp_path / "a.js").write_text("x" * 600_000)
    (tmp_path / "b.min.js").write_text("y")
    assert files.script_files(spark, str(tmp_path)).count() == 1 and files.script_files(spark, str(tmp_path), 100).count() == 0
    assert sorted(r["reason"] for r in files.skipped_scripts(spark, str(tmp_path), 100).collect()) == ["minified", "too large"]
    assert files.kept(files.script_files(spark, str(tmp_path)), str(tmp_path / "kept")).count() == 1
    env = frame(spark, "name string, value string", [("API_A", "http://ord-api.x.com/v1"), ("API_B", "/cust/api"), ("API_C", "zzz")])
    assert rows(files.backend_repos(env, frame(spark, "repo string", [("ord-api",), ("CUST",), ("api",)]))) == [("API_A", "ord-api"), ("API_B", "CUST")]


def test_reports(spark, tmp_path):
    df = frame(spark, "a string, b array<int>, c string", [("x|y", [1, 2], None), ("한\n글", None, "q")])
    folder = sinks.write_reports({"r": df}, str(tmp_path), "입력/x y", "2025-01-02")
    assert folder.endswith("입력_x_y/20250102")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "입력_x_y/20250102/r.md").glob("part-*")))
    assert lines.split("\n")[:4] == ["## r", "", "| a | b | c |", "|---|---|---|"] and "| x\\|y | [1,2] |  |" in lines and "| 한 글 |" in lines
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(folder + "/r.csv").count() == 2
    assert sinks.with_environment({"a": ["${X}-${Y:z}", 1], "b": {"c": "${NO}"}}, {"X": "1"}) == {"a": ["1-z", 1], "b": {"c": "${NO}"}}
