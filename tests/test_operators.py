"""Graph, dictionary, naming, lineage, vector, mapper and migration operators on small fixtures."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quarrylane.functions.text import identifier_words, match_key
from quarrylane.operators import dictionary as dic
from quarrylane.operators import graph, lineage, migrate, naming, profile, vectors
from quarrylane.operators import statements as st
from quarrylane.sources import catalog, files, mapper

F = pytest.importorskip("pyspark.sql.functions")


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- graphs


def parts_of(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out, seen = {}, set()
    for n in sorted(near):
        if n in seen:
            continue
        todo, own = [n], set()
        while todo:
            x = todo.pop()
            if x not in own:
                own.add(x)
                todo += near[x]
        seen |= own
        out |= dict.fromkeys(own, n)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_against_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    rng.shuffle(edges)
    assert dict(rows(graph.components(frame(spark, "src bigint, dst bigint", edges)))) == parts_of(edges)


def test_components_of_nothing_loops_and_nulls(spark):
    assert rows(graph.components(frame(spark, "src string, dst string", []))) == []
    assert rows(graph.components(frame(spark, "src string, dst string", [("a", "a"), (None, "b"), ("c", "d"), ("d", "c"), ("c", "d")]))) == [("c", "c"), ("d", "c")]


def test_hub_star_of_a_third_of_all_rows(spark):
    edges = [("hub", f"n{i:05}") for i in range(3000)] + [(f"m{i:05}", f"m{i + 1:05}") for i in range(0, 6000, 2)]
    df = frame(spark, "src string, dst string", edges)
    sizes = dict((c, n) for c, n in rows(graph.component_sizes(graph.components(df))))
    assert sizes["hub"] == 3001 and len(sizes) == 3001
    assert rows(graph.hubs(df, threshold=100)) == [("hub",)]
    assert ("hub",) in rows(graph.hubs(df, manual=frame(spark, "node string", [("hub",), ("zzz",)])))
    usage = frame(spark, "node string, main int, joined int", [("hub", 1, 9), ("m00000", 0, 2)])
    assert rows(graph.hubs(df, usage=usage)) == [("hub",)]


def test_bounded_groups(spark):
    edges = [(f"a{i:02}", f"a{i + 1:02}") for i in range(20)] + [("x", "y")]
    df = frame(spark, "src string, dst string", edges)
    got = graph.bounded_groups(df, graph.components(df), size=5).collect()
    by = defaultdict(set)
    for r in got:
        by[r["component"], r["part"]].add(r["node"])
    assert all(len(v) <= 5 for v in by.values()) and sum(map(len, by.values())) == 23 and by["x", 0] == {"x", "y"}


def test_reachable_and_imports(spark):
    e = frame(spark, "src string, dst string", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")])
    got = {(n, h) for s, n, h in rows(graph.reachable(e, frame(spark, "node string", [("a",)]), most=3))}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    code = "import A from './x/a'; const b = require('../b'); const c = import('./c'); import React from 'react'; export * from \"./d\""
    assert {d for _, d in rows(graph.import_edges(frame(spark, "path string, content string", [("src/app/m.js", code)])))} == {"src/app/x/a", "src/b", "src/app/c", "src/app/d"}


def test_chunks_number_all_in_order(spark):
    df = frame(spark, "node string", [(f"t{i:04}",) for i in range(95)] * 2)
    assert rows(graph.chunks(df, 30)) == [(f"t{i:04}", i // 30) for i in range(95)]


def test_cardinality_pairs_and_erd(spark):
    e = frame(spark, "table1 string, column1 string, table2 string, column2 string, join_type string", [("A", "ID", "B", "A_ID", "INNER JOIN"), ("B", "X", "A", "Y", "LEFT JOIN")])
    k = frame(spark, "table_name string, column_name string", [("A", "ID")])
    assert [r["cardinality"] for r in graph.cardinality(e, k).orderBy("table1").collect()] == ["1:N", "N:M"]
    assert rows(graph.grouped_pairs(e)) == [("A", "B", "ID=A_ID / Y=X", "INNER JOIN / LEFT JOIN", 2)]
    lines = [r["line"] for r in graph.mermaid(graph.grouped_pairs(e).withColumn("cardinality", F.lit("1:N"))).collect()]
    assert lines == ['    A ||--o{ B : "ID=A_ID / Y=X"']
    assert graph.related(e, ["A"]).count() == 2 and graph.related(e, ["A"], only_between=True).count() == 0


# ---- statements


def test_edges_are_the_same_whichever_way_round(spark):
    stmts = [("m", "1", "select", "SELECT 1 FROM A a JOIN B b ON a.x = b.y"), ("m", "2", "select", "SELECT 1 FROM A a, B b WHERE b.y = a.x"), ("n", "1", "select", None), ("n", "2", "update", "")]
    got = st.join_edges(st.read(frame(spark, "mapper string, id string, type string, sql string", stmts))).collect()
    assert [(r["table1"], r["column1"], r["table2"], r["column2"], r["join_type"], r["n_sources"], r["sources"]) for r in got] == [("A", "X", "B", "Y", "INNER JOIN", 2, "m#1,m#2")]


LINT = {
    "SELECT_STAR": ("SELECT * FROM A", "SELECT a.* FROM A a"), "NOT_IN": ("SELECT 1 FROM A WHERE x NOT IN (1)", "SELECT 1 FROM A WHERE x IN (1)"), "LIKE_LEADING_WILDCARD": ("WHERE x LIKE '%a'", "WHERE x LIKE 'a%'"),
    "FUNCTION_ON_COLUMN": ("SELECT 1 FROM A a WHERE UPPER(a.x) = 1", "SELECT UPPER(a.x) FROM A a"), "CARTESIAN_JOIN": ("SELECT 1 FROM A a, B b", "SELECT 1 FROM A a JOIN B b ON 1 = 1"), "OR_IN_WHERE": ("SELECT 1 FROM A WHERE x = 1 OR y = 2", "SELECT 1 FROM A WHERE x = 1"),
    "DISTINCT": ("SELECT DISTINCT x FROM A", "SELECT x FROM A"), "IMPLICIT_CONVERSION": ("WHERE x = '123'", "WHERE x = 123"), "ORDER_BY_NO_INDEX": ("SELECT 1 FROM A ORDER BY x, ROWNUM", "SELECT 1 FROM A ORDER BY x"),
    "SUBQUERY_IN_SELECT": ("SELECT (SELECT 1 FROM B) FROM A", "SELECT x FROM A"), "MISSING_WHERE": ("UPDATE A SET x = 1", "UPDATE A SET x = 1 WHERE y = 2"),
}


def test_each_lint_rule_hits_and_misses(spark):
    data = [(rule, str(i), "update" if rule == "MISSING_WHERE" else "select", q) for rule, pair in LINT.items() for i, q in enumerate(pair)]
    got = {(r["mapper"], r["id"]) for r in st.lint(frame(spark, "mapper string, id string, type string, sql string", data)).collect() if r["rule"] == r["mapper"]}
    assert got == {(rule, "0") for rule in LINT}


def test_placeholders_come_back(spark):
    texts = ["SELECT #{a} FROM ${b} WHERE x = #{a} AND y = #{c,jdbcType=INT}", "SELECT 1", ""]
    df = frame(spark, "sql string", [(t,) for t in texts]).select("sql", st.placeholders(F.col("sql")).alias("m"))
    back = df.select("sql", "m.sql", st.unmasked(F.col("m.sql"), F.col("m.placeholders")).alias("back")).collect()
    assert all(r["back"] == r[0] for r in back) and back[0][1] == "SELECT __MBP_0__ FROM __MBP_1__ WHERE x = __MBP_0__ AND y = __MBP_2__"


def test_cleaning_keeps_comparisons(spark):
    got = frame(spark, "q string", [("SELECT a /* x */ FROM T -- y\n WHERE a <= 1 AND b <> 2 AND <if test='c'>c < #{d}</if> <![CDATA[ e > 1 ]]>",)]).select(st.cleaned(F.col("q"))).first()[0]
    assert got == "SELECT a FROM T WHERE a <= 1 AND b <> 2 AND c < ? e > 1"


# ---- names and dictionaries


def test_identifier_words(spark):
    names = ["CUST_ORDER_DT", "customerOrder", "CustomerOrderNo", "HTTPServer_id", "F123", "", "__a__"]
    got = frame(spark, "n string", [(n,) for n in names]).select(identifier_words(F.col("n"))).collect()
    assert [list(r[0]) for r in got] == [["CUST", "ORDER", "DT"], ["CUSTOMER", "ORDER"], ["CUSTOMER", "ORDER", "NO"], ["HTTP", "SERVER", "ID"], ["F123"], [], ["A"]]


def test_naming_rules(spark):
    names = [("TB_" + "A" * 30, "table"), ("tb_cust", "table"), ("TB-CUST", "table"), ("1TB_CUST", "table"), ("CUST", "table"), ("TB_XYZ", "table"), ("CUST_NM", "column")]
    got = defaultdict(set)
    for r in naming.name_issues(frame(spark, "name string, kind string", names)).collect():
        got[r["name"]].add(r["rule"])
    assert "LENGTH" in got["TB_" + "A" * 30] and "CASE" in got["tb_cust"] and "SPECIAL_CHAR" in got["TB-CUST"] and "FIRST_CHAR" in got["1TB_CUST"] and got["CUST"] == {"PREFIX"} and got["TB_XYZ"] == {"UNKNOWN_ABBREVIATION"} and "CUST_NM" not in got
    close = dict(rows(naming.suggestions(frame(spark, "part string", [("CUSTM",), ("QQQQ",)]))))
    assert close["CUSTM"][0] in ("CUST", "CUSTOMER") and close["QQQQ"] == []
    assert rows(naming.ddl_names(frame(spark, "ddl_id int, ddl string", [(1, "CREATE TABLE own.TB_A (\n ID NUMBER(9),\n NM VARCHAR2(10)\n)")]))) == [(1, "ID", "column"), (1, "NM", "column"), (1, "TB_A", "table")]


WORDS = "word_id bigint, logical string, physical string, eng string, is_std int, is_classifier int, synonyms string, expire string"
TERMS = "term_id bigint, logical string, physical string, domain_name string, data_type string, data_length string, data_scale string, expire string"
WORD_ROWS = [
    (1, "고객", "CUST", "Customer", 1, 0, "손님, 거래선", None), (2, "번호", "NO", "Number", 1, 1, None, None), (3, "주문", "ORD", "Order", 1, 0, None, None), (4, "금액", "AMT", "Amount", 1, 1, None, None),
    (5, "옛말", "OLD", None, 1, 0, None, "2001-01-01"), (6, "손님", "GUEST", None, 0, 0, None, None), (7, "빈말", None, None, 1, 0, None, None), (8, "고객번호", "CUSTNO", None, 0, 0, None, None), (9, "날", "DY", None, 1, 0, None, "9999-12-31"),
]
TERM_ROWS = [(1, "주문번호", "ORD_NO", "번호형", "VARCHAR2", "20", None, None), (2, "주문금액", "ORD_AMT", "금액형", "NUMBER", "15", "2", None), (3, "끝난말", "DEAD", "번호형", "DATE", None, None, "19990101"), (4, "고객번호", "CUST_NO", "번호형", "VARCHAR2", "20", None, None)]


def recommended(spark, columns):
    df = dic.recommended(frame(spark, "column_name string, col_comment string", columns), frame(spark, WORDS, WORD_ROWS), frame(spark, TERMS, TERM_ROWS), "20250101")
    return {(r["column_name"], r["col_comment"]): (r["tobe_name"], r["tier"], r["confidence"]) for r in df.collect()}


def test_recommendation(spark):
    cases = {
        ("X", "주문번호"): ("ORD_NO", "exact", 1.0), ("X", "주문 번호(PK)"): ("ORD_NO", "exact", 1.0), ("X", "손님금액"): ("CUST_AMT", "composed", 1.0), ("X", "옛말"): ("«옛말»", "unmatched", 0.0), ("X", "고객벼루번호"): ("CUST_«벼루»_NO", "partial", 0.67),
        ("X", "Customer Amount"): ("CUST_AMT", "composed", 1.0), ("ORD_NO", None): ("ORD_NO", "already_standard", 1.0), ("CUST_AMT", ""): ("CUST_AMT", "already_standard", 1.0), ("ZZZ", None): ("«ZZZ»", "unmatched", 0.0), ("custAmt", None): ("CUST_AMT", "already_standard", 1.0),
    }
    got = recommended(spark, list(cases))
    assert {k: got[k] for k in cases if k != ("custAmt", None)} == {k: v for k, v in cases.items() if k != ("custAmt", None)}
    assert got["custAmt", None][:2] == ("CUST_AMT", "composed")


def brute_segments(text, keys):
    out, i, pending = [], 0, ""
    while i < len(text):
        k = next((text[i : i + n] for n in range(len(text) - i, 0, -1) if text[i : i + n] in keys), None)
        if k:
            if len(pending) > 1:
                out.append((pending, False))
            out.append((k, True))
            i, pending = i + len(k), ""
        else:
            pending += text[i]
            i += 1
    return out + ([(pending, False)] if len(pending) > 1 else [])


def test_segmentation_against_brute_force(spark):
    rng = random.Random(4)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(9)})
    texts = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(0, 12))) for _ in range(300)})
    k = frame(spark, "match_key string, logical string, physical string, field string", [(x, x, x.upper(), "logical") for x in keys])
    got = {r["text"]: [(t["frag"], t["matched"]) for t in r["tokens"]] for r in dic.segmented(frame(spark, "text string", [(t,) for t in texts]), k).collect()}
    assert got == {t: brute_segments(t, set(keys)) for t in texts}


def test_priority_and_keys(spark):
    got = {r["match_key"]: (r["physical"], r["rank"]) for r in dic.resolved(dic.candidates(frame(spark, WORDS, WORD_ROWS), "20250101")).collect()}
    assert got["손님"] == ("CUST", 1) and got["CUSTOMER"] == ("CUST", 2) and "옛말" not in got and "빈말" not in got and got["날"] == ("DY", 0)
    assert frame(spark, "s string", [("a-B c.",), (None,), ("가 나",)]).select(match_key(F.col("s"))).collect() == [("ABC",), ("",), ("가나",)]


def test_modal_types(spark):
    assert rows(dic.classifier_types(frame(spark, TERMS, TERM_ROWS), frame(spark, WORDS, WORD_ROWS), "20250101")) == [("금액", "금액형", "NUMBER(15,2)", 1, 1), ("번호", "번호형", "VARCHAR2(20)", 2, 1)]
    d = frame(spark, "term_id int, domain_name string, data_type string", [(1, "d", "B"), (2, "d", "A"), (3, "e", "X"), (4, None, "X"), (5, "e", None)])
    assert rows(dic.domain_types(d)) == [("d", "B", 1, 2, False), ("e", "X", 1, 1, True)]


# ---- profiles


def test_profiles_of_nulls_ties_and_nothing(spark):
    v = frame(spark, "table_name string, column_name string, value string", [("t", "c", x) for x in ["a", "b", "b", "a", None, "z"]] + [("t", "n", None)])
    got = [(r["value"], r["n"], r["rank"], r["total_rows"], r["distinct_count"], r["null_count"]) for r in profile.code_profile(v, top=2).orderBy("rank").collect()]
    assert got == [("a", 2, 1, 6, 3, 1), ("b", 2, 2, 6, 3, 1)]
    assert profile.code_profile(v.limit(0)).count() == 0
    u = profile.column_usage(frame(spark, "a string, b string", [(None, "x" * 20), (None, None)]), "t", ["a", "b"])
    f = profile.usage_findings(u, frame(spark, LENGTHS, [("t", "a", "DATE"), ("t", "b", "VARCHAR2(100)")]))
    assert {(r["column_name"], r["is_unused"], r["is_oversized"], r["null_ratio"]) for r in f.collect()} == {("a", True, False, 100.0), ("b", False, True, 50.0)}


LENGTHS = "table_name string, column_name string, data_type string"


# ---- lineage


def test_urls(spark):
    cases = {"": "", None: "", "/Order/{id}/": "/order/{p}", "order/:no": "/order/{p}", "http://h:80/a//b": "/a/b", "/a/*": "/a/{p}", "/a/**": "/a/{p}", "/": "/", "/a*b": "/a*b", "/x?q=1": "/x?q=1"}
    df = frame(spark, "u string", [(u,) for u in cases]).select("u", lineage.normalized_url(F.col("u")).alias("k"), lineage.normalized_url(lineage.normalized_url(F.col("u"))).alias("kk"))
    assert {r["u"]: r["k"] for r in df.collect()} == cases and all(r["k"] == r["kk"] for r in df.collect())


def test_menu_depths_cycles_and_missing_parents(spark):
    data = [("1", "A", None, None), ("2", "B", None, "1"), ("3", "C", None, "2"), ("4", "D", None, "3"), ("5", "E", "/e", "4"), ("6", "F", "/f", "1"), ("7", "G", "/g", None), ("8", "H", "/h", "nowhere"), ("x", "X", "/x", "y"), ("y", "Y", None, "x")]
    got = {r["program_id"]: (r["main_menu"], r["sub_menu"], r["tab"], r["depth"]) for r in lineage.menu_tree(frame(spark, "program_id string, program_nm string, url string, parent_id string", data)).collect()}
    assert got["5"] == ("A", "B", "C", 5) and got["6"] == ("A", "F", "", 2) and got["7"] == ("G", "", "", 1) and got["8"] == ("H", "", "", 1) and got["x"][3] == 20


def test_implementations(spark):
    c = [("a.OrderService", "OrderService", True, []), ("b.OrderServiceImpl", "OrderServiceImpl", False, ["OrderService<T>"]), ("a.PayService", "PayService", True, []), ("b.PayServiceBo", "PayServiceBo", False, []), ("a.ItemBo", "ItemBo", True, []), ("b.ItemImpl", "ItemImpl", False, [])]
    got = {r["interface"]: (r["implementation"], r["way"]) for r in lineage.implementations(frame(spark, "fqcn string, class_name string, is_interface boolean, implements array<string>", c)).collect()}
    assert got["a.OrderService"] == ("b.OrderServiceImpl", 1) and got["a.PayService"] == ("b.PayServiceBo", 2) and got["a.ItemBo"] == ("b.ItemImpl", 3)


def test_services_first_definition_and_attribute_order(spark):
    f = [("b.xml", '<service serviceClass="x.B" id="one" method="go"/>'), ("a.xml", "<service id='one' serviceClass='x.A'><service id='two'/>"), ("c.xml", "<bean/>")]
    assert rows(lineage.services(frame(spark, "path string, content string", f))) == [("one", "x.A", "", "a.xml")]


def test_votes_and_routes(spark):
    f = frame(spark, "path string, content string", [("a", "@Controller"), ("b", "@Controller"), ("c", "@Controller io.vertx"), ("d", "x")])
    assert {r["framework"]: (r["votes"], r["wins"]) for r in lineage.framework_votes(f, {"spring": "@Controller", "vertx": r"io\.vertx"}).collect()} == {"spring": (3, True), "vertx": (1, False)}
    u, r = frame(spark, "url string", [("/apps/foo/list",), ("/apps/foo-bar/x",), ("/none",)]), frame(spark, "route string", [("/apps/foo",), ("/apps",), ("/",), ("/apps/foo-bar",)])
    assert rows(lineage.longest_route(u, r)) == [("/apps/foo-bar/x", "/apps/foo-bar"), ("/apps/foo/list", "/apps/foo")]


# ---- vectors


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_against_brute_force(spark, metric):
    rng = np.random.default_rng(0)
    v = np.vstack([rng.normal(size=(60, 5)), np.zeros((1, 5)), np.tile(rng.normal(size=5), (4, 1))])
    df = frame(spark, "vec_id bigint, embedding array<double>", [(i, list(map(float, x))) for i, x in enumerate(v)] + [(900, None), (901, [])]).repartition(5)
    got = defaultdict(list)
    for r in vectors.nearest(df, df.filter("vec_id % 20 = 0 or vec_id = 62"), k=4, block=2, metric=metric).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for q in (0, 20, 40, 60, 62):
        d = []
        for i, x in enumerate(v):
            n = np.linalg.norm(x) * np.linalg.norm(v[q])
            dist = ((x - v[q]) ** 2).sum() if metric == "l2" else (1 - x @ v[q] / n if n else None)
            if i != q and dist is not None:
                d.append((round(dist, 12), i))
        assert got[q] == [i for _, i in sorted(d)[:4]]


def test_embedding_survives_a_bad_batch(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    df = frame(spark, "id string, text string", [("1", "a"), ("2", "bad"), ("3", "ccc")])
    assert {r["id"]: r["embedding"] for r in vectors.embedded(df, embed, batch=1).collect()} == {"1": [1.0], "2": None, "3": [3.0]}


# ---- mappers and migration


def test_ibatis_translation_is_idempotent():
    root = mapper.parse('<sqlMap><select id="s">A <iterate property="l" conjunction="," open="(" close=")">#l[]#</iterate> <isEqual property="a" compareValue="1" prepend="AND">x</isEqual></select></sqlMap>')
    assert mapper.to_mybatis(root) > 0 and mapper.to_mybatis(root) == 0
    assert [e.tag for e in root.iter()] == ["mapper", "select", "foreach", "if"] and root.find(".//if").get("test") == "a == 1"


def test_paths_are_capped_and_loops_doubled():
    root = mapper.parse('<mapper><select id="s">Q<choose>' + "".join(f'<when test="{i}">W{i}</when>' for i in range(20)) + '</choose><foreach collection="l" separator=",">#{x}</foreach></select></mapper>')
    e = root.find("select")
    assert len(mapper.paths(e, {})) == 10
    assert ("foreach[n=2]", "QW0#{x},#{x}") in [(a, b) for a, b, _ in mapper.paths(e, {}, most=50, level=3)]


def test_include_cycles_end():
    root = mapper.parse('<mapper><sql id="a">x<include refid="b"/></sql><sql id="b">y<include refid="a"/></sql><select id="s"><include refid="a"/></select></mapper>')
    assert mapper.statements_of("p", '<mapper><sql id="a">x<include refid="b"/></sql><sql id="b">y<include refid="a"/></sql><select id="s"><include refid="a"/></select></mapper>')[0][4] == "xy"
    assert mapper.paths(root.find("select"), mapper.fragments(root))[0][1] == "xy"


MAPPING_CASES = [
    (("ORDERS", "ORD_NO", None, "", "", None), ("ORDERS", "ORD_NO")), (("CUST", "CUST_NM", None, "CUSTOMER", "CUST_NAME", None), ("CUSTOMER", "CUST_NAME")), (("CUST", "REG_DT", None, None, None, None), ("CUSTOMER", "REG_DT")),
    (("CUST", "OLD_1", None, "CUSTOMER", "-", None), (None, None)), (("CUST", "OLD_2", None, "CUSTOMER", "drop", None), (None, None)), (("CUST", "OLD_3", None, "CUSTOMER", "삭제", None), (None, None)), (("LEGACY_T", "COL1", None, "", "NEW_COL", None), ("LEGACY_T", "NEW_COL")),
]


def test_flat_mapping(spark):
    m = migrate.flat_mapping(frame(spark, migrate.MAPPING, [a for a, _ in MAPPING_CASES] + [(None, "X", None, None, None, None), ("", "", None, None, None, None)]))
    got = {(r["as_is_table"], r["as_is_column"]): (r["to_be_table"], r["to_be_column"]) for r in m.collect()}
    assert got == {(a[0], a[1]): b for a, b in MAPPING_CASES}


def mapping(**more):
    base = {"as_is_table": "CUST", "to_be_table": "CUSTOMER", "kind": "rename", "read": None, "write": None, "where_": None, "value_map": None}
    return migrate.Mapping.of(
        [
            base | {"as_is_column": "CUST_NM", "to_be_column": "CUST_NAME"},
            base | {"as_is_column": "REG_DT", "to_be_column": "REG_DATE", "kind": "type_convert", "read": "R({src})", "write": "W({src})", "where_": "C({src})"},
            base | {"as_is_column": "USE_YN", "to_be_column": "USE_FLAG", "kind": "value_map", "value_map": {"Y": "1"}},
            base | {"as_is_column": "OLD", "to_be_column": None, "kind": "drop"},
            base | {"as_is_table": "OTHER", "to_be_table": "OTHER", "as_is_column": "CUST_NM", "to_be_column": "NM2"},
        ]
    )


@pytest.mark.parametrize(
    ("sql", "want", "status"),
    [
        ("SELECT c.CUST_NM FROM CUST c -- CUST", "SELECT c.CUST_NAME FROM CUSTOMER c -- CUST", "AUTO"),
        ("SELECT CUST.CUST_NM FROM own.CUST", "SELECT CUSTOMER.CUST_NAME FROM own.CUSTOMER", "AUTO"),
        ("SELECT REG_DT FROM CUST WHERE REG_DT > #{REG_DT}", "SELECT R(REG_DATE) FROM CUSTOMER WHERE C(REG_DATE) > #{REG_DT}", "AUTO"),
        ("UPDATE CUST SET REG_DT = :a, CUST_NM = 'CUST_NM'", "UPDATE CUSTOMER SET REG_DATE = W(:a), CUST_NAME = 'CUST_NM'", "AUTO"),
        ("SELECT 1 FROM CUST WHERE USE_YN IN ('Y', 'N')", "SELECT 1 FROM CUSTOMER WHERE USE_FLAG IN ('1', 'N')", "AUTO_WARN"),
        ("SELECT OLD FROM CUST", "SELECT OLD FROM CUSTOMER", "AUTO_WARN"),
        ("SELECT CUST_NM FROM CUST, OTHER", "SELECT CUST_NM FROM CUSTOMER, OTHER", "AUTO_WARN"),
        ("SELECT x FROM NONE", "SELECT x FROM NONE", "AUTO"),
        ("", "", "PARSE_FAIL"),
    ],
)
def test_rewrite(sql, want, status):
    got = migrate.rewrite(sql, mapping())
    assert (got["to_be_sql"], got["status"]) == (want, status)


XML = """<mapper namespace="n"><!-- CUST -->
  <select id="a" parameterType="CUST">SELECT c.CUST_NM, c.REG_DT FROM CUST c
    <where><if test="CUST_NM != null">AND c.CUST_NM = #{CUST_NM}</if> AND c.USE_YN &lt;&gt; 'Y' <![CDATA[ AND c.REG_DT < 5 ]]></where></select>
  <update id="b">UPDATE CUST <set><if test="x">CUST_NM = #{x},</if></set></update>
  <delete id="c">DELETE FROM ELSE_T WHERE CUST_NM = 1</delete><select id="d"></select></mapper>"""


def test_mapper_files_are_rewritten_in_place(spark):
    want = (
        XML.replace("SELECT c.CUST_NM, c.REG_DT FROM CUST c", "SELECT c.CUST_NAME, R(c.REG_DATE) FROM CUSTOMER c").replace("AND c.CUST_NM = #", "AND c.CUST_NAME = #").replace("c.USE_YN", "c.USE_FLAG")
        .replace("AND c.REG_DT <", "AND C(c.REG_DATE) <").replace("UPDATE CUST <", "UPDATE CUSTOMER <").replace(">CUST_NM = #{x}", ">CUST_NAME = #{x}")
    )
    got, n, _ = migrate.rewrite_mapper(XML, mapping())
    assert got == want and n > 6
    m = frame(spark, migrate.MAPPING, [("CUST", "CUST_NM", None, "CUSTOMER", "CUST_NAME", None)])
    m = migrate.mapping_kind(migrate.with_conversions(migrate.flat_mapping(m)).withColumn("value_map", F.lit(None).cast("map<string,string>")))
    out = {r["path"]: r for r in migrate.rewritten_files(frame(spark, "path string, content string", [("a", XML), ("b", None), ("c", "")]), m).collect()}
    assert "SELECT c.CUST_NAME, c.REG_DT FROM CUSTOMER c" in out["a"]["content"] and out["b"]["content"] is None and out["c"]["n_changes"] == 0


def test_both_ways_to_rewrite_agree(spark):
    m = frame(spark, migrate.MAPPING, [("CUST", "CUST_NM", None, "CUSTOMER", "CUST_NAME", None), ("CUST", "REG_DT", "VARCHAR2(8)", "CUSTOMER", "REG_DATE", "DATE")])
    m = migrate.mapping_kind(migrate.with_conversions(migrate.flat_mapping(m)).withColumn("value_map", F.lit(None).cast("map<string,string>")))
    s = frame(spark, "mapper string, id string, type string, sql string", [("m", "1", "select", "SELECT CUST_NM, REG_DT FROM CUST"), ("m", "1", "select", "SELECT CUST_NM, REG_DT FROM CUST"), ("m", "2", "select", None), ("m", "3", "x", "SELECT 1 FROM Z")])
    a, b = (rows(migrate.rewritten(s, m, most=n).select("mapper", "id", "to_be_sql", "status")) for n in (100, 1))
    assert a == b and len(a) == 4 and "TO_DATE(REG_DATE, 'YYYYMMDD')" in str(a)


# ---- sources


def test_catalog_views(spark):
    c = frame(spark, "constraint_name string, constraint_type string, r_constraint_name string", [("PK_A", "P", None), ("FK_B", "R", "PK_A")])
    m = frame(spark, "constraint_name string, table_name string, column_name string, position int", [("PK_A", "A", "X", 1), ("PK_A", "A", "Y", 2), ("FK_B", "B", "P", 1), ("FK_B", "B", "Q", 2)])
    assert rows(catalog.primary_keys(c, m)) == [("A", 1, "X"), ("A", 2, "Y")]
    assert rows(catalog.foreign_keys(c, m)) == [("B", "P", "A", "X", "FK_B"), ("B", "Q", "A", "Y", "FK_B")]
    i = catalog.indexes(frame(spark, "table_name string, index_name string, uniqueness string", [("A", "I", "UNIQUE")]), frame(spark, "table_name string, index_name string, column_name string, column_position int", [("A", "I", "Y", 2), ("A", "I", "X", 1)]))
    assert rows(i) == [("A", "I", ["X", "Y"], True)]
    types = [("VARCHAR2", 10, None, None, "VARCHAR2(10)"), ("NUMBER", 22, 9, 2, "NUMBER(9,2)"), ("NUMBER", 22, 9, 0, "NUMBER(9)"), ("NUMBER", 22, None, None, "NUMBER"), ("DATE", 7, None, None, "DATE"), ("FLOAT", 22, 126, None, "FLOAT(126)")]
    t = frame(spark, "t string, l int, p int, s int, w string", types)
    assert all(r[0] == r[1] for r in t.select(catalog.typed(F.col("t"), F.col("l"), F.col("p"), F.col("s")), "w").collect())


def test_markdown(spark):
    md = "# x\n## TB_A\n| Column | Type | Null | Default | Comment |\n|---|---|---|---|---|\n| ID | NUMBER(9) | N | | key |\n| NM | VARCHAR2(5) | Y | | name |\n## TB_B\n| ID | DATE | N | | |\n"
    got = [(r["table_name"], r["column_name"], r["data_type"], r["nullable"], r["comment"]) for r in catalog.markdown_columns(frame(spark, "path string, content string", [("s.md", md)])).orderBy("table_name", "pos").collect()]
    assert got == [("TB_A", "ID", "NUMBER(9)", "N", "key"), ("TB_A", "NM", "VARCHAR2(5)", "Y", "name"), ("TB_B", "ID", "DATE", "N", "")]
    assert rows(catalog.markdown_joins(frame(spark, "path string, content string", [("q.md", "| A.X <-> B.Y | LEFT JOIN |\n| no |")]))) == [("q.md", "A", "X", "B", "Y", "LEFT JOIN")]


def test_levels_fill_down_and_clear(spark):
    data = [("s", 1, "A", "B", "C"), ("s", 2, None, None, "D"), ("s", 3, None, "E", ""), ("s", 4, "F", None, None)]
    got = [(r["l1"], r["l2"], r["l3"]) for r in catalog.filled_levels(frame(spark, "sheet string, no int, l1 string, l2 string, l3 string", data), ["l1", "l2", "l3"], "no", "sheet").orderBy("no").collect()]
    assert got == [("A", "B", "C"), ("A", "B", "D"), ("A", "E", None), ("F", None, None)]


def test_files(spark, tmp_path):
    for name, data in {"a/m.xml": b"<mapper namespace='x'><select id='s'>SELECT 1</select></mapper>", "target/classes/m.xml": b"<mapper namespace='x'><select id='s'/></mapper>", "a/pom.xml": b"<project/>", "a/k.js": "한글".encode("euc-kr"), "node_modules/z.js": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert [r["id"] for r in mapper.statements(files.mapper_files(spark, str(tmp_path))).collect()] == ["s"]
    assert [r["content"] for r in files.script_files(spark, str(tmp_path)).collect()] == ["한글"]
    env = frame(spark, "path string, content string", [(".env", "# c\nexport A=1\nB=\"x y\" # z\n=bad\nC=\n")])
    assert rows(files.env_settings(env)) == [(".env", "A", "1"), (".env", "B", "x y"), (".env", "C", "")]
    assert rows(files.attribute_list(frame(spark, "value string, no int", [("﻿a", 1), ("b ", 2), ("a", 3), ("#c", 4), ("", 5)]))) == [("a", 1), ("b", 2)]


