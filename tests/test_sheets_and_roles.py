from quarrylane.operators import migrate, roles
from quarrylane.sources import java, sheets


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dictionary_sheet(spark):
    book = {
        "표지": [["표준 단어 사전"], ["v1"]],
        "단어": [["표준사전"], ["1. 논리명*", "물리명(영문)", "물리의미", "동의어", "표준여부"], ["고객", "CUST", "Customer", "손님", "Y"], ["", "", "", "", ""], ["번호", "NO", None, "", "N"], ["짧음"]],
    }
    got = rows(sheets.dictionary(spark, book, ["logical", "physical", "eng", "synonyms", "is_std"]))
    assert got == [("단어", 1, "고객", "CUST", "Customer", "손님", "Y"), ("단어", 3, "번호", "NO", None, None, "N"), ("단어", 4, "짧음", None, None, None, None)]
    assert sheets.dictionary(spark, {"x": [["a"]]}, ["logical"]).count() == 0 and sheets.dictionary(spark, {}, ["logical"]).count() == 0


def test_header_writings():
    assert [sheets.field_of(x) for x in ("논리명", "표준단어논리명*", "물리의미", "물리명", "도메인그룹", "도메인명", "데이터 유형", "길이", "소수점", None, "", "?")] == ["logical", "logical", "eng", "physical", "domain_group", "domain_name", "data_type", "data_length", "data_scale", None, None, None]


def menu(spark, text):
    return [(r["menu_path"], r["url"]) for r in sheets.menu(spark, sheets.markdown_rows(text)).orderBy("row_no").collect()]


def test_menu_layouts(spark):
    levels = "| 1레벨 | 2레벨 | 3레벨 | URL |\n|---|---|---|---|\n| 주문 | 조회 | | /a |\n| | 등록 | 상세 | /b |\n| | | 이력 | /c |\n| 설비 | | | |\n| | 관리 | | /d |\n| | | | /e |"
    assert menu(spark, levels) == [("주문 > 조회", "/a"), ("주문 > 등록 > 상세", "/b"), ("주문 > 등록 > 이력", "/c"), ("설비 > 관리", "/d"), ("(menu row 6)", "/e")]
    depth = "| 메뉴명 | depth | url |\n| 주문 | 1 | |\n| 조회 | 2 | /a |\n| 설비 | 1 | /b |"
    assert menu(spark, depth) == [("주문 > 조회", "/a"), ("설비", "/b")]
    assert menu(spark, "| 메뉴경로 | link |\n| A > B > C | /x |") == [("A > B > C", "/x")]
    assert menu(spark, "no table") == [] and menu(spark, "| a | b |\n| 1 | 2 |") == []


def test_mapping_documents(spark):
    md = "| asis_table | asis_column | tobe_table | tobe_column |\n|---|---|---|---|\n| CUST | CUST_NM | CUSTOMER | CUST_NAME |\n| CUST | REG_DT | | |\n| CUST | OLD | | - |"
    got = {(r["as_is_column"], r["to_be_table"], r["to_be_column"]) for r in migrate.flat_mapping(sheets.mapping_rows(spark, md)).collect()}
    assert got == {("CUST_NM", "CUSTOMER", "CUST_NAME"), ("REG_DT", "CUSTOMER", "REG_DT"), ("OLD", None, None)}
    assert sheets.mapping_rows(spark, "| x |\n| y |").count() == 0 and sheets.mapping_rows(spark, "").count() == 0


YAML = """
tables:
  - {type: rename, as_is: cust, to_be: customer}
  - {type: split, as_is: big, to_be: [a]}
columns:
  - {as_is: {table: cust, column: nm}, to_be: {table: customer, column: name}}
  - {as_is: {table: cust, column: dt}, to_be: {column: reg}, transform: {read: "R({src})"}}
  - {as_is: {table: cust, column: yn}, to_be: {column: flag}, value_map: {Y: 1}}
  - {as_is: {table: cust, column: old}, to_be: null}
  - {as_is: {table: cust}, to_be: null}
  - {as_is: {table: cust, column: z}}
  - {as_is: {table: cust, column: s}, to_be: [{column: a}]}
"""


def test_mapping_yaml_round_trip():
    got, wrong = sheets.load_mapping(YAML)
    assert [(r["as_is_column"], r["kind"], r["to_be_table"], r["to_be_column"]) for r in got] == [("NM", "rename", "CUSTOMER", "NAME"), ("DT", "type_convert", "CUSTOMER", "REG"), ("YN", "value_map", "CUSTOMER", "FLAG"), ("OLD", "drop", None, None)]
    assert len(wrong) == 4 and all(":" in w for w in wrong) and sheets.load_mapping("a: [")[1] and sheets.load_mapping("") == ([], [])
    assert sheets.load_mapping(sheets.dump_mapping(got)) == (got, [])
    assert migrate.rewrite("SELECT nm FROM cust WHERE yn = 'Y'", migrate.Mapping.of(got))["to_be_sql"] == "SELECT NAME FROM CUSTOMER WHERE FLAG = '1'"


CODE = [
    ("C.java", 'package c; import s.OrderService; @RestController @RequestMapping("/o") public class OrderController { @Autowired OrderService svc; @Autowired private OrderService svc2; @GetMapping("/list") public Object list() { return svc2.find(); } }'),
    ("S.java", 'package s; @Service public class OrderService { private final OrderDao dao; static final String F = "Z_FN"; public Object find() { dest.getFunction(F); repo.getRemoteFunction("Z_TWO"); return inner(); } Object inner() { return sqlSession.selectList("order.find"); } }'),
    ("M.java", "package m; public interface OrderRepository { }"),
]


def test_from_endpoint_to_table(spark):
    f = spark.createDataFrame(CODE, "path string, content string")
    c, m = java.classes(f).cache(), java.methods(f).cache()
    ns = spark.createDataFrame([("com.x.order",), ("m.OrderRepository",)], "namespace string")
    assert dict(rows(roles.class_roles(c, m, ns))) == {"c.OrderController": "controller", "s.OrderService": "service", "m.OrderRepository": "mapper"}
    assert {r["remote"] for r in roles.remote_calls(m, f).collect()} == {"Z_FN", "Z_TWO"}
    sql = m.selectExpr("concat(fqcn, '.', method) node", "explode(sql_ids) sql_id")
    crud = spark.createDataFrame([("com.x.order", "find", "TB_ORD", "R"), ("com.x.order", "find", "TB_ITEM", "R"), ("com.x.order", "put", "TB_ORD", "U")], "namespace string, id string, table_name string, crud string")
    e = spark.createDataFrame([("GET", "/o/list", "OrderController", "list", "c.OrderController.list")], "verb string, url string, class_name string, method string, node string")
    t = roles.endpoint_tables(e, java.resolved_calls(c, m), sql, crud)
    assert rows(t) == [("/o/list", "TB_ITEM", "R"), ("/o/list", "TB_ORD", "R")]
    menu_ = spark.createDataFrame([("/O/list/", "주문", "조회", "목록")], "url string, main_menu string, sub_menu string, program_name string")
    got = roles.program_rows(e, menu_, t, "shop").first()
    assert (got["backend"], got["program_name"], got["tables"], got["matched"]) == ("shop", "목록", "TB_ITEM(R), TB_ORD(R)", True)


def test_jobs_paths_and_labels(spark):
    x = '<bean id="a" class="x.JobDetailFactoryBean"><property name="jobClass" value="j.A"/></bean><bean class="x.MethodInvokingJobDetailFactoryBean"><property name="targetObject" ref="svc"/><property name="targetMethod" value="run"/></bean><job><job-class> j.B </job-class></job>'
    assert rows(roles.scheduled_jobs(spark.createDataFrame([("q.xml", x)], "path string, content string"))) == [("q.xml", "j.A", "execute", "quartz_job"), ("q.xml", "j.B", "execute", "quartz_job"), ("q.xml", "svc", "run", "quartz_method")]
    c = spark.createDataFrame([("a.A", "A", "B"), ("a.B", "B", "C"), ("a.C", "C", ""), ("a.D", "D", "D")], "fqcn string, class_name string, parent string")
    p = spark.createDataFrame([("a.C", "/c")], "fqcn string, class_path string")
    assert dict(rows(roles.inherited_paths(c, p))) == {"a.A": "/c", "a.B": "/c", "a.C": "/c", "a.D": ""}
    lines = spark.createDataFrame([("d.md", 1, "| CUST | Customer | 고객 |"), ("d.md", 2, "| cust | | 손님 |"), ("d.md", 3, "|---|---|---|")], "path string, no int, value string")
    assert rows(roles.label_words(lines)) == [("CUST", "고객")]
    assert rows(roles.project_roots(spark.createDataFrame([("p/a/pom.xml",), ("p/a/src/x.java",), ("q/package.json",)], "path string"))) == [("p/a", "pom.xml"), ("q", "package.json")]
    e = spark.createDataFrame([("/u", 2, "S", "M", "b"), ("/u", 1, "C", "S", "a")], "url string, at int, caller string, callee string, message string")
    assert roles.sequence_lines(e).first()["text"] == "sequenceDiagram\n  C->>S: a\n  S->>M: b"


def test_diagnostics(spark):
    calls = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "9")], "ns string, id string")
    m = spark.createDataFrame([("a", "x.a", True), ("c", "x.c", False)], "ns string, namespace string, ambiguous boolean")
    s = spark.createDataFrame([("x.a", "1")], "namespace string, id string")
    assert rows(roles.chain_diagnostics(calls, m, s)) == [(3, 1, 1, 1)]
