import pytest

from quarrylane.operators import lineage
from quarrylane.sources import java

CONTROLLER = '''package a.b;
import a.svc.OrderService;
/* @GetMapping("/dead") */
@RestController
@RequestMapping({"/order", "/ord"})
public class OrderController extends Base implements Foo<Bar, Baz>, Qux {
  private static final String NS = "order.";
  @Autowired private OrderService svc;
  private final UserDao userDao;
  @GetMapping(value="/list", produces="x") public List<String> list(@RequestParam("a") String a) throws Exception { if (a == null) { return helper("}"); } return svc.find(a); }
  @RequestMapping(method = RequestMethod.POST)
  public void save() { sqlSession.insert(NS + (x ? "ins" : "upd"), p); sqlSession.insert(NS + "ins", p); userDao.selectOne("user.one"); new Thing(); }
  private String helper(String s) { return s; }
  static class Inner { void deep() { svc.find(1); } }
}'''
SERVICE = "package a.svc;\n@Service public class OrderService { String find(String a) { return dao.selectOne(\"order.find\"); } }"
VERTX = 'package v; @RestVerticle(url = "/v/one", isAuth = true) public class V extends AbstractVerticle { void start() { router.get("/v/list").handler(this::list); router.route().path("/v/any").method(HttpMethod.PUT).handler(x); map.get("key"); } }'
NEXCORE = "package n; public class N extends AbstractBizController { public Object getList(IDataSet ds, IBizServiceContext c) { return null; } public Object other(String s) { return null; } }"
JOB = "package j; public class T implements Tasklet { public void execute() {} }"
FILES = [("c.java", CONTROLLER), ("s.java", SERVICE), ("v.java", VERTX), ("n.java", NEXCORE), ("j.java", JOB), ("e.java", ""), ("z.java", None)]


@pytest.fixture(scope="module")
def parsed(spark):
    f = spark.createDataFrame(FILES, "path string, content string")
    return java.classes(f).cache(), java.methods(f).cache()


def test_classes(parsed):
    c = {r["fqcn"]: r for r in parsed[0].collect()}
    o = c["a.b.OrderController"]
    assert o["stereotypes"] == ["RestController"] and o["parent"] == "Base" and o["implements"] == ["Foo", "Qux"]
    assert {f["name"]: f["injected"] for f in o["fields"]} == {"NS": False, "svc": True, "userDao": True}
    assert "a.b.Inner" in c and c["a.svc.OrderService"]["stereotypes"] == ["Service"]


def test_endpoints(parsed):
    e = lineage.endpoints(parsed[1].filter("verb <> ''").withColumnRenamed("fqcn", "class_name"))
    got = {(r["verb"], r["url"]) for r in e.collect()}
    assert got == {("GET", "/order/list"), ("GET", "/ord/list"), ("POST", "/order"), ("POST", "/ord"), ("ANY", "/v/one"), ("GET", "/v/list"), ("PUT", "/v/any"), ("ANY", "/getlist.do")}


def test_calls_and_sql(parsed):
    m = {(r["fqcn"], r["method"]): r for r in parsed[1].collect()}
    assert m["a.b.OrderController", "save"]["sql_ids"] == ["order.ins", "user.one"]
    edges = {(r["src"], r["dst"]) for r in java.resolved_calls(*parsed).collect()}
    assert ("a.b.OrderController.list", "a.svc.OrderService.find") in edges and ("a.b.OrderController.list", "a.b.OrderController.helper") in edges


def test_jobs(parsed):
    assert [(r["fqcn"], r["job_kind"]) for r in java.job_entries(parsed[0]).collect()] == [("j.T", "tasklet")]


def test_texts():
    assert java.evaluated('"a." + NAME', {"NAME": '"z"'}) == ["a.z"]
    assert java.evaluated('f ? "a.b" : "c.d"', {}) == ["a.b", "c.d"]
    assert java.evaluated('"a." + unknown', {}) == [] and java.evaluated("A", {"A": "B", "B": "A"}) == []


def test_unbalanced_and_very_long():
    assert java.read("p", "class A { void f() { ").classes[0]["class_name"] == "A"
    assert len(java.read("p", "class A { " + "void f() { g(); } " * 2000 + "}").methods) == 2000
