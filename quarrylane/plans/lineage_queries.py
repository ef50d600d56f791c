"""Queries of URLs, menus, calls and vectors (H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import endpoints, vectors
from quarrylane.operators import lineage as lin
from quarrylane.plans.tables import catalog_columns, values, values_sql
from quarrylane.session import table


def raw_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field_id, url: the screens' paths in the writings of different sources."""
    f = table(spark, sf_dir, "screen_field")
    url = (
        F.when(F.col("field_id") % 4 == 0, F.concat(F.lit("https://Host.example/"), "screen_file", F.lit("/:id")))
        .when(F.col("field_id") % 4 == 1, F.concat(F.lit("//"), "screen_file", F.lit("//{fieldNo}/")))
        .when(F.col("field_id") % 4 == 2, F.concat(F.upper("screen_file"), F.lit("/*/")))
        .otherwise(F.concat(F.lit("/"), "screen_file", F.lit("/**?App="), F.coalesce("component", F.lit("x"))))
    )
    return f.select("field_id", url.alias("url"))


RAW = """(SELECT field_id, CASE WHEN field_id % 4 = 0 THEN 'https://Host.example/' || screen_file || '/:id' WHEN field_id % 4 = 1 THEN '//' || screen_file || '//{fieldNo}/'
  WHEN field_id % 4 = 2 THEN upper(screen_file) || '/*/' ELSE '/' || screen_file || '/**?App=' || coalesce(component, 'x') END AS url FROM screen_field)"""
NORM = lambda c: rf"""regexp_replace(CASE WHEN starts_with(n, '/') THEN n ELSE '/' || n END, '(.)/$', '\1') FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  lower(trim({c})), '^https?://[^/]+', ''), '/+', '/', 'g'), '\{{[^}}]+\}}', '{{p}}', 'g'), ':\w+', '{{p}}', 'g'), '\*\*', '{{p}}', 'g'), '/\*(/|$)', '/{{p}}\1', 'g') AS n FROM """  # noqa: E731


def h1_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_urls(spark, sf_dir).select("field_id", lin.normalized_url(F.col("url")).alias("url_key"))


H1 = f"SELECT field_id, {NORM('url')}{RAW})".replace("FROM (SELECT *", "AS url_key FROM (SELECT *", 1)


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "screen_field").select(F.concat(F.lit("/"), "screen_file").alias("url")).distinct()


SCREENS = "(SELECT DISTINCT '/' || screen_file AS url FROM screen_field)"


def h15_menu_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of the screens as a menu, with the screens as its programs."""
    return lin.menu_tree(menu(spark, sf_dir))


def menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = screens(spark, sf_dir).select("url", F.posexplode(lin.prefixes(F.col("url"))).alias("level", "program_id"))
    parent = F.when(F.col("level") > 0, F.regexp_replace("program_id", "/[^/]*$", ""))
    rows = each.select("program_id", F.regexp_extract("program_id", "([^/]*)$", 1).alias("program_nm"), F.when(F.col("program_id") == F.col("url"), F.col("url")).alias("url"), parent.alias("parent_id"))
    return rows.groupBy("program_id", "program_nm", "parent_id").agg(F.max("url").alias("url"))


H15 = f"""SELECT url AS program_id, split_part(url, '/', -1) AS program_name, split_part(url, '/', 2) AS main_menu, split_part(url, '/', 3) AS sub_menu, split_part(url, '/', 4) AS tab, url, len(string_split(url, '/')) - 1 AS depth FROM {SCREENS}"""


def h16_first_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.first_by_url(raw_urls(spark, sf_dir), "field_id").select("url_key", "field_id")


H16 = f"SELECT url_key, min(field_id) AS field_id FROM ({H1}) GROUP BY url_key"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """screen, app, endpoint: each screen field's path and folder beside the endpoint of the same number."""
    f = table(spark, sf_dir, "screen_field").select("field_id", F.lower(F.concat(F.lit("/"), "screen_file")).alias("screen"))
    e = table(spark, sf_dir, "endpoint_spec").select(F.col("spec_id").alias("field_id"), F.concat(F.lit("/api/e"), "spec_id").alias("endpoint"))
    return f.join(e, "field_id").withColumn("app", F.split_part("screen", F.lit("/"), F.lit(4)))


def h17_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each endpoint's menu entry: its own path, what a screen's files call, the folder that calls it, or a folder's other name."""
    x = _links(spark, sf_dir)
    way = F.col("field_id") % 4
    menu_ = x.select(F.col("screen").alias("program_id"), F.col("screen").alias("url")).distinct()
    own = x.select(F.when(way == 0, F.col("screen")).otherwise(F.col("endpoint")).alias("url"))
    chain = x.filter(way == 1).select(F.col("screen").alias("menu_url"), F.col("endpoint").alias("url"))
    api = x.filter(way >= 2).select(F.when(way == 2, F.col("app")).otherwise(F.concat(F.lit("zz-"), "app")).alias("app"), F.col("endpoint").alias("url"))
    alias = x.select(F.col("app").alias("alias"), F.concat(F.lit("zz-"), "app").alias("app")).distinct()
    return endpoints.menu_matches(own, menu_, chain, api, alias, segment=3)


LINKS = "(SELECT field_id, lower('/' || screen_file) AS screen, '/api/e' || spec_id AS endpoint, split_part(lower('/' || screen_file), '/', 4) AS app FROM screen_field JOIN endpoint_spec ON spec_id = field_id)"
H17 = f"""
WITH x AS {LINKS}, m AS (SELECT app, min(screen) AS first FROM x WHERE app <> '' GROUP BY app)
SELECT DISTINCT screen AS url, screen AS program_id, 'url' AS way FROM x WHERE field_id % 4 = 0
UNION ALL SELECT endpoint, screen, 'import_chain' FROM x WHERE field_id % 4 = 1
UNION ALL SELECT endpoint, first, CASE field_id % 4 WHEN 2 THEN 'app' ELSE 'alias' END FROM x JOIN m USING (app) WHERE field_id % 4 >= 2"""


def h34_front_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The endpoints that screens call and no back end has: those of every third number are taken to be gone."""
    x = _links(spark, sf_dir)
    calls = endpoints.front_map(x.select(F.col("endpoint").alias("url"), "screen", F.lit("save").alias("trigger")), x.select(F.col("endpoint").alias("url"), F.col("app").alias("screen"), F.lit(None).cast("string").alias("trigger")))
    there = x.filter("field_id % 3 <> 0").select(F.col("endpoint").alias("url"))
    return endpoints.front_only(calls, there).select("url", "screens", "triggers", "program_name")


H34 = f"SELECT endpoint AS url, least(app, screen) || '; ' || greatest(app, screen) AS screens, screen || ': save' AS triggers, substr(endpoint, 2) AS program_name FROM {LINKS} WHERE field_id % 3 = 0"


def h18_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each screen with the folder of its component's endpoints, where there is one."""
    routes = table(spark, sf_dir, "endpoint_spec").select(F.concat(F.lit("/src/views/"), F.split_part("spec_key", F.lit("."), F.lit(2))).alias("route")).unionByName(values(spark, "route string", [("/src",)]))
    return lin.longest_route(screens(spark, sf_dir), routes)


H18 = f"""
WITH r AS (SELECT DISTINCT '/src/views/' || split_part(spec_key, '.', 2) AS route FROM endpoint_spec UNION SELECT '/src')
SELECT url, arg_max(route, length(route)) AS route FROM {SCREENS} JOIN r ON url = route OR starts_with(url, route || '/') GROUP BY url"""


def h19_app_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = raw_urls(spark, sf_dir)
    return u.select("field_id", lin.app_key(F.col("url"), segment=3).alias("by_segment"), lin.app_key(F.col("url"), parameter="app").alias("by_parameter"))


H19 = rf"""
WITH p AS (SELECT field_id, regexp_replace(trim(url), '^https?://[^/]+', '') AS path FROM {RAW})
SELECT field_id, lower(coalesce(list_filter(string_split(split_part(path, '?', 1), '/'), lambda x: x <> '')[3], '')) AS by_segment, lower(trim(regexp_extract(path, '(?i)[?&]\s*app\s*=([^&]*)', 1))) AS by_parameter FROM p"""


def h20_prefix_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the screens' paths have before the paths that endpoints are known by."""
    back = table(spark, sf_dir, "screen_field").select(F.regexp_replace("screen_file", "^src/views", "").alias("url"))
    return lin.prefix_votes(screens(spark, sf_dir), back)


H20 = f"""
WITH f AS {SCREENS}, b AS (SELECT DISTINCT regexp_replace(screen_file, '^src/views', '') AS url FROM screen_field),
k AS (SELECT unnest([1, 2]) AS k),
x AS (SELECT string_split(url, '/') AS p, 'f' AS side FROM f UNION ALL SELECT string_split(url, '/'), 'b' FROM b),
c AS (SELECT '/' || array_to_string(p[2:k + 1], '/') AS prefix, '/' || array_to_string(p[k + 2:], '/') AS rest, side FROM x, k WHERE len(p) > k + 1)
SELECT prefix, count(*) AS n FROM c WHERE (side = 'f' AND rest IN (SELECT url FROM b)) OR (side = 'b' AND rest IN (SELECT url FROM f)) GROUP BY prefix"""


def h21_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.exploded(table(spark, sf_dir, "screen_field").select("field_id", "event_names"), "event_names", "/")


H21 = "SELECT field_id, CASE WHEN len(e) > 0 THEN unnest(e) END AS event_names FROM (SELECT field_id, list_filter(list_transform(string_split(event_names, '/'), lambda x: trim(x)), lambda x: x <> '') AS e FROM screen_field WHERE trim(coalesce(event_names, '')) NOT IN ('', '/')) UNION ALL SELECT field_id, NULL FROM screen_field WHERE trim(coalesce(event_names, '')) IN ('', '/')"


def h22_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in order with their orders, or alone."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return lin.in_menu_order(c, o, "c_custkey", "c_name")


H22 = "SELECT c_custkey, c_name, o_orderkey, o_orderkey IS NULL AS placeholder FROM customer LEFT JOIN orders ON o_custkey = c_custkey"


def h24_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table names that only the catalog or only the endpoints have."""
    left = catalog_columns(spark, sf_dir).select("table_name")
    right = table(spark, sf_dir, "endpoint_spec").select(F.explode(F.regexp_extract_all("read_targets", F.lit(r"(TB_\w+)\."), F.lit(1))).alias("table_name"))
    return lin.orphans(left, right, "table_name")


H24 = r"""
WITH l AS (SELECT DISTINCT table_name FROM column_rec), r AS (SELECT DISTINCT unnest(regexp_extract_all(read_targets, '(TB_\w+)\.', 1)) AS table_name FROM endpoint_spec)
SELECT table_name, 'left' AS side FROM l WHERE table_name NOT IN (SELECT table_name FROM r) UNION ALL SELECT table_name, 'right' FROM r WHERE table_name NOT IN (SELECT table_name FROM l)"""


def h36_body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with one body, by hash."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", lin.body_hash(F.col("text")).alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


H36 = r"""
SELECT sha256('v1|' || trim(regexp_replace(regexp_replace(regexp_replace(text, '//[^\n]*', '', 'g'), '/\*[\s\S]*?\*/', '', 'g'), '\s+', ' ', 'g'))) AS hash, count(*) AS n, min(doc_id) AS first_doc
FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""

NS = [("order",), ("com.x.order",), ("a.b.c.item",), ("nothing",), ("pay",), ("com.x.user",)]
NAMESPACES = [("com.x.order",), ("com.long.x.pay",), ("x.pay",), ("item",), ("c.item",), ("com.x.user",)]


def h11_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.namespace_matches(values(spark, "ns string", NS), values(spark, "namespace string", NAMESPACES))


H11 = f"""
WITH c AS {values_sql('ns string', NS)}, x AS {values_sql('namespace string', NAMESPACES)},
m AS (SELECT ns, namespace, CASE WHEN ns = namespace THEN 0 WHEN ends_with(namespace, '.' || ns) THEN 1 ELSE 2 END AS way FROM c JOIN x ON ns = namespace OR ends_with(namespace, '.' || ns) OR ends_with(ns, '.' || namespace))
SELECT ns, namespace, way, count(*) FILTER (way = 1) OVER (PARTITION BY ns) > 1 AS ambiguous FROM m QUALIFY row_number() OVER (PARTITION BY ns ORDER BY way, length(namespace) DESC, namespace) = 1"""

CALLS = [("A.a", "A.b"), ("A.b", "S.c"), ("S.c", "S.d"), ("S.d", "M.q"), ("M.q", "A.a"), ("M.q", "X.y"), ("X.y", "Y.z"), ("Y.z", "Z.z")]


def h12_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.call_chain(values(spark, "node string", [("A.a",), ("X.y",)]), values(spark, "src string, dst string", CALLS), depth=3)


H12 = f"""
WITH RECURSIVE e AS {values_sql('src string, dst string', CALLS)},
r(start, node, depth, n) AS (SELECT s, s, 0, 0 FROM (VALUES ('A.a'), ('X.y')) t(s)
  UNION SELECT start, dst, depth + CASE WHEN split_part(src, '.', 1) = split_part(dst, '.', 1) THEN 0 ELSE 1 END, n + 1 FROM r JOIN e ON src = node WHERE n < 20
    AND depth + CASE WHEN split_part(src, '.', 1) = split_part(dst, '.', 1) THEN 0 ELSE 1 END <= 3)
SELECT start, node, min(depth) AS depth FROM r GROUP BY ALL"""

PAGES = [
    ("a.jsp", '<form action="/order/save.do"><input type="submit" value="저장"/></form><script>function f(){$.post("/api/item/list", {});}</script><a href="/stock/{id}">x</a><a href="#top">t</a>'),
    ("b.jsp", "<!-- <form action='/dead.do'> --><button onclick=\"location.href='${ctx}/main/view.do?x=1'\">go</button><script>httpSend(\"fabList\", p); fetch('/api//v1/users/:id');</script><link href='/css/a.css'>"),
    ("c.jsp", "<script>var o={url : '/svc/run'}; x.open('POST', '/raw/post'); axios.get(\"/ax/one\"); window.open('help.html');</script>"),
]
PAGE_ROWS = [
    ("a.jsp", "/order/save.do"), ("a.jsp", "/api/item/list"), ("a.jsp", "/stock/{p}"), ("b.jsp", "/main/view.do?x=1"), ("b.jsp", "/fablist"), ("b.jsp", "/api/v1/users/{p}"),
    ("c.jsp", "/svc/run"), ("c.jsp", "/raw/post"), ("c.jsp", "/ax/one"),
]


def h30_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.page_urls(values(spark, "path string, content string", PAGES))


GRID = [("g1.jsx", "{headerName: '주문번호', field: 'ordNo'}, {field: \"qty\", headerName: \"수량\"}"), ("g2.jsx", "cols=[{ field:'ordNo', width: 10, headerName:'주문번호' }]" + " " * 300 + "headerName: '멀리'")]


def h32_grid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lin.grid_labels(values(spark, "path string, content string", GRID))


def i1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.schema_chunks(catalog_columns(spark, sf_dir))


I1 = """
WITH o AS (SELECT table_name, column_name, min(col_no) AS col_no FROM column_rec GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY col_no, column_name) AS r FROM o)
SELECT table_name, CAST(floor((r - 1) / 30) AS BIGINT) AS chunk, count(*) AS n_columns, table_name || ': ' || string_agg(column_name, ', ' ORDER BY r) AS text FROM n GROUP BY 1, 2"""


def i4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, e.filter("vec_id % 20 = 0")).select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("distance", 5).alias("distance"))


I4 = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(q.v, e.v) AS distance FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS rank, round(distance, 5) AS distance FROM d WHERE NOT isnan(distance) QUALIFY rank <= 5"""

QUERIES = {
    f.__name__: f
    for f in (h1_url, h11_namespace, h12_chain, h15_menu_tree, h16_first_url, h17_menu, h34_front_only, h18_prefix, h19_app_key, h20_prefix_vote, h21_explode, h22_placeholder, h24_orphans, h30_page_links, h32_grid_labels, h36_body_hash, i1_chunks, i4_topk)
}
SQL = {
    "h1_url": H1, "h11_namespace": H11, "h12_chain": H12, "h15_menu_tree": H15, "h16_first_url": H16, "h17_menu": H17, "h34_front_only": H34, "h18_prefix": H18, "h19_app_key": H19, "h20_prefix_vote": H20, "h21_explode": H21, "h22_placeholder": H22,
    "h24_orphans": H24, "h30_page_links": f"SELECT * FROM {values_sql('path string, url string', PAGE_ROWS)}", "h36_body_hash": H36, "i1_chunks": I1, "i4_topk": I4,
    "h32_grid_labels": f"SELECT * FROM {values_sql('field string, label string, n int, n_files int', [('ordNo', '주문번호', 2, 2), ('qty', '수량', 1, 1)])}",
}
