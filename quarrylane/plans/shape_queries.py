"""Queries over a generated statement corpus: every table of the catalog in every shape of statement (B, C, F, G).

A shape is a statement with places for two tables and two columns of each, beside what it uses. The statements are made from the
shapes' texts and read by the operators; the SQL is made from what the shapes are written to use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarrylane.operators import graph
from quarrylane.operators import migrate as mig
from quarrylane.operators import statements as st
from quarrylane.plans.tables import catalog_columns, literal
from quarrylane.session import cut


@dataclass(frozen=True)
class Shape:
    """A statement's text, with {t} {a} {b} for a table and two of its columns and {u} {c} {d} for the other's; the letters of
    each table, joined columns (left table, column, right table, column, type), column uses (table, column, letter), the main
    table, the tables behind a join, lint rules, procedures, and columns a schema can't vouch for (level, code, place)."""

    type: str
    sql: str
    crud: dict[str, str] = field(default_factory=dict)
    joins: tuple = ()
    columns: tuple = ()
    main: str | None = None
    joined: tuple = ()
    lint: tuple = ()
    calls: tuple = ()
    issues: tuple = ()


SHAPES = [
    Shape("select", "SELECT p.{a}, q.{c} FROM {t} p LEFT JOIN {u} q ON p.{a} = q.{c} WHERE p.{b} = #{{k}}", {"t": "R", "u": "R"}, (("t", "a", "u", "c", "LEFT JOIN"),), (("t", "a", "R"), ("u", "c", "R")), "t", ("u",)),
    Shape("select", "SELECT p.{b} FROM {t} p, {u} q WHERE p.{a} = q.{c}(+)", {"t": "R", "u": "R"}, (("t", "a", "u", "c", "LEFT OUTER JOIN (Oracle +)"),), (("t", "b", "R"),), "t", ("u",), ("CARTESIAN_JOIN",)),
    Shape("select", "SELECT q.{d} FROM {t} p, {u} q WHERE p.{b}(+) = q.{d}", {"t": "R", "u": "R"}, (("t", "b", "u", "d", "RIGHT OUTER JOIN (Oracle +)"),), (("u", "d", "R"),), "t", ("u",), ("CARTESIAN_JOIN",)),
    Shape("select", "WITH w AS (SELECT p.{a}, p.{b} FROM {t} p WHERE p.{b} > 0) SELECT w.{a} FROM w JOIN {u} q ON q.{c} = q.{d}", {"t": "R", "u": "R"}, (), (), None, ("u",)),
    Shape("select", "SELECT p.{a}, p.{b} FROM {t} p MINUS SELECT q.{c}, q.{d} FROM {u} q", {"t": "R", "u": "R"}, (("t", "a", "u", "c", "MINUS"), ("t", "b", "u", "d", "MINUS")), (("t", "a", "R"), ("t", "b", "R")), "t", ()),
    Shape("merge", "MERGE INTO {t} m USING {u} s ON (m.{a} = s.{d}) WHEN MATCHED THEN UPDATE SET m.{b} = s.{c} WHEN NOT MATCHED THEN INSERT (m.{a}, m.{b}) VALUES (s.{d}, s.{c})", {"t": "CU", "u": "R"},
          (("t", "a", "u", "d", "INNER JOIN"), ("t", "b", "u", "c", "INNER JOIN")), (("t", "a", "C"), ("t", "b", "C"), ("t", "b", "U")), None, ("u",)),
    Shape("merge", "MERGE INTO {t} m USING (SELECT q.{c} FROM {u} q) s ON (m.{a} = s.{c}) WHEN MATCHED THEN UPDATE SET m.{b} = 1", {"t": "U", "u": "R"}, (), (("t", "b", "U"),), None, ()),
    Shape("update", "UPDATE {t} SET {a} = (SELECT MAX(z.{c}) FROM {u} z WHERE z.{d} = 1) WHERE {b} = #{{k}}", {"t": "U", "u": "R"}, (), (("t", "a", "U"),), "t", ()),
    Shape("delete", "DELETE FROM {t} WHERE {a} NOT IN (SELECT z.{c} FROM {u} z)", {"t": "D", "u": "R"}, (), (), "t", (), ("NOT_IN",)),
    Shape("insert", "INSERT INTO {t} ({a}, {b}) SELECT p.{c}, p.{d} FROM {u} p INNER JOIN {u} q ON p.{c} = q.{d}", {"t": "C", "u": "R"}, (), (("t", "a", "C"), ("t", "b", "C"), ("u", "c", "R"), ("u", "d", "R")), "t", ("u",)),
    Shape("select", "SELECT {a} FROM {t} WHERE {b} LIKE '%x' FOR UPDATE", {"t": "R"}, (), (("t", "a", "R"),), "t", (), ("LIKE_LEADING_WILDCARD",)),
    Shape("select", "SELECT DISTINCT p.{a} FROM {t} p WHERE UPPER(p.{b}) = 'X' OR p.{a} = '12'", {"t": "R"}, (), (("t", "a", "R"),), "t", (), ("DISTINCT", "FUNCTION_ON_COLUMN", "OR_IN_WHERE", "IMPLICIT_CONVERSION")),
    Shape("select", "SELECT * FROM {t}", {"t": "R"}, main="t", lint=("SELECT_STAR",)),
    Shape("update", "UPDATE {t} SET {a} = 0", {"t": "U"}, (), (("t", "a", "U"),), "t", (), ("MISSING_WHERE",)),
    Shape("select", "SELECT (SELECT MAX(z.{c}) FROM {u} z) mx, p.{a} FROM {t} p WHERE p.{b} > 0 ORDER BY ROWNUM", {"t": "R", "u": "R"}, (), (("t", "a", "R"),), "t", (), ("SUBQUERY_IN_SELECT", "ORDER_BY_NO_INDEX")),
    Shape("select", "SELECT q.{c} FROM own.{t} p FULL JOIN {u} q ON q.{c} = p.{b} AND q.{c} <> 'NOT IN (' -- JOIN NONE", {"t": "R", "u": "R"}, (("u", "c", "t", "b", "FULL JOIN"),), (("u", "c", "R"),), "t", ("u",), ("NOT_IN",)),
    Shape("procedure", "{{CALL PKG_{t}.RUN(?)}}", calls=("PKG_{t}.RUN",)),
    Shape("procedure", "BEGIN pkg_{t}.step(1); COMMIT; END;", calls=("PKG_{t}.STEP",)),
    Shape("select", "SELECT p.{a}, x.{b}, NO_SUCH_1 FROM {t} p WHERE p.NO_SUCH_2 = 1", {"t": "R"}, (), (("t", "a", "R"), ("?", "b", "R"), ("t", "NO_SUCH_1", "R")), "t", (), (),
          (), (("warning", "UNRESOLVED_QUALIFIER", "X.{b}"), ("error", "UNKNOWN_COLUMN", "NO_SUCH_1"), ("error", "UNKNOWN_COLUMN", "{t}.NO_SUCH_2"))),
    Shape("select", "WITH w AS (SELECT p.{a} FROM {t} p) SELECT NO_SUCH_3 FROM w", {"t": "R"}, (), (), None, (), (), (), (("warning", "UNRESOLVED_COLUMN", "NO_SUCH_3"),)),
    Shape("select", "SELECT p.{a} FROM NO_TABLE n JOIN {t} p ON p.{a} = n.X", {"t": "R", "NO_TABLE": "R"}, (("t", "a", "NO_TABLE", "X", "INNER JOIN"),), (("t", "a", "R"),), "NO_TABLE", ("t",), (), (), (("error", "UNKNOWN_TABLE", "NO_TABLE"),)),
    Shape("select", "SELECT p.{a} FROM {t} p WHERE (p.{b} = 1", {"t": "R"}, (), (("t", "a", "R"),), "t", (), (), (), (("error", "PARSE_FAIL", "open parenthesis"),)),
]
#: A table that many others are joined with.
HUB = ("TB_CMN_CHGLOG", "CHG_ID1", "CHG_ID2")
NAME = "^[A-Z]+[0-9_][A-Z0-9_]*$"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, a, b, u, c, d: each table of the catalog with two of its columns, and the next one of its subject, or, of the last and
    of a third of the others by a hash, the hub."""
    own = catalog_columns(spark, sf_dir).filter(F.col("column_name").rlike(NAME) & (F.col("table_name") != HUB[0])).groupBy(F.col("table_name").alias("t")).agg(F.min("column_name").alias("a"), F.max("column_name").alias("b")).filter("a <> b")
    nxt = F.lead(F.struct("t", "a", "b")).over(W.Window.partitionBy(F.substring("t", 1, 7)).orderBy("t"))
    hub = F.struct(F.lit(HUB[0]).alias("t"), F.lit(HUB[1]).alias("a"), F.lit(HUB[2]).alias("b"))
    other = F.when(F.substring(F.md5("t"), 1, 1) < "5", hub).otherwise(F.coalesce(nxt, hub))
    return own.withColumn("o", other).select("t", "a", "b", F.col("o.t").alias("u"), F.col("o.a").alias("c"), F.col("o.b").alias("d"))


PAIRS = f"""
(SELECT t, a, b, CASE WHEN h OR n IS NULL THEN '{HUB[0]}' ELSE n.t END AS u, CASE WHEN h OR n IS NULL THEN '{HUB[1]}' ELSE n.a END AS c, CASE WHEN h OR n IS NULL THEN '{HUB[2]}' ELSE n.b END AS d
 FROM (SELECT *, substr(md5(t), 1, 1) < '5' AS h, lead({{'t': t, 'a': a, 'b': b}}) OVER (PARTITION BY substr(t, 1, 7) ORDER BY t) AS n
  FROM (SELECT table_name AS t, min(column_name) AS a, max(column_name) AS b FROM column_rec WHERE regexp_matches(column_name, '{NAME}') AND table_name <> '{HUB[0]}' GROUP BY 1 HAVING min(column_name) <> max(column_name))))"""


def filled(text: str):
    """text with the pair's names at their places, as a column."""
    out = F.lit(text.replace("{{", "\0").replace("}}", "\1"))
    for k in "tabucd":
        out = F.replace(out, F.lit("{" + k + "}"), F.col(k))
    return F.replace(F.replace(out, F.lit("\0"), F.lit("{")), F.lit("\1"), F.lit("}"))


def filled_sql(text: str) -> str:
    out = literal(text)
    for k in "tabucd":
        out = f"replace({out}, '{{{k}}}', {k})"
    return out


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mapper, id, type, sql: every pair in every shape."""
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s.type).alias("type"), filled(s.sql).alias("sql")) for n, s in enumerate(SHAPES)])
    # few rows with much work each: over all cores, which adaptive execution would not do by their size
    made = pairs(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "t").select("t", F.explode(each).alias("s"))
    return made.select(F.concat(F.lit("gen/"), F.substring("t", 4, 4)).alias("mapper"), F.concat_ws("_", "t", F.lpad(F.col("s.n").cast("string"), 2, "0")).alias("id"), "s.type", "s.sql")


def truth(rows: list[tuple[int, tuple]], names: list[str], where: str = "") -> str:
    """SQL of mapper, id and names from (shape, texts with places), for every pair."""
    cast = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else filled_sql(v)
    made = "\n  UNION ALL ".join(
        f"SELECT 'gen/' || substr(t, 4, 4) AS mapper, t || '_{n:02d}' AS id, " + ", ".join(f"{cast(v)} AS {k}" for k, v in zip(names, vs, strict=True)) + f" FROM pairs {where}" for n, vs in rows
    )
    return f"(WITH pairs AS MATERIALIZED (SELECT * FROM {PAIRS}) {made})"


def place(k: str) -> str:
    """A letter of a shape as its place; names stand for themselves, ? for the qualifier x that is no table."""
    return "X" if k == "?" else "{" + k + "}" if k in set("tabucd") else k


T_CRUD = truth([(n, (s.type, place(t), c, s.main is not None and t == s.main, t in s.joined and t != s.main)) for n, s in enumerate(SHAPES) for t, c in s.crud.items()], ["type", "table_name", "crud", "main", "joined"])
T_JOINS = truth([(n, (i, *map(place, j[:4]), j[4])) for n, s in enumerate(SHAPES) for i, j in enumerate(s.joins)], ["pos", "table1", "column1", "table2", "column2", "join_type"])


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.read(corpus(spark, sf_dir))


def b3_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each table of MERGE, WITH, MINUS, sub-queries, comma joins and the like."""
    return st.table_crud(mined(spark, sf_dir))


def b4_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.procedure_calls(mined(spark, sf_dir)).select("mapper", "id", "procedure_name")


B4 = f"SELECT mapper, id, procedure_name FROM {truth([(n, (c,)) for n, s in enumerate(SHAPES) for c in s.calls], ['procedure_name'])}"


def b5_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.column_usage(mined(spark, sf_dir))


B5 = f"SELECT DISTINCT mapper, id, table_name, column_name, op FROM {truth([(n, (*map(place, c[:2]), c[2])) for n, s in enumerate(SHAPES) for c in s.columns], ['table_name', 'column_name', 'op'])}"


def b7_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement's joined columns and join types."""
    return mined(spark, sf_dir).select("mapper", "id", F.explode("joins").alias("j")).select("mapper", "id", "j.*")


B7 = f"SELECT mapper, id, table1, column1, table2, column2, join_type FROM {T_JOINS}"


def b10_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.join_edges(mined(spark, sf_dir)).select("table1", "column1", "table2", "column2", "join_type", "n_sources")


B10 = f"""
WITH e AS (SELECT *, CASE WHEN (table1, column1) <= (table2, column2) THEN table1 || '.' || column1 || '=' || table2 || '.' || column2 ELSE table2 || '.' || column2 || '=' || table1 || '.' || column1 END AS k FROM {T_JOINS})
SELECT arg_min(table1, (mapper, id, pos)) AS table1, arg_min(column1, (mapper, id, pos)) AS column1, arg_min(table2, (mapper, id, pos)) AS table2, arg_min(column2, (mapper, id, pos)) AS column2,
  arg_min(join_type, (mapper, id, pos)) AS join_type, count(DISTINCT mapper || '#' || id) AS n_sources FROM e GROUP BY k"""


def b10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement of every edge, a row each."""
    return st.edge_sources(mined(spark, sf_dir))


B10S = f"""
SELECT DISTINCT least(table1 || '.' || column1, table2 || '.' || column2) AS side_a, greatest(table1 || '.' || column1, table2 || '.' || column2) AS side_b, mapper, id FROM {T_JOINS}"""


def b11_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table_usage(mined(spark, sf_dir))


KINDS = ("select", "insert", "update", "delete")
B11 = f"""
SELECT table_name, {', '.join(f"count(*) FILTER (type = '{k}') AS {k}_count" for k in KINDS)}, count(*) FILTER (main) AS as_main_count, count(*) FILTER (joined) AS as_join_count,
  count(DISTINCT mapper) AS n_mappers, count(*) AS n_statements FROM {T_CRUD} GROUP BY table_name"""


def b11_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table's mappers, and its statements as a list."""
    return st.usage_lists(mined(spark, sf_dir))


B11L = f"SELECT table_name, array_to_string(list_sort(list(DISTINCT mapper)), ',') AS mappers, mapper_first, n_statements FROM (SELECT *, min(mapper || '#' || id) OVER (PARTITION BY table_name) AS mapper_first, count(*) OVER (PARTITION BY table_name) AS n_statements FROM {T_CRUD}) GROUP BY ALL"


def f_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lint rule on statements that are written to break it, and on those that aren't."""
    return st.lint(corpus(spark, sf_dir)).select("mapper", "id", "rule", "severity")


SEVERITY = {r: v for r, v, _ in st.LINT_RULES} | {"MISSING_WHERE": "CRITICAL"}
FS = f"SELECT mapper, id, rule, severity FROM {truth([(n, (r, SEVERITY[r])) for n, s in enumerate(SHAPES) for r in s.lint], ['rule', 'severity'])}"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b10_shapes(spark, sf_dir).select(F.col("table1").alias("src"), F.col("table2").alias("dst"))


E = f"(SELECT table1 AS node, table2 AS other FROM {T_JOINS} UNION SELECT table2, table1 FROM {T_JOINS})"
LIMIT = 5


def c2_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that at least five others are joined with."""
    return graph.hubs(edges(spark, sf_dir), threshold=LIMIT)


C2 = f"SELECT node FROM {E} GROUP BY node HAVING count(*) >= {LIMIT}"


def c2_by_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that are nearly always used as joined ones."""
    m = mined(spark, sf_dir)
    usage = st.table_usage(m).select(F.col("table_name").alias("node"), F.col("as_main_count").alias("main"), F.col("as_join_count").alias("joined"))
    return graph.hubs(edges(spark, sf_dir), usage)


C2U = f"SELECT table_name AS node FROM ({B11}) WHERE as_join_count >= 3 AND as_join_count / (as_main_count + as_join_count) >= 0.8 AND table_name IN (SELECT node FROM {E})"


def c3_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of what is left without the hubs."""
    e = cut(edges(spark, sf_dir))
    return graph.components(e, without=graph.hubs(e, threshold=LIMIT))


LEFT = f"(SELECT node, other FROM {E} WHERE node NOT IN ({C2}) AND other NOT IN ({C2}))"
C3 = f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT node, other FROM {LEFT}),
r(node, root) USING KEY (node) AS (
  SELECT node, least(node, min(other)) FROM p GROUP BY node
  UNION SELECT p.node, min(r.root) FROM r JOIN p ON p.other = r.node JOIN recurring.r AS old ON old.node = p.node WHERE r.root < old.root GROUP BY p.node)
SELECT node, root AS component FROM r"""


def c5_hub_reattach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hubs that each component is joined with, and its joins with them and inside."""
    e = cut(b10_shapes(spark, sf_dir))
    pairs_ = e.select(F.col("table1").alias("src"), F.col("table2").alias("dst"))
    h = cut(graph.hubs(pairs_, threshold=LIMIT))
    members = graph.components(pairs_, without=h)
    hub = graph.attached_hubs(pairs_, members, h)
    inside = graph.group_joins(e, members, hub).groupBy("component").agg(F.count("*").alias("n_joins"))
    return hub.join(inside, "component").select("component", "node", "n_joins")


C5 = f"""
WITH m AS MATERIALIZED ({C3}), e AS MATERIALIZED ({B10}), h AS MATERIALIZED ({C2}),
a AS (SELECT DISTINCT m.component, x.other AS node FROM m JOIN {E} x ON x.node = m.node WHERE x.other IN (SELECT node FROM h)),
g AS (SELECT component, node FROM m UNION SELECT component, node FROM a),
j AS (SELECT l.component, count(*) AS n_joins FROM e JOIN g l ON l.node = e.table1 JOIN g r ON r.node = e.table2 AND r.component = l.component GROUP BY 1)
SELECT a.component, a.node, j.n_joins FROM a JOIN j USING (component)"""


def c14_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hubs reach in up to eight hops, without passing the common one."""
    e = graph.both_ways(edges(spark, sf_dir)).filter(f"node <> '{HUB[0]}' and other <> '{HUB[0]}' and node <> 'NO_TABLE' and other <> 'NO_TABLE'").toDF("src", "dst")
    starts = e.groupBy("src").count().filter("count >= 2").select(F.col("src").alias("node"))
    return graph.reachable(e, starts)


C14 = f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT node, other FROM {E} WHERE node NOT IN ('{HUB[0]}', 'NO_TABLE') AND other NOT IN ('{HUB[0]}', 'NO_TABLE')),
r(start, node, hops) AS (SELECT node, node, 0 FROM p GROUP BY node HAVING count(*) >= 2
  UNION SELECT r.start, p.other, hops + 1 FROM r JOIN p ON p.node = r.node WHERE hops < 8)
SELECT start, node, min(hops) AS hops FROM r GROUP BY ALL"""


def schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.col(t).alias("table_name"), F.col(c).alias("column_name")) for t, c in (("t", "a"), ("t", "b"), ("u", "c"), ("u", "d"))])).alias("s")
    return p.select(each).select("s.*").distinct()


def g14_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the statements name that their tables lack."""
    found = mig.static_issues(corpus(spark, sf_dir), schema(spark, sf_dir))
    return found.filter("code <> 'AMBIGUOUS_COLUMN'")


G14 = f"SELECT DISTINCT mapper, id, level, code, place FROM {truth([(n, i) for n, s in enumerate(SHAPES) for i in s.issues], ['level', 'code', 'place'])}"


def g14_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare columns that both tables of a statement have."""
    return mig.static_issues(corpus(spark, sf_dir), schema(spark, sf_dir)).filter("code = 'AMBIGUOUS_COLUMN'").select("mapper", "id", "place")


# the bare columns of an UPDATE with a sub-query and of a DELETE with one, and of an INSERT from a query
BARE = truth([(n, (c,)) for n, s in enumerate(SHAPES) for c in {7: ("{a}", "{b}"), 8: ("{a}",), 9: ("{a}", "{b}")}.get(n, ())], ["place"], "WHERE t <> u")
G14A = f"SELECT DISTINCT x.mapper, x.id, x.place FROM {BARE} x JOIN {PAIRS} p ON starts_with(x.id, p.t || '_') WHERE x.place IN (p.c, p.d)"

QUERIES = {f.__name__: f for f in (b3_shapes, b4_shapes, b5_shapes, b7_shapes, b10_shapes, b10_sources, b11_shapes, b11_lists, f_shapes, c2_hubs, c2_by_usage, c3_shapes, c5_hub_reattach, c14_reach, g14_shapes, g14_ambiguous)}
SQL = {
    "b3_shapes": f"SELECT mapper, id, table_name, crud FROM {T_CRUD}", "b4_shapes": B4, "b5_shapes": B5, "b7_shapes": B7, "b10_shapes": B10, "b10_sources": B10S, "b11_shapes": B11, "b11_lists": B11L, "f_shapes": FS,
    "c2_hubs": C2, "c2_by_usage": C2U, "c3_shapes": C3, "c5_hub_reattach": C5, "c14_reach": C14, "g14_shapes": G14, "g14_ambiguous": G14A,
}
