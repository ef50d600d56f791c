"""Migration over a generated corpus (G): every table of the catalog in every kind of mapping, with what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import migrate as mig
from quarrylane.operators import statements as st
from quarrylane.plans.shape_queries import HUB, PAIRS, filled, filled_sql, pairs
from quarrylane.plans.tables import literal
from quarrylane.session import cut

#: Type, statement, what it becomes, status where the other table is mapped, changes (kind, as_is, to_be, transformer, n).
#: {t} {a} {b} {u} {c}: names as they are; {T} {A} {B} {U} {C}: what they become.
T_ = ("table", "{t}", "{T}", "table_rename", 1)
U_ = ("table", "{u}", "{U}", "table_rename", 1)
REWRITES = [
    ("select", "SELECT p.{a}, p.{b} FROM {t} p WHERE p.{b} > 1 -- {a}", "SELECT p.{A}, R(p.{B}) FROM {T} p WHERE C(p.{B}) > 1 -- {a}", "AUTO",
     [T_, ("column", "{t}.{a}", "{T}.{A}", "column_rename", 1), ("column", "{t}.{b}", "{T}.{B}", "column_rename", 2), ("type_wrap", "{t}.{b}", "R({src})", "type_conversion", 1), ("type_wrap", "{t}.{b}", "C({src})", "type_conversion", 1)]),
    ("update", "UPDATE {t} SET {b} = :x, {a} = 'K' WHERE {a} = '{a}'", "UPDATE {T} SET {B} = W(:x), {A} = 'K' WHERE {A} = '{a}'", "AUTO",
     [T_, ("column", "{t}.{a}", "{T}.{A}", "column_rename", 2), ("column", "{t}.{b}", "{T}.{B}", "column_rename", 1), ("type_wrap", "{t}.{b}", "W({src})", "type_conversion", 1)]),
    ("insert", "INSERT INTO {t} ({a}, {b}) VALUES (1, NVL(#{{y}}, 2))", "INSERT INTO {T} ({A}, {B}) VALUES (1, W(NVL(#{{y}}, 2)))", "AUTO",
     [T_, ("column", "{t}.{a}", "{T}.{A}", "column_rename", 1), ("column", "{t}.{b}", "{T}.{B}", "column_rename", 1), ("type_wrap", "{t}.{b}", "W({src})", "type_conversion", 1)]),
    ("merge", "MERGE INTO {t} m USING {u} s ON (m.{a} = s.{c}) WHEN MATCHED THEN UPDATE SET m.{b} = s.{c} WHEN NOT MATCHED THEN INSERT (m.{a}, m.{b}) VALUES (s.{c}, s.{c})",
     "MERGE INTO {T} m USING {U} s ON (m.{A} = s.{C}) WHEN MATCHED THEN UPDATE SET m.{B} = W(s.{C}) WHEN NOT MATCHED THEN INSERT (m.{A}, m.{B}) VALUES (s.{C}, W(s.{C}))", "AUTO",
     [T_, U_, ("column", "{t}.{a}", "{T}.{A}", "column_rename", 2), ("column", "{t}.{b}", "{T}.{B}", "column_rename", 2), ("column", "{u}.{c}", "{U}.{C}", "column_rename", 4), ("type_wrap", "{t}.{b}", "W({src})", "type_conversion", 2)]),
    ("insert", "INSERT INTO {t} ({b}) SELECT s.{c} FROM {u} s", "INSERT INTO {T} ({B}) SELECT s.{C} FROM {U} s", "AUTO_WARN",
     [T_, U_, ("column", "{t}.{b}", "{T}.{B}", "column_rename", 1), ("column", "{u}.{c}", "{U}.{C}", "column_rename", 1)]),
    ("select", "SELECT p.ADDR FROM {t} p", "SELECT p.ADDR1 || p.ADDR2 FROM {T} p", "AUTO", [T_, ("column", "{t}.ADDR", "{T}.ADDR1,{T}.ADDR2", "column_split", 1)]),
    ("select", "SELECT 1 FROM {t} p WHERE p.ADDR = 'x'", "SELECT 1 FROM {T} p WHERE p.ADDR = 'x'", "NEEDS_LLM", [T_]),
    ("select", "SELECT p.OLD_A FROM {t} p", "SELECT p.OLD_A FROM {T} p", "NEEDS_LLM", [T_]),
    ("select", "SELECT GONE FROM {t}", "SELECT GONE FROM {T}", "AUTO_WARN", [T_]),
    ("select", "SELECT TWICE FROM {t}", "SELECT TWICE FROM {T}", "NEEDS_LLM", [T_]),
    ("select", "SELECT 1 FROM {t} p WHERE p.FLAG IN ('Y', 'Z') AND p.{a} = 'FLAG'", "SELECT 1 FROM {T} p WHERE p.FLAG_N IN ('1', '9') AND p.{A} = 'FLAG'", "AUTO_WARN",
     [T_, ("column", "{t}.FLAG", "{T}.FLAG_N", "column_rename", 1), ("column", "{t}.{a}", "{T}.{A}", "column_rename", 1), ("value", "'Y'", "1", "value_mapping", 1), ("value", "'Z'", "9", "value_mapping", 1)]),
    ("select", "SELECT p.{a} FROM {t} p JOIN {u} q ON p.{a} = q.{c}", "SELECT p.{A} FROM {T} p JOIN {U} q ON p.{A} = q.{C}", "AUTO",
     [T_, U_, ("column", "{t}.{a}", "{T}.{A}", "column_rename", 2), ("column", "{u}.{c}", "{U}.{C}", "column_rename", 1)]),
]


def new_table(c):
    return F.when(F.col(c) == HUB[0], F.col(c)).otherwise(F.concat(F.lit("TN_"), F.substring(c, 4, 99)))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every table: two columns renamed, one of them converted, one split, two merged, one dropped, one mapped
    twice, one with mapped values; the hub is split into two tables."""
    p = pairs(spark, sf_dir).withColumn("n", new_table("t"))
    n = lambda t: F.lit(None).cast(t)

    def row(column, to, kind, read=None, write=None, where=None, values=None, targets=None, reverse=None, default=None, table="n"):
        s = lambda x: n("string") if x is None else F.lit(x)
        return F.struct(
            F.col("t").alias("as_is_table"), column.alias("as_is_column"), (F.col(table) if to is not None or kind == "split" else n("string")).alias("to_be_table"), (to if to is not None else n("string")).alias("to_be_column"), F.lit(kind).alias("kind"),
            s(read).alias("read"), s(write).alias("write"), s(where).alias("where_"), (values if values is not None else n("map<string,string>")).alias("value_map"), (targets if targets is not None else n("array<string>")).alias("targets"), s(reverse).alias("reverse"), s(default).alias("value_default"),
        )

    lit = F.lit
    rows = F.array(
        row(F.col("a"), F.concat("a", lit("_N")), "rename"), row(F.col("b"), F.concat("b", lit("_N")), "type_convert", "R({src})", "W({src})", "C({src})"),
        row(lit("ADDR"), None, "split", targets=F.array(F.concat("n", lit(".ADDR1")), F.concat("n", lit(".ADDR2"))), reverse="{ADDR1} || {addr2}"), row(lit("OLD_A"), lit("AB"), "merge"), row(lit("OLD_B"), lit("AB"), "merge"),
        row(lit("GONE"), None, "drop"), row(lit("TWICE"), lit("ONE"), "rename"), row(lit("TWICE"), lit("OTHER"), "rename"), row(lit("FLAG"), lit("FLAG_N"), "value_map", values=F.create_map(lit("Y"), lit("1")), default="9"),
    )
    own = p.select(F.explode(rows).alias("r")).select("r.*")
    hub = p.limit(1).select(F.lit(HUB[0]).alias("t"), F.explode(F.array(*[F.struct(lit(f"LOG_{x}").alias("n"), lit(c).alias("c")) for x, c in zip("AB", HUB[1:], strict=True)])).alias("h")).select("t", "h.n", "h.c")
    return mig.with_table_kinds(own.unionByName(hub.select(row(F.col("c"), F.col("c"), "rename").alias("r")).select("r.*")))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r[0]).alias("type"), filled(r[1]).alias("sql")) for n, r in enumerate(REWRITES)])
    made = pairs(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "t").select("t", F.explode(each).alias("s"))
    return made.select(F.concat(F.lit("gen/"), F.substring("t", 4, 4)).alias("mapper"), F.concat_ws("_", "t", F.lpad(F.col("s.n").cast("string"), 2, "0")).alias("id"), "s.type", "s.sql")


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.rewritten(statements(spark, sf_dir), cut(mapping(spark, sf_dir)))


def made_sql(text: str) -> str:
    """SQL of a text with the old and new names at their places."""
    new = {"T": "'TN_' || substr(t, 4)", "A": "a || '_N'", "B": "b || '_N'", "U": f"CASE WHEN u = '{HUB[0]}' THEN u ELSE 'TN_' || substr(u, 4) END", "C": f"CASE WHEN u = '{HUB[0]}' THEN c ELSE c || '_N' END"}
    out = filled_sql(text)
    for k, v in new.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return f"replace(replace({out}, '{{{{', '{{'), '}}}}', '}}')"


IS_HUB = f"u = '{HUB[0]}'"
G1 = f"WITH pairs AS MATERIALIZED (SELECT * FROM {PAIRS}) " + " UNION ALL ".join(
    f"SELECT 'gen/' || substr(t, 4, 4) AS mapper, t || '_{n:02d}' AS id, {made_sql(to)} AS to_be_sql, " + (f"CASE WHEN {IS_HUB} THEN 'NEEDS_LLM' ELSE '{status}' END" if "{u}" in sql else f"'{status}'") + " AS status FROM pairs"
    for n, (_, sql, to, status, _) in enumerate(REWRITES)
)
CHANGED = " UNION ALL ".join(
    f"SELECT {literal(k)} AS kind, {made_sql(a)} AS as_is, {made_sql(b)} AS to_be, '{f}' AS transformer, {c} AS n FROM pairs" + (f" WHERE NOT {IS_HUB}" if a.startswith("{u}") else "")
    for *_, changes in REWRITES for k, a, b, f, c in changes
)
G3 = f"WITH pairs AS MATERIALIZED (SELECT * FROM {PAIRS}) SELECT kind, as_is, to_be, transformer, sum(n) AS n FROM ({CHANGED}) GROUP BY ALL"


def g1_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of every kind rewritten: renamed, converted, split, merged, dropped, mapped twice and by value."""
    return rewritten(spark, sf_dir).select("mapper", "id", "to_be_sql", "status")


def g3_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.change_counts(rewritten(spark, sf_dir))


def g16_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which mapped tables each statement names."""
    hits = mig.statement_hits(st.read(statements(spark, sf_dir)), mapping(spark, sf_dir))
    return hits.filter("kind = 'table'").select("mapper", "id", "as_is_table", "to_be")


G16 = f"""WITH pairs AS MATERIALIZED (SELECT * FROM {PAIRS}) """ + " UNION ALL ".join(
    f"SELECT 'gen/' || substr(t, 4, 4) AS mapper, t || '_{n:02d}' AS id, {x} AS as_is_table, " + ("'TN_' || substr(t, 4)" if x == "t" else f"CASE WHEN {IS_HUB} THEN 'LOG_A' ELSE 'TN_' || substr(u, 4) END") + " AS to_be FROM pairs" + ("" if x == "t" else f" WHERE {IS_HUB} OR u IN (SELECT t FROM pairs)")
    for n, (_, sql, *_) in enumerate(REWRITES) for x in ("t", "u") if "{" + x + "}" in sql
)


def g19_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a mapping that has some of everything."""
    return mig.mapping_violations(mapping(spark, sf_dir))


G19 = f"""
WITH pairs AS MATERIALIZED (SELECT * FROM {PAIRS})
SELECT 'DUPLICATE_SOURCE' AS code, t || '.TWICE' AS place, '2' AS detail FROM pairs
UNION ALL SELECT 'DUPLICATE_TARGET', 'TN_' || substr(t, 4) || '.AB', '2' FROM pairs
UNION ALL SELECT 'SPLIT_TABLE', '{HUB[0]}', '2' WHERE EXISTS (FROM pairs)"""


def g21_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mapping row was used."""
    m = mapping(spark, sf_dir)
    return mig.coverage(m, g3_shapes(spark, sf_dir))


G21 = f"""
WITH pairs AS MATERIALIZED (SELECT * FROM {PAIRS}), h AS (SELECT as_is, sum(n) AS hits FROM ({CHANGED}) WHERE kind IN ('column', 'type_wrap') GROUP BY 1),
m AS (SELECT t AS as_is_table, unnest([{{'c': a, 'k': 'rename'}}, {{'c': b, 'k': 'type_convert'}}, {{'c': 'ADDR', 'k': 'split'}}, {{'c': 'OLD_A', 'k': 'merge'}}, {{'c': 'OLD_B', 'k': 'merge'}}, {{'c': 'GONE', 'k': 'drop'}}, {{'c': 'TWICE', 'k': 'rename'}}, {{'c': 'TWICE', 'k': 'rename'}}, {{'c': 'FLAG', 'k': 'value_map'}}]) AS x FROM pairs
  UNION ALL SELECT '{HUB[0]}', unnest([{{'c': '{HUB[1]}', 'k': 'rename'}}, {{'c': '{HUB[2]}', 'k': 'rename'}}]) WHERE EXISTS (FROM pairs))
SELECT as_is_table, x.c AS as_is_column, x.k AS kind, coalesce(hits, 0) AS hits, hits IS NULL AS unused FROM m LEFT JOIN h ON h.as_is = as_is_table || '.' || x.c"""


def g22_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.rates(rewritten(spark, sf_dir))


G22 = f"""
SELECT count(*) AS total, count(*) FILTER (status = 'AUTO') AS auto, count(*) FILTER (status = 'AUTO_WARN') AS auto_warn, count(*) FILTER (status = 'NEEDS_LLM') AS needs_llm, count(*) FILTER (status = 'PARSE_FAIL') AS parse_fail,
  round(count(*) FILTER (status IN ('AUTO', 'AUTO_WARN')) / count(*), 4) AS automation_rate FROM ({G1})"""

QUERIES = {f.__name__: f for f in (g1_shapes, g3_shapes, g16_hits, g19_violations, g21_coverage, g22_rates)}
SQL = {"g1_shapes": G1, "g3_shapes": G3, "g16_hits": G16, "g19_violations": G19, "g21_coverage": G21, "g22_rates": G22}
