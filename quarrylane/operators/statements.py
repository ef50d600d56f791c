"""Mining of SQL statement corpora (survey sections 2.2 and 2.7)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarrylane.operators import sqltext

# The lint rules: id, severity, pattern over the upper-case statement.
LINT_RULES = [
    ("SELECT_STAR", "MEDIUM", r"\bSELECT\s+\*\s+FROM\b"),
    ("NOT_IN", "HIGH", r"\bNOT\s+IN\s*\("),
    ("LIKE_LEADING_WILDCARD", "HIGH", r"LIKE\s+['\"]%"),
    ("FUNCTION_ON_COLUMN", "MEDIUM", r"WHERE[^=<>]*(?:UPPER|LOWER|SUBSTR|TRUNC|TO_CHAR|TO_DATE|NVL)\s*\(\s*\w+\.\w+"),
    ("CARTESIAN_JOIN", "HIGH", r"FROM\s+\w+(?:\s+\w+)?\s*,\s*\w+"),
    ("OR_IN_WHERE", "LOW", r"WHERE[^;]*\bOR\b[^;]*"),
    ("DISTINCT", "LOW", r"\bSELECT\s+DISTINCT\b"),
    ("IMPLICIT_CONVERSION", "MEDIUM", r"=\s*['\"]\d+['\"]|=\s*\d+\s+AND\s+\w+\s*=\s*['\"]"),
    ("ORDER_BY_NO_INDEX", "LOW", r"ORDER\s+BY[^;]*ROWNUM"),
    ("SUBQUERY_IN_SELECT", "MEDIUM", r"SELECT\s+[^,]*\(\s*SELECT\b"),
]
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

READ_SCHEMA = (
    "letters array<string>, main_table string, tables array<struct<name: string, crud: array<string>, joined: boolean>>, "
    "joins array<struct<table1: string, column1: string, table2: string, column2: string, join_type: string>>, "
    "columns array<struct<table_name: string, column_name: string, op: string>>, procedures array<string>"
)


def stripped(sql: Column) -> Column:
    """B1: sql without comments and string literals."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), r"'(?:''|[^'])*'", " ")


def cleaned(sql: Column) -> Column:
    """Sql without comments, placeholders ('?' instead), CDATA marks and left-over tags, with single blanks.

    '<' only opens a tag before a letter, '/', '!' or '?', so comparisons stay.
    """
    s = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"[#$]\{[^}]*\}", "?"), r"<!\[CDATA\[|\]\]>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[/!?A-Za-z][^>]*>", " "), r"\s+", " "))


def crud_letters(sql: Column) -> Column:
    """B2: the letters of the body's keywords, as text in the order C, R, U, D; FOR UPDATE is no update."""
    s = F.regexp_replace(F.upper(stripped(sql)), r"\bFOR\s+UPDATE\b", " ")
    return F.concat(*[F.when(s.rlike(rf"\b{w}\b"), c).otherwise("") for c, w in (("C", "INSERT"), ("R", "SELECT"), ("U", "UPDATE"), ("D", "DELETE"))])


def masked_binds(sql: Column) -> Column:
    """B15: '#{p,jdbcType=X}' becomes ':p', '${x}' becomes DUMMY_IDENT."""
    return F.regexp_replace(F.regexp_replace(sql, r"#\{\s*([\w.]+)[^}]*\}", ":$1"), r"\$\{[^}]*\}", "DUMMY_IDENT")


def placeholders(sql: Column) -> Column:
    """Sql with its placeholders as __MBP_n__, by order of distinct ones, and the list that undoes it."""
    found = F.array_distinct(F.regexp_extract_all(sql, F.lit(r"([#$]\{[^}]*\})"), F.lit(1)))
    masked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), sql, lambda s, i: F.when(i <= F.size(found), F.replace(s, F.element_at(found, i), F.concat(F.lit("__MBP_"), i - 1, F.lit("__")))).otherwise(s))
    return F.struct(masked.alias("sql"), found.alias("placeholders"))


def unmasked(sql: Column, found: Column) -> Column:
    """The inverse of placeholders."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))), sql, lambda s, i: F.when(i <= F.size(found), F.replace(s, F.concat(F.lit("__MBP_"), i - 1, F.lit("__")), F.element_at(found, i))).otherwise(s))


def read(statements: DataFrame) -> DataFrame:
    """mapper, id, type, sql and what each statement uses (READ_SCHEMA); every distinct text of a batch is read once.

    Null and empty statements use nothing.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str | None, tuple] = {}
            for q in b["sql"].unique():
                s = sqltext.read(q)
                crud = sqltext.table_crud(s)
                known[q] = (
                    s.letters, s.main, [{"name": t, "crud": crud[t], "joined": t in s.joined} for t in s.tables],
                    [dict(zip(("table1", "column1", "table2", "column2", "join_type"), j, strict=True)) for j in s.joins],
                    [dict(zip(("table_name", "column_name", "op"), c, strict=True)) for c in dict.fromkeys(s.columns)], sqltext.procedures(q),
                )
            names = ["letters", "main_table", "tables", "joins", "columns", "procedures"]
            yield pd.concat([b, pd.DataFrame([known[q] for q in b["sql"]], columns=names, index=b.index)], axis=1)

    return statements.select("mapper", "id", "type", "sql").mapInPandas(work, "mapper string, id string, type string, sql string, " + READ_SCHEMA)


def table_crud(read_: DataFrame) -> DataFrame:
    """Mapper, id, table_name, crud: each table of each statement with the letters of its role."""
    return read_.select("mapper", "id", F.explode("tables").alias("t")).select("mapper", "id", F.col("t.name").alias("table_name"), F.array_join("t.crud", "").alias("crud"))


def column_usage(read_: DataFrame) -> DataFrame:
    """Mapper, id, table_name, column_name, op."""
    return read_.select("mapper", "id", F.explode("columns").alias("c")).select("mapper", "id", "c.*")


def procedure_calls(read_: DataFrame) -> DataFrame:
    """Mapper, id, pos, procedure_name."""
    return read_.select("mapper", "id", F.posexplode("procedures").alias("pos", "procedure_name"))


def ordinal(statements: DataFrame) -> Column:
    """The statements' order, on which first ones depend: by mapper and id."""
    return F.struct("mapper", "id")


def _edge_sides(read_: DataFrame) -> DataFrame:
    each = read_.select("mapper", "id", F.posexplode("joins").alias("pos", "j")).select("mapper", "id", "pos", "j.*")
    a, b = (F.struct(F.col(f"table{k}").alias("t"), F.col(f"column{k}").alias("c")) for k in (1, 2))
    return each.withColumn("a", F.least(a, b)).withColumn("b", F.greatest(a, b))


def join_edges(read_: DataFrame, sources: int = 1000) -> DataFrame:
    """Each pair of joined columns once, whichever way round it was written.

    The first statement, by mapper, id and place, gives direction and join type. n_sources counts all statements,
    sources lists the first `sources` of them in order, which is for display: the list is cut before it is gathered.
    edge_sources has all of them.
    """
    keyed = _edge_sides(read_)
    first = keyed.groupBy("a", "b").agg(F.min_by(F.struct("table1", "column1", "table2", "column2", "join_type"), F.struct("mapper", "id", "pos")).alias("e"))
    who = keyed.select("a", "b", F.concat_ws("#", "mapper", "id").alias("source"), "mapper", "id").distinct()
    ranked = who.withColumn("r", F.row_number().over(W.Window.partitionBy("a", "b").orderBy("mapper", "id"))).filter(F.col("r") <= sources)
    listed = ranked.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "source"))), lambda x: x["source"]), ",").alias("sources"))
    counts = who.groupBy("a", "b").agg(F.count("*").alias("n_sources"))
    return first.join(counts, ["a", "b"]).join(listed, ["a", "b"]).select("e.*", "n_sources", "sources")


def edge_sources(read_: DataFrame) -> DataFrame:
    """side_a, side_b, mapper, id: every statement of every pair of joined columns, a row each; the sides in order."""
    side = lambda s: F.concat_ws(".", F.col(f"{s}.t"), F.col(f"{s}.c"))
    return _edge_sides(read_).select(F.least(side("a"), side("b")).alias("side_a"), F.greatest(side("a"), side("b")).alias("side_b"), "mapper", "id").distinct()


def table_usage(read_: DataFrame) -> DataFrame:
    """For each table the statements that use it by type, as main table, as joined table, and the mappers."""
    t = read_.select("mapper", "id", F.lower("type").alias("type"), "main_table", F.explode("tables").alias("t"))
    kinds = ("select", "insert", "update", "delete")
    return t.groupBy(F.col("t.name").alias("table_name")).agg(
        *[F.count(F.when(F.col("type") == k, 1)).alias(f"{k}_count") for k in kinds],
        F.count(F.when(F.col("t.name") == F.col("main_table"), 1)).alias("as_main_count"),
        F.count(F.when(F.col("t.joined") & (~F.col("main_table").eqNullSafe(F.col("t.name"))), 1)).alias("as_join_count"),
        F.count_distinct("mapper").alias("n_mappers"),
        F.count("*").alias("n_statements"),
    )


def usage_lists(read_: DataFrame) -> DataFrame:
    """table_name, mappers (each once, in order), mapper_first (the first statement) and n_statements. The statements
    themselves are rows of table_crud; a list of them would have no bound."""
    t = read_.select("mapper", "id", F.explode("tables.name").alias("table_name"))
    by_mapper = t.groupBy("table_name", "mapper").agg(F.count("*").alias("n"), F.min(F.concat_ws("#", "mapper", "id")).alias("first"))
    return by_mapper.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list("mapper")), ",").alias("mappers"), F.min("first").alias("mapper_first"), F.sum("n").alias("n_statements"))


def known_edges(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """The edges of which both tables are in tables (table_name)."""
    names = tables.select("table_name").distinct()
    left = edges.join(names.withColumnRenamed("table_name", "table1"), "table1", "left_semi")
    return left.join(names.withColumnRenamed("table_name", "table2"), "table2", "left_semi")


def crud_text(letters: Column) -> Column:
    """An array of letters as text in the order C, R, U, D."""
    return F.array_join(F.filter(F.array(*map(F.lit, "CRUD")), lambda x: F.array_contains(letters, x)), "")


def rolled_up(crud: DataFrame, by: list[str]) -> DataFrame:
    """The letters of each table over groups of statements; crud: ..., table_name, crud."""
    letters = crud.select(*by, "table_name", F.explode(F.split("crud", "")).alias("letter")).filter("letter <> ''")
    return letters.groupBy(*by, "table_name").agg(crud_text(F.collect_set("letter")).alias("crud"))


def merged_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """Several corpora as one, each statement with its source_dir."""
    out = None
    for name, df in corpora.items():
        one = df.withColumn("source_dir", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no corpus")
    return out


def merged_edges(merged: DataFrame) -> DataFrame:
    """The pairs of joined columns of several corpora (source_dir, and what read gives), each once, with the folders
    that have it and the number of its statements in each order of columns. All column pairs are kept."""
    sides = _edge_sides(merged.select(F.struct("source_dir", "mapper").alias("m"), "id", "joins").select(F.col("m.source_dir").alias("mapper"), F.concat_ws("#", "m.mapper", "id").alias("id"), "joins"))
    by_dir = sides.groupBy("a", "b", F.col("mapper").alias("dir")).agg(F.count_distinct("id").alias("n"), F.min_by(F.struct("table1", "column1", "table2", "column2", "join_type"), F.struct("id", "pos")).alias("e"))
    return by_dir.groupBy("a", "b").agg(F.min_by("e", "dir").alias("e"), F.array_join(F.array_sort(F.collect_list("dir")), ",").alias("source_dirs"), F.sum("n").alias("n_statements")).select("e.*", "source_dirs", "n_statements")


def merged_usage(merged: DataFrame) -> DataFrame:
    """table_name, as_main_count, as_join_count over all corpora, n_dirs."""
    t = merged.select("source_dir", "main_table", F.explode("tables").alias("t"))
    main = F.col("t.name").eqNullSafe(F.col("main_table"))
    return t.groupBy(F.col("t.name").alias("table_name")).agg(F.count(F.when(main, 1)).alias("as_main_count"), F.count(F.when(F.col("t.joined") & ~main, 1)).alias("as_join_count"), F.count_distinct("source_dir").alias("n_dirs"))


def corpus_totals(statements: DataFrame) -> DataFrame:
    """n_mappers, n_statements, and the statements of each type of a corpus."""
    kinds = ("select", "insert", "update", "delete", "procedure", "merge")
    return statements.agg(F.count_distinct("mapper").alias("n_mappers"), F.count("*").alias("n_statements"), *[F.count(F.when(F.lower("type") == k, 1)).alias(f"n_{k}") for k in kinds])


def statement_index(read_: DataFrame) -> DataFrame:
    """Key (namespace.id as mapper#id), tables, crud, procedures of each statement, for look-ups by key."""
    letters = F.array_join(F.filter(F.array(*map(F.lit, "CRUD")), lambda x: F.array_contains("letters", x)), "")
    return read_.select(F.concat_ws("#", "mapper", "id").alias("key"), F.array_join(F.array_sort("tables.name"), ",").alias("tables"), letters.alias("crud"), F.array_join("procedures", ",").alias("procedures"))


def lint(statements: DataFrame) -> DataFrame:
    """Mapper, id, type, rule, severity: each rule at most once a statement.

    The rules are tested in the scan, none is joined. MISSING_WHERE goes by the statement's type.
    """
    up = F.upper("sql")
    hits = [F.when(up.rlike("(?m)" + p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p in LINT_RULES]
    missing = F.when(F.upper("type").isin("UPDATE", "DELETE") & ~up.rlike(r"\bWHERE\b"), F.struct(F.lit("MISSING_WHERE").alias("rule"), F.lit("CRITICAL").alias("severity")))
    return statements.select("mapper", "id", "type", F.explode(F.array_compact(F.array(missing, *hits))).alias("f")).select("mapper", "id", "type", "f.*")


def lint_summary(findings: DataFrame) -> DataFrame:
    """Hits and statements of each rule."""
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("hits"), F.count_distinct("mapper").alias("mappers"))


def worst(findings: DataFrame, n: int = 20) -> DataFrame:
    """the n statements of the worst findings, by the highest severity, then the number of findings, mapper and id."""
    order = F.expr("array_position(array('CRITICAL','HIGH','MEDIUM','LOW'), severity)")
    return findings.groupBy("mapper", "id").agg(F.min(order).cast("int").alias("worst"), F.count("*").alias("n")).orderBy("worst", F.desc("n"), "mapper", "id").limit(n)
