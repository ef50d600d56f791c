"""Schema migration: mappings, rewriting, validation and impact (survey section 2.8)."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators import sqltext

# Marks that drop a column, conversions that are known by types, names that no schema holds.
DROP_MARKS = ("-", "DROP", "삭제")
CONVERSIONS = [
    ("VARCHAR2_8", "DATE", "TO_DATE({src}, 'YYYYMMDD')", "TO_DATE({src}, 'YYYYMMDD')", "TO_CHAR({src}, 'YYYYMMDD')"),
    ("CHAR_8", "DATE", "TO_DATE({src}, 'YYYYMMDD')", "TO_DATE({src}, 'YYYYMMDD')", "TO_CHAR({src}, 'YYYYMMDD')"),
    ("VARCHAR2_14", "TIMESTAMP", "TO_TIMESTAMP({src}, 'YYYYMMDDHH24MISS')", "TO_TIMESTAMP({src}, 'YYYYMMDDHH24MISS')", "TO_CHAR({src}, 'YYYYMMDDHH24MISS')"),
    ("DATE", "TIMESTAMP", "CAST({src} AS TIMESTAMP)", "CAST({src} AS TIMESTAMP)", "CAST({src} AS TIMESTAMP)"),
    ("VARCHAR2", "NUMBER", "TO_NUMBER({src})", "TO_CHAR({src})", "TO_CHAR({src})"),
    ("NUMBER", "VARCHAR2", "TO_CHAR({src})", "TO_NUMBER({src})", "TO_NUMBER({src})"),
]
PSEUDO_COLUMNS = frozenset("ROWNUM ROWID USER UID SYSDATE SYSTIMESTAMP LEVEL CURRVAL NEXTVAL COLUMN_VALUE SESSIONTIMEZONE DBTIMEZONE ORA_ROWSCN NULL TRUE FALSE".split())
#: Rows of a mapping, at most, that are handed to all executors.
MAPPING_ROWS = 200_000

MAPPING = "as_is_table string, as_is_column string, as_is_type string, to_be_table string, to_be_column string, to_be_type string"


def flat_mapping(rows: DataFrame) -> DataFrame:
    """Column mappings from a flat list (MAPPING, with blanks): a blank table is the table's new name in another row,
    else its own, a blank column its own name, and a drop mark drops (to_be_column null). Names in upper case; rows without
    table or column are left out."""
    up = {c: F.upper(F.trim(F.coalesce(c, F.lit("")))) for c in ("as_is_table", "as_is_column", "to_be_table", "to_be_column")}
    own = rows.select(*[v.alias(k) for k, v in up.items()], "as_is_type", "to_be_type").filter("as_is_table <> '' and as_is_column <> ''")
    drops = F.col("to_be_column").isin(*DROP_MARKS) | F.col("to_be_table").isin(*DROP_MARKS)
    renamed = own.filter((F.col("to_be_table") != "") & ~F.col("to_be_table").isin(*DROP_MARKS)).groupBy("as_is_table").agg(F.min("to_be_table").alias("new_table"))
    out = own.join(renamed, "as_is_table", "left")
    table = F.when(drops, None).when(F.col("to_be_table") != "", F.col("to_be_table")).otherwise(F.coalesce("new_table", "as_is_table"))
    column = F.when(drops, None).when(F.col("to_be_column") != "", F.col("to_be_column")).otherwise(F.col("as_is_column"))
    return out.select("as_is_table", "as_is_column", "as_is_type", table.alias("to_be_table"), column.alias("to_be_column"), "to_be_type")


def type_key(t: Column, with_length: bool) -> Column:
    base, n = F.upper(F.regexp_extract(F.trim(t), r"^([A-Za-z][A-Za-z0-9_]*)", 1)), F.regexp_extract(t, r"\(\s*(\d+)", 1)
    return F.when(n != "", F.concat(base, F.lit("_"), n)) if with_length else base


def conversions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONVERSIONS, "from_key string, to_key string, read string, write string, where_ string")


def with_conversions(mapping: DataFrame) -> DataFrame:
    """The mapping with the expressions that convert its types; a key with length goes before one without."""
    conv = F.broadcast(conversions(mapping.sparkSession))  # six rows
    keyed = mapping.withColumn("to_key", type_key(F.col("to_be_type"), False))
    for name, with_length in (("l", True), ("p", False)):
        c = conv.select(F.col("from_key").alias(f"{name}_key"), "to_key", F.struct("read", "write", "where_").alias(f"{name}_conv"))
        keyed = keyed.withColumn(f"{name}_key", type_key(F.col("as_is_type"), with_length)).join(c, [f"{name}_key", "to_key"], "left")
    best = F.coalesce("l_conv", "p_conv")
    return keyed.select(*mapping.columns, best["read"].alias("read"), best["write"].alias("write"), best["where_"].alias("where_"))


def mapping_kind(m: DataFrame) -> DataFrame:
    """The kind of each row: drop, then value_map, then type_convert, then rename. m has read, write, where_ and value_map."""
    some = F.coalesce("read", "write", "where_").isNotNull()
    valued = F.coalesce(F.size("value_map"), F.lit(-1)) > 0
    return m.withColumn("kind", F.when(F.col("to_be_column").isNull(), "drop").when(valued, "value_map").when(some, "type_convert").otherwise("rename"))


def mapping_violations(m: DataFrame) -> DataFrame:
    """Code, place, detail: what is wrong with a mapping, all of it at once."""
    where = F.concat_ws(".", "as_is_table", "as_is_column")
    twice = m.groupBy("as_is_table", "as_is_column").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("DUPLICATE_SOURCE").alias("code"), where.alias("place"), F.col("n").cast("string").alias("detail"))
    clash = m.filter("to_be_column is not null").groupBy("to_be_table", "to_be_column").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("DUPLICATE_TARGET").alias("code"), F.concat_ws(".", "to_be_table", "to_be_column").alias("place"), F.col("n").cast("string").alias("detail"))
    tables = m.filter("to_be_table is not null").groupBy("as_is_table").agg(F.count_distinct("to_be_table").alias("n")).filter("n > 1").select(F.lit("SPLIT_TABLE").alias("code"), F.col("as_is_table").alias("place"), F.col("n").cast("string").alias("detail"))
    bad = m.filter(~F.coalesce(F.col("to_be_column"), F.lit("X")).rlike("^[A-Z][A-Z0-9_$#]*$")).select(F.lit("BAD_NAME").alias("code"), where.alias("place"), F.col("to_be_column").alias("detail"))
    return twice.unionByName(clash).unionByName(tables).unionByName(bad)


def derived_schema(m: DataFrame) -> DataFrame:
    """table_name, column_name, data_type of the new schema; the first known type by name of the source."""
    live = m.filter("to_be_column is not null")
    typed = F.coalesce("to_be_type", "as_is_type")
    best = live.groupBy("to_be_table", "to_be_column").agg(F.min_by(typed, F.when(typed.isNotNull(), F.concat_ws(".", "as_is_table", "as_is_column"))).alias("data_type"))
    return best.select(F.col("to_be_table").alias("table_name"), F.col("to_be_column").alias("column_name"), "data_type")


def with_table_kinds(m: DataFrame) -> DataFrame:
    """m with table_kind: drop where a table has no new name, split where it has several, merge where its new name is that of
    several tables, rename otherwise. Counted over the whole mapping."""
    old = m.groupBy("as_is_table").agg(F.count_distinct("to_be_table").alias("targets"), F.min("to_be_table").alias("target"))
    new = m.filter("to_be_table is not null").groupBy(F.col("to_be_table").alias("target")).agg(F.count_distinct("as_is_table").alias("sources"))
    kind = F.when(F.col("targets") == 0, "drop").when(F.col("targets") > 1, "split").when(F.col("sources") > 1, "merge").otherwise("rename")
    kinds = old.join(new, "target", "left").select("as_is_table", kind.alias("table_kind"))
    return m.join(kinds, "as_is_table")


@dataclass
class Mapping:
    """A mapping ready for look-ups: tables to their new names (None: split or dropped) and kinds, columns to what becomes
    of them. Columns that several different rows map are in `twice`: what becomes of them is not known."""

    tables: dict[str, str | None] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    columns: dict[tuple[str, str], dict] = field(default_factory=dict)
    twice: set[tuple[str, str]] = field(default_factory=set)

    @classmethod
    def of(cls, rows: list[dict]) -> Mapping:
        """Rows: as_is_table, as_is_column, to_be_table, to_be_column, kind, read, write, where_, value_map; optional:
        table_kind, value_default, targets and reverse of a split."""
        out, targets = cls(), defaultdict(set)
        for r in rows:
            key = (r["as_is_table"], r["as_is_column"])
            if out.columns.setdefault(key, r) != r:
                out.twice.add(key)
            if r["to_be_table"]:
                targets[r["as_is_table"]].add(r["to_be_table"])
            if r.get("table_kind"):
                out.kinds[r["as_is_table"]] = r["table_kind"]
        for t in {r["as_is_table"] for r in rows}:
            kind = out.kinds.setdefault(t, ("drop", "rename", "split")[min(len(targets[t]), 2)])
            out.tables[t] = next(iter(targets[t])) if len(targets[t]) == 1 and kind != "drop" else None
        return out


@dataclass
class Place:
    """Where a statement names a column: its token, the text there, qualifier, column, table, and the clause. values is the
    expression that an INSERT list gives the column (first token, token behind the last), None where a query gives it."""

    at: int
    raw: str
    qualifier: str
    column: str
    table: str | None
    clause: str
    holders: list[str]
    listed: bool = False
    values: tuple[int, int] | None = None


class Text:
    """A statement's tokens with their texts as written."""

    def __init__(self, sql: str):
        self.sql = sql
        self.r = sqltext.Reader(sql)
        self.s = self.r.read()
        self.t = self.r.t

    def end(self, i: int) -> int:
        """Where the text of token i ends."""
        m = sqltext.TOKEN.match(self.sql, self.t[i].at)
        return m.end() if m else self.t[i].at + len(self.t[i].text)

    def raw(self, i: int) -> str:
        return self.sql[self.t[i].at : self.end(i)]

    def insert_lists(self) -> dict[int, tuple[str, tuple[int, int] | None]]:
        """Each column token of an INSERT's list: the table, and the tokens of the value at the same place."""
        r, out = self.r, {}
        merged = next((n for n, roles in self.s.tables.items() if "merge" in roles), "")
        for i in range(len(self.t)):
            if r.word(i) != "INSERT":
                continue
            into = r.word(i + 1) == "INTO"
            target, j = (sqltext.last(r.word(i + 2)), i + 3) if into else (merged, i + 1)
            if r.op(j) != "(" or r.word(j + 1) in ("SELECT", "WITH"):
                continue
            columns = [a for a, _ in self.items(j)]
            k = r.close(j) + 1
            values = self.items(k + 1) if r.word(k) == "VALUES" and r.op(k + 1) == "(" else []
            for n, c in enumerate(columns):
                out[c] = (target, values[n] if n < len(values) else None)
        return out

    def items(self, open_: int) -> list[tuple[int, int]]:
        """The items between the parenthesis at open_ and its end: first token, token behind the last."""
        out, start, depth, end = [], open_ + 1, 0, self.r.close(open_)
        for k in range(open_ + 1, end + 1):
            if k == end or depth == 0 and self.r.op(k) == ",":
                if k > start:
                    out.append((start, k))
                start = k + 1
            depth += (self.r.op(k) == "(") - (self.r.op(k) == ")")
        return out

    def scope(self, i: int) -> sqltext.Scope:
        while i >= 0:
            if i in self.r.scopes:
                return self.r.scopes[i]
            i -= 1
        return sqltext.Scope(0)

    def tables(self, known) -> list[tuple[int, str]]:
        """The tokens that name tables of known as tables, with the table."""
        return [(i, n) for i, n, _ in self.names(known) if n]

    def names(self, known):
        """Walks the tokens: (token, table or '', clause) of every word that is no keyword."""
        r, clause, by_depth, depth = self.r, "", {}, 0
        for i in range(len(self.t)):
            depth += (r.op(i) == "(") - (r.op(i) == ")")
            w = r.word(i)
            if w in ("SELECT", "FROM", "WHERE", "ON", "SET", "INTO", "VALUES", "HAVING", "GROUP", "ORDER", "UPDATE", "JOIN", "USING"):
                clause = by_depth[depth] = w
            elif r.op(i) == ")":
                clause = by_depth.get(depth, clause)
            if not w or w in sqltext.KEYWORDS or w.isdigit():
                continue
            name = sqltext.last(w)
            a_table = r.word(i - 1) in ("FROM", "JOIN", "INTO", "UPDATE", "USING") or r.op(i - 1) == "," and clause == "FROM"
            yield i, name if a_table and name in known and "(" not in self.raw(i) else "", clause

    def columns(self, m: Mapping) -> list[Place]:
        """The places of columns, with the table each belongs to: a bare column's is the only one of the statement that maps
        it."""
        out, lists = [], self.insert_lists()
        for i, table, clause in self.names(m.tables):
            if table or self.r.word(i - 1) == "AS":
                continue
            w = self.r.word(i)
            q, _, c = w.rpartition(".")
            q = sqltext.last(q)
            if self.r.op(i + 1) == "(" and not q:
                continue
            place = Place(i, self.raw(i), q, c, None, clause, [])
            if i in lists:
                place.table, place.values, place.listed = lists[i][0], lists[i][1], True
            elif q:
                place.table = self.scope(i).resolve(q)
            elif clause == "INTO":
                place.table = self.s.main
            else:
                place.holders = [x for x in self.s.tables if (x, c) in m.columns]
                place.table = place.holders[0] if len(place.holders) == 1 else None
            out.append(place)
        return out


class Rewriter:
    """One statement rewritten by a mapping."""

    def __init__(self, sql: str, m: Mapping):
        self.x, self.m = Text(sql), m
        self.changes: Counter = Counter()
        self.warnings: list[str] = []
        self.help = False
        self.edits: list[tuple[int, int, str]] = []

    def warn(self, text: str, help_: bool = False) -> None:
        self.help |= help_
        if text not in self.warnings:
            self.warnings.append(text)

    def put(self, i: int, text: str) -> None:
        """Token i becomes text."""
        at = self.x.t[i].at
        self.edits.append((at, self.x.end(i) - at, text))

    def wrap(self, span: tuple[int, int], form: str) -> None:
        """The tokens of span inside form."""
        before, _, after = form.partition("{src}")
        start, end = self.x.t[span[0]].at, self.x.end(span[1] - 1)
        self.edits.append((start, 0, before))
        self.edits.append((end, 0, after.replace("{src}", self.x.sql[start:end])))

    def run(self) -> None:
        m, s = self.m, self.x.s
        for t in (t for t in s.tables if t in m.tables):
            if m.kinds[t] != "rename":
                self.warn(f"table {t} is to {m.kinds[t]}", True)
        involved = sorted(t for t in s.tables if m.kinds.get(t) in ("split", "merge"))
        if involved and s.joined:
            self.warn(f"join with tables to split or merge: {', '.join(involved)}", True)
        for i, name in self.x.tables(m.tables):
            new = m.tables[name]
            if new and new != name:
                self.put(i, re.sub(r"\w+$", new, self.x.raw(i)))
                self.changes["table", name, new, "table_rename"] += 1
        for place in self.x.columns(m):
            if len(place.holders) > 1:
                self.warn(f"column {place.column} is ambiguous")
            elif place.table:
                self.column(place, m.columns.get((place.table, place.column)))

    def column(self, p: Place, row: dict | None) -> None:
        q = p.qualifier
        new_q = self.m.tables.get(q) or q if q == p.table else q
        name = f"{p.table}.{p.column}"
        if row is None:
            if q and new_q != q:
                self.put(p.at, re.sub(r"^(?:\w+\.)*\w+\.", new_q + ".", p.raw))
            return
        prefix = (p.raw[: p.raw.rfind(".") + 1] if new_q == q else f"{new_q}.") if q else ""
        kind = row["kind"]
        if (p.table, p.column) in self.m.twice:
            return self.warn(f"{name} is mapped more than once", True)
        if kind == "drop":
            return self.warn(f"{name} is dropped")
        if kind == "merge":
            return self.warn(f"{name} is merged with others; what it holds must be taken apart by hand", True)
        if kind == "split":
            return self.split(p, row, name, prefix)
        new = row["to_be_column"]
        text = prefix + new
        if new != p.column:
            self.changes["column", name, f"{row['to_be_table']}.{new}", "column_rename"] += 1
        if kind == "value_map":
            self.values(p, row, name)
        if kind == "type_convert":
            text = self.converted(p, row, name, text)
        self.put(p.at, text)

    def split(self, p: Place, row: dict, name: str, prefix: str) -> None:
        """A split column is put together again where it is selected, if the mapping says how."""
        targets, back = list(row.get("targets") if row.get("targets") is not None else []), row.get("reverse")
        if p.clause != "SELECT" or p.listed:
            return self.warn(f"{name} is split and used outside a projection", True)
        if not back:
            return self.warn(f"{name} is split, and nothing says how to put it together", True)
        text = back
        for t in targets:
            c = sqltext.last(t)
            text = re.sub(r"\{" + re.escape(c) + r"\}", lambda _, c=c: prefix + c, text, flags=re.I)
        self.put(p.at, text)
        self.changes["column", name, ",".join(targets).upper(), "column_split"] += 1

    def values(self, p: Place, row: dict, name: str) -> None:
        """Literals beside a column of mapped values."""
        for k in literals_beside(self.x.r, p.at):
            old = self.x.t[k].text[1:-1]
            new = (row["value_map"] or {}).get(old)
            if new is None:
                new = row.get("value_default")
                self.warn(f"{name}: value {old} has no mapping" + ("" if new is None else f", {new} is taken"))
            if new is not None:
                self.put(k, f"'{new}'")
                self.changes["value", f"'{old}'", new, "value_mapping"] += 1

    def converted(self, p: Place, row: dict, name: str, text: str) -> str:
        """A converted column's text; what is written to it is wrapped."""
        read = row["read"]
        form = {"SELECT": read, "WHERE": row["where_"] or read, "ON": row["where_"] or read, "HAVING": row["where_"] or read}.get(p.clause)
        span = None
        if p.listed:
            form, span = None, p.values
            if span is None and row["write"]:
                self.warn(f"{name}: inserted values must be converted")
        elif p.clause == "SET" and self.x.r.op(p.at + 1) == "=":
            form, span = None, value_behind(self.x.r, p.at + 2)
        if span and row["write"] and span[0] < span[1]:
            self.wrap(span, row["write"])
            self.changes["type_wrap", name, row["write"], "type_conversion"] += 1
        if form:
            self.changes["type_wrap", name, form, "type_conversion"] += 1
            return form.replace("{src}", text)
        return text


def rewrite(sql: str, m: Mapping, shown: str | None = None) -> dict:
    """G1 to G12 for one statement: to_be_sql, status, changes and warnings. `shown` is the text that is changed where sql is
    read; both have the same places (see rewrite_mapper).

    Only tokens are replaced, so that layout, comments, literals and placeholders stay. Names are looked up as they were.
    A bare column counts if just one table of the statement maps it. Values in comparisons and IN lists are mapped;
    converted columns are wrapped: by `write` what SET assigns and what INSERT's values give, by `where_` in conditions, by
    `read` in projections. Split columns are put together in projections where the mapping tells how. What else is
    split, merged or mapped twice, and joins of tables to split or merge, is left as it is and needs help.
    """
    if not sql or not sql.strip():
        return {"to_be_sql": sql, "status": "PARSE_FAIL", "changes": [], "warnings": ["empty statement"]}
    work = Rewriter(sql, m)
    work.run()
    out = sql if shown is None else shown
    for at, n, text in sorted(work.edits, key=lambda e: (e[0], e[1]), reverse=True):
        out = out[:at] + text + out[at + n :]
    return {
        "to_be_sql": out,
        "status": "NEEDS_LLM" if work.help else "AUTO_WARN" if work.warnings else "AUTO",
        "changes": [{"kind": k, "as_is": a, "to_be": b, "n": n, "transformer": f} for (k, a, b, f), n in sorted(work.changes.items())],
        "warnings": work.warnings,
    }


BODY = re.compile(r"(<(select|insert|update|delete|procedure|statement|sql)\b[^>]*>)(.*?)(</\2\s*>)", re.S | re.I)
NOT_SQL = re.compile(r"<!--.*?-->|<!\[CDATA\[|\]\]>|</?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|&\w+;", re.S)


def blanked(tag: re.Match) -> str:
    """As many blanks as a tag has characters; <where> and <set> leave their keyword."""
    blank = re.sub(r"[^\n]", " ", tag[0])
    word = re.match(r"<(where|set)\b", tag[0], re.I)
    return f" {word[1].upper()}" + blank[len(word[1]) + 1 :] if word else blank


def rewrite_mapper(content: str, m: Mapping) -> tuple[str, int, list[str]]:
    """A mapper file with its statements rewritten in place, the number of changes, and warnings.

    Each statement's text is read with its tags, comments and entities blanked, so that places stay, and changed where it
    stands: layout, tags and placeholders remain. Names are changed by the statement's own tables; a fragment that names no
    table stays as it is.
    """
    changes, warnings = 0, []

    def body(x: re.Match) -> str:
        nonlocal changes
        sql = NOT_SQL.sub(blanked, x[3])
        got = rewrite(sql, m, shown=x[3])
        changes += sum(c["n"] for c in got["changes"])
        warnings.extend(w for w in got["warnings"] if w != "empty statement")
        return x[1] + (x[3] if got["status"] == "PARSE_FAIL" else got["to_be_sql"]) + x[4]

    return BODY.sub(body, content), changes, warnings


def rewritten_files(files: DataFrame, mapping: DataFrame, most: int = MAPPING_ROWS) -> DataFrame:
    """Path, content, n_changes, warnings of mapper files (path, content). A mapping of up to `most` rows goes to all
    executors; of a larger one, the rows of the tables whose names stand in a file are joined to it. Both ways give the same
    result."""
    schema = "path string, content string, n_changes bigint, warnings array<string>"
    own = files.select("path", "content")

    def done(b: pd.DataFrame, got: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"path": b["path"], "content": [g[0] for g in got], "n_changes": [g[1] for g in got], "warnings": [g[2] for g in got]})

    if mapping.limit(most + 1).count() <= most:
        shared = files.sparkSession.sparkContext.broadcast([r.asDict() for r in mapping.collect()])

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Mapping.of(shared.value)
            for b in batches:
                yield done(b, [rewrite_mapper(c, m) if c else (c, 0, []) for c in b["content"]])

        return own.mapInPandas(work, schema)

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield done(b, [rewrite_mapper(c, Mapping.of(as_rows(rows))) if c else (c, 0, []) for c, rows in zip(b["content"], b["rows"], strict=True)])

    words = own.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("content"), F.lit(r"(\w+)"), F.lit(1)))).alias("as_is_table"))
    relevant = words.join(mapping, "as_is_table").groupBy("path").agg(F.collect_set(F.struct(*mapping_columns(mapping))).alias("rows")).withColumnRenamed("path", "file")
    whole = own.join(relevant, F.col("path").eqNullSafe(F.col("file")), "left").select("path", "content", F.coalesce("rows", F.array().cast(relevant.schema["rows"].dataType)).alias("rows"))
    return whole.mapInPandas(alone, schema)


def mapping_columns(mapping: DataFrame) -> list[Column]:
    """A mapping's columns; a map as its entries, which can be compared."""
    return [F.map_entries(c).alias(c) if t.startswith("map") else F.col(c) for c, t in mapping.dtypes]


def as_rows(rows: list) -> list[dict]:
    """Rows that came as structs, as Mapping.of takes them."""
    return [dict(r, value_map={e["key"]: e["value"] for e in r["value_map"]} if r["value_map"] is not None else None) for r in rows]


def literals_beside(r: sqltext.Reader, i: int) -> list[int]:
    """The string literals that the column at i is compared with by =, <> or IN."""
    t = r.t
    string = lambda k: 0 <= k < len(t) and t[k].kind == "string"
    if r.op(i + 1) in ("=", "<>", "!=") and string(i + 2):
        return [i + 2]
    if r.op(i - 1) in ("=", "<>", "!=") and string(i - 2):
        return [i - 2]
    j = i + 2 if r.word(i + 1) == "NOT" else i + 1
    if r.word(j) == "IN" and r.op(j + 1) == "(":
        return [k for k in range(j + 2, r.close(j + 1)) if string(k)]
    return []


def value_behind(r: sqltext.Reader, a: int) -> tuple[int, int]:
    """The tokens of the expression that starts at a, up to a comma or clause of the same level."""
    depth, b = 0, a
    while b < len(r.t):
        depth += (r.op(b) == "(") - (r.op(b) == ")")
        if depth < 0 or depth == 0 and (r.op(b) == "," or r.word(b) in ("WHERE", "WHEN", "FROM")):
            break
        b += 1
    return a, b


REWRITTEN = "to_be_sql string, status string, changes array<struct<kind: string, as_is: string, to_be: string, n: bigint, transformer: string>>, warnings array<string>"


def rewritten(statements: DataFrame, mapping: DataFrame, most: int = MAPPING_ROWS) -> DataFrame:
    """Each statement (mapper, id, type, sql) rewritten by a mapping (with kind, conversions and value_map).

    A mapping of up to `most` rows goes to all executors. Of a larger one, the rows of the tables that each distinct
    statement names are joined to it, so that none of it must fit in memory. Both ways give the same result.
    """
    own = statements.select("mapper", "id", "type", "sql")
    if mapping.limit(most + 1).count() <= most:
        shared = statements.sparkSession.sparkContext.broadcast([r.asDict() for r in mapping.collect()])

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Mapping.of(shared.value)
            for b in batches:
                known: dict[str | None, dict] = {q: rewrite(q, m) for q in b["sql"].unique()}
                got = pd.DataFrame([known[q] for q in b["sql"]], columns=["to_be_sql", "status", "changes", "warnings"], index=b.index)
                yield pd.concat([b, got], axis=1)

        return own.mapInPandas(work, "mapper string, id string, type string, sql string, " + REWRITTEN)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(q, t) for q in b["sql"] for t in sqltext.read(q).tables], columns=["sql", "as_is_table"])

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [rewrite(q, Mapping.of(as_rows(rows))) for q, rows in zip(b["sql"], b["rows"], strict=True)]
            yield pd.concat([b[["sql"]], pd.DataFrame(got, columns=["to_be_sql", "status", "changes", "warnings"], index=b.index)], axis=1)

    texts = own.select("sql").distinct()
    uses = texts.mapInPandas(named, "sql string, as_is_table string")
    relevant = uses.join(mapping, "as_is_table").groupBy("sql").agg(F.collect_set(F.struct(*mapping_columns(mapping))).alias("rows"))
    whole = texts.join(relevant, texts["sql"].eqNullSafe(relevant["sql"]), "left").select(texts["sql"], F.coalesce("rows", F.array().cast(relevant.schema["rows"].dataType)).alias("rows"))
    done = whole.mapInPandas(alone, "sql string, " + REWRITTEN)
    return own.join(done, own["sql"].eqNullSafe(done["sql"]), "left").select(own["mapper"], own["id"], own["type"], own["sql"], "to_be_sql", "status", "changes", "warnings")


def change_counts(out: DataFrame) -> DataFrame:
    """Kind, as_is, to_be, transformer, n over all statements."""
    return out.select(F.explode("changes").alias("c")).groupBy("c.kind", "c.as_is", "c.to_be", "c.transformer").agg(F.sum("c.n").alias("n"))


def references(read_: DataFrame) -> DataFrame:
    """mapper, id, table_name, column_name of what statements name (from statements.read)."""
    return read_.select("mapper", "id", F.explode("columns").alias("c")).select("mapper", "id", "c.table_name", "c.column_name").distinct()


def table_impact(read_: DataFrame, mapping: DataFrame) -> DataFrame:
    """as_is_table, to_be_table, n_statements, n_mappers of each mapped table, also of those nothing names."""
    used = read_.select("mapper", "id", F.explode("tables").alias("t")).select("mapper", "id", F.col("t.name").alias("as_is_table"))
    tables = mapping.groupBy("as_is_table").agg(F.coalesce(F.min("to_be_table"), F.lit("<dropped>")).alias("to_be_table"))
    return tables.join(used, "as_is_table", "left").groupBy("as_is_table", "to_be_table").agg(F.count_distinct("mapper", "id").alias("n_statements"), F.count_distinct("mapper").alias("n_mappers"))


def column_impact(read_: DataFrame, mapping: DataFrame) -> DataFrame:
    """as_is_table, as_is_column, to_be, n_statements of each mapped column, also of those nothing names."""
    refs = references(read_).toDF("mapper", "id", "as_is_table", "as_is_column")
    own = mapping.select("as_is_table", "as_is_column", F.coalesce(F.concat_ws(".", F.when(F.col("to_be_column").isNotNull(), F.col("to_be_table")), "to_be_column"), F.lit("")).alias("to_be"))
    own = own.withColumn("to_be", F.when(F.col("to_be") == "", "<dropped>").otherwise(F.col("to_be")))
    return own.join(refs, ["as_is_table", "as_is_column"], "left").groupBy("as_is_table", "as_is_column", "to_be").agg(F.count("id").alias("n_statements"))


def impact_report(statements: DataFrame, schema: DataFrame, document: str) -> dict[str, DataFrame]:
    """Tables, columns, mismatch and errors of a mapping document (YAML) over statements (mapper, id, type, sql) and a schema:
    where the document has no sound row, the first three are empty and errors say why."""
    from quarrylane.operators.statements import read
    from quarrylane.sources.sheets import load_mapping

    rows, wrong = load_mapping(document)
    spark = statements.sparkSession
    names = "as_is_table string, as_is_column string, to_be_table string, to_be_column string, kind string"
    mapping = spark.createDataFrame([tuple(r[n.split()[0]] for n in names.split(", ")) for r in rows], names)
    mined = read(statements)
    return {"tables": table_impact(mined, mapping), "columns": column_impact(mined, mapping), "mismatch": schema_mismatch(mapping, schema), "errors": spark.createDataFrame([(w,) for w in wrong], "error string")}


def schema_mismatch(mapping: DataFrame, columns: DataFrame) -> DataFrame:
    """Code, place: mapped columns that the schema (table_name, column_name) lacks, and schema columns nothing maps."""
    s = columns.select(F.col("table_name").alias("as_is_table"), F.col("column_name").alias("as_is_column")).distinct()
    m = mapping.select("as_is_table", "as_is_column").distinct()
    place = F.concat_ws(".", "as_is_table", "as_is_column").alias("place")
    lacking = m.join(s, ["as_is_table", "as_is_column"], "left_anti").select(F.lit("NOT_IN_SCHEMA").alias("code"), place)
    mapped_tables = m.select("as_is_table").distinct()
    return lacking.unionByName(s.join(mapped_tables, "as_is_table", "left_semi").join(m, ["as_is_table", "as_is_column"], "left_anti").select(F.lit("NOT_MAPPED").alias("code"), place))


NAMED = "fault string, refs array<struct<qualifier: string, table_name: string, column_name: string, derived: boolean>>, names array<string>, withs boolean"


def named(statements: DataFrame) -> DataFrame:
    """mapper, id, why a statement can't be read, the columns it names anywhere, its tables, and whether it has WITH
    queries; every distinct text of a batch is read once. Placeholders of mapper files are no columns."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str | None, tuple] = {}
            for q in b["sql"].unique():
                why = sqltext.fault(q)
                refs = [] if why else [dict(zip(("qualifier", "table_name", "column_name", "derived"), x, strict=True)) for x in sqltext.references(q)]
                r = sqltext.Reader(q or "")
                known[q] = (why, refs, list(r.read().tables) if not why else [], bool(r.ctes))
            got = pd.DataFrame([known[q] for q in b["sql"]], columns=["fault", "refs", "names", "withs"], index=b.index)
            yield pd.concat([b[["mapper", "id"]], got], axis=1)

    return statements.select("mapper", "id", "sql").mapInPandas(work, "mapper string, id string, " + NAMED)


def static_issues(statements: DataFrame, schema: DataFrame) -> DataFrame:
    """Mapper, id, level, code, place: what is wrong with statements (mapper, id, sql) by a schema (table_name,
    column_name), by joins.

    Errors: PARSE_FAIL (place says why; nothing else is reported), UNKNOWN_TABLE, UNKNOWN_COLUMN (of a known table, or a bare
    one that no table of the statement has). Warnings: UNRESOLVED_QUALIFIER (no table or alias), UNRESOLVED_COLUMN (a bare
    column that may come from a WITH query), AMBIGUOUS_COLUMN (bare, in several tables). DUAL, WITH queries,
    sub-queries and pseudo-columns are exempt. Each place is reported once a statement.
    """
    own = named(statements)
    columns = schema.select("table_name", "column_name").distinct()
    known = columns.select("table_name").distinct()
    row = lambda level, code, place: [F.lit(level).alias("level"), F.lit(code).alias("code"), place.alias("place")]
    broken = own.filter("fault is not null").select("mapper", "id", *row("error", "PARSE_FAIL", F.col("fault")))
    tables = own.select("mapper", "id", F.explode("names").alias("table_name")).filter("table_name <> 'DUAL'")
    lacking = tables.join(known, "table_name", "left_anti").select("mapper", "id", *row("error", "UNKNOWN_TABLE", F.col("table_name")))
    refs = own.select("mapper", "id", "names", "withs", F.explode("refs").alias("r")).select("mapper", "id", "names", "withs", "r.*").filter(~F.col("column_name").isin(*sorted(PSEUDO_COLUMNS)))
    qualified = refs.filter("qualifier <> '' and not derived")
    strange = qualified.filter("table_name = ''").select("mapper", "id", *row("warning", "UNRESOLVED_QUALIFIER", F.concat_ws(".", "qualifier", "column_name")))
    absent = qualified.join(known, "table_name", "left_semi").join(columns, ["table_name", "column_name"], "left_anti").select("mapper", "id", *row("error", "UNKNOWN_COLUMN", F.concat_ws(".", "table_name", "column_name")))
    # a bare column by the tables of its statement that have it
    bare = refs.filter("qualifier = ''").select("mapper", "id", "withs", "column_name", F.explode_outer("names").alias("table_name"))
    held = bare.join(columns.withColumn("has", F.lit(1)), ["table_name", "column_name"], "left").groupBy("mapper", "id", "withs", "column_name").agg(F.count("has").alias("n"))
    none = held.filter("n = 0").select("mapper", "id", F.when(F.col("withs"), "warning").otherwise("error").alias("level"), F.when(F.col("withs"), "UNRESOLVED_COLUMN").otherwise("UNKNOWN_COLUMN").alias("code"), F.col("column_name").alias("place"))
    many = held.filter("n > 1").select("mapper", "id", *row("warning", "AMBIGUOUS_COLUMN", F.col("column_name")))
    out = broken
    for x in (lacking, strange, absent, none, many):
        out = out.unionByName(x)
    return out.distinct()


def coverage(mapping: DataFrame, changes: DataFrame) -> DataFrame:
    """as_is_table, as_is_column, kind, hits, unused of each mapping row; a conversion's hits count like a rename's."""
    hits = changes.filter("kind in ('column', 'type_wrap')").groupBy(F.col("as_is").alias("place")).agg(F.sum("n").alias("hits"))
    own = mapping.select("as_is_table", "as_is_column", "kind", F.concat_ws(".", "as_is_table", "as_is_column").alias("place"))
    return own.join(hits, "place", "left").select("as_is_table", "as_is_column", "kind", F.coalesce("hits", F.lit(0)).alias("hits"), F.col("hits").isNull().alias("unused"))


def rates(out: DataFrame) -> DataFrame:
    """Total, counts by status, and the share that needed no help."""
    n = F.count("*")
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    return out.agg(n.alias("total"), count("AUTO").alias("auto"), count("AUTO_WARN").alias("auto_warn"), count("NEEDS_LLM").alias("needs_llm"), count("PARSE_FAIL").alias("parse_fail"), F.round((count("AUTO") + count("AUTO_WARN")) / n, 4).alias("automation_rate"))


def unresolved(out: DataFrame) -> DataFrame:
    """The statements somebody must look at."""
    return out.filter(F.col("status").isin("NEEDS_LLM", "PARSE_FAIL") | (F.size("warnings") > 0))


def mapped_values(df: DataFrame, column: str, pairs: dict[str, str], default: str | None = None) -> DataFrame:
    """G10 for data: a column's values by a map; others become the default, or stay without one."""
    c = F.col(column)
    new: Column | None = None
    for k, v in pairs.items():
        new = F.when(c == k, v) if new is None else new.when(c == k, v)
    other = c if default is None else F.when(c.isNotNull(), F.lit(default))
    return df.withColumn(column, other if new is None else new.otherwise(other))


def commented(sql: Column, notes: Column) -> Column:
    """A statement under a comment with its notes (an array), where there are any."""
    return F.when(F.size(notes) > 0, F.concat(F.lit("/* "), F.array_join(notes, "; "), F.lit(" */\n"), sql)).otherwise(sql)


#: Where G25 puts comments, and the clauses that stand for it.
SCOPES = {"select": ("SELECT",), "update": ("SET",), "insert": ("INTO",), "where": ("WHERE", "HAVING"), "join": ("ON",)}
#: The sources of column comments, in the order in which they win, by policy.
POLICIES = {"mapping": ("mapping",), "mapping_first": ("mapping", "terms", "schema"), "to_be_schema": ("schema",), "terms_dictionary": ("terms",), "both": ("terms", "schema")}


def comment_sources(sources: dict[str, DataFrame], policy: str = "mapping_first") -> DataFrame:
    """table_name, column_name, comment by a policy: of the sources it names (mapping, terms, schema: each table_name,
    null for any, column_name, comment) the first that has one counts. Blank comments are none."""
    out = None
    for rank, name in enumerate(POLICIES[policy]):
        if name in sources:
            one = sources[name].select(F.upper("table_name").alias("table_name"), F.upper("column_name").alias("column_name"), "comment").filter("trim(comment) <> ''").withColumn("rank", F.lit(rank))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no source for {policy}")
    return out.groupBy("table_name", "column_name").agg(F.min(F.struct("rank", "comment"))["comment"].alias("comment"))


def annotate(sql: str, notes: dict[tuple[str, str], str], scopes: tuple[str, ...] = ("select", "update", "insert")) -> str:
    """Sql with a comment behind each column of the scopes that has one, by its table, else by its bare name."""
    if not sql or not sql.strip():
        return sql
    x = Text(sql)
    clauses = {c for s in scopes for c in SCOPES.get(s, ())}
    known = Mapping(tables=dict.fromkeys(x.s.tables, ""), columns={k: {} for k in notes})
    edits = []
    for p in x.columns(known):
        scope_ok = "insert" in scopes if p.listed else p.clause in clauses and (p.clause != "SET" or x.r.op(p.at + 1) == "=")
        if scope_ok and (note := notes.get((p.table or "", p.column)) or notes.get(("", p.column))):
            edits.append((x.end(p.at), note.replace("*/", "* /")))
    for at, note in sorted(edits, reverse=True):
        sql = f"{sql[:at]} /* {note} */{sql[at:]}"
    return sql


def annotated(statements: DataFrame, comments: DataFrame, scopes: tuple[str, ...] = ("select", "update", "insert")) -> DataFrame:
    """Statements (mapper, id, type, sql) with column comments (table_name, null for any, column_name, comment). The
    comments of the columns that a statement's words name are joined to it, so that no dictionary must fit in memory."""
    own = statements.select("mapper", "id", "type", "sql")
    texts = own.select("sql").filter("sql is not null").distinct()
    words = texts.select("sql", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("sql"), F.lit(r"(\w+)"), F.lit(1)))).alias("column_name"))
    notes = words.join(comments, "column_name").groupBy("sql").agg(F.collect_set(F.struct(F.coalesce("table_name", F.lit("")).alias("t"), F.col("column_name").alias("c"), F.col("comment").alias("n"))).alias("notes"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sql": b["sql"], "commented": [annotate(q, {(r["t"], r["c"]): r["n"] for r in sorted(n, key=lambda r: r["n"], reverse=True)}, scopes) for q, n in zip(b["sql"], b["notes"], strict=True)]})

    done = notes.mapInPandas(work, "sql string, commented string")
    return own.join(done, "sql", "left").select("mapper", "id", "type", F.coalesce("commented", "sql").alias("sql"))


def statement_hits(read_: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapper, id, as_is_table, as_is_column, to_be, kind: each mapped column that a statement names, and, with a null
    column, each mapped table."""
    target = F.when(F.col("to_be_column").isNotNull(), F.concat_ws(".", "to_be_table", "to_be_column")).otherwise("<dropped>")
    columns = references(read_).toDF("mapper", "id", "as_is_table", "as_is_column").join(mapping.select("as_is_table", "as_is_column", target.alias("to_be"), "kind"), ["as_is_table", "as_is_column"])
    used = read_.select("mapper", "id", F.explode("tables").alias("t")).select("mapper", "id", F.col("t.name").alias("as_is_table"))
    tables = mapping.groupBy("as_is_table").agg(F.coalesce(F.min("to_be_table"), F.lit("<dropped>")).alias("to_be"))
    hits = used.join(tables, "as_is_table").select("mapper", "id", "as_is_table", F.lit(None).cast("string").alias("as_is_column"), "to_be", F.lit("table").alias("kind"))
    return hits.unionByName(columns.select("mapper", "id", "as_is_table", "as_is_column", "to_be", "kind"))
