"""Words of identifiers and naming rules (survey section 2.6, E1 to E10)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quarrylane.functions.text import identifier_words

# Words that say nothing.
STOP_WORDS = """GET SET IS HAS CAN DO ON TO BY IN OF THE AND OR NOT FOR WITH FROM THIS THAT NEW OLD ALL ANY USE USED
PROPS STATE RENDER RETURN EXPORT DEFAULT IMPORT CONST LET VAR FUNCTION ASYNC AWAIT CLASS COMPONENT HOOK EFFECT REF MEMO CALLBACK
HANDLE HANDLER EVENT CLICK CHANGE SUBMIT TRUE FALSE NULL UNDEFINED DIV SPAN INPUT BUTTON FORM TABLE MODAL HEADER FOOTER WRAPPER
CONTAINER CONTENT LAYOUT STYLE STYLED CSS WIDTH HEIGHT COLOR INDEX KEY VALUE ITEM ITEMS ARRAY OBJECT MAP FILTER REDUCE FIND SORT
PUSH POP LENGTH SIZE COUNT TOTAL MAX MIN INIT LOAD FETCH SEND POST PUT DELETE REQUEST RESPONSE ERROR SUCCESS FAIL RESULT DATA INFO
TYPE TYPES ENUM INTERFACE ID IDX NUM NO SEQ TB TBL VW IF FN SP PK FK IX""".split()
# Table prefixes, name length, and the abbreviations known without a dictionary.
TABLE_PREFIXES = ("TB", "TBL", "T", "VW", "V")
MAX_NAME = 30
ABBREVIATIONS = {
    "CUST": "CUSTOMER", "ORD": "ORDER", "PROD": "PRODUCT", "EMP": "EMPLOYEE", "DEPT": "DEPARTMENT", "USR": "USER", "DT": "DATE",
    "DTM": "DATETIME", "NM": "NAME", "NO": "NUMBER", "CD": "CODE", "ID": "IDENTIFIER", "ST": "STATUS", "TYPE": "TYPE", "AMT": "AMOUNT",
    "QTY": "QUANTITY", "PRC": "PRICE", "YN": "YESNO", "SEQ": "SEQUENCE", "CNT": "COUNT", "REG": "REGISTER", "MOD": "MODIFY",
    "DEL": "DELETE", "ADDR": "ADDRESS", "TEL": "TELEPHONE", "EMAIL": "EMAIL",
}
DDL_TYPES = "VARCHAR2|NVARCHAR2|CHAR|NCHAR|NUMBER|DATE|TIMESTAMP|CLOB|BLOB|FLOAT"


def valid_word(word: Column) -> Column:
    """Of two letters at least, no stop word, not digits alone."""
    return (F.length(word) >= 2) & ~word.isin(STOP_WORDS) & ~word.rlike("^[0-9]+$")


def default_abbreviations(spark: SparkSession) -> DataFrame:
    """Abbreviation, word: the dictionary used where none is given."""
    return spark.createDataFrame(list(ABBREVIATIONS.items()), "abbreviation string, word string")


def schema_words(columns: DataFrame) -> DataFrame:
    """Word, source: each word of each table's and column's name, once a place."""
    tables = columns.select("table_name").distinct().select(F.explode(identifier_words(F.col("table_name"))).alias("word"), F.concat(F.lit("TABLE:"), "table_name").alias("source"))
    own = columns.select("table_name", "column_name").distinct().select(F.explode(identifier_words(F.col("column_name"))).alias("word"), F.concat(F.lit("COL:"), "table_name", F.lit("."), "column_name").alias("source"))
    return tables.unionByName(own).filter(valid_word(F.col("word")))


def source_words(files: DataFrame) -> DataFrame:
    """Word, source: each word of the identifiers (three letters at least) of each source file (path, content), once a
    file, without comments and strings."""
    code = F.col("content")
    for p in (r"//[^\n]*", r"(?s)/\*.*?\*/", r'"[^"]*"', r"'[^']*'", r"(?s)`[^`]*`"):
        code = F.regexp_replace(code, p, "")
    ids = F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]{2,})\b"), F.lit(1)))
    words = F.array_distinct(F.flatten(F.transform(ids, identifier_words)))
    return files.select(F.explode(words).alias("word"), F.concat(F.lit("FE:"), "path").alias("source")).filter(valid_word(F.col("word")))


def merged_words(db: DataFrame, fe: DataFrame, samples: int = 5) -> DataFrame:
    """E5: word, db_count, fe_count, total_count, source_count, sample_sources (the first in order).

    One union and one grouping instead of a full join; samples are cut by rank before they are gathered.
    """
    every = db.withColumn("db", F.lit(1)).unionByName(fe.withColumn("db", F.lit(0)))
    counts = every.groupBy("word").agg(F.sum("db").alias("db_count"), F.sum(1 - F.col("db")).alias("fe_count"), F.count("*").alias("total_count"), F.count_distinct("source").alias("source_count"))
    ranked = every.select("word", "source").distinct().withColumn("r", F.row_number().over(W.Window.partitionBy("word").orderBy("source"))).filter(F.col("r") <= samples)
    return counts.join(ranked.groupBy("word").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sample_sources")), "word")


def word_category(merged: DataFrame) -> DataFrame:
    """Both, db_only or fe_only."""
    c = F.when((F.col("db_count") > 0) & (F.col("fe_count") > 0), "both").when(F.col("db_count") > 0, "db_only").when(F.col("fe_count") > 0, "fe_only").otherwise("unknown")
    return merged.withColumn("category", c)


def name_issues(names: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Name, kind, rule, severity for each broken rule; names: name, kind ('table' or 'column').

    known: standard abbreviations and words; the default dictionary where None.
    """
    words = known if known is not None else [*ABBREVIATIONS, *ABBREVIATIONS.values()]
    name, table = F.col("name"), F.col("kind") == "table"
    parts = F.filter(F.split(F.upper(name), "_"), lambda p: p != "")
    unknown = F.filter(parts, lambda p: ~p.isin(words) & ~(table & p.isin(*TABLE_PREFIXES)))

    def rule(when: Column, r: str, s: str) -> Column:
        return F.when(when, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity")))

    rules = [
        rule(F.length(name) > MAX_NAME, "LENGTH", "CRITICAL"),
        rule(name.rlike(r"\p{Ll}"), "CASE", "HIGH"),
        rule(name.rlike("[^a-zA-Z0-9_]"), "SPECIAL_CHAR", "CRITICAL"),
        rule(name.rlike("^[0-9]"), "FIRST_CHAR", "CRITICAL"),
        rule(table & ~F.split_part(F.upper(name), F.lit("_"), F.lit(1)).isin(*TABLE_PREFIXES), "PREFIX", "LOW"),
        rule(F.size(unknown) > 0, "UNKNOWN_ABBREVIATION", "MEDIUM"),
    ]
    return names.select("name", "kind", F.explode(F.array_compact(F.array(*rules))).alias("i")).select("name", "kind", "i.*")


def unknown_parts(names: DataFrame, known: list[str] | None = None) -> DataFrame:
    """name, part: the words of each name that no dictionary has."""
    words = known if known is not None else [*ABBREVIATIONS, *ABBREVIATIONS.values()]
    parts = names.select("name", "kind", F.explode(F.split(F.upper("name"), "_")).alias("part")).filter("part <> ''")
    return parts.filter(~F.col("part").isin(words) & ~((F.col("kind") == "table") & F.col("part").isin(*TABLE_PREFIXES))).select("name", "part").distinct()


def suggestions(parts: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Part, suggestions: up to three similar known words for each distinct part; the list is small and fixed."""
    words = known if known is not None else [*ABBREVIATIONS, *ABBREVIATIONS.values()]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def close(s: pd.Series) -> pd.Series:
        return s.map(lambda p: difflib.get_close_matches(p, words, n=3, cutoff=0.6))

    return parts.select("part").distinct().withColumn("suggestions", close("part"))


def ddl_names(ddl: DataFrame) -> DataFrame:
    """ddl_id, name, kind: the tables and columns that CREATE TABLE statements (ddl_id, ddl) define."""
    body = F.regexp_extract_all("ddl", F.lit(r"(?is)\bCREATE\s+TABLE\s+(?:\w+\.)?(\w+)\s*\("), F.lit(1))
    columns = F.regexp_extract_all("ddl", F.lit(rf"(?im)(?:^|[(,])\s*(\w+)\s+(?:{DDL_TYPES})\b"), F.lit(1))
    t = ddl.select("ddl_id", F.explode(body).alias("name"), F.lit("table").alias("kind"))
    return t.unionByName(ddl.select("ddl_id", F.explode(columns).alias("name"), F.lit("column").alias("kind")))
