"""Profiles of data and of column catalogs (survey section 2.5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# Name endings of code and flag columns, and the values that a flag may have.
CODE_SUFFIXES = ("_CD", "_TYPE", "_CODE", "_GB", "_GBN", "_CL", "_KIND", "_GUBUN", "_DIV")
FLAG_SUFFIXES = ("_YN", "_FLAG", "_TF", "_AT")
FLAG_VALUES = ("Y", "N", "1", "0", "TRUE", "FALSE")


def long_values(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """table_name, column_name, value: the columns' values as text, one row each. One scan, however many columns."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return df.select(F.lit(table).alias("table_name"), F.expr(f"stack({len(columns)}, {pairs}) as (column_name, value)"))


def value_counts(values: DataFrame) -> DataFrame:
    """table_name, column_name, value, n."""
    return values.groupBy("table_name", "column_name", "value").agg(F.count("*").alias("n"))


def code_profile(values: DataFrame, top: int = 50) -> DataFrame:
    """For each column its most frequent values with the column's totals.

    values: table_name, column_name, value. total_rows counts nulls, distinct_count doesn't. A column of nulls alone
    has no row; equal counts are ranked by value. The rank limit is applied in each partition before the shuffle.
    """
    counts = value_counts(values)
    key = ["table_name", "column_name"]
    totals = counts.groupBy(*key).agg(
        F.sum("n").alias("total_rows"), F.count("value").alias("distinct_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count")
    )
    ranked = counts.filter("value is not null").withColumn("rank", F.row_number().over(W.Window.partitionBy(*key).orderBy(F.desc("n"), "value")))
    return ranked.filter(F.col("rank") <= top).join(totals, key)


def flag_profile(values: DataFrame) -> DataFrame:
    """For each flag column its totals and, as 'value=count' parts in value order, whatever isn't a flag's value."""
    counts = value_counts(values)
    odd = F.col("value").isNotNull() & ~F.col("value").isin(*FLAG_VALUES)
    return counts.groupBy("table_name", "column_name").agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.coalesce(F.sum(F.when(odd, F.col("n"))), F.lit(0)).alias("abnormal_rows"),
        F.count(F.when(odd, 1)).alias("abnormal_values"),
    )


def declared_length(data_type: Column) -> Column:
    """The length in a declared type, null if it has none."""
    found = F.regexp_extract(data_type, r"\((\d+)", 1)
    return F.when(found != "", found.cast("int"))


def column_usage(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """D10, first half: table_name, column_name, total_rows, null_ratio (percent, one decimal), max_length; one pass."""
    aggs = [F.count("*").alias("total")] + [F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)] + [F.max(F.length(F.col(c).cast("string"))).alias(f"m_{i}") for i, c in enumerate(columns)]
    parts = ", ".join(f"'{c}', n_{i}, m_{i}" for i, c in enumerate(columns))
    wide = df.agg(*aggs).select("total", F.expr(f"stack({len(columns)}, {parts}) as (column_name, filled, max_length)"))
    ratio = F.when(F.col("total") > 0, F.bround((F.col("total") - F.col("filled")) / F.col("total") * 100, 1)).otherwise(0.0)
    return wide.select(F.lit(table).alias("table_name"), "column_name", F.col("total").alias("total_rows"), ratio.alias("null_ratio"), "max_length")


def usage_findings(usage: DataFrame, declared: DataFrame) -> DataFrame:
    """The columns that are never filled, or declared over three times as long as anything in them.

    declared: table_name, column_name, data_type.
    """
    length = declared_length(F.col("data_type"))
    found = usage.join(declared, ["table_name", "column_name"]).withColumn("defined_length", length)
    return found.select(
        "table_name", "column_name", "total_rows", "null_ratio", "max_length", "defined_length",
        (F.col("null_ratio") == 100).alias("is_unused"),
        F.coalesce((F.col("defined_length") > 3 * F.col("max_length")) & (F.col("defined_length") >= 50) & (F.col("max_length") > 0), F.lit(False)).alias("is_oversized"),
    ).filter("is_unused or is_oversized")


def join_name_mismatch(edges: DataFrame) -> DataFrame:
    """Joins of columns that are named differently."""
    return edges.filter("column1 <> column2")


def type_drift(columns: DataFrame) -> DataFrame:
    """Column names with more than one type: types in order, rows, types; the most widespread come first by rows."""
    return (
        columns.filter("data_type is not null")
        .groupBy("column_name")
        .agg(F.array_join(F.array_sort(F.collect_set("data_type")), "|").alias("types"), F.count("*").alias("table_count"), F.count_distinct("data_type").alias("n_types"))
        .filter("n_types > 1")
    )


def prefix_outliers(columns: DataFrame) -> DataFrame:
    """D3: tables whose columns mostly, but not all, share a first name part.

    columns: table_name, column_name, col_no. The part of the most columns is dominant, of equal ones the first in
    column order; its share must be at least 0.4 and below 1, of at least three columns.
    """
    part = F.when(F.instr("column_name", "_") > 0, F.substring_index("column_name", "_", 1))
    own = columns.select("table_name", "column_name", "col_no", part.alias("part"))
    by_table = own.groupBy("table_name").agg(F.count("*").alias("total_columns"))
    parts = own.filter("part is not null").groupBy("table_name", "part").agg(F.count("*").alias("n"), F.min("col_no").alias("first_no"))
    best = parts.withColumn("r", F.row_number().over(W.Window.partitionBy("table_name").orderBy(F.desc("n"), "first_no", "part"))).filter("r = 1").drop("r")
    found = best.join(by_table, "table_name").filter("total_columns >= 3 and n / total_columns >= 0.4 and n < total_columns")
    found = found.withColumnRenamed("part", "dominant")
    others = own.join(found, "table_name").filter(F.coalesce("part", F.lit("")) != F.col("dominant"))
    listed = others.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "column_name"))), lambda x: x["column_name"]), ",").alias("outliers"))
    return found.join(listed, "table_name").select(
        "table_name", F.col("dominant").alias("dominant_prefix"), F.bround(F.col("n") / F.col("total_columns"), 2).alias("prefix_ratio"), "total_columns", F.col("n").alias("conforming_columns"), "outliers"
    )


def suffix_histogram(keys: DataFrame, examples: int = 5) -> DataFrame:
    """How key columns end, with the first examples in order of table and column.

    keys: table_name, column_name. The examples are kept by a per-group rank, so no group is gathered whole.
    """
    suffix = F.when(F.instr("column_name", "_") > 0, F.concat(F.lit("_"), F.substring_index("column_name", "_", -1))).otherwise("(no suffix)")
    own = keys.select(suffix.alias("suffix"), F.concat_ws(".", "table_name", "column_name").alias("example"))
    counts = own.groupBy("suffix").agg(F.count("*").alias("n"))
    first = own.withColumn("r", F.row_number().over(W.Window.partitionBy("suffix").orderBy("example"))).filter(F.col("r") <= examples)
    listed = first.groupBy("suffix").agg(F.array_join(F.array_sort(F.collect_list("example")), ",").alias("examples"))
    return counts.join(listed, "suffix")


def named_like(columns: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """The columns whose upper-case name has one of the endings."""
    return columns.filter(F.upper("column_name").rlike("(" + "|".join(suffixes) + ")$"))


def structure_report(columns: DataFrame, edges: DataFrame, keys: DataFrame) -> dict[str, DataFrame]:
    """All six structural findings."""
    return {
        "join_column_mismatch": join_name_mismatch(edges),
        "type_inconsistency": type_drift(columns),
        "naming_pattern": prefix_outliers(columns),
        "identifier_pattern": suffix_histogram(keys),
        "code_columns": named_like(columns, CODE_SUFFIXES),
        "yn_columns": named_like(columns, FLAG_SUFFIXES),
    }


def audit_counts(issues: DataFrame) -> DataFrame:
    """Counts by rule, by severity, and of all, of issue rows (rule, severity, name)."""
    return (
        issues.groupingSets([["rule"], ["severity"], []], "rule", "severity")
        .agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.grouping_id().alias("g"))
        .select(F.when(F.col("g") == 1, "rule").when(F.col("g") == 2, "severity").otherwise("all").alias("kind"), F.coalesce("rule", "severity", F.lit("all")).alias("what"), "n", "names")
    )


def histogram(df: DataFrame, by: str, over: str, values: list[str]) -> DataFrame:
    """Counts of `over`'s values as columns, a row for each value of `by`."""
    return df.groupBy(by).agg(*[F.count(F.when(F.col(over) == v, 1)).alias(v.lower()) for v in values], F.count("*").alias("total"))


def report_rows(profile: DataFrame, top: int = 20) -> DataFrame:
    """A code profile's first rows as text lines, by column and rank."""
    share = F.format_number(100 * F.col("n") / F.col("total_rows"), 1)
    return profile.filter(F.col("rank") <= top).select("table_name", "column_name", "rank", F.format_string("| %s | %d | %s%% |", "value", "n", share).alias("line"))
