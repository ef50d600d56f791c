"""Queries of problems 2 to 8 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.session import table

from . import bpe, catalog_match, frequency, language, leakage, lookalike, mojibake


def fields(spark: SparkSession, sf_dir: str, *of: tuple[str, str, str]) -> DataFrame:
    """src_field, row_id, value of some fields, each given by table, key and column."""
    out = None
    for t, key, c in of:
        one = table(spark, sf_dir, t).select(F.lit(f"{t}.{c}").alias("src_field"), F.col(key).cast("bigint").alias("row_id"), F.col(c).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fields(spark, sf_dir, ("column_rec", "rec_id", "col_comment"), ("word", "word_id", "logical"), ("token_match", "token_id", "frag"))
    return catalog_match.map_to_catalog(values, table(spark, sf_dir, "std_catalog"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fields(spark, sf_dir, ("word", "word_id", "logical"), ("word", "word_id", "logical_norm"), ("term", "term_id", "logical"))
    return lookalike.ordinary_forms(values)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = fields(spark, sf_dir, ("column_rec", "rec_id", "col_comment"), ("word", "word_id", "word_desc"), ("screen_field", "field_id", "label"))
    return mojibake.restore(values)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a row of morpheme_result is a record; the fragments of a column are rows of token_match
    parts = table(spark, sf_dir, "morpheme_result").select(F.lit("morpheme_result.tokens").alias("src_field"), F.col("attr_id").alias("rec"), F.col("tokens").alias("terms"), F.lit(True).alias("whole"))
    frags = table(spark, sf_dir, "token_match").select(F.lit("token_match.frag").alias("src_field"), F.col("rec_id").alias("rec"), F.array("frag").alias("terms"), F.lit(False).alias("whole"))
    return frequency.frequencies(parts.unionByName(frags))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), verbatim_only=True).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks, re-parameterised questions too, with the longest passage of each."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.relabelled(table(spark, sf_dir, "documents")).select("doc_id", "seg_no", "lang")


def p8_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language stretch of every document, with its confidence."""
    return language.languages(table(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_stretches": p8_stretches,
}
