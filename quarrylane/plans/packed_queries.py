"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.operators.packed import PackedField, unpack
from quarrylane.session import table

FIELDS = [PackedField("word.synonyms"), PackedField("term.compose"), PackedField("endpoint_spec.read_targets", inside="_")]


def packed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_field, row_id, cell of the three packed fields."""
    parts = [("word", "word_id", "synonyms"), ("term", "term_id", "compose"), ("endpoint_spec", "spec_id", "read_targets")]
    out = None
    for t, key, c in parts:
        one = table(spark, sf_dir, t).select(F.lit(f"{t}.{c}").alias("src_field"), F.col(key).alias("row_id"), F.col(c).alias("cell"))
        out = one if out is None else out.unionByName(one)
    return out


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all cells that hold at least two."""
    return unpack(packed_cells(spark, sf_dir), FIELDS).filter("n_vals > 1").select("src_field", "row_id", "val_pos", "val")


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each packed value occurs in each field, and in how many rows."""
    return (
        unpack(packed_cells(spark, sf_dir), FIELDS)
        .groupBy("src_field", "val")
        .agg(F.count("*").alias("n_occ"), F.count_distinct("row_id").alias("n_rows"))
    )


QUERIES = {"p1_found": p1_found, "p1_values": p1_values}
SQL: dict[str, str] = {}
