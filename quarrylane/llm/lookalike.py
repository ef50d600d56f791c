"""Problem 3: text that looks the same but is made of different characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .glyphs import BLANKS, INVISIBLE, LOOKALIKE, STYLED

LATIN = "A-Za-zÀ-ɏ"
_LOOK = "".join(LOOKALIKE)
#: Values of nothing else, with single blanks inside, are in their ordinary form already.
PLAIN = "^[!-~가-힣]+( [!-~가-힣]+)*$"


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """NFC, which SQL has no function for."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def mapped(c: Column) -> Column:
    """c with look-alikes replaced, invisible characters gone and single blanks; not yet composed.

    Letters of other scripts count as Latin only in a run with Latin letters or other look-alikes; a lone one is a
    symbol of its own. Null stays null.
    """
    shown = F.translate(c, "".join(STYLED) + BLANKS + INVISIBLE, "".join(STYLED.values()) + " " * len(BLANKS))
    runs = F.regexp_extract_all(shown, F.lit(f"([{LATIN}{_LOOK}̀-ͯ]+|[^{LATIN}{_LOOK}̀-ͯ]+)"), F.lit(1))
    latin = F.array_join(
        F.transform(runs, lambda r: F.when(r.rlike(f"^[{LATIN}{_LOOK}][{LATIN}{_LOOK}̀-ͯ]+$"), F.translate(r, _LOOK, "".join(LOOKALIKE.values()))).otherwise(r)), ""
    )
    return F.trim(F.regexp_replace(F.when(shown.rlike(f"[{_LOOK}]"), latin).otherwise(shown), " +", " "))


def ordinary_forms(values: DataFrame) -> DataFrame:
    """One row (src_field, row_id, clean_text) for each value that differs from its ordinary form.

    values: src_field, row_id, value (other columns are ignored). All distinct values, look-alikes replaced, are
    grouped under the Unicode collation that tells accents and case apart but takes composed and decomposed letters
    for the same. Of each class the shortest member counts, of these the first by code points; where the class has no
    composed member, it is composed. The canonical members are joined back to the rows.

    Null values, and those that show nothing, give no row. Repeated rows each give one. Without rows the result is
    empty. The values are pre-aggregated before each shuffle; rows in their ordinary form are not shuffled at all,
    and a frequent value among the rest is split by adaptive execution, since each class has one row.
    """
    values = values.select("src_field", "row_id", "value").filter(F.col("value").isNotNull())
    distinct = values.select("value").distinct().select(mapped(F.col("value")).alias("seen")).filter("seen <> ''").distinct()
    classes = (
        distinct.groupBy(F.collate(F.col("seen"), "UNICODE").alias("class"))
        .agg(F.min(F.struct(F.length("seen").alias("n"), F.col("seen").alias("s"))).alias("first"), F.collect_set("seen").alias("members"))
        .select(F.col("first.s").alias("canonical"), F.explode("members").alias("seen"))
    )
    loose = F.col("canonical").rlike("[̀-ͯᄀ-ᇿꥠ-꥿ힰ-퟿]")
    classes = classes.filter(loose).select("seen", composed("canonical").alias("clean_text")).unionByName(classes.filter(~loose).select("seen", F.col("canonical").alias("clean_text")))
    odd = values.filter(~F.col("value").rlike(PLAIN)).withColumn("seen", mapped(F.col("value")))
    return odd.join(classes, "seen").filter("value <> clean_text").select("src_field", "row_id", "clean_text")
