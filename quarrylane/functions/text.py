"""Column functions on text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What dictionary keys leave out, as a character class.
PUNCTUATION = r"[\s\p{Z}\-_./,()\[\]{}<>~!@#$%^&*+=|\\:;'\"?]+"
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc(c: Column) -> Column:
    """c in composed form; SQL has no function for it."""
    return _nfc(c)


def plain_key(c: Column) -> Column:
    """A dictionary key: composed, without blanks and punctuation; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(nfc(c), F.lit("")), PUNCTUATION, ""))


def match_key(c: Column) -> Column:
    """plain_key in upper case."""
    return F.upper(plain_key(c))


def identifier_words(c: Column) -> Column:
    """The words of an identifier in upper case: cut at underscores, then at camel humps; a part without humps stays."""
    def cut(part: Column) -> Column:
        humps = F.regexp_extract_all(part, F.lit(f"({CAMEL})"), F.lit(1))
        return F.when(F.size(humps) > 0, humps).otherwise(F.array(part))

    parts = F.filter(F.split(c, "_"), lambda p: p != "")
    return F.transform(F.flatten(F.transform(parts, cut)), F.upper)


def has_hangul(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]")
