"""Queries of names and dictionaries (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.functions.text import identifier_words, match_key
from quarrylane.operators import dictionary as dic
from quarrylane.operators import naming
from quarrylane.plans.tables import catalog_columns
from quarrylane.session import table

TODAY = "20250101"
PUNCT = r"[\s\p{Z}\-_./,()\[\]{}<>~!@#$%^&*+=|\\:;''\"?]+"
KEY = lambda c: f"upper(trim(regexp_replace(coalesce(nfc_normalize({c}), ''), '{PUNCT}', '', 'g')))"
DEAD = lambda c: f"coalesce(try_strptime(CASE WHEN length(regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')) >= 8 THEN left(regexp_replace({c}, '[^0-9]', '', 'g'), 8) END, '%Y%m%d') < TIMESTAMP '2025-01-01', false)"
TYPE = """CASE WHEN trim(data_type) = '' THEN NULL WHEN instr(data_type, '(') > 0 THEN upper(trim(data_type))
  WHEN upper(trim(data_type)) IN ('DATE','TIMESTAMP','CLOB','BLOB','LONG','ROWID') OR regexp_replace(coalesce(data_length, ''), '[^0-9]', '', 'g') = '' THEN upper(trim(data_type))
  WHEN regexp_replace(coalesce(data_scale, ''), '[^0-9]', '', 'g') NOT IN ('', '0') THEN upper(trim(data_type)) || '(' || regexp_replace(data_length, '[^0-9]', '', 'g') || ',' || regexp_replace(data_scale, '[^0-9]', '', 'g') || ')'
  ELSE upper(trim(data_type)) || '(' || regexp_replace(data_length, '[^0-9]', '', 'g') || ')' END"""
STOP = ", ".join(f"'{w}'" for w in naming.STOP_WORDS)
KNOWN = ", ".join(f"'{w}'" for w in [*naming.ABBREVIATIONS, *naming.ABBREVIATIONS.values()])


def e1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word occurs in the catalog's column names."""
    return catalog_columns(spark, sf_dir).select(F.explode(identifier_words(F.col("column_name"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


WORDS = lambda c: f"string_split(upper(regexp_replace(regexp_replace({c}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '_')"
E1 = f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS('column_name')}) AS word FROM column_rec) WHERE word <> '' GROUP BY word"


def e3_schema_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = naming.schema_words(catalog_columns(spark, sf_dir))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))


E3 = f"""
WITH t AS (SELECT unnest({WORDS('table_name')}) AS word, 'TABLE:' || table_name AS source FROM (SELECT DISTINCT table_name FROM column_rec)
  UNION ALL SELECT unnest({WORDS('column_name')}), 'COL:' || table_name || '.' || column_name FROM (SELECT DISTINCT table_name, column_name FROM column_rec))
SELECT word, count(*) AS n, count(DISTINCT source) AS n_sources FROM t WHERE length(word) >= 2 AND word NOT IN ({STOP}) AND NOT regexp_matches(word, '^[0-9]+$') GROUP BY word"""


def e5_merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the catalog beside those of the documents' identifiers."""
    files = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return naming.word_category(naming.merged_words(naming.schema_words(catalog_columns(spark, sf_dir)), naming.source_words(files)))


def e6_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e5_merged_words(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog_columns(spark, sf_dir)
    return c.select(F.col("table_name").alias("name"), F.lit("table").alias("kind")).unionByName(c.select(F.col("column_name").alias("name"), F.lit("column").alias("kind"))).distinct()


def e7_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.name_issues(names(spark, sf_dir))


NAMES = "(SELECT DISTINCT table_name AS name, 'table' AS kind FROM column_rec UNION ALL SELECT DISTINCT column_name, 'column' FROM column_rec)"
E7 = f"""
WITH n AS {NAMES}
SELECT name, kind, 'LENGTH' AS rule, 'CRITICAL' AS severity FROM n WHERE length(name) > 30
UNION ALL SELECT name, kind, 'CASE', 'HIGH' FROM n WHERE regexp_matches(name, '\\p{{Ll}}')
UNION ALL SELECT name, kind, 'SPECIAL_CHAR', 'CRITICAL' FROM n WHERE regexp_matches(name, '[^a-zA-Z0-9_]')
UNION ALL SELECT name, kind, 'FIRST_CHAR', 'CRITICAL' FROM n WHERE regexp_matches(name, '^[0-9]')
UNION ALL SELECT name, kind, 'PREFIX', 'LOW' FROM n WHERE kind = 'table' AND split_part(upper(name), '_', 1) NOT IN ('TB','TBL','T','VW','V')
UNION ALL SELECT name, kind, 'UNKNOWN_ABBREVIATION', 'MEDIUM' FROM n WHERE len(list_filter(string_split(upper(name), '_'), lambda p: p <> '' AND p NOT IN ({KNOWN}) AND NOT (kind = 'table' AND p IN ('TB','TBL','T','VW','V')))) > 0"""


def d12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylane.operators.profile import audit_counts

    return audit_counts(e7_naming(spark, sf_dir))


D12 = f"""
WITH i AS ({E7})
SELECT 'rule' AS kind, rule AS what, count(*) AS n, count(DISTINCT name) AS names FROM i GROUP BY rule
UNION ALL SELECT 'severity', severity, count(*), count(DISTINCT name) FROM i GROUP BY severity
UNION ALL SELECT 'all', 'all', count(*), count(DISTINCT name) FROM i"""


def e8_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.suggestions(naming.unknown_parts(names(spark, sf_dir))).withColumn("suggestions", F.array_join("suggestions", ","))


def e11_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "word").select("word_id", match_key(F.col("logical")).alias("match_key"))


def e12_living(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard and expired words by source."""
    w = table(spark, sf_dir, "word")
    return w.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(dic.is_standard(F.col("is_std")), 1)).alias("n_standard"), F.count(F.when(dic.is_expired(F.col("expire"), TODAY), 1)).alias("n_expired"))


E12 = f"SELECT source, count(*) AS n, count(*) FILTER (coalesce(is_std, 1) <> 0) AS n_standard, count(*) FILTER ({DEAD('expire')}) AS n_expired FROM word GROUP BY source"


def e14_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.resolved(dic.candidates(table(spark, sf_dir, "word"), TODAY))


E14 = f"""
WITH w AS (SELECT *, CASE WHEN coalesce(is_std, 1) <> 0 THEN 0 ELSE 10 END AS base FROM word WHERE NOT {DEAD('expire')} AND coalesce(trim(physical), '') <> ''),
c AS (SELECT {KEY('logical')} AS match_key, base AS rank, coalesce(logical, '') AS logical, physical, 'logical' AS field FROM w
  UNION ALL SELECT {KEY('s')}, base + 1, coalesce(logical, ''), physical, 'synonym' FROM (SELECT *, unnest(regexp_split_to_array(coalesce(synonyms, ''), '[,/;|·\n]+')) AS s FROM w) WHERE trim(s) <> ''
  UNION ALL SELECT {KEY('eng')}, base + 2, coalesce(logical, ''), physical, 'meaning' FROM w)
SELECT match_key, rank, logical, physical, field FROM c WHERE match_key <> '' QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY rank, logical, physical, field) = 1"""


def e15_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.classifier_types(table(spark, sf_dir, "term"), table(spark, sf_dir, "word"), TODAY)


E15 = f"""
WITH f AS (SELECT physical, term_id, coalesce(domain_name, '') AS domain_name, {TYPE} AS data_type FROM term WHERE NOT {DEAD('expire')} AND coalesce(physical, '') <> '' QUALIFY row_number() OVER (PARTITION BY physical ORDER BY term_id) = 1),
h AS (SELECT physical, arg_min(logical, word_id) AS logical FROM word WHERE NOT {DEAD('expire')} AND coalesce(is_std, 1) <> 0 AND is_classifier = 1 AND physical IS NOT NULL AND logical IS NOT NULL GROUP BY physical),
c AS (SELECT logical, domain_name, data_type, count(*) AS n, min(term_id) AS first FROM f JOIN h ON split_part(f.physical, '_', -1) = h.physical WHERE data_type IS NOT NULL GROUP BY ALL)
SELECT logical, domain_name, data_type, n, count(*) OVER (PARTITION BY logical) AS n_variants FROM c QUALIFY row_number() OVER (PARTITION BY logical ORDER BY n DESC, first) = 1"""


def e16_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "term").select("term_id", "domain_name", dic.composed_type(F.col("data_type"), F.col("data_length"), F.col("data_scale")).alias("data_type"))
    return dic.domain_types(t)


E16 = f"""
WITH c AS (SELECT domain_name, {TYPE} AS data_type, term_id FROM term), g AS (SELECT domain_name, data_type, count(*) AS n, min(term_id) AS first FROM c WHERE domain_name IS NOT NULL AND data_type IS NOT NULL GROUP BY ALL)
SELECT domain_name, data_type, n, count(*) OVER (PARTITION BY domain_name) AS n_variants, n_variants = 1 AS single FROM g QUALIFY row_number() OVER (PARTITION BY domain_name ORDER BY n DESC, first) = 1"""


def e17_exact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose name is a living term's physical name."""
    t = dic.first_terms(table(spark, sf_dir, "term"), TODAY, "physical").withColumnRenamed("key", "column_name").drop("physical")
    return catalog_columns(spark, sf_dir).select("column_name").distinct().join(t, "column_name")


E17 = f"""
WITH f AS (SELECT physical, logical, domain_name, {TYPE} AS data_type FROM term WHERE NOT {DEAD('expire')} AND coalesce(physical, '') <> '' QUALIFY row_number() OVER (PARTITION BY physical ORDER BY term_id) = 1)
SELECT column_name, f.logical, f.domain_name, f.data_type FROM (SELECT DISTINCT column_name FROM column_rec) c JOIN f ON c.column_name = f.physical"""


def e20_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = dic.recommended(catalog_columns(spark, sf_dir), table(spark, sf_dir, "word"), table(spark, sf_dir, "term"), TODAY)
    return recs.drop("tokens")


def e23_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.recommendation_stats(e20_recommend(spark, sf_dir))


QUERIES = {f.__name__: f for f in (e1_tokens, e3_schema_words, e5_merged_words, e6_partition, e7_naming, e8_suggestions, e11_match_key, e12_living, e14_priority, e15_classifier, e16_domain, e17_exact_terms, e20_recommend, e23_stats, d12_audit)}
SQL = {
    "e1_tokens": E1, "e3_schema_words": E3, "e7_naming": E7, "e11_match_key": f"SELECT word_id, {KEY('logical')} AS match_key FROM word", "e12_living": E12, "e14_priority": E14, "e15_classifier": E15,
    "e16_domain": E16, "e17_exact_terms": E17, "d12_audit": D12,
}
