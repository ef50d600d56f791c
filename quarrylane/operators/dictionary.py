"""Word, term and domain dictionaries and the names they recommend (survey section 2.6, E11 to E26)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarrylane.functions.text import has_hangul, identifier_words, match_key, plain_key
from quarrylane.session import cut

# Writings of 'not standard', types without a length, the fields of a word with their ranks.
NOT_STANDARD = ("N", "NO", "FALSE", "0", "X", "×", "비표준", "미표준", "아니오", "폐기", "삭제")
NO_LENGTH = ("DATE", "TIMESTAMP", "CLOB", "BLOB", "LONG", "ROWID")
FIELDS = {"logical": 0, "synonym": 1, "meaning": 2}
SYNONYM_SPLIT = r"[,/;|·\n]+"
#: Bracketed remarks and marks in a comment.
REMARK = r"\([^)]*\)|\[[^\]]*\]|（[^）]*）|【[^】]*】"
MARK = r"(?i)(LLM\s*추천|자동\s*생성|추천\s*값|미정|TODO|N/?A)"
MAX_NAME = 30


def is_standard(c: Column) -> Column:
    """Standard unless said otherwise; null counts as standard."""
    return ~F.coalesce(F.upper(F.trim(c.cast("string"))).isin(*NOT_STANDARD), F.lit(False))


def is_expired(c: Column, today: str) -> Column:
    """Whether a date, its first eight digits, is before today ('yyyyMMdd'); what is no date isn't."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    day = F.try_to_timestamp(F.when(F.length(digits) >= 8, F.left(digits, F.lit(8))), F.lit("yyyyMMdd"))
    return F.coalesce(day < F.to_timestamp(F.lit(today), "yyyyMMdd"), F.lit(False))


def synonyms(c: Column) -> Column:
    """The parts of a synonym cell."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SYNONYM_SPLIT), lambda s: F.trim(s)), lambda s: s != "")


def composed_type(data_type: Column, length: Column, scale: Column) -> Column:
    """TYPE, TYPE(length) or TYPE(length,scale) of three text cells; null without a type."""
    t = F.upper(F.trim(data_type))
    n, s = (F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "") for c in (length, scale))
    full = F.when((s != "") & (s != "0"), F.concat(t, F.lit("("), n, F.lit(","), s, F.lit(")"))).otherwise(F.concat(t, F.lit("("), n, F.lit(")")))
    return F.when(t == "", None).when(F.instr(t, "(") > 0, t).when(t.isin(*NO_LENGTH) | (n == ""), t).otherwise(full)


def candidates(words: DataFrame, today: str) -> DataFrame:
    """match_key, rank, logical, physical, field: every way to write a word that has a physical name.

    words: logical, physical, eng, is_std, synonyms, expire. Standard logical names rank 0, synonyms 1, meanings 2;
    those of non-standard words ten more.
    """
    live = words.filter(~is_expired(F.col("expire"), today) & (F.coalesce(F.trim("physical"), F.lit("")) != ""))
    base = F.when(is_standard(F.col("is_std")), 0).otherwise(10)
    ways = F.concat(
        F.array(F.struct(F.col("logical").alias("text"), F.lit("logical").alias("field"), F.lit(0).alias("r"))),
        F.transform(synonyms(F.col("synonyms")), lambda s: F.struct(s.alias("text"), F.lit("synonym").alias("field"), F.lit(1).alias("r"))),
        F.array(F.struct(F.col("eng").alias("text"), F.lit("meaning").alias("field"), F.lit(2).alias("r"))),
    )
    each = live.select(F.coalesce("logical", F.lit("")).alias("logical"), "physical", base.alias("base"), F.explode(ways).alias("w"))
    keyed = each.select(match_key(F.col("w.text")).alias("match_key"), (F.col("base") + F.col("w.r")).alias("rank"), "logical", "physical", F.col("w.field").alias("field"))
    return keyed.filter("match_key <> ''")


def resolved(cands: DataFrame) -> DataFrame:
    """For each key its best candidate, by rank, logical name, physical name and field. A minimum of structs, which
    is pre-aggregated, instead of a window."""
    best = cands.groupBy("match_key").agg(F.min(F.struct("rank", "logical", "physical", "field")).alias("b"))
    return best.select("match_key", "b.*")


def abbreviations(words: DataFrame, today: str) -> DataFrame:
    """physical, logical: each physical name's first logical name, by word_id."""
    live = words.filter(~is_expired(F.col("expire"), today) & (F.coalesce(F.trim("physical"), F.lit("")) != ""))
    return live.groupBy("physical").agg(F.min_by(F.coalesce("logical", F.lit("")), "word_id").alias("logical"))


def first_terms(terms: DataFrame, today: str, by: str) -> DataFrame:
    """For each logical key or physical name the first living term, by term_id."""
    live = terms.filter(~is_expired(F.col("expire"), today))
    key = plain_key(F.col("logical")) if by == "logical" else F.col("physical")
    own = live.select(key.alias("key"), F.struct("term_id", "logical", "physical", "domain_name", composed_type(F.col("data_type"), F.col("data_length"), F.col("data_scale")).alias("data_type")).alias("t"))
    return own.filter("key <> ''").groupBy("key").agg(F.min("t").alias("t")).select("key", "t.logical", "t.physical", "t.domain_name", "t.data_type")


def most_frequent(df: DataFrame, by: str, what: list[str], order: str) -> DataFrame:
    """For each value of `by` its most frequent combination of `what`, of equal ones that of the smallest `order`."""
    counts = df.groupBy(by, *what).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", *what, "n")).alias("b"), F.count("*").alias("n_variants"))
    return best.select(by, *[f"b.{w}" for w in what], F.col("b.n").alias("n"), "n_variants")


def classifier_types(terms: DataFrame, words: DataFrame, today: str) -> DataFrame:
    """Logical, domain_name, data_type, n, n_variants: each classifier's usual domain and type, by the last part of the
    physical names of living terms with a type."""
    live = terms.filter(~is_expired(F.col("expire"), today) & (F.coalesce("physical", F.lit("")) != ""))
    first = live.groupBy("physical").agg(F.min(F.struct("term_id", F.coalesce("domain_name", F.lit("")).alias("domain_name"), composed_type(F.col("data_type"), F.col("data_length"), F.col("data_scale")).alias("data_type"))).alias("t"))
    typed = first.select(F.substring_index("physical", "_", -1).alias("physical"), "t.*").filter("data_type is not null")
    heads = words.filter(~is_expired(F.col("expire"), today) & is_standard(F.col("is_std")) & (F.col("is_classifier").cast("int") == 1) & F.col("physical").isNotNull() & F.col("logical").isNotNull())
    heads = heads.groupBy("physical").agg(F.min_by("logical", "word_id").alias("logical"))
    return most_frequent(typed.join(heads, "physical"), "logical", ["domain_name", "data_type"], "term_id")


def domain_types(domains: DataFrame, key: str = "domain_name", order: str = "term_id") -> DataFrame:
    """Each domain's usual type, and whether it is the only one (single)."""
    return most_frequent(domains.filter(f"data_type is not null and {key} is not null"), key, ["data_type"], order).withColumn("single", F.col("n_variants") == 1)


def cleaned_comment(c: Column) -> Column:
    """A comment without bracketed remarks and marks."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), REMARK, " "), MARK, " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


#: Keys, at most, that are handed to all executors.
KEYS_MOST = 500_000
TOKEN = "struct<frag: string, logical: string, abbr: string, matched: boolean, via: string>"


class Words:
    """Keys by their first character and length: the longest key at a place takes one look-up for each length that occurs."""

    def __init__(self, keys: dict[str, tuple[str, str, str]]):
        self.keys = keys
        self.lengths: dict[str, list[int]] = {}
        for k in keys:
            own = self.lengths.setdefault(k[0], [])
            if len(k) not in own:
                own.append(len(k))
        for own in self.lengths.values():
            own.sort(reverse=True)

    def tokens(self, text: str) -> list[dict]:
        """The longest keys from left to right; what lies between, of two characters at least, unmatched."""
        out, at, open_ = [], 0, 0

        def rest(end: int) -> None:
            if end - open_ >= 2:
                out.append({"frag": text[open_:end], "logical": None, "abbr": None, "matched": False, "via": "unmatched"})

        while at < len(text):
            n = next((n for n in self.lengths.get(text[at], ()) if text[at : at + n] in self.keys), 0)
            if n:
                rest(at)
                k = text[at : at + n]
                logical, physical, field = self.keys[k]
                out.append({"frag": k, "logical": logical, "abbr": physical, "matched": True, "via": field})
                open_ = at + n
            at += n or 1
        rest(len(text))
        return out


def segmented(texts: DataFrame, keys: DataFrame, most: int = KEYS_MOST) -> DataFrame:
    """Text, tokens: the longest keys from left to right; what lies between is an unmatched token, if of two
    characters at least.

    texts: text (a match key, each once); keys: resolved candidates. Up to `most` keys go to all executors; beyond, the
    texts' parts of the lengths that keys have are joined with the keys, so that neither side must fit in memory, and only
    a text's own hits are gathered. Both ways give the same result.
    """
    own = keys.select("match_key", "logical", "physical", "field").filter("match_key <> ''")
    if own.limit(most + 1).count() <= most:
        shared = texts.sparkSession.sparkContext.broadcast({r[0]: (r[1], r[2], r[3]) for r in own.collect()})

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = Words(shared.value)
            for b in batches:
                yield pd.DataFrame({"text": b["text"], "tokens": [words.tokens(t) if t else [] for t in b["text"]]})

        return texts.select("text").mapInPandas(work, f"text string, tokens array<{TOKEN}>")
    lengths = F.array(*[F.lit(r[0]) for r in own.select(F.length("match_key")).distinct().collect()])
    places = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    subs = texts.filter("text <> ''").select("text", F.explode(lengths).alias("n")).filter("n <= length(text)").select("text", "n", F.explode(F.slice(places, F.lit(1), F.length("text") - F.col("n") + 1)).alias("i"))
    hits = subs.withColumn("match_key", F.col("text").substr(F.col("i"), F.col("n"))).join(own, "match_key")
    listed = hits.groupBy("text").agg(F.collect_list(F.struct("match_key", "logical", "physical", "field")).alias("hits"))

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own_keys = [{h["match_key"]: (h["logical"], h["physical"], h["field"]) for h in hs} if hs is not None else {} for hs in b["hits"]]
            yield pd.DataFrame({"text": b["text"], "tokens": [Words(k).tokens(t) if t else [] for t, k in zip(b["text"], own_keys, strict=True)]})

    return texts.select("text").join(listed, "text", "left").mapInPandas(alone, f"text string, tokens array<{TOKEN}>")


def physical_tokens(texts: DataFrame, keys: DataFrame, abbrs: DataFrame) -> DataFrame:
    """Text, tokens: the words of identifiers or English text, a physical name first, then any key."""
    words = texts.select("text", F.posexplode(F.flatten(F.transform(F.split(F.regexp_replace("text", r"\s+", "_"), "_"), lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(identifier_words(p))))).alias("pos", "frag"))
    words = words.withColumn("match_key", F.upper(F.regexp_replace("frag", r"[^\p{L}\p{N}]+", "")))
    hit = words.join(abbrs.select(F.col("physical").alias("frag"), F.col("logical").alias("abbr_logical"), F.lit(True).alias("is_abbr")), "frag", "left").join(keys.select("match_key", "logical", "physical", "field"), "match_key", "left")
    token = F.when(F.col("is_abbr"), F.struct("frag", F.col("abbr_logical").alias("logical"), F.col("frag").alias("abbr"), F.lit(True).alias("matched"), F.lit("physical").alias("via"))).otherwise(
        F.struct("frag", "logical", F.col("physical").alias("abbr"), F.col("physical").isNotNull().alias("matched"), F.coalesce("field", F.lit("unmatched")).alias("via"))
    )
    return hit.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", token.alias("t")))).alias("l")).select("text", F.transform("l", lambda x: x["t"]).alias("tokens"))


def composed_name(tokens: Column) -> Column:
    """The tokens' abbreviations; an unmatched one stands in guillemets."""
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(t["abbr"], F.concat(F.lit("«"), F.upper(t["frag"]), F.lit("»")))), "_")


def inferred_types(tokens: DataFrame, classifiers: DataFrame, domains: DataFrame) -> DataFrame:
    """Kind, text, domain_name, data_type by the last token of tokens (kind, text, tokens) that is a classifier
    (classifier_types); the domain's usual type (domain_types) goes before the classifier's own."""
    each = tokens.select("kind", "text", F.posexplode("tokens").alias("pos", "t")).select("kind", "text", "pos", F.col("t.logical").alias("logical"))
    hit = each.join(classifiers.select("logical", "domain_name", "data_type"), "logical")
    last = hit.groupBy("kind", "text").agg(F.max(F.struct("pos", "domain_name", "data_type")).alias("b")).select("kind", "text", "b.domain_name", F.col("b.data_type").alias("own_type"))
    usual = domains.select("domain_name", F.col("data_type").alias("usual"))
    return last.join(usual, "domain_name", "left").select("kind", "text", "domain_name", F.coalesce("usual", "own_type").alias("data_type"))


def probed(term: str, words: DataFrame, terms: DataFrame, today: str) -> DataFrame:
    """How one term is known: its key, whether it is a term's or a word's name, what it stands for, through which field,
    and the name, tier and tokens that are recommended for it."""
    spark = words.sparkSession
    key = spark.createDataFrame([(term,)], "term string").select("term", match_key(F.col("term")).alias("match_key"), plain_key(F.col("term")).alias("term_key"))
    rec = recommended(spark.createDataFrame([(term, term)], "column_name string, col_comment string"), words, terms, today)
    as_term = first_terms(terms, today, "logical").select(F.col("key").alias("term_key"), F.lit(True).alias("is_term"))
    as_word = resolved(candidates(words, today)).select("match_key", F.col("logical").alias("resolved_logical"), F.col("physical").alias("abbr"), F.col("field").alias("matched_field"))
    got = key.join(as_term, "term_key", "left").join(as_word, "match_key", "left").join(rec.select(F.col("column_name").alias("term"), "tobe_name", "tier", "tokens"), "term", "left")
    return got.select("term", "match_key", F.coalesce("is_term", F.lit(False)).alias("in_terms"), F.col("abbr").isNotNull().alias("in_words"), "resolved_logical", "matched_field", "abbr", "tobe_name", "tier", "tokens")


def retrieved_terms(comments: DataFrame, collection: DataFrame, embed, k: int = 5, batch: int = 64) -> DataFrame:
    """query_id, vec_id, distance, rank: the k terms of a collection (vec_id, embedding) nearest to each distinct comment
    (query_id, comment), cleaned; a blank one, or one without a vector, has none."""
    from quarrylane.operators.vectors import embedded, nearest

    asked = comments.select("query_id", cleaned_comment(F.col("comment")).alias("c"), F.trim("comment").alias("raw")).withColumn("text", F.when(F.col("c") != "", F.col("c")).otherwise(F.col("raw"))).filter("text <> ''")
    texts = embedded(asked.select(F.col("text").alias("id"), "text").distinct(), embed, batch).filter("embedding is not null").select("text", "embedding")
    return nearest(collection.select("vec_id", "embedding"), asked.join(texts, "text").select(F.col("query_id").alias("vec_id"), "embedding"), k, same_ids=False)


def saved(words: DataFrame, terms: DataFrame, path: str, stamp: str) -> None:
    """The dictionaries written anew at path, with the stamp (a date or hash) of what they were made from."""
    words.write.mode("overwrite").parquet(f"{path}/word")
    terms.write.mode("overwrite").parquet(f"{path}/term")
    words.sparkSession.createDataFrame([(stamp,)], "stamp string").coalesce(1).write.mode("overwrite").parquet(f"{path}/stamp")


def is_stale(spark, path: str, stamp: str) -> bool:
    """Whether what is written at path was made from something else, or isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return [r[0] for r in spark.read.parquet(f"{path}/stamp").collect()] != [stamp]
    except AnalysisException:
        return True


def loaded(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The word and term dictionaries at path."""
    return spark.read.parquet(f"{path}/word"), spark.read.parquet(f"{path}/term")


def recommended(columns: DataFrame, words: DataFrame, terms: DataFrame, today: str, domains: DataFrame | None = None) -> DataFrame:
    """A name, tier and confidence for each distinct column name and comment.

    columns: column_name, col_comment. A Hangul comment is looked up as a term, then cut into words; an English one is
    resolved word by word; without a comment the column's name is looked up and resolved. tier: exact, already_standard,
    composed, partial or unmatched; confidence: the share of matched tokens to two decimals. Where no term gives domain
    and type, the last classifier among the tokens does (see inferred_types; domains: domain_name, data_type, term_id as order,
    those of the terms where None).
    """
    pairs = columns.select("column_name", "col_comment").distinct()
    pairs = pairs.withColumn("cleaned", cleaned_comment(F.col("col_comment")))
    basis = F.when(F.col("cleaned") == "", "column").otherwise("comment")
    hangul = has_hangul(F.col("cleaned"))
    pairs = pairs.withColumn("basis", basis).withColumn("route", F.when(F.col("cleaned") == "", "physical").when(hangul, "hangul").otherwise("english"))
    pairs = pairs.withColumn("term_key", F.when(F.col("route") == "hangul", plain_key(F.col("cleaned")))).withColumn(
        "text", F.when(F.col("route") == "hangul", match_key(F.col("cleaned"))).when(F.col("route") == "english", F.col("cleaned")).otherwise(F.col("column_name"))
    )
    keys, abbrs = cut(resolved(candidates(words, today))), abbreviations(words, today)
    by_logical = first_terms(terms, today, "logical").select(F.col("key").alias("term_key"), F.col("physical").alias("term_name"), F.col("domain_name").alias("term_domain"), F.col("data_type").alias("term_type"))
    by_name = first_terms(terms, today, "physical").select(F.col("key").alias("own_key"), F.col("domain_name").alias("own_domain"), F.col("data_type").alias("own_type"))
    hangul_tokens = segmented(pairs.filter("route = 'hangul'").select("text").distinct(), keys).withColumn("kind", F.lit("hangul"))
    parts = physical_tokens(pairs.filter("route <> 'hangul'").select("text").distinct(), keys, abbrs).withColumn("kind", F.lit("other"))
    tokens = cut(hangul_tokens.unionByName(parts))
    typed = terms.select("term_id", "domain_name", composed_type(F.col("data_type"), F.col("data_length"), F.col("data_scale")).alias("data_type")) if domains is None else domains
    guessed = inferred_types(tokens, classifier_types(terms, words, today), domain_types(typed)).select("kind", "text", F.col("domain_name").alias("guessed_domain"), F.col("data_type").alias("guessed_type"))
    pairs = pairs.withColumn("kind", F.when(F.col("route") == "hangul", "hangul").otherwise("other")).withColumn("own_key", F.when(F.col("route") == "physical", F.upper("column_name")))
    all_ = pairs.join(by_logical, "term_key", "left").join(by_name, "own_key", "left").join(tokens, ["kind", "text"], "left").join(guessed, ["kind", "text"], "left")
    n, m = F.coalesce(F.greatest(F.size("tokens"), F.lit(0)), F.lit(0)), F.size(F.filter(F.coalesce("tokens", F.expr("array()")), lambda t: t["matched"]))
    name = composed_name(F.col("tokens"))
    exact, own = F.col("term_name").isNotNull(), F.col("own_type").isNotNull() | F.col("own_domain").isNotNull()
    tier = (
        F.when(exact, "exact").when(own, "already_standard").when((n > 0) & (m == n) & (F.col("kind") == "other") & (name == F.upper("column_name")), "already_standard")
        .when((n > 0) & (m == n), "composed").when(m > 0, "partial").otherwise("unmatched")
    )
    out = all_.select(
        "column_name", "col_comment", "basis",
        F.when(exact, F.col("term_name")).when(own, F.upper("column_name")).otherwise(name).alias("tobe_name"),
        tier.alias("tier"),
        F.when(exact | own, 1.0).when(n > 0, F.bround(m / n, 2)).otherwise(0.0).alias("confidence"),
        F.when(exact, F.col("term_domain")).when(own, F.col("own_domain")).otherwise(F.col("guessed_domain")).alias("domain_name"),
        F.when(exact, F.col("term_type")).when(own, F.col("own_type")).otherwise(F.col("guessed_type")).alias("data_type"),
        "tokens",
    )
    return out.withColumn("too_long", F.length("tobe_name") > MAX_NAME)


def recommendation_stats(recs: DataFrame) -> DataFrame:
    """Rows of each tier, of low confidence (under one half but over nothing) and of too long names."""
    return recs.groupBy("tier").agg(F.count("*").alias("n"), F.count(F.when((F.col("confidence") > 0) & (F.col("confidence") < 0.5), 1)).alias("low_confidence"), F.count(F.when(F.col("too_long"), 1)).alias("too_long"))


def needs_help(recs: DataFrame) -> DataFrame:
    """What a reviewer or a model must look at: unmatched, or with an unmatched fragment."""
    return recs.filter((F.col("tier") == "unmatched") | F.exists(F.coalesce("tokens", F.expr("array()")), lambda t: ~t["matched"]))


def ranked_candidates(recs: DataFrame, n: int = 5) -> DataFrame:
    """Rows in order of confidence for a bounded report: n of each tier, by name."""
    w = W.Window.partitionBy("tier").orderBy("confidence", "column_name", "col_comment")
    return recs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
