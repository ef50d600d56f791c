"""Operators that ask an outside service (survey section 2.13): batching, retries and answers; the service itself is a function
that the caller gives. None is called by default."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers below this confidence are marked.
LOW = 0.7
#: What a filled-in comment is marked with.
MARK = " (추천)"


def batch_size(texts: list[str], budget: int = 1200, least: int = 10, most: int = 50) -> int:
    """K4: how many texts go into one request, by their mean length."""
    if not texts:
        return least
    return max(least, min(most, int(budget / max(sum(map(len, texts)) / len(texts), 1))))


def answers(text: str | None) -> list[dict]:
    """The objects of a JSON answer, which may be fenced, cut off or broken: whole objects count."""
    text = (text or "").strip()
    if m := re.search(r"```(?:json)?\s*(.*?)```", text, re.S):
        text = m[1].strip()
    try:
        got = json.loads(text)
        return [x for x in (got if isinstance(got, list) else [got]) if isinstance(x, dict)]
    except ValueError:
        pass
    out, decoder, at = [], json.JSONDecoder(), 0
    while (at := text.find("{", at)) >= 0:
        for piece in (text[at:], re.sub(r",\s*([}\]])", r"\1", text[at:])):
            try:
                got, n = decoder.raw_decode(piece)
            except ValueError:
                continue
            out.append(got)
            at += n - 1 if piece == text[at:] else 0
            break
        at += 1
    return out


def asked(items: DataFrame, ask: Callable[[list[str]], str], key: str = "id", text: str = "text", size: int | None = None) -> DataFrame:
    """id, text, answer (JSON), ok: each text's answer, batch by batch. An answer names its text by 'id' (its place in the batch).
    A batch that fails is halved, down to single texts, which then fail alone; repeated texts of a batch are asked once."""

    def batched(texts: list[str]) -> dict[str, dict]:
        try:
            got = {int(a["id"]): a for a in answers(ask(texts)) if str(a.get("id", "")).isdigit()}
            out = {t: got[i] for i, t in enumerate(texts) if i in got}
            if out or len(texts) == 1:
                return out
        except Exception:  # noqa: BLE001 - a service's failure must not end the job
            if len(texts) == 1:
                return {}
        half = len(texts) // 2
        return batched(texts[:half]) | batched(texts[half:])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t for t in dict.fromkeys(b["text"]) if t]
            n = size or batch_size(texts)
            got: dict[str, dict] = {}
            for at in range(0, len(texts), n):
                got |= batched(texts[at : at + n])
            out = [json.dumps(got[t], ensure_ascii=False, sort_keys=True) if t in got else None for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "text": b["text"], "answer": out, "ok": [a is not None for a in out]})

    return items.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInPandas(work, "id string, text string, answer string, ok boolean")


def morphemes(attrs: DataFrame, ask: Callable[[list[str]], str], most: int = 12) -> DataFrame:
    """K4: id, text, tokens (up to `most`), confidence, note: what a service splits names into."""
    got = asked(attrs, ask).withColumn("a", F.from_json("answer", "tokens array<string>, confidence double"))
    note = F.when(~F.col("ok"), "no answer").when(F.coalesce("a.confidence", F.lit(0.0)) < LOW, "low confidence")
    return got.select("id", "text", F.slice(F.coalesce("a.tokens", F.array().cast("array<string>")), 1, most).alias("tokens"), F.coalesce("a.confidence", F.lit(0.0)).alias("confidence"), note.alias("note"))


def filled_comments(columns: DataFrame, proposals: DataFrame) -> DataFrame:
    """K1: columns (table_name, column_name, comment) with a proposal where they have no comment; none is overwritten."""
    p = proposals.select("table_name", "column_name", "proposal")
    empty = F.trim(F.coalesce("comment", F.lit(""))) == ""
    return columns.join(p, ["table_name", "column_name"], "left").withColumn("comment", F.when(empty & F.col("proposal").isNotNull(), F.concat("proposal", F.lit(MARK))).otherwise(F.col("comment"))).drop("proposal")


def resolved_answers(words: DataFrame, keys: DataFrame) -> DataFrame:
    """Id, name, confidence: the words that a service proposes, looked up in the dictionary (match_key, physical); a word it
    lacks stays as it is, and then the confidence is one half at most."""
    each = words.select("id", F.posexplode("words").alias("pos", "word"), "confidence")
    hit = each.withColumn("match_key", F.upper(F.regexp_replace("word", r"[^\p{L}\p{N}]", ""))).join(keys.select("match_key", "physical"), "match_key", "left")
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("physical", F.upper("word")).alias("w")))), lambda x: x["w"]), "_")
    return hit.groupBy("id").agg(name.alias("name"), F.when(F.max(F.col("physical").isNull().cast("int")) == 1, F.least(F.max("confidence"), F.lit(0.5))).otherwise(F.max("confidence")).alias("confidence"))


def kept_answers(old: DataFrame, items: DataFrame, hashed: Column) -> DataFrame:
    """The items that no kept answer (hash, answer) covers, by the hash of what would be asked."""
    return items.withColumn("hash", hashed).join(old.select("hash"), "hash", "left_anti")


def answered(items: DataFrame, ask: Callable[[list[str]], str], schema: str, key: str = "id", text: str = "text", size: int | None = None) -> DataFrame:
    """id, text, ok, and the fields of schema of each answer (see asked); null where there is no answer."""
    got = asked(items, ask, key, text, size).withColumn("a", F.from_json("answer", schema))
    return got.select("id", "text", "ok", *[F.col(f"a.{f.split()[0]}") for f in re.split(r",\s*(?![^<]*>)", schema)])


def described_tables(tables: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """K2: table_name, description, domain of tables (table_name, text: columns and relations)."""
    got = answered(tables, ask, "description string, domain string", "table_name")
    return got.select(F.col("id").alias("table_name"), "description", "domain", "ok")


def proposed_relations(tables: DataFrame, ask: Callable[[list[str]], str], edges: DataFrame) -> DataFrame:
    """K2, K8: table1, column1, table2, column2: relations that a service proposes for tables (table_name, text), but for those
    that name an unknown table, or that edges have already, either way round."""
    got = answered(tables, ask, "relations array<struct<column: string, table: string, target: string>>", "table_name")
    each = got.select(F.upper("id").alias("table1"), F.explode("relations").alias("r")).select("table1", F.upper("r.column").alias("column1"), F.upper("r.table").alias("table2"), F.upper("r.target").alias("column2"))
    known = tables.select(F.upper("table_name").alias("table2")).distinct()
    both = edges.select("table1", "column1", "table2", "column2").unionByName(edges.select(F.col("table2").alias("table1"), F.col("column2").alias("column1"), F.col("table1").alias("table2"), F.col("column1").alias("column2")))
    return each.join(known, "table2", "left_semi").join(both, ["table1", "column1", "table2", "column2"], "left_anti").select("table1", "column1", "table2", "column2").distinct()


def enriched_words(words: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """K3: word, label, definition, is_kept of words (word, text, label): a label that is there stays."""
    got = answered(words, ask, "label string, definition string", "word").select(F.col("id").alias("word"), F.col("label").alias("new_label"), "definition")
    own = words.select("word", "label").join(got, "word", "left")
    kept = F.trim(F.coalesce("label", F.lit(""))) != ""
    return own.select("word", F.when(kept, F.col("label")).otherwise(F.col("new_label")).alias("label"), "definition", kept.alias("is_kept"))


def proposed_ddl(requests: DataFrame, ask: Callable[[list[str]], str], known: list[str] | None = None) -> DataFrame:
    """ddl_id, ddl, issues, ok: the statement that a service writes for a request (ddl_id, text), with the naming rules
    that its names break; ok is false where it defines no table."""
    from quarrylane.operators.naming import ddl_names, name_issues

    got = answered(requests, ask, "ddl string", "ddl_id").select(F.col("id").alias("ddl_id"), "ddl")
    names = ddl_names(got.filter("ddl is not null"))
    rules = name_issues(names.select("name", "kind").distinct(), known)
    listed = names.join(rules, ["name", "kind"]).groupBy("ddl_id").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "name", "rule"))).alias("issues"))
    defined = names.filter("kind = 'table'").select("ddl_id").distinct().withColumn("ok", F.lit(True))
    return got.join(listed, "ddl_id", "left").join(defined, "ddl_id", "left").select("ddl_id", "ddl", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), F.coalesce("ok", F.lit(False)).alias("ok"))


def reviewed(worst: DataFrame, statements: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """K6: mapper, id, review, better of the statements that lint ranks worst (see statements.worst)."""
    own = worst.select("mapper", "id").join(statements.select("mapper", "id", "sql"), ["mapper", "id"])
    got = answered(own.select(F.concat_ws("#", "mapper", "id").alias("key"), "sql"), ask, "review string, better string", "key", "sql")
    return own.select("mapper", "id", F.concat_ws("#", "mapper", "id").alias("key")).join(got.select(F.col("id").alias("key"), "review", "better"), "key").drop("key")


def proposals(findings: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """K7: place, proposal, reason for what a standardization report finds (place, text)."""
    return answered(findings, ask, "proposal string, reason string", "place").select(F.col("id").alias("place"), "proposal", "reason")


def url_patterns(urls: DataFrame, folders: DataFrame) -> DataFrame:
    """K9 without a service: prefix, strip, app_segment: the longest run of leading path segments that all URLs (url) share,
    the pattern that strips it, and 1-based the place of the segment that names an application's folder (name), null where no
    first segment behind the prefix does. Only counts of prefixes are put together."""
    parts = F.filter(F.split(F.regexp_replace("url", r"^https?://[^/]+|[?#].*$", ""), "/"), lambda p: p != "")
    own = urls.select(parts.alias("p")).filter("size(p) > 0")
    total = own.agg(F.count("*").alias("total"))
    heads = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.struct(i.alias("n"), F.concat(F.lit("/"), F.array_join(F.slice("p", 1, i), "/")).alias("prefix")))).alias("h"))
    shared = heads.groupBy("h.n", "h.prefix").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).filter("c = total")  # one row
    best = shared.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max_by("prefix", "n").alias("prefix"))
    at = own.crossJoin(F.broadcast(best)).select(F.lower(F.try_element_at("p", F.col("n") + 1)).alias("name"))  # one row
    hit = at.join(folders.select(F.lower("name").alias("name")).distinct(), "name", "left_semi").agg((F.count("*") > 0).alias("any"))
    return best.crossJoin(hit).select(F.coalesce("prefix", F.lit("")).alias("prefix"), F.when(F.col("n") > 0, F.concat(F.lit("^"), "prefix", F.lit("(?=/|$)"))).alias("strip"), F.when(F.col("any"), F.col("n") + 1).alias("app_segment"))


def discovered_patterns(samples: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """K9: kind, pattern: what a service finds in sample files (path, text); each once, with the number of files."""
    got = answered(samples, ask, "patterns array<struct<kind: string, pattern: string>>", "path")
    return got.select(F.explode("patterns").alias("p")).groupBy("p.kind", "p.pattern").agg(F.count("*").alias("n"))


def described_methods(methods: DataFrame, ask: Callable[[list[str]], str], kept: DataFrame | None = None) -> DataFrame:
    """Key, hash, summary of methods (key, body): a kept answer (hash, summary) of the same body counts, the others are
    asked for, each distinct body once; without an answer the body's first comment or words stand for it."""
    from quarrylane.operators.lineage import body_hash

    own = methods.withColumn("hash", body_hash(F.col("body")))
    bodies = own.groupBy("hash").agg(F.min("body").alias("body"))
    old = kept.select("hash", "summary") if kept is not None else bodies.select("hash", F.lit(None).cast("string").alias("summary")).limit(0)
    asked_ = answered(bodies.join(old.select("hash"), "hash", "left_anti"), ask, "summary string", "hash", "body").select(F.col("id").alias("hash"), "summary")
    fallback = F.coalesce(F.nullif(F.trim(F.regexp_extract("body", r"(?://+|/\*+)\s*([^\n*]+)", 1)), F.lit("")), F.left(F.trim(F.regexp_replace("body", r"\s+", " ")), F.lit(80)))
    return own.join(old.unionByName(asked_.filter("summary is not null")), "hash", "left").select("key", "hash", F.coalesce("summary", fallback).alias("summary"), F.col("summary").isNotNull().alias("is_answer"))


def bundles(triggers: DataFrame, parts: DataFrame, budget: int = 3500) -> DataFrame:
    """Trigger, text, n_parts, n_left_out: the sources behind each trigger (trigger, key; parts: key, rank, text), in
    order of rank, as long as they fit the budget of characters."""
    from pyspark.sql import window as W

    own = triggers.join(parts, "key").select("trigger", "rank", "key", "text")
    w = W.Window.partitionBy("trigger").orderBy("rank", "key").rowsBetween(W.Window.unboundedPreceding, 0)
    spent = own.withColumn("spent", F.sum(F.length("text")).over(w)).withColumn("fits", F.col("spent") <= budget)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", "key", "text")))), lambda x: x["text"]), "\n")
    return spent.groupBy("trigger").agg(listed.alias("text"), F.count(F.when(F.col("fits"), 1)).alias("n_parts"), F.count(F.when(~F.col("fits"), 1)).alias("n_left_out"))


def described_triggers(bundled: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """Trigger, summary, validations of bundles."""
    got = answered(bundled.select("trigger", "text"), ask, "summary string, validations array<string>", "trigger")
    return got.select(F.col("id").alias("trigger"), "summary", F.coalesce("validations", F.array().cast("array<string>")).alias("validations"))


def screen_layouts(screens: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """Path, row_no, col_no, kind, label of screens by their sources, or by captures in base 64 (path, text)."""
    got = answered(screens, ask, "elements array<struct<row: int, col: int, kind: string, label: string>>", "path")
    return got.select(F.col("id").alias("path"), F.explode("elements").alias("e")).select("path", F.col("e.row").alias("row_no"), F.col("e.col").alias("col_no"), "e.kind", "e.label")


def converted_mapping(lines: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """Rows of migrate.MAPPING from free text (line_id, text); an answer without table and column is none."""
    got = answered(lines, ask, "as_is_table string, as_is_column string, as_is_type string, to_be_table string, to_be_column string, to_be_type string", "line_id")
    return got.filter("trim(as_is_table) <> '' and trim(as_is_column) <> ''").drop("id", "text", "ok")


def rewritten_by_service(out: DataFrame, mapping: DataFrame, ask: Callable[[list[str]], str], least: float = LOW) -> DataFrame:
    """Mapper, id, to_be_sql, status of the statements that need help (see migrate.rewritten): a service is asked with the
    statement and the mapping rows of the tables it names; an answer below `least`, or one that can't be read as a
    statement, is UNRESOLVED and leaves the statement as it was."""
    from quarrylane.operators import sqltext

    need = out.filter("status in ('NEEDS_LLM', 'PARSE_FAIL')").select("mapper", "id", "sql", "to_be_sql")
    words = need.select("mapper", "id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("sql"), F.lit(r"(\w+)"), F.lit(1)))).alias("as_is_table"))
    line = F.format_string("%s.%s -> %s.%s", "as_is_table", "as_is_column", F.coalesce("to_be_table", F.lit("-")), F.coalesce("to_be_column", F.lit("-")))
    rules = words.join(mapping.select("as_is_table", line.alias("line")), "as_is_table").groupBy("mapper", "id").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("rules"))
    items = need.join(rules, ["mapper", "id"], "left").select(F.concat_ws("#", "mapper", "id").alias("key"), F.concat_ws("\n", "sql", "rules").alias("text"))
    got = answered(items, ask, "sql string, confidence double", "key").select(F.col("id").alias("key"), F.col("sql").alias("proposal"), "confidence")
    readable = F.udf(lambda q: sqltext.fault(q) is None, "boolean")
    good = F.coalesce((F.col("confidence") >= least) & readable("proposal"), F.lit(False))
    joined = need.withColumn("key", F.concat_ws("#", "mapper", "id")).join(got, "key", "left")
    return joined.select("mapper", "id", F.when(good, F.col("proposal")).otherwise(F.col("to_be_sql")).alias("to_be_sql"), F.when(good, "LLM").otherwise("UNRESOLVED").alias("status"))
