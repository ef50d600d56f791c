"""Chunks and nearest vectors (survey section 2.10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Query vectors that are handed to all executors at once.
QUERY_BLOCK = 4096


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each row in order, of equal ones by id, with their ids. Only what doesn't exceed the k-th
    one is sorted."""
    near = np.round(d, 12)
    row, col = np.nonzero(near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((ids[row, col], near[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, rank = row[rank < k], col[rank < k], rank[rank < k]
    out_d, out_i = np.full((len(d), k), np.inf), np.full((len(d), k), np.iinfo(np.int64).max)
    out_d[row, rank], out_i[row, rank] = d[row, col], ids[row, col]
    return out_d, out_i


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK, metric: str = "cosine", same_ids: bool = True) -> DataFrame:
    """I4: query_id, vec_id, rank, distance: the k nearest other vectors of each query, exactly, of equal ones the first by id.
    Ids of both sides mean the same things, unless same_ids is False. Vectors of another length than the query's don't count.

    vectors, queries: vec_id, embedding. The query set goes to all executors in blocks of bounded size; each batch of
    vectors is compared with a block by one matrix product and keeps k of each query, so that only partitions times k
    rows a query are shuffled. A null, empty or (for cosine) zero vector is at no distance and gives no row.
    """
    spark = vectors.sparkSession
    out: DataFrame | None = None

    def matched(ids: list[int], rows: list[list[float]]) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(rows, np.float64)))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            qn = np.linalg.norm(q, axis=1)
            best_d = np.full((len(qid), k), np.inf)
            best_i = np.full((len(qid), k), np.iinfo(np.int64).max)
            for b in batches:
                b = b[b["embedding"].map(lambda e: e is not None and len(e) == q.shape[1])]
                if not len(b):
                    continue
                v, vid = np.stack(b["embedding"].to_numpy()).astype(np.float64), b["vec_id"].to_numpy(np.int64)
                if metric == "cosine":
                    vn = np.linalg.norm(v, axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = 1 - (q @ v.T) / (qn[:, None] * vn[None, :])
                else:
                    d = np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * (q @ v.T), 0)
                d[np.isnan(d)] = np.inf
                if same_ids:
                    d[qid[:, None] == vid[None, :]] = np.inf
                best_d, best_i = smallest(np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(vid, d.shape)]), k)
            keep = np.isfinite(best_d)
            yield pd.DataFrame({"query_id": np.repeat(qid, keep.sum(1)), "vec_id": best_i[keep], "distance": best_d[keep]})

        return vectors.select("vec_id", "embedding").mapInPandas(work, "query_id bigint, vec_id bigint, distance double")

    sizes: dict[int, tuple[list, list]] = {}
    for r in queries.filter("embedding is not null and size(embedding) > 0").select("vec_id", "embedding").toLocalIterator():
        ids, rows = sizes.setdefault(len(r[1]), ([], []))
        ids.append(r[0])
        rows.append(list(r[1]))
        if len(ids) == block:
            one = matched(*sizes.pop(len(r[1])))
            out = one if out is None else out.unionByName(one)
    for ids, rows in sizes.values():
        one = matched(ids, rows)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, vec_id bigint, distance double")
    w = W.Window.partitionBy("query_id").orderBy(F.round("distance", 12), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merged_nearest(collections: dict[str, DataFrame], k: int) -> DataFrame:
    """I4: the k nearest over several collections' results, by distance, collection and id."""
    out = None
    for name, df in collections.items():
        one = df.withColumn("collection", F.lit(name))
        out = one if out is None else out.unionByName(one)
    w = W.Window.partitionBy("query_id").orderBy("distance", "collection", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def schema_chunks(columns: DataFrame, size: int = 30) -> DataFrame:
    """table_name, chunk, n_columns, text: a table of up to `size` columns is one chunk, a larger one is cut.

    columns: table_name, column_name, col_no. Columns are made distinct first, so a table's group holds no more rows
    than the table has columns.
    """
    own = columns.groupBy("table_name", "column_name").agg(F.min("col_no").alias("col_no"))
    numbered = own.withColumn("r", F.row_number().over(W.Window.partitionBy("table_name").orderBy("col_no", "column_name")))
    parts = numbered.withColumn("chunk", F.floor((F.col("r") - 1) / size))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "column_name"))), lambda x: x["column_name"]), ", ")
    return parts.groupBy("table_name", "chunk").agg(F.count("*").alias("n_columns"), listed.alias("columns")).select("table_name", "chunk", "n_columns", F.concat_ws(": ", "table_name", "columns").alias("text"))


def line_chunks(lines: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Lines by `size` in order within each group: group, chunk, n, text."""
    numbered = lines.withColumn("r", F.row_number().over(W.Window.partitionBy(group).orderBy(order))).withColumn("chunk", F.floor((F.col("r") - 1) / size))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy(group, "chunk").agg(F.count("*").alias("n"), listed.alias("text"))


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 10) -> DataFrame:
    """Chunks (id, text) with their vectors by a given function, batch by batch; a batch that fails is left out and
    reported by null."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                try:
                    vectors = embed(part["text"].tolist())
                except Exception:  # noqa: BLE001 - one batch must not end the others
                    vectors = [None] * len(part)
                yield pd.DataFrame({"id": part["id"], "text": part["text"], "embedding": vectors})

    return chunks.select("id", "text").mapInPandas(work, "id string, text string, embedding array<float>")


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old with new's rows in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def first_by_text(hits: DataFrame, order: str, length: int = 200) -> DataFrame:
    """Hits without those whose first characters an earlier hit has."""
    return hits.withColumn("head", F.left("text", F.lit(length))).groupBy("head").agg(F.min_by(F.struct(*hits.columns), order).alias("h")).select("h.*")


def schema_documents(columns: DataFrame, constraints: DataFrame, size: int = 30) -> DataFrame:
    """table_name, kind, chunk, text for retrieval. A table of up to `size` columns is one chunk (whole); a larger one has an
    overview (its name, comment and number of columns) and groups of columns; either has a chunk of its constraints where
    it has any.

    columns: table_name, table_comment, column_name, col_no, data_type; constraints: table_name, kind, detail.
    """
    line = F.trim(F.concat_ws(" ", "column_name", F.coalesce("data_type", F.lit(""))))
    own = columns.groupBy("table_name", "column_name").agg(F.min("col_no").alias("col_no"), F.min("data_type").alias("data_type")).withColumn("line", line)
    sized = own.withColumn("r", F.row_number().over(W.Window.partitionBy("table_name").orderBy("col_no", "column_name"))).withColumn("chunk", F.floor((F.col("r") - 1) / size))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), ", ")
    groups = sized.groupBy("table_name", "chunk").agg(listed.alias("columns"))
    heads = columns.groupBy("table_name").agg(F.max("table_comment").alias("table_comment"), F.count_distinct("column_name").alias("n"))
    title = F.concat_ws(" - ", "table_name", "table_comment")
    joined = groups.join(heads, "table_name")
    parts = joined.select("table_name", F.when(F.col("n") <= size, "whole").otherwise("columns").alias("kind"), "chunk", F.concat_ws(": ", F.when(F.col("n") <= size, title).otherwise(F.col("table_name")), "columns").alias("text"))
    overview = heads.filter(F.col("n") > size).select("table_name", F.lit("overview").alias("kind"), F.lit(0).cast("bigint").alias("chunk"), F.concat_ws(": ", title, F.concat(F.col("n").cast("string"), F.lit(" columns"))).alias("text"))
    detail = F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "kind", "detail"))), "; ")
    footer = constraints.groupBy("table_name").agg(detail.alias("c")).select("table_name", F.lit("constraints").alias("kind"), F.lit(0).cast("bigint").alias("chunk"), F.concat_ws(": ", "table_name", "c").alias("text"))
    return parts.unionByName(overview).unionByName(footer.join(heads.select("table_name"), "table_name", "left_semi"))


def query_documents(edges: DataFrame, crud: DataFrame, usage: DataFrame, relations: int = 15, queries: int = 5) -> DataFrame:
    """Kind, part, chunk, text, tables for retrieval: relations by 15, each mapper's statements by 5, and the tables' use.

    edges: table1, column1, table2, column2, join_type; crud: mapper, id, table_name, crud; usage: table_name and counts.
    Relations are put together by their first table, so that no chunk needs a global order.
    """
    rel = edges.select(F.lit("relation").alias("kind"), F.col("table1").alias("part"), F.format_string("%s.%s = %s.%s (%s)", "table1", "column1", "table2", "column2", "join_type").alias("line"), F.array("table1", "table2").alias("ts"))
    statements = crud.groupBy("mapper", "id").agg(F.array_sort(F.collect_set("table_name")).alias("ts"), F.array_join(F.array_sort(F.collect_set(F.format_string("%s(%s)", "table_name", "crud"))), ", ").alias("l"))
    own = statements.select(F.lit("query").alias("kind"), F.col("mapper").alias("part"), F.concat_ws(": ", "id", "l").alias("line"), "ts")
    counts = F.array_join(F.transform(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in usage.columns if c != "table_name"]), lambda x: F.concat_ws("=", x["k"], x["v"])), " ")
    used = usage.select(F.lit("usage").alias("kind"), F.col("table_name").alias("part"), F.concat_ws(": ", "table_name", counts).alias("line"), F.array("table_name").alias("ts"))
    every = rel.unionByName(own).unionByName(used)
    size = F.when(F.col("kind") == "relation", relations).when(F.col("kind") == "query", queries).otherwise(1)
    numbered = every.withColumn("r", F.row_number().over(W.Window.partitionBy("kind", "part").orderBy("line"))).withColumn("chunk", F.floor((F.col("r") - 1) / size))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("kind", "part", "chunk").agg(text.alias("text"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ts")))), ",").alias("tables"))


def term_texts(terms: DataFrame) -> DataFrame:
    """Id, text of each distinct logical name: the name and the first description; terms: logical, physical, term_desc."""
    own = terms.filter("trim(logical) <> '' and trim(physical) <> ''").groupBy("logical", "physical").agg(F.min("term_desc").alias("term_desc"))
    return own.select(F.concat_ws("|", "logical", "physical").alias("id"), F.trim(F.concat_ws(" ", "logical", "term_desc")).alias("text"))


def rebuilt(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str, batch: int = 64) -> DataFrame:
    """A collection (id, text, embedding) written anew at path, in place of what was there; what has no vector is left
    out."""
    embedded(chunks, embed, batch).filter("embedding is not null").write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def collection(spark: SparkSession, path: str) -> DataFrame:
    """A collection written by rebuilt, as vec_id, embedding and text for nearest."""
    return spark.read.parquet(path).select(F.col("id").alias("vec_id"), "embedding", "text")
