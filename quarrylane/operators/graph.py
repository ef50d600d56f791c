"""Graphs of tables and files (survey section 2.4)."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarrylane.session import cut


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, other: each edge in both directions, without loops and repeats."""
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).filter("node is not null and other is not null and node <> other")
    return e.unionByName(e.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Node, degree (distinct neighbours). edges: src, dst."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, usage: DataFrame | None = None, manual: DataFrame | None = None, threshold: int | None = None) -> DataFrame:
    """Node: the common tables. A manual list (node) wins; else those used (node, main, joined) as joined table in at
    least 80 % of their uses and three times; else those of at least threshold neighbours (30 % of the nodes, five at
    least)."""
    own = degrees(edges)
    if manual is not None:
        return own.join(manual.select("node").distinct(), "node", "left_semi").select("node")
    if usage is not None:
        return own.join(usage, "node").filter("joined >= 3 and joined / (main + joined) >= 0.8").select("node")
    if threshold is None:
        total = own.agg(F.greatest(F.lit(5), F.floor(F.count("*") * 0.3)).alias("t"))
        return own.crossJoin(F.broadcast(total)).filter("degree >= t").select("node")  # one row
    return own.filter(F.col("degree") >= threshold).select("node")


def components(edges: DataFrame, without: DataFrame | None = None, most: int = 60) -> DataFrame:
    """Node, component: connected components, each named by its smallest node.

    edges: src, dst; without: node, left out with their edges. Each round every node takes the smallest label among its
    neighbours and then the label of its label (so labels travel in leaps); the rounds end when none changes. Lineage
    is cut each round in the shared folder. A node of many neighbours only needs their minimum, which is
    pre-aggregated, so no group is gathered.
    """
    pairs = both_ways(edges)
    if without is not None:
        pairs = pairs.join(without.select(F.col("node")), "node", "left_anti").join(without.select(F.col("node").alias("other")), "other", "left_anti")
    pairs = cut(pairs.select("node", "other"))
    labels = cut(pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    for _ in range(most):
        near = pairs.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        leap = step.join(labels.select(F.col("node").alias("component"), F.col("component").alias("far")), "component", "left")
        new = cut(leap.select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component")))
        changed = not new.filter("component <> old").isEmpty()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")


def component_sizes(members: DataFrame) -> DataFrame:
    """component, size, in order of size and name as index."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    return sizes


def split_component(members: pd.DataFrame, neighbours: dict[str, list[str]], size: int) -> list[tuple[str, int]]:
    """C4: the parts of one component: again and again the node of the most remaining neighbours (of equal ones the
    first by name) and what is near it, breadth first in order of names, up to size."""
    left, out, part = set(members), [], 0
    degree = {n: len(left.intersection(neighbours[n])) for n in left}
    # degrees only fall: a node's entries with an old one are passed over
    heap = [(-d, n) for n, d in degree.items()]
    heapq.heapify(heap)
    while left:
        d, seed = heapq.heappop(heap)
        if seed not in left or -d != degree[seed]:
            continue
        queue, own = deque([seed]), []
        while queue and len(own) < size:
            n = queue.popleft()
            if n in left:
                left.discard(n)
                own.append(n)
                near = sorted(left.intersection(neighbours[n]))
                queue += near
                for x in near:
                    degree[x] -= 1
                    heapq.heappush(heap, (-degree[x], x))
        out += [(n, part) for n in own]
        part += 1
    return out


def bounded_groups(edges: DataFrame, members: DataFrame, size: int = 30) -> DataFrame:
    """C4: node, component, part: components of up to size nodes are one part, larger ones are split.

    Only components beyond the size are split one by one, each in a task of its own: their nodes and edges are tables
    of a schema, not rows of data.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    small = members.join(sizes.filter(F.col("n") <= size), "component").select("node", "component", F.lit(0).alias("part"))
    large = members.join(sizes.filter(F.col("n") > size), "component").select("node", "component")
    near = both_ways(edges).join(large, "node").join(large.select(F.col("node").alias("other")), "other", "left_semi")

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        neighbours = defaultdict(list)
        for a, b in zip(pdf["node"], pdf["other"], strict=True):
            neighbours[a].append(b)
        rows = split_component(sorted(neighbours), neighbours, size)
        return pd.DataFrame({"node": [n for n, _ in rows], "component": pdf["component"].iloc[0], "part": [p for _, p in rows]})

    kind = members.schema["node"].dataType.simpleString()
    parts = near.select("component", "node", "other").groupBy("component").applyInPandas(split, f"node {kind}, component {kind}, part int")
    return small.unionByName(parts)


def attached_hubs(edges: DataFrame, members: DataFrame, hub: DataFrame) -> DataFrame:
    """Component, node: the hubs that each component's nodes are joined with."""
    h = both_ways(edges).join(hub.select(F.col("node").alias("other")), "other", "left_semi")
    return h.join(members, "node").select("component", F.col("other").alias("node")).distinct()


def group_joins(joins: DataFrame, members: DataFrame, hub: DataFrame) -> DataFrame:
    """Component and the columns of joins (table1, table2 and more) whose tables both are among a component's nodes or
    the hubs attached to it (component, node)."""
    inside = members.select("component", "node").unionByName(hub.select("component", "node")).distinct()
    left = joins.join(inside.withColumnRenamed("node", "table1"), "table1")
    return left.join(inside.withColumnRenamed("node", "table2"), ["component", "table2"]).select("component", *joins.columns)


def chunks(nodes: DataFrame, size: int, key: str = "node") -> DataFrame:
    """Key, chunk: nodes in order, size by size. Numbered without a single sorted task: by range partitions, whose
    counts give each its first number."""
    ordered = nodes.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("p", F.spark_partition_id())
    # written once: the partitions' numbers must be the same on both sides
    ordered = cut(ordered.withColumn("r", F.row_number().over(W.Window.partitionBy("p").orderBy(key))))
    before = ordered.groupBy("p").agg(F.count("*").alias("n")).withColumn("start", F.sum("n").over(W.Window.orderBy("p").rowsBetween(W.Window.unboundedPreceding, -1)))
    return ordered.join(F.broadcast(before), "p").select(key, F.floor((F.col("r") + F.coalesce("start", F.lit(0)) - 1) / size).alias("chunk"))  # a row a partition


def top_nodes(counted: DataFrame, group: str, node: str, n: int = 3) -> DataFrame:
    """The n nodes of the highest cnt in each group, of equal ones the first by name."""
    return counted.withColumn("rank", F.row_number().over(W.Window.partitionBy(group).orderBy(F.desc("cnt"), node))).filter(F.col("rank") <= n)


def classified(schema: DataFrame, joined: DataFrame, mentioned: DataFrame, hub: DataFrame) -> DataFrame:
    """Node, category: common, with_joins, in_xml_no_join, not_in_xml or xml_only. Each input: node."""
    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("node").distinct().withColumn(name, F.lit(True))

    every = mark(schema, "s").join(mark(joined, "j"), "node", "full").join(mark(mentioned, "m"), "node", "full").join(mark(hub, "h"), "node", "full")
    yes = lambda c: F.coalesce(c, F.lit(False))
    category = (
        F.when(yes("s") & yes("h"), "common").when(yes("s") & yes("j"), "with_joins").when(yes("s") & yes("m"), "in_xml_no_join").when(yes("s"), "not_in_xml").when(yes("m"), "xml_only")
    )
    return every.select("node", category.alias("category")).filter("category is not null")


def cardinality(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The edges with '1:1', '1:N', 'N:1' or 'N:M', by whether their columns are keys (table_name, column_name)."""
    k = keys.select("table_name", "column_name").distinct().withColumn("k", F.lit(True))
    l, r = k.toDF("table1", "column1", "k1"), k.toDF("table2", "column2", "k2")
    e = edges.join(l, ["table1", "column1"], "left").join(r, ["table2", "column2"], "left")
    return e.withColumn("cardinality", F.when(F.col("k1") & F.col("k2"), "1:1").when(F.col("k1") | F.col("k2"), "1:N").otherwise("N:M")).drop("k1", "k2")


def grouped_pairs(edges: DataFrame) -> DataFrame:
    """One row for each pair of tables, with its aligned column pairs and join types in order."""
    turned = F.col("table1") > F.col("table2")
    pair = F.when(turned, F.concat_ws("=", "column2", "column1")).otherwise(F.concat_ws("=", "column1", "column2"))
    return (
        edges.select(F.least("table1", "table2").alias("table_a"), F.greatest("table1", "table2").alias("table_b"), pair.alias("pair"), "join_type")
        .groupBy("table_a", "table_b")
        .agg(F.array_join(F.array_sort(F.collect_set("pair")), " / ").alias("columns"), F.array_join(F.array_sort(F.collect_set("join_type")), " / ").alias("join_types"), F.count("*").alias("n_joins"))
    )


def related(edges: DataFrame, tables: list[str], only_between: bool = False) -> DataFrame:
    """The edges of some tables, or only those between them."""
    a, b = F.col("table1").isin(tables), F.col("table2").isin(tables)
    return edges.filter(a & b if only_between else a | b)


def mermaid(pairs: DataFrame) -> DataFrame:
    """An ER diagram's line for each pair of tables (with cardinality)."""
    mark = F.when(F.col("cardinality") == "1:1", "||--||").when(F.col("cardinality") == "1:N", "||--o{").otherwise("}o--o{")
    return pairs.select("table_a", "table_b", F.format_string('    %s %s %s : "%s"', "table_a", mark, "table_b", "columns").alias("line"))


def import_edges(files: DataFrame) -> DataFrame:
    """Src, dst: the relative modules that each source file (path, content) imports, statically, dynamically or by
    require; the target's path is resolved against the importing file's folder."""
    pattern = r"""(?:\bfrom\s*|\bimport\s*\(\s*|\bimport\s+|\brequire\s*\(\s*)['"](\.{1,2}/[^'"]+)['"]"""
    each = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)))).alias("spec"))
    parts = F.split(F.concat_ws("/", F.regexp_replace("src", r"/?[^/]+$", ""), "spec"), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return each.select("src", F.array_join(kept, "/").alias("dst"))


def reachable(edges: DataFrame, starts: DataFrame, most: int = 8) -> DataFrame:
    """C14: start, node, hops: what can be reached from each start (node) in up to `most` hops, with the fewest hops.

    Each round joins the frontier with the edges and drops what was seen; the frontier is cut in the shared folder.
    """
    steps = cut(edges.select(F.col("src"), F.col("dst")).distinct())
    seen = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct())
    front = seen
    for hop in range(1, most + 1):
        new = front.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        front = cut(new.withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def within_budget(ranked: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Of each group the first rows whose costs add up to no more than the budget."""
    w = W.Window.partitionBy(group).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    return ranked.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)
