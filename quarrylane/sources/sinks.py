"""Reports as files (survey 2.14, S1): any table as Markdown or CSV, written by the executors; where reports go."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_path(base: str, area: str, day: str) -> str:
    """base/area/yyyyMMdd; area loses what no folder name may have."""
    return f"{base.rstrip('/')}/{re.sub(r'[^0-9A-Za-z가-힣_.-]+', '_', area).strip('_') or 'report'}/{re.sub('[^0-9]', '', day)[:8]}"


def with_environment(config: dict, env: dict[str, str] | None = None) -> dict:
    """A configuration with ${NAME} and ${NAME:default} replaced by variables, at any depth; an unknown one without a
    default stays."""
    env = dict(os.environ) if env is None else env

    def put(x):
        if isinstance(x, dict):
            return {k: put(v) for k, v in x.items()}
        if isinstance(x, list):
            return [put(v) for v in x]
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: env.get(m[1], m[0] if m[2] is None else m[2]), x) if isinstance(x, str) else x

    return put(config)


def cell(c: str):
    """A value as a cell of a pipe table: null is blank, bars and breaks don't end it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|"), r"\s*[\r\n]+\s*", " ")


def markdown(df: DataFrame, order: list[str], title: str | None = None) -> DataFrame:
    """value: df as the lines of a pipe table, in order, under a title. Arrays and structs must be made text before."""
    names = df.columns
    head = [*([f"## {title}", ""] if title else []), "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines = df.select(*[F.col(c).alias(c) for c in names], F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in names]), F.lit(" |")).alias("value"))
    top = df.sparkSession.createDataFrame([(i, h) for i, h in enumerate(head)], "n int, value string").coalesce(1).orderBy("n").select("value")
    return top.unionByName(lines.orderBy(*order).select("value"))


def write_markdown(df: DataFrame, path: str, order: list[str], title: str | None = None) -> None:
    """df as Markdown files at path: the parts in order make up the document."""
    markdown(df, order, title).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """df as CSV with headers at path; arrays, maps and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_reports(reports: dict[str, DataFrame], base: str, area: str, day: str, orders: dict[str, list[str]] | None = None) -> str:
    """Several tables as CSV and Markdown under output_path; returns the folder."""
    folder = output_path(base, area, day)
    for name, df in reports.items():
        write_csv(df, f"{folder}/{name}.csv")
        simple = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        write_markdown(simple, f"{folder}/{name}.md", (orders or {}).get(name) or simple.columns, name)
    return folder
