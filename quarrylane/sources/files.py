"""Files as rows (survey A12, A13, A19, A20, A30, A31)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that hold no sources, paths of build output, encodings in the order they are tried.
SKIP_DIRS = ("node_modules", "build", "dist", ".next", ".git", ".svn", ".idea", "target", "out", "bin", "coverage", "__tests__", "__mocks__", "storybook-static", ".cache")
BUILD_OUTPUT = ("/target/classes/", "/target/test-classes/", "/target/generated-resources/", "/build/classes/", "/build/resources/main/", "/build/resources/test/", "/build/generated/", "/out/production/", "/out/test/", "/bin/main/", "/bin/test/")
ENCODINGS = ("utf-8", "euc-kr", "cp949", "latin-1")
MINIFIED = r"\.(?:min|bundle|chunk|compiled)\."


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text by the first encoding that fits."""
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for e in ENCODINGS:
            try:
                return bytes(b).decode(e)
            except UnicodeDecodeError:
                continue
        return None

    return content.map(one)


def text_files(spark: SparkSession, folder: str, glob: str, skip_dirs: bool = True) -> DataFrame:
    """path, content of the files below a folder whose names match a glob; without build output and skipped folders."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    for part in BUILD_OUTPUT:
        df = df.filter(~F.col("path").contains(part))
    if skip_dirs:
        df = df.filter(~F.col("path").rlike("/(?:" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + ")/"))
    return df.select("path", decoded("content").alias("content"))


def mapper_files(spark: SparkSession, folder: str) -> DataFrame:
    """The XML files that are SQL mappers, by their first 5000 characters."""
    head = F.lower(F.left("content", F.lit(5000)))
    return text_files(spark, folder, "*.xml", skip_dirs=False).filter(head.rlike("<(?:select|insert|update|delete)") | (head.rlike("mapper|sqlmap|sql-map") & head.contains("namespace")))


def script_files(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """JavaScript and TypeScript sources, without minified ones, and without those of more than `most` characters
    where it is given."""
    own = text_files(spark, folder, "*.{js,jsx,ts,tsx,mjs}").filter(~F.col("path").rlike(MINIFIED))
    return own if most is None else own.filter(F.length("content") <= most)


def skipped_scripts(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """Path, reason of the scripts that script_files leaves out."""
    own = text_files(spark, folder, "*.{js,jsx,ts,tsx,mjs}")
    large = F.lit(False) if most is None else F.length("content") > most
    return own.select("path", F.when(F.col("path").rlike(MINIFIED), "minified").when(large, "too large").alias("reason")).filter("reason is not null")


def kept(files: DataFrame, path: str) -> DataFrame:
    """Files read and decoded once, written at path and read from there, for several scanners."""
    files.write.mode("overwrite").parquet(path)
    return files.sparkSession.read.parquet(path)


def backend_repos(settings: DataFrame, repos: DataFrame) -> DataFrame:
    """Name, repo: the back end that a setting (name, value: a URL or path) means: the project (repo) whose name is a part
    of the URL's path or host between marks, the longest, of equal ones the first."""
    parts = F.array_distinct(F.filter(F.split(F.lower("value"), r"[/.:?&=#]+"), lambda p: p != ""))
    each = settings.select("name", F.explode(parts).alias("part"))
    hit = each.join(repos.select(F.lower("repo").alias("part"), "repo").distinct(), "part")
    return hit.groupBy("name").agg(F.min(F.struct((-F.length("repo")).alias("n"), "repo"))["repo"].alias("repo"))


def java_files(spark: SparkSession, folder: str) -> DataFrame:
    """Java sources."""
    return text_files(spark, folder, "*.java")


def page_files(spark: SparkSession, folder: str) -> DataFrame:
    """JSP and HTML pages and their scripts."""
    return text_files(spark, folder, "*.{jsp,jspx,jspf,html,htm,js}")


def attribute_list(lines: DataFrame) -> DataFrame:
    """Attr, first_no: the distinct lines (value, no) without byte order mark, blanks and remarks, by first place."""
    own = lines.select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("attr"), "no").filter("attr <> '' and not startswith(attr, '#')")
    return own.groupBy("attr").agg(F.min("no").alias("first_no"))


def env_settings(files: DataFrame) -> DataFrame:
    """Path, name, value of .env files (path, content): remarks and quotes are left out, 'export' too."""
    lines = files.select("path", F.explode(F.split("content", r"\r?\n")).alias("line"))
    m = lambda g: F.regexp_extract("line", r"""^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^#]*?))\s*(?:#.*)?$""", g)
    return lines.select("path", m(1).alias("name"), F.concat(m(2), m(3), F.trim(m(4))).alias("value")).filter("name <> ''")
