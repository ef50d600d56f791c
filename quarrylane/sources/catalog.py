"""Schema catalogs from databases, Spark tables and Markdown (survey A1 to A11, A21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The dictionary views that are read, by what they give.
VIEWS = {
    "tables": "ALL_TABLES", "table_comments": "ALL_TAB_COMMENTS", "columns": "ALL_TAB_COLUMNS", "column_comments": "ALL_COL_COMMENTS", "constraints": "ALL_CONSTRAINTS",
    "constraint_columns": "ALL_CONS_COLUMNS", "indexes": "ALL_INDEXES", "index_columns": "ALL_IND_COLUMNS",
}


def jdbc_table(spark: SparkSession, url: str, query: str, properties: dict[str, str]) -> DataFrame:
    """A query over JDBC; the driver must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in properties.items():
        reader = reader.option(k, v)
    return reader.load()


def dictionary_views(spark: SparkSession, url: str, owner: str, properties: dict[str, str]) -> dict[str, DataFrame]:
    """The dictionary views of one owner, eight reads instead of some for each table."""
    safe = owner.upper().replace("'", "''")
    return {k: jdbc_table(spark, url, f"SELECT * FROM {v} WHERE {'TABLE_OWNER' if v.startswith('ALL_IND') else 'OWNER'} = '{safe}'", properties) for k, v in VIEWS.items()}


def typed(data_type: Column, length: Column, precision: Column, scale: Column) -> Column:
    """A declared type as text; a scale of zero isn't shown."""
    text, num = F.upper(data_type).isin("VARCHAR2", "CHAR", "NVARCHAR2", "NCHAR"), F.upper(data_type) == "NUMBER"
    s = lambda c: c.cast("int").cast("string")
    return (
        F.when(text, F.concat(data_type, F.lit("("), s(length), F.lit(")")))
        .when(num & precision.isNotNull() & (F.coalesce(scale, F.lit(0)) != 0), F.concat(F.lit("NUMBER("), s(precision), F.lit(","), s(scale), F.lit(")")))
        .when(num & precision.isNotNull(), F.concat(F.lit("NUMBER("), s(precision), F.lit(")")))
        .when((F.upper(data_type) == "FLOAT") & precision.isNotNull(), F.concat(F.lit("FLOAT("), s(precision), F.lit(")")))
        .otherwise(data_type)
    )


def columns(cols: DataFrame, comments: DataFrame) -> DataFrame:
    """A3: table_name, column_id, column_name, data_type, nullable, comment."""
    own = cols.select("table_name", "column_id", "column_name", typed(F.col("data_type"), F.col("data_length"), F.col("data_precision"), F.col("data_scale")).alias("data_type"), "nullable")
    return own.join(comments.select("table_name", "column_name", F.col("comments").alias("comment")), ["table_name", "column_name"], "left")


def primary_keys(constraints: DataFrame, members: DataFrame) -> DataFrame:
    """A4: table_name, position, column_name."""
    return members.join(constraints.filter("constraint_type = 'P'").select("constraint_name"), "constraint_name").select("table_name", "position", "column_name")


def foreign_keys(constraints: DataFrame, members: DataFrame) -> DataFrame:
    """A5: table_name, column_name, ref_table, ref_column, constraint_name; a row for each position."""
    fk = constraints.filter("constraint_type = 'R'").select("constraint_name", F.col("r_constraint_name").alias("r"))
    a = members.select("constraint_name", "table_name", "column_name", "position")
    b = members.select(F.col("constraint_name").alias("r"), F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), "position")
    return a.join(fk, "constraint_name").join(b, ["r", "position"]).select("table_name", "column_name", "ref_table", "ref_column", "constraint_name")


def indexes(heads: DataFrame, members: DataFrame) -> DataFrame:
    """table_name, index_name, is_unique, columns in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("column_position", "column_name"))), lambda x: x["column_name"])
    own = members.groupBy("table_name", "index_name").agg(listed.alias("columns"))
    return own.join(heads.select("table_name", "index_name", (F.col("uniqueness") == "UNIQUE").alias("is_unique")), ["table_name", "index_name"])


def table_list(tables: DataFrame) -> DataFrame:
    """A1: table_name, each once."""
    return tables.select("table_name").distinct()


def table_comments(comments: DataFrame) -> DataFrame:
    """A2: table_name, comment of the tables that have one."""
    return comments.filter("comments is not null").select("table_name", F.col("comments").alias("comment"))


def schema(views: dict[str, DataFrame], only: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables (with comments), columns, primary_keys, foreign_keys and indexes of an owner's views (see VIEWS), or of only
    some tables. Set by set; nothing is read for each table."""
    pick = lambda df: df.filter(F.col("table_name").isin(only)) if only is not None else df
    members = views["constraint_columns"]
    return {
        "tables": pick(table_list(views["tables"])).join(table_comments(views["table_comments"]), "table_name", "left"),
        "columns": pick(columns(views["columns"], views["column_comments"])), "primary_keys": pick(primary_keys(views["constraints"], members)),
        "foreign_keys": pick(foreign_keys(views["constraints"], members)), "indexes": pick(indexes(views["indexes"], views["index_columns"])),
    }


def constraint_lines(parts: dict[str, DataFrame]) -> DataFrame:
    """table_name, kind, detail of a schema's keys and indexes, for retrieval documents and reports."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c]), ", ")
    pk = parts["primary_keys"].groupBy("table_name").agg(listed("column_name").alias("detail")).select("table_name", F.lit("PK").alias("kind"), "detail")
    fk = parts["foreign_keys"].select("table_name", F.lit("FK").alias("kind"), F.format_string("%s -> %s.%s", "column_name", "ref_table", "ref_column").alias("detail"))
    ix = parts["indexes"].select("table_name", F.lit("INDEX").alias("kind"), F.format_string("%s (%s)%s", "index_name", F.array_join("columns", ", "), F.when(F.col("is_unique"), " unique").otherwise("")).alias("detail"))
    return pk.unionByName(fk).unionByName(ix)


def spark_columns(df: DataFrame, table: str) -> DataFrame:
    """A3 for a Spark table: its own schema as catalog rows."""
    rows = [(table, i, f.name, f.dataType.simpleString(), "Y" if f.nullable else "N") for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_id int, column_name string, data_type string, nullable string")


def markdown_columns(files: DataFrame) -> DataFrame:
    """A10: path, table_name, pos, column_name, data_type, nullable, comment of schema documents (path, content): a heading
    '## NAME', then rows of cells, of which the first three name column, type and nullability."""
    sections = files.select("path", F.explode(F.split(F.regexp_replace("content", "\r", ""), r"(?m)^(?=## )")).alias("s")).filter(r"s rlike '^## \\S+'")
    rows = sections.select("path", F.regexp_extract("s", r"^## (\S+)", 1).alias("table_name"), F.posexplode(F.regexp_extract_all("s", F.lit(r"(?m)^\|([^\n]*)\|[ \t]*$"), F.lit(1))).alias("pos", "row"))
    cell = lambda i: F.trim(F.coalesce(F.try_element_at(F.split("row", r"\|"), F.lit(i)), F.lit("")))
    each = rows.select("path", "table_name", "pos", cell(1).alias("column_name"), cell(2).alias("data_type"), cell(3).alias("nullable"), cell(5).alias("comment"))
    return each.filter(r"column_name rlike '^[A-Za-z_][\\w$#]*$' and data_type rlike '^\\S+$' and nullable in ('Y', 'N', 'YES', 'NO')")


def markdown_joins(files: DataFrame) -> DataFrame:
    """Path, table1, column1, table2, column2, join_type of query documents: rows with 'T.C <-> T.C'."""
    pair = r"(\w+)\.([\w*]+)[`\s]*<->[`\s]*(\w+)\.([\w*]+)"
    each = files.select("path", F.explode(F.split("content", "\n")).alias("row")).filter(F.col("row").rlike(pair))
    get = lambda i: F.regexp_extract("row", pair, i)
    return each.select("path", get(1).alias("table1"), get(2).alias("column1"), get(3).alias("table2"), get(4).alias("column2"), F.trim(F.regexp_extract("row", r"<->[^|]*\|([^|]*)\|", 1)).alias("join_type"))


def markdown_usage(files: DataFrame) -> DataFrame:
    """Path, table_name and the counts of a query document's usage rows: a table's name, then at least three numbers."""
    rows = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\|([^\n]*)\|[ \t]*$"), F.lit(1))).alias("row"))
    cells = F.transform(F.split("row", r"\|"), lambda c: F.trim(F.regexp_replace(c, "[`*]", "")))
    own = rows.select("path", cells[0].alias("table_name"), F.filter(F.slice(cells, 2, 20), lambda c: c.rlike("^[0-9]+$")).alias("n"))
    return own.filter(r"table_name rlike '^[A-Za-z_][\\w$#]*$' and size(n) >= 3").select("path", F.upper("table_name").alias("table_name"), F.transform("n", lambda x: x.cast("bigint")).alias("counts"))


def markdown_tables(files: DataFrame) -> DataFrame:
    """table_name: every table that query documents name, as a heading, in a join or in a usage row, each once."""
    heads = files.select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^#{2,4} +`?([A-Za-z_][\w$#]*)`?[ \t]*$"), F.lit(1))).alias("table_name"))
    joins = markdown_joins(files)
    every = heads.unionByName(joins.select(F.col("table1").alias("table_name"))).unionByName(joins.select(F.col("table2").alias("table_name"))).unionByName(markdown_usage(files).select("table_name"))
    return every.select(F.upper("table_name").alias("table_name")).distinct()


def schema_lookup(files: DataFrame) -> DataFrame:
    """S3: table_name, column_name of schema documents, in upper case, each once."""
    return markdown_columns(files).select(F.upper("table_name").alias("table_name"), F.upper("column_name").alias("column_name")).distinct()


def renamed_menu(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """A menu table with its own column names as program_id, program_nm, url, parent_id, level."""
    want = ("program_id", "program_nm", "url", "parent_id", "level")
    return rows.select(*[F.col(names[w]).cast("string").alias(w) if w in names else F.lit(None).cast("string").alias(w) for w in want])


def filled_levels(rows: DataFrame, levels: list[str], order: str, group: str) -> DataFrame:
    """Levels filled down from the rows above within each sheet; a new name at one level clears the deeper ones."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy(group).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    out = rows
    changed: Column | None = None
    for i, c in enumerate(levels):
        own = F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct(F.col(order).alias("at"), F.col(c).alias("v")))
        out = out.withColumn(f"_f{i}", F.last(own, ignorenulls=True).over(w))
    for i, c in enumerate(levels):
        at = F.col(f"_f{i}.at")
        out = out.withColumn(c, F.col(f"_f{i}.v") if changed is None else F.when(at >= changed, F.col(f"_f{i}.v")))
        changed = at if changed is None else F.greatest(changed, at)
    return out.drop(*[f"_f{i}" for i in range(len(levels))])
