"""Roles of classes, chains from endpoints to tables, and program rows (survey H7, H9, H25, H33, H34, S12 to S20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.operators.lineage import call_chain, namespace_matches, normalized_url
from quarrylane.operators.statements import rolled_up
from quarrylane.session import cut

# Name endings of business classes and of data access classes, and of functions that call a remote system.
SERVICE_SUFFIXES = ("Service", "ServiceImpl", "Bo", "BoImpl", "Biz", "BizImpl", "Manager", "ManagerImpl", "Facade", "FacadeImpl")
DAO_SUFFIXES = ("Mapper", "Dao", "DAO", "Repository")
REMOTE_LITERAL = r"""\.get\w*Function\s*\(\s*"([^"]+)"\s*\)"""
REMOTE_NAME = r"""\.get\w*Function\s*\(\s*([A-Z][A-Z0-9_]*)\s*\)"""
TEXT_CONSTANT = r"""\bString\s+([A-Z][A-Z0-9_]*)\s*=\s*"([^"]+)"\s*;"""


def class_roles(classes: DataFrame, methods: DataFrame, namespaces: DataFrame | None = None, framework: str = "mixed") -> DataFrame:
    """Fqcn, role: controller (by stereotype or because it has endpoints), mapper (by stereotype, name or because a
    mapper file has its name), service (by stereotype or name) or other; the first that fits."""
    known = {"spring": ["Controller", "RestController"], "vertx": []}.get(framework, ["Controller", "RestController"])
    has = methods.filter("verb <> ''").select("fqcn").distinct().withColumn("has_endpoints", F.lit(True))
    df = classes.select("fqcn", "class_name", "stereotypes", "parent").join(has, "fqcn", "left")
    named = F.lit(False)
    if namespaces is not None:
        df = df.join(namespaces.select(F.col("namespace").alias("fqcn"), F.lit(True).alias("is_namespace")).distinct(), "fqcn", "left")
        named = F.coalesce("is_namespace", F.lit(False))
    some = lambda names: F.arrays_overlap("stereotypes", F.array(*map(F.lit, names))) if names else F.lit(False)
    ends = lambda suffixes: F.col("class_name").rlike("(" + "|".join(suffixes) + ")$")
    verticle = F.col("parent").endswith("Verticle") if framework != "spring" else F.lit(False)
    role = (
        F.when(F.coalesce("has_endpoints", F.lit(False)) | some(known) | verticle, "controller").when(some(["Mapper", "Repository"]) | ends(DAO_SUFFIXES) | named, "mapper")
        .when(some(["Service", "Component"]) | ends(SERVICE_SUFFIXES), "service").otherwise("other")
    )
    return df.select("fqcn", role.alias("role"))


def remote_calls(methods: DataFrame, files: DataFrame) -> DataFrame:
    """H7: fqcn, method, remote: the remote functions that a method asks for, by literal or by the name of a text constant of its
    file (path, content)."""
    body = methods.select("path", "fqcn", "method", "body")
    literal = body.select("path", "fqcn", "method", F.explode(F.regexp_extract_all("body", F.lit(REMOTE_LITERAL), F.lit(1))).alias("remote"))
    names = body.select("path", "fqcn", "method", F.explode(F.regexp_extract_all("body", F.lit(REMOTE_NAME), F.lit(1))).alias("name"))
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(TEXT_CONSTANT), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(TEXT_CONSTANT), F.lit(2)).alias("remote"))
    consts = files.select("path", F.explode(pairs).alias("c")).select("path", "c.name", "c.remote")
    return literal.select("fqcn", "method", "remote").unionByName(names.join(consts, ["path", "name"]).select("fqcn", "method", "remote")).distinct()


def inherited_paths(classes: DataFrame, paths: DataFrame, most: int = 5) -> DataFrame:
    """Fqcn, class_path: a class's own mapping path, else that of its nearest ancestor, up to `most` levels up.

    classes: fqcn, class_name, parent; paths: fqcn, class_path.
    """
    up = classes.select("fqcn", F.col("parent").alias("next")).join(paths, "fqcn", "left")
    names = classes.select(F.col("class_name").alias("next"), F.col("fqcn").alias("up_fqcn"), F.col("parent").alias("up_next")).dropDuplicates(["next"])
    up_paths = paths.select(F.col("fqcn").alias("up_fqcn"), F.col("class_path").alias("up_path"))
    for _ in range(most):
        step = up.join(names, "next", "left").join(up_paths, "up_fqcn", "left")
        up = cut(step.select("fqcn", F.when(F.col("class_path").isNull(), F.col("up_next")).alias("next"), F.coalesce("class_path", "up_path").alias("class_path")))
    return up.select("fqcn", F.coalesce("class_path", F.lit("")).alias("class_path"))


def endpoint_tables(endpoints: DataFrame, edges: DataFrame, sql_calls: DataFrame, statement_crud: DataFrame, depth: int = 6) -> DataFrame:
    """Url, table_name, crud: what each endpoint does to which tables, over its calls.

    endpoints: url, node (class.method); edges: src, dst; sql_calls: node, sql_id (namespace.id); statement_crud: namespace,
    id, table_name, crud. A call's namespace is matched with the mappers' (see namespace_matches).
    """
    chain = call_chain(endpoints.select("node").distinct(), edges, depth)
    named = sql_calls.select("node", F.regexp_replace("sql_id", r"\.[^.]*$", "").alias("ns"), F.regexp_extract("sql_id", r"([^.]*)$", 1).alias("id"))
    matched = namespace_matches(named, statement_crud.select("namespace").distinct()).select("ns", "namespace")
    used = named.join(matched, "ns").join(statement_crud, ["namespace", "id"]).select("node", "table_name", "crud")
    reach = chain.join(used, "node").select(F.col("start").alias("node"), "table_name", "crud")
    return rolled_up(endpoints.select("url", "node").join(reach, "node").select("url", "table_name", "crud"), ["url"])


def program_rows(endpoints: DataFrame, menu: DataFrame, tables: DataFrame, backend: str = "") -> DataFrame:
    """A row for each endpoint with its menu entry (by URL) and its tables as text; backend names the project.

    endpoints: verb, url, class_name, method; menu: url, main_menu, sub_menu, program_name; tables: url, table_name, crud.
    """
    listed = tables.groupBy("url").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s(%s)", "table_name", "crud"))), ", ").alias("tables"))
    entries = menu.select(normalized_url(F.col("url")).alias("url"), "main_menu", "sub_menu", "program_name").groupBy("url").agg(F.min(F.struct("main_menu", "sub_menu", "program_name")).alias("m"))
    out = endpoints.join(entries, "url", "left").join(listed, "url", "left")
    return out.select(F.lit(backend).alias("backend"), "m.main_menu", "m.sub_menu", "m.program_name", "verb", "url", "class_name", "method", F.coalesce("tables", F.lit("")).alias("tables"), F.col("m").isNotNull().alias("matched"))


def chain_diagnostics(calls: DataFrame, matches: DataFrame, statements: DataFrame) -> DataFrame:
    """How many calls have no namespace, an ambiguous one, or a statement that is missing. calls: ns, id; matches: see
    namespace_matches; statements: namespace, id."""
    known = statements.select("namespace", "id", F.lit(True).alias("is_known")).distinct()
    j = calls.select("ns", "id").distinct().join(matches.select("ns", "namespace", "ambiguous"), "ns", "left").join(known, ["namespace", "id"], "left")
    return j.agg(F.count("*").alias("calls"), F.count(F.when(F.col("namespace").isNull(), 1)).alias("no_namespace"), F.count(F.when(F.col("ambiguous"), 1)).alias("ambiguous"), F.count(F.when(F.col("namespace").isNotNull() & F.col("is_known").isNull(), 1)).alias("no_statement"))


def sequence_lines(events: DataFrame) -> DataFrame:
    """Url, text: a sequence diagram of each endpoint's calls in order. events: url, at, caller, callee, message."""
    line = F.format_string("  %s->>%s: %s", "caller", "callee", "message")
    return events.groupBy("url").agg(F.concat(F.lit("sequenceDiagram\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))), lambda x: x["l"]), "\n")).alias("text"))


def project_roots(files: DataFrame, markers: tuple[str, ...] = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json")) -> DataFrame:
    """Root, markers: the folders that hold a project's marker files (path)."""
    name: Column = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.filter(name.isin(*markers)).groupBy(F.regexp_replace("path", r"/?[^/]+$", "").alias("root")).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("markers"))


def label_words(lines: DataFrame) -> DataFrame:
    """Word, label: the first Korean label of each word in a dictionary's table rows (path, no, value)."""
    cell = lambda i: F.trim(F.coalesce(F.try_element_at(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), F.lit(i)), F.lit("")))
    rows = lines.filter(F.col("value").rlike(r"^\s*\|")).select("path", "no", F.upper(cell(1)).alias("word"), F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c)).alias("cells"))
    own = rows.select("path", "no", "word", F.get(F.filter("cells", lambda c: c.rlike("[가-힣]")), 0).alias("label")).filter(r"label is not null and word rlike '^\\w+$'")
    return own.groupBy("word").agg(F.min_by("label", F.struct("path", "no")).alias("label"))


def scheduled_jobs(files: DataFrame) -> DataFrame:
    """Path, target, method, job_kind: jobs that XML files define: a scheduler's own, a job bean, or a bean's method."""
    own = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)<job-class>\s*([\w.$]+)\s*</job-class>"), F.lit(1))).alias("target")).select("path", "target", F.lit("execute").alias("method"), F.lit("quartz_job").alias("job_kind"))
    beans = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?is)(<bean\b[^>]*JobDetailFactoryBean[^>]*>.*?</bean>)"), F.lit(1))).alias("b"))
    value = lambda n, k: F.regexp_extract("b", rf"""(?is)name\s*=\s*["']{n}["'][^>]*\b{k}\s*=\s*["']([^"']+)["']""", 1)
    calls = F.col("b").contains("MethodInvoking")
    made = beans.select("path", F.when(calls, value("targetObject", "ref")).otherwise(value("jobClass", "value")).alias("target"), F.when(calls, value("targetMethod", "value")).otherwise("execute").alias("method"), F.when(calls, "quartz_method").otherwise("quartz_job").alias("job_kind"))
    return own.unionByName(made.filter("target <> '' and method <> ''")).distinct()
