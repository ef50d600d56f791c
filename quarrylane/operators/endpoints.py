"""Endpoints beside menus, screens and classes (survey H13, H17, H23, H25, H34, H35, S13, S14, S23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.operators.lineage import app_key, call_chain, normalized_url, ranked_matches

# The ways to match an endpoint with a menu entry, in the order in which they count.
WAYS = ("url", "import_chain", "app", "alias", "part_of_url")


def menu_candidates(endpoints: DataFrame, menu: DataFrame, chain: DataFrame, api: DataFrame, aliases: DataFrame, segment: int | None = None, parameter: str | None = None) -> list[DataFrame]:
    """The five ways to find an endpoint's menu entries, each url, program_id.

    endpoints: url; menu: program_id, url; chain: menu_url, url (what the files behind a menu entry's screen call); api: app,
    url (what an application's files call); aliases: alias, app (names under which routes know an application). URLs are
    normalized here. The application of a menu URL is its path segment or parameter (see app_key). The last way, an
    application's name anywhere in a menu URL, joins the URL's parts of the lengths that names have; no pairs are compared.
    """
    own = endpoints.select(normalized_url(F.col("url")).alias("url")).distinct().filter("url <> ''")
    entries = menu.select("program_id", F.lower("url").alias("raw"), normalized_url(F.col("url")).alias("menu_url"), app_key(F.col("url"), segment, parameter).alias("app") if segment is not None or parameter else F.lit("").alias("app")).filter("menu_url <> ''")
    exact = own.join(entries.select(F.col("menu_url").alias("url"), "program_id"), "url")
    linked = chain.select(normalized_url(F.col("menu_url")).alias("menu_url"), normalized_url(F.col("url")).alias("url")).distinct()
    by_chain = own.join(linked, "url").join(entries, "menu_url").select("url", "program_id")
    calls = own.join(api.select(F.lower("app").alias("app"), normalized_url(F.col("url")).alias("url")).distinct(), "url").filter("app <> ''")
    named = entries.filter("app <> ''").select("app", "program_id")
    by_app = calls.join(named, "app").select("url", "program_id")
    other = aliases.select(F.lower("alias").alias("alias"), F.lower("app").alias("app")).distinct()
    by_alias = calls.join(other, "app").join(named.withColumnRenamed("app", "alias"), "alias").select("url", "program_id")
    apps = calls.select("app").distinct()
    lengths = [r[0] for r in apps.select(F.length("app")).distinct().orderBy(F.length("app")).collect()]

    def parts_of(n: int):
        places = F.sequence(F.lit(1), F.greatest(F.length("raw") - n + 1, F.lit(1)))
        return F.when(F.length("raw") >= n, F.transform(places, lambda i: F.substring("raw", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    parts = F.flatten(F.array(*map(parts_of, lengths))) if lengths else F.array().cast("array<string>")
    held = entries.select("program_id", F.explode(F.array_distinct(parts)).alias("app")).join(apps, "app", "left_semi")
    by_part = calls.join(held, "app").select("url", "program_id")
    return [exact, by_chain, by_app, by_alias, by_part]


def menu_matches(*args, **named) -> DataFrame:
    """Url, program_id, way: each endpoint's menu entry by the first way (see WAYS) that finds one, and of its entries the
    first. Arguments: see menu_candidates."""
    best = ranked_matches(menu_candidates(*args, **named), "url", "program_id")
    return best.select("url", "program_id", F.element_at(F.array(*map(F.lit, WAYS)), F.col("way") + 1).alias("way"))


def front_map(single: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Url, screens, triggers of calls that screens make (url, screen, trigger), of one front end and of several buckets of
    them: each once, in order. What is gathered is a URL's distinct screens."""
    every = single.select("url", "screen", "trigger")
    if buckets is not None:
        every = every.unionByName(buckets.select("url", "screen", "trigger"))
    each = every.select(normalized_url(F.col("url")).alias("url"), "screen", "trigger").filter("url <> ''").distinct()
    shown = F.concat_ws(": ", "screen", "trigger")
    return each.groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("screen")), "; ").alias("screens"), F.array_join(F.array_sort(F.collect_set(F.when(F.coalesce("trigger", F.lit("")) != "", shown))), "; ").alias("triggers"))


def front_only(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The rows of front_map (url, screens, triggers) that no endpoint (url) has: named after their URL, without a
    back end."""
    known = endpoints.select(normalized_url(F.col("url")).alias("url")).distinct()
    return calls.join(known, "url", "left_anti").withColumn("program_name", F.regexp_replace("url", "^/", "")).withColumn("matched", F.lit(False)).withColumn("resolved_via", F.lit("front_only"))


def bucket_aliases(routes: DataFrame, segment: int | None = None, parameter: str | None = None) -> DataFrame:
    """Alias, app: the names under which an application's folder is known: its own, and those that its routes (app, path)
    begin with. A name that several folders claim belongs to the folder of that name, else to the first."""
    own = routes.select(F.lower("app").alias("alias"), F.lower("app").alias("app"), F.lit(0).alias("way"))
    other = routes.select(app_key(F.col("path"), segment, parameter).alias("alias"), F.lower("app").alias("app"), F.lit(1).alias("way"))
    return own.unionByName(other).filter("alias <> ''").groupBy("alias").agg(F.min(F.struct("way", "app"))["app"].alias("app"))


def scanned_by_kind(files: DataFrame, scanners: dict[str, tuple[str, object]], kinds: DataFrame) -> DataFrame:
    """The rows of each front end's files (app, path, content) by the scanner of its kind (kinds: app, kind; scanners: kind
    to a pattern of paths and a function from files to rows). An application without a kind is scanned by none."""
    out = []
    for kind, (pattern, scan) in sorted(scanners.items()):
        own = files.join(kinds.filter(F.col("kind") == kind).select("app"), "app", "left_semi").filter(F.col("path").rlike(pattern))
        out.append(scan(own).withColumn("kind", F.lit(kind)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def over_backends(rows: dict[str, DataFrame], menu: DataFrame) -> DataFrame:
    """The program rows of several back ends as one table, in the menu's order (menu: url, menu_no), those without a
    menu entry last; position counts over all of them within an entry. A row that two back ends have stays in both."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("backend", F.lit(name)) for name, df in sorted(rows.items())])
    order = menu.select(normalized_url(F.col("url")).alias("url"), "menu_no").groupBy("url").agg(F.min("menu_no").alias("menu_no"))
    return every.withColumn("url", normalized_url(F.col("url"))).join(order, "url", "left").orderBy(F.asc_nulls_last("menu_no"), "url", "backend")


def by_screen(rows: DataFrame, screen: str, order: list[str]) -> DataFrame:
    """Rows with those of a screen side by side, screens in the order of their first row, rows without a screen last."""
    first = rows.groupBy(screen).agg(F.min(F.struct(*order)).alias("_first"))
    blank = F.trim(F.coalesce(F.col(screen), F.lit(""))) == ""
    joined = rows.join(first, rows[screen].eqNullSafe(first[screen])).drop(first[screen])
    return joined.orderBy(blank, "_first", screen, *order).drop("_first")


def remote_reach(starts: DataFrame, calls: DataFrame, remotes: DataFrame, depth: int = 4) -> DataFrame:
    """Start, remotes: the remote functions (node, remote) that a start (node) asks for, itself or through what it
    calls."""
    reach = call_chain(starts, calls, depth)
    return reach.join(remotes.select("node", "remote").distinct(), "node").groupBy("start").agg(F.array_join(F.array_sort(F.collect_set("remote")), ", ").alias("remotes"))


def injected(fields: DataFrame, classes: DataFrame) -> DataFrame:
    """Fqcn, field, target: the class that an injected field (fqcn, field, type, resolved: its full name by imports, or
    null) holds: the class of that full name, else the first of that simple name (classes: fqcn, class_name)."""
    simple = F.regexp_extract("type", r"(\w+)(?:<.*)?$", 1)
    f = fields.select("fqcn", "field", "resolved", simple.alias("class_name")).distinct()
    exact = f.join(classes.select(F.col("fqcn").alias("target")).distinct(), F.col("resolved") == F.col("target")).select("fqcn", "field", "target", F.lit(0).alias("way"))
    named = f.join(classes.select("class_name", F.col("fqcn").alias("target")).distinct(), "class_name").select("fqcn", "field", "target", F.lit(1).alias("way"))
    return exact.unionByName(named).groupBy("fqcn", "field").agg(F.min(F.struct("way", "target"))["target"].alias("target"))


def class_mappers(fields: DataFrame, roles: DataFrame, calls: DataFrame) -> DataFrame:
    """Fqcn, namespace: the mappers of a class: those that it holds (fqcn, target; roles: fqcn, role) and those whose
    statements it calls (fqcn, namespace)."""
    held = fields.select("fqcn", F.col("target").alias("namespace")).join(roles.filter("role = 'mapper'").select(F.col("fqcn").alias("namespace")), "namespace", "left_semi")
    return held.select("fqcn", "namespace").unionByName(calls.select("fqcn", "namespace")).filter("namespace <> ''").distinct()
