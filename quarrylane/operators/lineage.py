"""URLs, menus, classes and calls matched with each other (survey section 2.9)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarrylane.session import cut

# Endings of implementing classes, and what an interface's core name goes without.
IMPL_SUFFIXES = ("Impl", "Bo", "Biz", "Manager", "Facade", "Helper", "Delegate")
SERVICE_STRIP = r"(?:Service|Bo|Biz|Manager|Facade)$"
# Where a page names a URL: attributes of tags, first arguments of calls, second ones, assigned and named values.
URL_TAGS = {"form": "action", "a": "href", "c:url": "value", "c:redirect": "url"}
URL_CALLS = ("$.get", "$.post", "$.getJSON", "$.load", "fetch", "axios", "axios.get", "axios.post", "axios.put", "axios.patch", "axios.delete", "axios.head", "axios.request", "location.replace", "location.assign", "window.open")
URL_SECOND = (".open",)
URL_ASSIGNED = ("location.href", "location", ".action")
URL_NAMED = ("url",)
SERVICE_CALL = r"""\bhttpSend\s*\(\s*["']([A-Za-z_][\w.$-]*)["']"""
NO_ENDPOINT = r"(?i)^(?:#|javascript:|mailto:|tel:|data:|\{\{|//)|\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|eot|map|html?|pdf)(?:[?#]|$)"
ENDPOINT = r"(?i)^(?:/|https?://)|/|\.(?:do|act|action|jsp|jspx|json|ajax|nex|sc|svc|cmd|exec|proc)\b"


def url_places(methods: tuple[str, ...] = ()) -> list[str]:
    """The patterns by which pages name URLs, each with the URL as its group; methods are further calls."""
    def either(names) -> str:
        # a name stands alone, or behind a dot where it begins with one
        return "(?:" + "|".join((r"(?<![\w.$])" if n[0] not in ".$" else "") + r"\s*\.\s*".join(re.escape(p) for p in n.split(".")) for n in names) + ")"

    ahead = [rf"<{t}\b[^<>]*?\s{a}\s*=" for t, a in URL_TAGS.items()]
    ahead += [either([*URL_CALLS, *methods]) + r"\s*\(", either(URL_SECOND) + r"""\s*\(\s*["'][A-Za-z]+["']\s*,""", either(["window.location.href", "document.location.href", *URL_ASSIGNED]) + r"\s*=(?!=)", either(URL_NAMED) + r"\s*:"]
    return [rf"""(?i){x}\s*["']([^"']+)["']""" for x in ahead]


def normalized_url(c: Column, strip: list[str] | None = None) -> Column:
    """H1: lower case, no host, no prefixes of strip, single slashes, parameters as {p}, a slash in front, none at the end.

    '' for null and ''. The query string stays.
    """
    u = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^https?://[^/]+", "")
    for s in strip or []:
        u = F.regexp_replace(u, s, "")
    u = F.regexp_replace(u, "/+", "/")
    u = F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"\{[^}]+\}", "{p}"), r":\w+", "{p}"), r"\*\*", "{p}")
    u = F.regexp_replace(u, r"(?<=/)\*(?=/|$)", "{p}")
    u = F.when(F.startswith(u, F.lit("/")), u).otherwise(F.concat(F.lit("/"), u))
    u = F.regexp_replace(u, "(?<=.)/$", "")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").otherwise(u)


def endpoints(classes: DataFrame) -> DataFrame:
    """H2: each path of a class with each path of a method. classes: class_name, class_paths, method, method_paths, verb;
    no path on one side is an empty one."""
    some = lambda c: F.when(F.size(F.coalesce(c, F.expr("array()"))) > 0, c).otherwise(F.array(F.lit("")))
    each = classes.withColumn("a", F.explode(some(F.col("class_paths")))).withColumn("b", F.explode(some(F.col("method_paths"))))
    return each.select("class_name", "method", "verb", normalized_url(F.concat_ws("/", "a", "b")).alias("url")).distinct()


def implementations(classes: DataFrame) -> DataFrame:
    """Interface, implementation, way: by declaration, by a name ending, by the core name with an ending.

    classes: fqcn, class_name, is_interface, implements (array of simple names). The first way wins, then the ending's
    place, then the name.
    """
    own = classes.select("fqcn", "class_name")
    declared = classes.filter("not is_interface").select(F.col("fqcn").alias("impl"), F.explode("implements").alias("i")).select("impl", F.trim(F.regexp_replace("i", "<.*$", "")).alias("class_name"))
    one = declared.join(own, "class_name").select(F.col("fqcn").alias("interface"), F.col("impl").alias("implementation"), F.lit(1).alias("way"), F.lit(0).alias("place"))
    named = own.toDF("implementation", "impl_name")

    def by_name(core: Column, way: int, suffixes: tuple[str, ...]) -> DataFrame:
        names = F.posexplode(F.array(*[F.concat(core, F.lit(s)) for s in suffixes])).alias("place", "impl_name")
        src = own.filter(core != "") if way == 2 else own.filter((core != "") & (core != F.col("class_name")))
        tried = src.select(F.col("fqcn").alias("interface"), "class_name", names).filter("impl_name <> class_name")
        return tried.join(named, "impl_name").filter("implementation <> interface").select("interface", "implementation", F.lit(way).alias("way"), "place")

    every = one.unionByName(by_name(F.col("class_name"), 2, IMPL_SUFFIXES)).unionByName(by_name(F.regexp_replace("class_name", SERVICE_STRIP, ""), 3, (*IMPL_SUFFIXES, "Service")))
    best = every.groupBy("interface").agg(F.min(F.struct("way", "place", "implementation")).alias("b"))
    return best.select("interface", "b.implementation", "b.way")


def tails(name: Column) -> Column:
    """All endings of a dotted name, the whole name first."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def namespace_matches(calls: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Ns, namespace: the mapper namespace that a call means: the same, else the longest one that ends with it, else
    the longest of the call's own endings. Equi-joins over endings instead of a comparison of all pairs."""
    known = namespaces.select("namespace").distinct()
    c = calls.select("ns").filter("ns <> ''").distinct()
    long = c.join(known.select("namespace", F.explode(tails(F.col("namespace"))).alias("ns")), "ns")
    short = c.select("ns", F.explode(tails(F.col("ns"))).alias("namespace")).join(known, "namespace")
    ranked = long.select("ns", "namespace", F.when(F.col("ns") == F.col("namespace"), 0).otherwise(1).alias("way")).unionByName(short.filter("ns <> namespace").select("ns", "namespace", F.lit(2).alias("way")))
    best = ranked.groupBy("ns").agg(F.min(F.struct("way", (-F.length("namespace")).alias("l"), "namespace")).alias("b"), F.count(F.when(F.col("way") == 1, 1)).alias("n_longer"))
    return best.select("ns", "b.namespace", "b.way", (F.col("n_longer") > 1).alias("ambiguous"))


def call_chain(starts: DataFrame, calls: DataFrame, depth: int = 4) -> DataFrame:
    """Start, node, depth: what a method reaches; calls: src, dst (class.method). A call within its own class adds
    no depth; each node counts with its least depth. The rounds go on until none finds a lesser depth, which must come: depths
    only fall."""
    owner = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    steps = cut(calls.select("src", "dst", F.when(owner(F.col("src")) == owner(F.col("dst")), 0).otherwise(1).alias("cost")).distinct())
    seen = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct())
    front = seen
    while not front.isEmpty():
        new = front.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("depth") + F.col("cost")).alias("depth")).filter(F.col("depth") <= depth)
        new = new.groupBy("start", "node").agg(F.min("depth").alias("depth"))
        front = cut(new.join(seen.withColumnRenamed("depth", "old"), ["start", "node"], "left").filter("old is null or depth < old").drop("old"))
        seen = cut(seen.unionByName(front).groupBy("start", "node").agg(F.min("depth").alias("depth")))
    return seen


def framework_votes(files: DataFrame, markers: dict[str, str], dominance: float = 3.0) -> DataFrame:
    """Framework, votes, wins: files that hold each framework's marker; one wins if it has dominance times the rest."""
    flags = F.array(*[F.when(F.col("content").rlike(p), F.lit(k)) for k, p in markers.items()])
    votes = files.select(F.explode(F.array_compact(flags)).alias("framework")).groupBy("framework").agg(F.count("*").alias("votes"))
    total = votes.agg(F.sum("votes").alias("total"))
    return votes.crossJoin(F.broadcast(total)).select("framework", "votes", (F.col("votes") >= dominance * (F.col("total") - F.col("votes"))).alias("wins"))  # one row


def menu_tree(rows: DataFrame, most: int = 20) -> DataFrame:
    """program_id, program_name, main_menu, sub_menu, tab, url, depth of each row with a URL: the first three names from
    the root. rows: program_id, program_nm, url, parent_id. A missing parent is a root; a cycle ends after `most` steps."""
    own = rows.select("program_id", "program_nm", "parent_id")
    up = cut(rows.filter("url is not null and url <> ''").select("program_id", "url", F.col("program_nm").alias("program_name"), F.array("program_nm").alias("chain"), F.col("parent_id").alias("next")))
    parents = own.select(F.col("program_id").alias("next"), F.col("program_nm").alias("up_name"), F.col("parent_id").alias("up_next"))
    done = None
    for step in range(most):
        joined = cut(up.join(parents, "next", "left")) if step < most - 1 else up.withColumn("up_name", F.lit(None).cast("string")).withColumn("up_next", F.col("next"))
        ended = joined.filter("up_name is null").select("program_id", "url", "program_name", "chain")
        done = ended if done is None else done.unionByName(ended)
        up = joined.filter("up_name is not null").select("program_id", "url", "program_name", F.concat(F.array("up_name"), "chain").alias("chain"), F.col("up_next").alias("next"))
        if up.isEmpty():
            break
    at = lambda i: F.coalesce(F.try_element_at("chain", F.lit(i)), F.lit(""))
    return done.select("program_id", "program_name", at(1).alias("main_menu"), at(2).alias("sub_menu"), at(3).alias("tab"), "url", F.size("chain").alias("depth"))


def first_by_url(programs: DataFrame, order: str = "program_id") -> DataFrame:
    """Each normalized URL's first program."""
    key = programs.withColumn("url_key", normalized_url(F.col("url"))).filter("url_key <> ''")
    return key.groupBy("url_key").agg(F.min_by(F.struct(*[c for c in programs.columns]), order).alias("p")).select("url_key", "p.*")


def ranked_matches(candidates: list[DataFrame], key: str, value: str) -> DataFrame:
    """Of several ways to match a key with a value, the first way that does, then the smallest value."""
    out = None
    for i, c in enumerate(candidates):
        one = c.select(key, value, F.lit(i).alias("way"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(key).agg(F.min(F.struct("way", value)).alias("b")).select(key, f"b.{value}", "b.way")


def prefixes(url: Column) -> Column:
    """All leading parts of a path, at slashes, the whole path too."""
    parts = F.filter(F.split(url, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array(F.lit("/")))


def longest_route(urls: DataFrame, routes: DataFrame) -> DataFrame:
    """Url, route: the longest route (but '/') that is the URL or a leading part of it at a slash. The URL's leading
    parts are equi-joined with the routes."""
    each = urls.select("url").distinct().select("url", F.explode(prefixes(F.col("url"))).alias("route"))
    hit = each.join(routes.select("route").distinct().filter("route not in ('', '/')"), "route")
    return hit.groupBy("url").agg(F.max_by("route", F.length("route")).alias("route"))


def app_key(url: Column, segment: int | None = None, parameter: str | None = None) -> Column:
    """The application named by a path segment (from 1) or a query parameter, in lower case; '' if there is none."""
    path = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "^https?://[^/]+", "")
    if segment is not None:
        parts = F.filter(F.split(F.split_part(path, F.lit("?"), F.lit(1)), "/"), lambda p: p != "")
        return F.lower(F.coalesce(F.try_element_at(parts, F.lit(segment)), F.lit("")))
    return F.lower(F.trim(F.regexp_extract(path, rf"(?i)[?&]\s*{parameter}\s*=([^&]*)", 1)))


def prefix_votes(front: DataFrame, back: DataFrame) -> DataFrame:
    """Prefix, n: leading one or two segments without which a URL of one side is one of the other, by votes. Each
    input: url (normalized)."""
    def scan(src: DataFrame, dst: DataFrame) -> DataFrame:
        parts = F.split("url", "/")
        each = src.select("url").distinct().select(parts.alias("p"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).filter("size(p) > k + 1")
        cut_ = each.select(F.concat(F.lit("/"), F.array_join(F.slice("p", 2, F.col("k")), "/")).alias("prefix"), F.concat(F.lit("/"), F.array_join(F.slice("p", F.col("k") + 2, F.size("p")), "/")).alias("url"))
        return cut_.join(dst.select("url").distinct(), "url", "left_semi").select("prefix")

    return scan(front, back).unionByName(scan(back, front)).groupBy("prefix").agg(F.count("*").alias("n"))


def exploded(rows: DataFrame, column: str, separator: str) -> DataFrame:
    """A row for each part of a packed column; a row without parts stays, with null."""
    parts = F.filter(F.transform(F.split(column, separator), lambda p: F.trim(p)), lambda p: p != "")
    return rows.withColumn(column, F.explode_outer(parts))


def in_menu_order(menu: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Every menu entry in its order with its rows, or alone as a placeholder."""
    return menu.join(rows, key, "left").withColumn("placeholder", F.col(rows.columns[-1]).isNull()).orderBy(F.asc_nulls_last(order), key)


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Key, side: what only one side has."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, key, "left_anti").withColumn("side", F.lit("right")))


def page_urls(pages: DataFrame, methods: tuple[str, ...] = ()) -> DataFrame:
    """Path, url: the endpoints that pages (path, content) call, normalized; static files, anchors and the like don't
    count. Comments are left out, a leading expression is dropped, an inner one becomes {p}. Service calls become /id.
    methods: further functions whose first argument is a URL."""
    code = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"(?s)<!--.*?-->|<%--.*?--%>|/\*.*?\*/", " "), r"(?m)(?:^|(?<=[\s;{}]))//[^\n]*", " "), r"\r", "")
    urls = F.flatten(F.array(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in url_places(methods)]))
    plain = F.transform(urls, lambda u: F.regexp_replace(F.regexp_replace(F.trim(u), r"^(?:\$\{[^}]*\}|<%=[^%]*%>)+", ""), r"\$\{[^}]*\}|<%=.*?%>", "{p}"))
    good = F.filter(plain, lambda u: ~u.rlike(NO_ENDPOINT) & u.rlike(ENDPOINT))
    ids = F.transform(F.regexp_extract_all(code, F.lit(SERVICE_CALL), F.lit(1)), lambda i: F.concat(F.lit("/"), i))
    return pages.select("path", F.explode(F.concat(good, ids)).alias("u")).select("path", normalized_url(F.col("u")).alias("url")).distinct()


def services(files: DataFrame) -> DataFrame:
    """service_id, class_name, method, path: service definitions, the first of an id by path and place. A tag without
    id or class isn't one; attributes stand in any order."""
    tags = files.filter("content like '%serviceClass%'").select("path", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?is)<service\b([^>]*)>"), F.lit(1))).alias("pos", "tag"))
    attr = lambda n: F.trim(F.regexp_extract("tag", rf"""(?is)(?:^|\s){n}\s*=\s*["']([^"']*)["']""", 1))
    each = tags.select(attr("id").alias("service_id"), attr("serviceClass").alias("class_name"), attr("method(?:Name)?").alias("method"), "path", "pos").filter("service_id <> '' and class_name <> ''")
    return each.groupBy("service_id").agg(F.min_by(F.struct("class_name", "method", "path"), F.struct("path", "pos")).alias("s")).select("service_id", "s.*")


def nearest_pairs(content: str, a: str, b: str, most: int = 200) -> list[tuple[str, str]]:
    """Each match of a with the nearest unused match of b, up to `most` characters away; the first one wins a tie."""
    left = [(m.start(), m[1]) for m in re.finditer(a, content)]
    right = [(m.start(), m[1]) for m in re.finditer(b, content)]
    used: set[int] = set()
    out = []
    for at, label in left:
        free = [(abs(p - at), i) for i, (p, _) in enumerate(right) if i not in used and abs(p - at) <= most]
        if free:
            i = min(free)[1]
            used.add(i)
            out.append((right[i][1], label))
    return out


# A grid column's header and field.
GRID_HEADER = r"""headerName\s*:\s*['"`]([^'"`\n]+)['"`]"""
GRID_FIELD = r"""field\s*:\s*['"`]([^'"`\n]+)['"`]"""


def grid_labels(files: DataFrame) -> DataFrame:
    """Field, label, n, n_files over source files (path, content)."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(p, f, l) for p, c in zip(x["path"], x["content"], strict=True) if c for f, l in nearest_pairs(c, GRID_HEADER, GRID_FIELD)]
            yield pd.DataFrame(rows, columns=["path", "field", "label"])

    pairs = files.select("path", "content").mapInPandas(work, "path string, field string, label string")
    return pairs.groupBy("field", "label").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))


def body_hash(c: Column, version: str = "v1") -> Column:
    """A hash of a body without comments and with single blanks, bound to a version."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", ""), r"\s+", " "))
    return F.sha2(F.concat(F.lit(version), F.lit("|"), norm), 256)


def worth_reading(methods: DataFrame, hints: list[str], least: int = 120, skip: str = r"^(?:get|set|is|toString|hashCode|equals)") -> DataFrame:
    """Methods (name, body) that are long enough or hold a hint, but for those whose name says they do nothing."""
    return methods.filter(~F.col("name").rlike(skip) & ((F.length("body") >= least) | F.col("body").rlike(r"(?i)\b(?:" + "|".join(hints) + r")\b")))


def top_of(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)
