"""Java sources read into classes, methods, endpoints and calls (survey A19, H2 to H8, S13 to S16)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

# Annotations, base classes, context types and operations that the scanner knows.
MAPPINGS = {"RequestMapping": "", "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
STEREOTYPES = ("Controller", "RestController", "Service", "Component", "Repository", "Mapper")
INJECTIONS = ("Autowired", "Resource", "Inject")
CONTEXT_BASES = ("AbstractMultiActionBizController", "AbstractSingleActionBizController", "AbstractBizController", "AbstractCommonBizController")
CONTEXT_TYPES = ("IDataSet", "IBizServiceContext", "IOnlineContext", "IDataSetHelper", "HttpServletRequest")
#: What calls statements: anything named after SQL, a data access object, a template or a runner.
SQL_RECEIVER = r"(?:\w*(?:sql|Sql|SQL)\w*|\w*(?:[Dd]ao|DAO|[Tt]emplate|[Rr]unner))"
SQL_OPERATION = r"(?:selectList|selectOne|selectMap|selectPage|selectCount|selectCursor|queryForList|queryForObject|queryForMap|insertBatch|updateBatch|deleteBatch|insert|update|delete|save|execute|call|query|select)"
JOBS = {"Tasklet": "tasklet", "ItemReader": "reader", "ItemStreamReader": "reader", "ItemWriter": "writer", "ItemStreamWriter": "writer", "ItemProcessor": "processor", "Job": "quartz", "QuartzJobBean": "quartz"}
NO_CALL = frozenset("if for while switch catch return new throw synchronized super this else do try assert".split())

CLASS = re.compile(r"\b(class|interface|enum)\s+(\w+)(?:\s*<[^{]*?>)?((?:\s+extends\s+[\w.<>,\s?&]+?)?)((?:\s+implements\s+[\w.<>,\s?&]+?)?)\s*\{")
METHOD = re.compile(r"((?:@\w[\w.]*(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*)*)((?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*)(?:<[^>]+>\s*)?([\w.]+(?:\s*<[^;{}()=]*>)?(?:\[\])*)\s+(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?:throws\s+[\w.,\s]+)?\{")
MODIFIER = r"(?:private|protected|public|static|final|transient|volatile)\s+"
FIELD = re.compile(rf"(?=@|\b(?:private|protected|public|static|final|transient|volatile)\b)((?:@[\w.]+(?:\s*\([^()]*\))?\s*)*)((?:{MODIFIER})*)([\w.]+)(?:\s*<[^;=>]*>)?\s+(\w+)\s*(?:=\s*([^;]*))?;")
HEAD = re.compile(r"(?:@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?\s*|\b(?:public|protected|private|abstract|final|static)\s+)+")
ROUTE = re.compile(r"\b\w+\.(get|post|put|delete|patch|options|head|route)\s*\(\s*\"([^\"]+)\"\s*\)\s*\.\s*handler\s*\(")
CHAIN = re.compile(r"\b\w+\.route\s*\(\s*\)((?:\s*\.\s*\w+\s*\([^()]*\))+?)\s*\.\s*handler\s*\(")
CALL = re.compile(r"(?:\b(\w+)\s*\.\s*)?\b(\w+)\s*\(")
STRING = re.compile(r'"(?:\\.|[^"\\\n])*"')

CLASS_SCHEMA = "path string, fqcn string, package string, class_name string, kind string, stereotypes array<string>, parent string, implements array<string>, imports array<string>, fields array<struct<type: string, name: string, injected: boolean>>"
METHOD_SCHEMA = "path string, fqcn string, method string, verb string, class_paths array<string>, method_paths array<string>, body string, calls array<struct<receiver: string, name: string, at: int>>, sql_ids array<string>"


def without_comments(code: str) -> str:
    """The code with comments blanked, so that places stay; strings are left alone."""
    def blank(m: re.Match) -> str:
        return m[0] if m[0][0] in "\"'" else re.sub(r"[^\n]", " ", m[0])

    return re.sub(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|/\*.*?\*/|//[^\n]*', blank, code, flags=re.S)


def without_strings(code: str) -> str:
    """The code with the insides of strings blanked, for counting braces."""
    return STRING.sub(lambda m: '"' + " " * (len(m[0]) - 2) + '"', re.sub(r"'(?:\\.|[^'\\\n])'", "' '", code))


def closing(code: str, at: int) -> int:
    """Where the brace at `at` closes; the end if it doesn't."""
    depth = 0
    for m in re.finditer(r"[{}]", code[at:]):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return at + m.start()
    return len(code)


def annotation(text: str, names: tuple[str, ...]) -> tuple[str, str] | None:
    """The first annotation of these names in text, with its arguments."""
    m = re.search(r"@(?:[\w.]+\.)?(" + "|".join(names) + r")\b(?:\s*\(((?:[^()]|\([^()]*\))*)\))?", text)
    return (m[1], m[2] or "") if m else None


def mapped_paths(args: str) -> list[str]:
    """The paths of a mapping's arguments: keyed or bare, one or several; other keys don't count."""
    keyed = re.search(r"\b(?:value|path)\s*=\s*(\{[^}]*\}|\"[^\"]*\")", args)
    bare = re.match(r"\s*(\{[^}]*\}|\"[^\"]*\")", args)
    found = keyed or bare
    return [s[1:-1] for s in STRING.findall(found[1])] if found else []


@dataclass
class Source:
    """One file: classes and methods as rows of CLASS_SCHEMA and METHOD_SCHEMA."""

    path: str
    classes: list[dict] = field(default_factory=list)
    methods: list[dict] = field(default_factory=list)


def constants(body: str) -> dict[str, str]:
    """Names of text constants with their expressions."""
    return {m[1]: m[2] for m in re.finditer(r"\bString\s+(\w+)\s*=\s*([^;]+);", body)}


def evaluated(expr: str, known: dict[str, str], depth: int = 6, most: int = 32) -> list[str]:
    """The texts that an expression may be: literals, sums, both sides of a choice, names; none if any part is unknown."""
    expr = expr.strip()
    while expr.startswith("(") and expr.endswith(")") and expr.count("(") == 1:
        expr = expr[1:-1].strip()
    if depth < 0 or not expr:
        return []
    if choice := re.fullmatch(r"[^?\"]*\?\s*((?:\"[^\"]*\"|[^:\"])+):((?:\"[^\"]*\"|[^\"])+)", expr):
        a, b = evaluated(choice[1], known, depth - 1, most), evaluated(choice[2], known, depth - 1, most)
        return (a + b)[:most] if a and b else []
    parts = [p for p in re.findall(r"\"(?:\\.|[^\"\\])*\"|[^+\"]+", expr) if p.strip()]
    out = [""]
    for p in parts:
        p = p.strip()
        if p[0] == '"':
            options = [p[1:-1]]
        elif re.fullmatch(r"[\w.]+", p) and p.rpartition(".")[2] in known:
            options = evaluated(known[p.rpartition(".")[2]], known, depth - 1, most)
        else:
            return []
        out = [a + b for a in out for b in options][:most]
    return out if parts else []


def read(path: str, content: str, suffix: str = ".do") -> Source:
    """What one Java file declares; a file without a class gives nothing."""
    code = without_comments(content)
    bare = without_strings(code)
    out = Source(path)
    package = (re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", code) or [None, ""])[1]
    imports = re.findall(r"(?m)(?:^|;)\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code)
    for m in CLASS.finditer(bare):
        start, end = m.end() - 1, closing(bare, m.end() - 1)
        before = code[: m.start()]
        head = next((h[0] for h in HEAD.finditer(before) if h.end() == len(before)), "")
        names = lambda s, w: [re.sub(r"<.*", "", x).strip() for x in re.split(r",(?![^<]*>)", re.sub(rf"^\s*{w}\s+", "", s)) if x.strip()]
        body, own = code[start : end + 1], bare[start : end + 1]
        # nested classes have rows of their own
        inner = [(k.start(), closing(own, k.end() - 1)) for k in CLASS.finditer(own)]
        for a, b in inner:
            own = own[:a] + re.sub(r"[^\n]", " ", own[a : b + 1]) + own[b + 1 :]
        fqcn = f"{package}.{m[2]}" if package else m[2]
        parent = (names(m[3], "extends") or [""])[0]
        known = constants(body)
        methods = list(METHOD.finditer(own))
        outside = own
        for k in reversed(methods):
            outside = outside[: k.end()] + re.sub(r"[^\n]", " ", outside[k.end() : closing(own, k.end() - 1)]) + outside[closing(own, k.end() - 1) :]
        fields = [{"type": f[3], "name": f[4], "injected": bool(annotation(f[1], INJECTIONS)) or "final" in f[2] and "static" not in f[2] and not f[5]} for f in FIELD.finditer(outside) if f[3] not in NO_CALL]
        made = re.search(rf"\b{m[2]}\s*\(([^()]*)\)\s*\{{", outside)
        for p in re.findall(r"(?:final\s+)?([\w.]+)(?:\s*<[^>]*>)?\s+(\w+)", made[1]) if made else []:
            fields += [{"type": p[0], "name": p[1], "injected": True}] * (p[1] not in {f["name"] for f in fields})
        at = annotation(head, tuple(MAPPINGS))
        class_paths = mapped_paths(at[1]) if at else []
        out.classes.append(
            {"path": path, "fqcn": fqcn, "package": package, "class_name": m[2], "kind": m[1], "stereotypes": [s for s in STEREOTYPES if re.search(rf"@{s}\b", head)], "parent": parent, "implements": names(m[4], "implements"), "imports": imports, "fields": fields}
        )
        for k in methods:
            if k[4] in NO_CALL or k[3] in ("new", "return", "else", "throw"):
                continue
            a, b = k.end() - 1, closing(own, k.end() - 1)
            text, plain = body[a : b + 1], own[a : b + 1]
            notes = body[k.start(1) : k.end(1)]
            verb, paths = "", []
            if ann := annotation(notes, tuple(MAPPINGS)):
                named = re.search(r"RequestMethod\.(\w+)", ann[1])
                verb, paths = MAPPINGS[ann[0]] or (named[1] if named else "ANY"), mapped_paths(ann[1]) or [""]
            elif parent in CONTEXT_BASES and "public" in k[2] and any(re.search(rf"\b{t}\b", k[5]) for t in CONTEXT_TYPES):
                verb, paths = "ANY", [f"/{k[4]}{suffix}"]
            local = known | constants(text)
            sql = [s for c in re.finditer(rf"\b{SQL_RECEIVER}(?:\.\w+)?\s*\.\s*{SQL_OPERATION}\s*\(\s*([^,()]+(?:\([^()]*\)[^,()]*)*)", text) for s in evaluated(c[1], local) if "." in s]
            calls = [{"receiver": c[1] or "this", "name": c[2], "at": c.start()} for c in CALL.finditer(plain) if c[2] not in NO_CALL and not re.search(r"\bnew\s+$", plain[: c.start()])]
            out.methods.append({"path": path, "fqcn": fqcn, "method": k[4], "verb": verb, "class_paths": class_paths, "method_paths": paths, "body": text, "calls": calls, "sql_ids": list(dict.fromkeys(sql))})
        for k in ROUTE.finditer(body):
            out.methods.append({"path": path, "fqcn": fqcn, "method": "handler", "verb": k[1].upper() if k[1] != "route" else "ANY", "class_paths": [], "method_paths": [k[2]], "body": "", "calls": [], "sql_ids": []})
        for k in CHAIN.finditer(body):
            p, v = re.search(r"\.\s*path\s*\(\s*\"([^\"]+)\"", k[1]), re.search(r"HttpMethod\.(\w+)", k[1])
            if p:
                out.methods.append({"path": path, "fqcn": fqcn, "method": "handler", "verb": v[1] if v else "ANY", "class_paths": [], "method_paths": [p[1]], "body": "", "calls": [], "sql_ids": []})
        if (rest := annotation(head, ("RestVerticle",))) and (u := re.search(r"\burl\s*=\s*\"([^\"]+)\"", rest[1])):
            v = re.search(r"\bmethod\s*=\s*(?:HttpMethod\.)?(\w+)", rest[1])
            out.methods.append({"path": path, "fqcn": fqcn, "method": "handle", "verb": v[1].upper() if v else "ANY", "class_paths": [], "method_paths": [u[1]], "body": "", "calls": [], "sql_ids": []})
    return out


def _rows(files: DataFrame, what: str, schema: str) -> DataFrame:
    names = [c.split()[0] for c in re.split(r", (?=\w+ (?:string|array))", schema)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) if c for r in getattr(read(p, c), what)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(work, schema)


def classes(files: DataFrame) -> DataFrame:
    """H4, H5: the classes of Java files (path, content)."""
    return _rows(files, "classes", CLASS_SCHEMA)


def methods(files: DataFrame) -> DataFrame:
    """H2, H3, H6: the methods of Java files with their endpoints, calls in order and SQL ids."""
    return _rows(files, "methods", METHOD_SCHEMA)


def job_entries(classes_: DataFrame) -> DataFrame:
    """H8: fqcn, job_kind: batch and scheduler jobs, by what a class implements or extends."""
    from pyspark.sql import functions as F

    kinds = F.create_map(*[F.lit(x) for kv in JOBS.items() for x in kv])
    each = classes_.select("fqcn", F.explode(F.concat("implements", F.array("parent"))).alias("base")).select("fqcn", kinds[F.regexp_replace("base", r"^.*\.", "")].alias("job_kind"))
    return each.filter("job_kind is not null").distinct()


def resolved_calls(classes_: DataFrame, methods_: DataFrame) -> DataFrame:
    """S15, H12's edges: src, dst as class.method: a call on a field goes to the field's type, by import, else in the same
    package; a bare call stays in its class."""
    from pyspark.sql import functions as F

    own = classes_.select("fqcn", "package", "class_name")
    fields = classes_.select("fqcn", "package", "imports", F.explode("fields").alias("f")).select("fqcn", "package", "imports", F.col("f.name").alias("receiver"), F.col("f.type").alias("type"))
    typed = fields.select("fqcn", "receiver", F.when(F.instr("type", ".") > 0, F.col("type")).otherwise(F.coalesce(F.get(F.filter("imports", lambda i: F.endswith(i, F.concat(F.lit("."), F.col("type")))), 0), F.concat_ws(".", F.nullif("package", F.lit("")), "type"))).alias("target"))
    calls = methods_.select("fqcn", "method", F.explode("calls").alias("c")).select("fqcn", "method", F.col("c.receiver").alias("receiver"), F.col("c.name").alias("name"))
    joined = calls.join(typed, ["fqcn", "receiver"], "left")
    target = F.when(F.col("receiver") == "this", F.col("fqcn")).otherwise(F.col("target"))
    edges = joined.select(F.concat_ws(".", "fqcn", "method").alias("src"), target.alias("owner"), "name").filter("owner is not null")
    return edges.join(own.select(F.col("fqcn").alias("owner")).distinct(), "owner", "left_semi").select("src", F.concat_ws(".", "owner", "name").alias("dst")).distinct()
