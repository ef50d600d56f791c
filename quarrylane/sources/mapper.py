"""SQL mapper files: statements, includes, dynamic tags and their paths (survey A14 to A17, B20 to B22)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

# Statement tags, and the tests that iBatis 2 tags stand for.
STATEMENT_TAGS = ("select", "insert", "update", "delete", "procedure", "statement")
IBATIS_TESTS = {
    "isNotNull": "{p} != null", "isNull": "{p} == null", "isNotEmpty": "{p} != null and {p} != ''", "isEmpty": "{p} == null or {p} == ''",
    "isEqual": "{p} == {v}", "isNotEqual": "{p} != {v}", "isGreaterThan": "{p} > {v}", "isGreaterEqual": "{p} >= {v}", "isLessThan": "{p} < {v}", "isLessEqual": "{p} <= {v}",
    "isPropertyAvailable": "{p} != null", "isNotPropertyAvailable": "{p} == null", "isParameterPresent": "_parameter != null", "isNotParameterPresent": "_parameter == null",
}
PARAMETER = re.compile(r"#(\w[\w.\[\]]*)(?::[\w]+)?#")
INLINE = re.compile(r"\$(\w[\w.\[\]]*)\$")
STATEMENT_SCHEMA = "path string, namespace string, id string, type string, sql string"
PATH_SCHEMA = "path string, namespace string, id string, type string, path_no int, label string, sql string, activations map<string,boolean>"


def local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def parse(content: str) -> ET.Element | None:
    """The root of a mapper file, None if it is no XML; a document type is left out."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>", "", content, flags=re.S).lstrip("﻿ \t\r\n")
    try:
        return ET.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", text))
    except ET.ParseError:
        return None


def cleaned(sql: str) -> str:
    """A16 for one text."""
    for p, to in ((r"(?s)/\*.*?\*/", " "), (r"--[^\n]*", " "), (r"[#$]\{[^}]*\}", "?"), (r"<!\[CDATA\[|\]\]>", ""), (r"<[/!?A-Za-z][^>]*>", " "), (r"\s+", " ")):
        sql = re.sub(p, to, sql)
    return sql.strip()


@dataclass
class Course:
    """Which parts of a dynamic statement are on: everything at once, or one static path."""

    everything: bool = False
    on: bool = True
    picks: dict[int, int] = field(default_factory=dict)
    items: int = 1


class Renderer:
    """Renders a statement along one course."""

    def __init__(self, fragments: dict[str, ET.Element], course: Course):
        self.fragments, self.course = fragments, course
        self.activations: dict[str, bool] = {}
        self.numbers = {"if": 0, "choose": 0}

    def body(self, e: ET.Element, inside: tuple[str, ...] = ()) -> str:
        return (e.text or "") + "".join(self.element(c, inside) + (c.tail or "") for c in e)

    def number(self, kind: str) -> int:
        self.numbers[kind] += 1
        return self.numbers[kind] - 1

    def element(self, e: ET.Element, inside: tuple[str, ...]) -> str:
        tag, c = local(e.tag), self.course
        if tag == "include":
            ref = (e.get("refid") or "").rpartition(".")[2]
            return self.body(self.fragments[ref], (*inside, ref)) if ref in self.fragments and ref not in inside else ""
        if not tag or tag in ("bind", "selectKey"):
            return ""
        if c.everything:
            return f" {self.body(e, inside)} "
        if tag == "if":
            self.activations[f"if[{self.number('if')}][test={e.get('test', '')}]"] = c.on
            return self.body(e, inside) if c.on else ""
        if tag == "choose":
            return self.choose(e, inside)
        if tag == "foreach":
            return self.foreach(e, inside)
        if tag == "where":
            return self.trimmed(self.body(e, inside), "WHERE", "AND |OR ", "", "")
        if tag == "set":
            return self.trimmed(self.body(e, inside), "SET", "", "", ",")
        if tag == "trim":
            return self.trimmed(self.body(e, inside), e.get("prefix", ""), e.get("prefixOverrides", ""), e.get("suffix", ""), e.get("suffixOverrides", ""))
        return self.body(e, inside)

    def choose(self, e: ET.Element, inside: tuple[str, ...]) -> str:
        n = self.number("choose")
        branches = [b for b in e if local(b.tag) in ("when", "otherwise")]
        whens = [b for b in branches if local(b.tag) == "when"]
        other = next((b for b in branches if local(b.tag) == "otherwise"), None)
        pick = self.course.picks.get(n, 0) if self.course.on else -1
        taken = other if pick < 0 or not whens else whens[min(pick, len(whens) - 1)]
        for i, w in enumerate(whens):
            self.activations[f"choose[{n}]/when[{i}]"] = w is taken
        if other is not None:
            self.activations[f"choose[{n}]/otherwise"] = other is taken
        return self.body(taken, inside) if taken is not None else ""

    def foreach(self, e: ET.Element, inside: tuple[str, ...]) -> str:
        n = self.course.items if self.course.on else 0
        if not n:
            return ""
        return e.get("open", "") + e.get("separator", "").join(self.body(e, inside) for _ in range(n)) + e.get("close", "")

    @staticmethod
    def trimmed(body: str, prefix: str, prefix_overrides: str, suffix: str, suffix_overrides: str) -> str:
        """A body without one leading and one trailing override, the longest that fits, between prefix and suffix; nothing
        if it is blank."""
        text = body.strip()
        if not text:
            return ""
        for o in sorted(filter(None, prefix_overrides.split("|")), key=len, reverse=True):
            if text.upper().startswith(o.strip().upper()) and (not o.strip()[-1:].isalnum() or not text[len(o.strip()) : len(o.strip()) + 1].isalnum()):
                text = text[len(o.strip()) :].lstrip()
                break
        for o in sorted(filter(None, suffix_overrides.split("|")), key=len, reverse=True):
            if text.upper().endswith(o.strip().upper()):
                text = text[: len(text) - len(o.strip())].rstrip()
                break
        return f" {prefix} {text} {suffix} " if text else ""


def fragments(root: ET.Element) -> dict[str, ET.Element]:
    """The file's <sql> fragments by id."""
    return {e.get("id", ""): e for e in root.iter() if local(e.tag) == "sql" and e.get("id")}


def paths(e: ET.Element, parts: dict[str, ET.Element], most: int = 10, level: int = 2) -> list[tuple[str, str, dict[str, bool]]]:
    """Label, SQL and activations of a statement's representative static paths, each text once.

    Everything on, everything off; from level 2 each further branch of each choice; from level 3 two items of a loop.
    """
    courses = [("max", Course()), ("min", Course(on=False))]
    if level >= 2:
        for n, c in enumerate(x for x in e.iter() if local(x.tag) == "choose"):
            whens = [w for w in c if local(w.tag) == "when"]
            courses += [(f"choose[{n}]/when[{i}]", Course(picks={n: i})) for i in range(1, len(whens))]
            courses += [(f"choose[{n}]/otherwise", Course(picks={n: -1})) for w in c if local(w.tag) == "otherwise"]
    if level >= 3 and any(local(x.tag) == "foreach" for x in e.iter()):
        courses.append(("foreach[n=2]", Course(items=2)))
    out: dict[str, tuple[str, dict[str, bool]]] = {}
    for label, course in courses:
        r = Renderer(parts, course)
        sql = re.sub(r"\s+", " ", r.body(e)).strip()
        out.setdefault(sql, (label, r.activations))
    return [(label, sql, on) for sql, (label, on) in out.items()][:most]


def to_mybatis(root: ET.Element) -> int:
    """Turns iBatis 2 tags and parameters of a tree into those of MyBatis 3, in place; the number of changes. A tree that
    needs none stays as it is."""
    changes = 0
    if local(root.tag) == "sqlMap":
        root.tag, changes = "mapper", 1
    for e in root.iter():
        tag = local(e.tag)
        prepend, prop, value = e.get("prepend", ""), e.get("property", ""), e.get("compareProperty") or e.get("compareValue", "")
        if tag in IBATIS_TESTS or re.match(r"is[A-Z]", tag):
            quoted = value if e.get("compareProperty") or re.fullmatch(r"-?\d+(?:\.\d+)?", value) else f"'{value}'"
            test = IBATIS_TESTS.get(tag, "true").format(p=prop, v=quoted)
            e.tag = "if"
            e.attrib.clear()
            e.set("test", test)
            if prepend and not (e.text or "").lstrip().upper().startswith(prepend.strip().upper()):
                e.text = f" {prepend} {e.text or ''}"
        elif tag == "dynamic":
            e.tag = {"WHERE": "where", "SET": "set"}.get(prepend.strip().upper(), "trim")
            e.attrib.clear()
            if e.tag == "trim" and prepend:
                e.set("prefix", prepend)
        elif tag == "iterate":
            was = dict(e.attrib)
            e.tag = "foreach"
            e.attrib.clear()
            for k, v in (("collection", prop or "list"), ("item", "item"), ("open", was.get("open", "")), ("close", was.get("close", "")), ("separator", was.get("conjunction", ""))):
                if v:
                    e.set(k, v)
            e.text = f" {prepend} {e.text or ''}" if prepend else e.text
        else:
            changes -= 1
        changes += 1
        for side in ("text", "tail"):
            if text := getattr(e, side):
                new, n = PARAMETER.subn(r"#{\1}", text)
                new, m = INLINE.subn(r"${\1}", new)
                if n + m:
                    setattr(e, side, new)
                    changes += n + m
    return changes


BROKEN = re.compile(r"<(select|insert|update|delete|procedure|statement)\b([^>]*)>(.*?)</\1\s*>", re.S | re.I)


def statements_of(path: str, content: str) -> list[tuple[str, str, str, str, str]]:
    """The statements of one file with all branches in a row; a file that is no XML is read tag by tag."""
    root = parse(content)
    if root is None:
        ns = re.search(r"""\bnamespace\s*=\s*["']([^"']*)""", content)
        out = []
        for m in BROKEN.finditer(content):
            key = re.search(r"""\bid\s*=\s*["']([^"']*)""", m[2])
            out.append((path, ns[1] if ns else "", key[1] if key else "", m[1].lower(), cleaned(m[3])))
        return out
    parts = fragments(root)
    ns = root.get("namespace", "")
    return [(path, ns, e.get("id", ""), local(e.tag), cleaned(Renderer(parts, Course(everything=True)).body(e))) for e in root.iter() if local(e.tag) in STATEMENT_TAGS and e.get("id")]


def statements(files: DataFrame) -> DataFrame:
    """Path, namespace, id, type, sql of mapper files (path, content); null contents give none."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) if c for r in statements_of(p, c)]
            yield pd.DataFrame(rows, columns=["path", "namespace", "id", "type", "sql"])

    return files.select("path", "content").mapInPandas(work, STATEMENT_SCHEMA)


def expanded(files: DataFrame, most: int = 10, level: int = 2) -> DataFrame:
    """The static paths of each statement, after iBatis tags became MyBatis ones."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"], strict=True):
                root = parse(c) if c else None
                if root is None:
                    continue
                to_mybatis(root)
                parts = fragments(root)
                for e in root.iter():
                    if local(e.tag) in STATEMENT_TAGS and e.get("id"):
                        rows += [(p, root.get("namespace", ""), e.get("id"), local(e.tag), i, label, sql, on) for i, (label, sql, on) in enumerate(paths(e, parts, most, level))]
            yield pd.DataFrame(rows, columns=["path", "namespace", "id", "type", "path_no", "label", "sql", "activations"])

    return files.select("path", "content").mapInPandas(work, PATH_SCHEMA)
