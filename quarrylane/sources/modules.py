"""Modules of scripts (survey J5, J8, S24, S25): what imports mean, attributes, conditions and input tables of components."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a module's path may end with, in the order of trial.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
IMPORT = r"""(?:\bfrom\s*|\bimport\s*\(\s*|\bimport\s+|\brequire\s*\(\s*)['"]([^'"]+)['"]"""
COMMENT = re.compile(r"/\*.*?\*/|(?<![:'\"])//[^\n]*", re.S)


def path_aliases(config: str, folder: str = "") -> list[tuple[str, str]]:
    """(alias, folder) of a compiler configuration's paths: '@/*' to 'src/*' gives ('@/', 'src/'), longest first. Comments
    and trailing commas are allowed; what can't be read has none."""
    # texts stay, comments between them go
    plain = re.sub(r'("(?:\\.|[^"\\])*")|/\*.*?\*/|//[^\n]*', lambda m: m[1] or "", config or "", flags=re.S)
    try:
        own = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))["compilerOptions"]
    except (ValueError, KeyError, TypeError):
        return []
    base = "/".join(p for p in (folder, own.get("baseUrl", "")) if p not in ("", ".")).strip("/")
    out = []
    for alias, targets in (own.get("paths") or {}).items():
        if targets:
            to = re.sub(r"^\./", "", targets[0]).removesuffix("*")
            out.append((alias.removesuffix("*"), f"{base}/{to}" if base else to))
    return sorted(out, key=lambda x: (-len(x[0]), x[0]))


def joined(folder: str, spec: str) -> str:
    """A relative path from a folder."""
    out: list[str] = [p for p in folder.split("/") if p]
    for p in spec.split("/"):
        if p == "..":
            out = out[:-1]
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def resolved_imports(files: DataFrame, aliases: list[tuple[str, str]] = ()) -> DataFrame:
    """Src, spec, dst: the file that each import of each file (path, content) means, relative or through an alias, by the
    first ending with which there is one; packages have none."""
    each = files.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1)))).alias("spec"))
    known = list(aliases)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for src, spec in zip(b["src"], b["spec"], strict=True):
                if spec.startswith("."):
                    base = joined(src.rpartition("/")[0], spec)
                else:
                    hit = next(((a, f) for a, f in known if spec == a or spec.startswith(a) and a.endswith("/")), None)
                    if hit is None:
                        continue
                    base = joined("", hit[1] + spec[len(hit[0]) :])
                out += [(src, spec, base + e, i) for i, e in enumerate(ENDINGS)]
            yield pd.DataFrame(out, columns=["src", "spec", "dst", "way"])

    tried = each.mapInPandas(work, "src string, spec string, dst string, way int")
    hit = tried.join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return hit.groupBy("src", "spec").agg(F.min_by("dst", "way").alias("dst"))


def closing(text: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`; quotes are passed over."""
    pairs, stack, i = {"{": "}", "(": ")", "[": "]"}, [], at
    while i < len(text):
        c = text[i]
        if c in "'\"`":
            end = text.find(c, i + 1)
            while end > 0 and text[end - 1] == "\\":
                end = text.find(c, end + 1)
            i = end if end > 0 else len(text)
        elif c in pairs:
            stack.append(pairs[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return len(text)


def attributes(tag: str) -> dict[str, str]:
    """A tag's attributes: text without quotes, an expression without braces, 'true' without a value."""
    out, i = {}, 0
    while m := re.compile(r"([A-Za-z_:][\w:.-]*)\s*(=)?\s*").search(tag, i):
        i = m.end()
        if not m[2]:
            out.setdefault(m[1], "true")
        elif tag[i : i + 1] in ("'", '"'):
            end = tag.find(tag[i], i + 1)
            end = len(tag) if end < 0 else end
            out.setdefault(m[1], tag[i + 1 : end])
            i = end + 1
        elif tag[i : i + 1] == "{":
            end = closing(tag, i)
            out.setdefault(m[1], tag[i + 1 : end - 1].strip())
            i = end
        elif v := re.compile(r"[^\s>]+").match(tag, i):
            out.setdefault(m[1], v[0])
            i = v.end()
    return out


def literals(content: str) -> dict[str, str]:
    """The names that a file's constants give to texts; of a repeated name the first."""
    out: dict[str, str] = {}
    for m in re.finditer(r"""\b(?:const|let|var|static)\s+(\w+)\s*(?::\s*\w+\s*)?=\s*(['"`])((?:(?!\2)[^\\\n]|\\.)*)\2""", content):
        out.setdefault(m[1], m[3])
    return out


def condition(content: str, at: int) -> str | None:
    """What must hold for the tag at `at` to be shown: the nearest `x &&` or `x ?` whose brace is still open there."""
    depth = 0
    for i in range(at - 1, -1, -1):
        depth += (content[i] == "}") - (content[i] == "{")
        if depth < 0:
            m = re.match(r"\{\s*((?:[^{}<>?&]|&(?!&)|[<>]=?\s*[\w.'\"]+)+?)\s*(?:&&|\?)\s*\(?\s*", content[i:at], re.S)
            return " ".join(m[1].split()) if m else None
    return None


TAG = re.compile(r"<([A-Za-z][\w.]*)\b")


def components(files: DataFrame) -> DataFrame:
    """Path, pos, tag, attrs, condition of every component of each file (path, content), in order; attributes that name a
    constant of the file have its text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                code = COMMENT.sub(lambda m: " " * len(m[0]), content or "")
                known = literals(code)
                for pos, m in enumerate(TAG.finditer(code)):
                    end, i = len(code), m.end()
                    while i < len(code):
                        if code[i] == "{":
                            i = closing(code, i)
                            continue
                        if code[i] in "'\"":
                            i = code.find(code[i], i + 1) if code.find(code[i], i + 1) > 0 else len(code)
                        elif code[i] == ">":
                            end = i
                            break
                        i += 1
                    own = {k: known.get(v, v) for k, v in attributes(code[m.end() : end].rstrip("/")).items()}
                    out.append((path, pos, m[1], own, condition(code, m.start())))
            yield pd.DataFrame(out, columns=["path", "pos", "tag", "attrs", "condition"])

    return files.select("path", "content").mapInPandas(work, "path string, pos int, tag string, attrs map<string,string>, condition string")


ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.S | re.I)
CELL = re.compile(r"<(th|td)\b[^>]*>(.*?)</\1>", re.S | re.I)


def input_tables(files: DataFrame) -> DataFrame:
    """Path, row_no, label, component, field of input tables: in each row, the components of a cell belong to the nearest
    heading before it. A row without components gives none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                for no, row in enumerate(ROW.finditer(COMMENT.sub(" ", content or "")), 1):
                    label = ""
                    for cell in CELL.finditer(row[1]):
                        if cell[1].lower() == "th":
                            label = " ".join(re.sub(r"<[^>]*>|[{}'\"`]", " ", cell[2]).split())
                            continue
                        for t in re.finditer(r"<([A-Z]\w*|input|select|textarea|button)\b((?:\{[^{}]*\}|[^>{])*)>", cell[2]):
                            a = attributes(t[2].rstrip("/"))
                            out.append((path, no, label, t[1], a.get("name") or a.get("id") or a.get("field")))
            yield pd.DataFrame(out, columns=["path", "row_no", "label", "component", "field"])

    return files.select("path", "content").mapInPandas(work, "path string, row_no int, label string, component string, field string")
