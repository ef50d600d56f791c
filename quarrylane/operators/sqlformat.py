"""Statements laid out for reading (survey G26, S26): right-aligned words, leading commas; places and text stay as they are."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quarrylane.operators import sqltext

#: Words that begin a line, longest first.
STARTS = (
    "LEFT OUTER JOIN", "RIGHT OUTER JOIN", "FULL OUTER JOIN", "WHEN NOT MATCHED THEN", "WHEN MATCHED THEN", "LEFT JOIN", "RIGHT JOIN", "FULL JOIN", "INNER JOIN", "CROSS JOIN", "INSERT INTO", "DELETE FROM", "MERGE INTO", "UNION ALL",
    "GROUP BY", "ORDER BY", "START WITH", "CONNECT BY", "FOR UPDATE", "SELECT", "FROM", "WHERE", "AND", "OR", "ON", "SET", "VALUES", "UPDATE", "HAVING", "UNION", "MINUS", "INTERSECT", "USING", "JOIN", "WITH",
)
#: Columns on which words end.
WIDTH = 6


def width(text: str) -> int:
    """Columns that text takes: East Asian wide characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def layout(sql: str) -> str:
    """Sql with a line for each clause, condition and item: words end at the same column, commas lead. What stands in
    parentheses stays on its line, BETWEEN keeps its AND, comments, literals and placeholders stay. A statement that can't be
    read, or would change but for its blanks, stays as it is."""
    if sqltext.fault(sql):
        return sql
    found = list(sqltext.TOKEN.finditer(sql))
    pieces = [(m.lastgroup or "comment", m[0]) for m in found]
    beside = [bool(k) and found[k - 1].end() == m.start() for k, m in enumerate(found)]
    lines: list[str] = []
    line, depth, i, between, case = "", 0, 0, False, 0

    def flush() -> None:
        nonlocal line
        if line.strip():
            lines.append(line.rstrip())
        line = ""

    while i < len(pieces):
        kind, text = pieces[i]
        if kind == "op":
            depth += (text == "(") - (text == ")")
        word = text.upper() if kind == "word" else ""
        case += (word == "CASE") - (word == "END")
        start = None
        if kind == "word" and depth == 0 and not case:
            start = next((s for s in STARTS if [x.upper() for _, x in pieces[i : i + s.count(" ") + 1]] == s.split(" ")), None)
            if start == "AND" and between:
                start, between = None, False
        if word == "BETWEEN":
            between = True
        if start:
            flush()
            n = start.count(" ") + 1
            own = " ".join(x for _, x in pieces[i : i + n])
            line = " " * max(WIDTH - width(own), 0) + own
            i += n
            continue
        if kind == "op" and text == "," and depth == 0 and not case:
            flush()
            line = " " * (WIDTH - 1) + ","
            i += 1
            continue
        if kind == "comment" and text.startswith("--"):
            line += (" " if line else "") + text
            flush()
            line = " " * WIDTH
            i += 1
            continue
        tight = not line.strip() or beside[i] and text != "=" or text in (")", ",", ".", ";")
        line += ("" if tight or line[-1:] in ("(", " ") else " ") + text
        i += 1
    flush()
    out = "\n".join(lines)
    bare = lambda q: [x for x in (re.sub(r"\s+", "", m[0]) for m in sqltext.TOKEN.finditer(q)) if x]
    return out if bare(out) == bare(sql) else sql


def laid_out(statements: DataFrame) -> DataFrame:
    """Mapper, id, type, sql with each statement laid out; null stays null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = {q: layout(q) if q else q for q in b["sql"].unique()}
            yield b.assign(sql=b["sql"].map(known, na_action="ignore"))

    return statements.select("mapper", "id", "type", "sql").mapInPandas(work, "mapper string, id string, type string, sql string")


def reindented(body: str, indent: str = "    ") -> str:
    """The text of a mapper's statement with its common margin replaced by indent; blank lines at its ends go, relative
    indentation and CDATA sections stay."""
    lines = [x.rstrip() for x in body.expandtabs(4).split("\n")]
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    margin = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(indent + x[margin:] if x.strip() else "" for x in lines)


def localized_cdata(body: str) -> str:
    """A CDATA section around a whole statement is narrowed to the comparisons that need one."""
    m = re.fullmatch(r"\s*<!\[CDATA\[(.*)\]\]>\s*", body, re.S)
    if not m or "]]>" in m[1]:
        return body
    out, at = [], 0
    for x in re.finditer(r"'(?:''|[^'])*'|<>|<=|<|&", m[1]):
        if x[0][0] != "'" or re.search("[<&]", x[0]):
            out += [m[1][at : x.start()], f"<![CDATA[{x[0]}]]>"]
            at = x.end()
    return "".join(out) + m[1][at:]
