"""Sheets of menus and dictionaries, and mapping documents (survey A22 to A27, S5 to S9). A sheet is a small table that somebody
wrote by hand; it is read on the driver as rows of cells and becomes a DataFrame."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession

# How headers of menu sheets are written.
LEVELS = {1: ("1레벨", "level1", "lv1", "lvl1", "대분류"), 2: ("2레벨", "level2", "lv2", "lvl2", "중분류"), 3: ("3레벨", "level3", "lv3", "lvl3", "소분류"), 4: ("4레벨", "level4", "lv4", "lvl4", "세분류"), 5: ("5레벨", "level5", "lv5", "lvl5", "최하위")}
URL_SURE, URL_MAYBE = ("url", "uri", "link", "endpoint"), ("경로", "path")
NAMES, DEPTHS, PATHS = ("메뉴명", "화면명", "프로그램명", "menuname", "name", "명칭"), ("depth", "레벨", "level", "lv", "깊이"), ("메뉴경로", "menupath", "전체경로", "path", "경로")
# How headers of dictionary sheets are written: the field, the whole header or a part of it, in the order of trial.
FIELDS = [
    ("eng", ("영문명", "영문"), ("물리의미", "영문풀")), ("logical", ("한글", "한글명칭", "속성명", "논리명칭"), ("논리명", "한글명")), ("physical", ("물리", "물리명칭", "영문명약어"), ("물리명", "컬럼명", "영문약어")), ("compose", ("구성",), ("구성정보",)),
    ("domain_group", (), ("도메인그룹",)), ("domain_name", (), ("도메인",)), ("data_type", (), ("데이터유형", "데이터타", "자료형")), ("data_length", ("길이",), ("데이터길이", "길이")), ("data_scale", (), ("소수",)), ("is_classifier", (), ("분류어",)), ("is_std", ("표준",), ("표준여부",)),
    ("synonyms", (), ("동의어", "유의어", "이음동의")), ("privacy", (), ("개인정보",)), ("encrypt", (), ("암호화",)), ("desc", (), ("설명", "정의", "비고")), ("expire", (), ("만료",)), ("source", (), ("출처",)),
]
MAPPING_HEADERS = {"as_is_table": ("asistable", "as_is_table", "asis_table"), "as_is_column": ("asiscolumn", "as_is_column", "asis_column"), "as_is_type": ("asiscolumntype", "as_is_type", "asis_column_type"), "to_be_table": ("tobetable", "to_be_table", "tobe_table"), "to_be_column": ("tobecolumn", "to_be_column", "tobe_column"), "to_be_type": ("tobecolumntype", "to_be_type", "tobe_column_type")}
MENU = "row_no int, level1 string, level2 string, level3 string, level4 string, level5 string, url string, program_name string, menu_path string"

Rows = list[list[str]]


def markdown_rows(text: str) -> Rows:
    """The rows of a text's pipe tables, or of tab-separated lines, without rulers."""
    out = []
    for line in text.replace("\r", "").split("\n"):
        if "|" in line:
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
        elif "\t" in line:
            cells = [c.strip() for c in line.split("\t")]
        else:
            continue
        if not all(re.fullmatch(r":?-{2,}:?", c) for c in cells if c):
            out.append(cells)
    return out


def header(cell: object) -> str:
    """A header as compared: composed, without remarks in brackets, marks, blanks and leading numbers, in lower case."""
    t = unicodedata.normalize("NFC", str(cell or ""))
    t = re.sub(r"[​-‍﻿]", "", t)
    t = re.sub(r"[*※★●○◦:：·\s]", "", re.sub(r"\(.*?\)", "", t))
    return re.sub(r"^[0-9]+[.)\-](?=\D)", "", t).lower()


def field_of(cell: object) -> str | None:
    """The dictionary field that a header names; whole headers go before parts, in the order of FIELDS."""
    t = header(cell)
    if not t:
        return None
    return next((f for f, whole, parts in FIELDS if t in whole or any(p in t for p in parts)), None)


def header_row(rows: Rows, required: tuple[str, ...] = ("logical", "physical"), within: int = 20) -> int | None:
    """The first of the upper rows whose headers name all required fields."""
    return next((i for i, r in enumerate(rows[:within]) if set(required) <= {field_of(c) for c in r}), None)


def dictionary(spark: SparkSession, sheets: dict[str, Rows], fields: list[str], required: tuple[str, ...] = ("logical", "physical")) -> DataFrame:
    """Sheet, row_no and the fields of the sheet that has the required headers and the most rows, the first of several; a
    cover sheet or one without headers is passed over. Blank cells are null, blank rows left out; of two columns for one field the first counts."""
    best: tuple[int, str, int] | None = None
    for name, rows in sheets.items():
        at = header_row(rows, required)
        if at is not None:
            n = sum(any(c not in (None, "") for c in r) for r in rows[at + 1 :])
            if best is None or n > best[0]:
                best = (n, name, at)
    schema = "sheet string, row_no int, " + ", ".join(f"{f} string" for f in fields)
    if best is None:
        return spark.createDataFrame([], schema)
    _, name, at = best
    place: dict[str, int] = {}
    for i, c in enumerate(sheets[name][at]):
        if (f := field_of(c)) in fields:
            place.setdefault(f, i)
    cell = lambda r, f: (str(r[place[f]]).strip() or None) if f in place and place[f] < len(r) and r[place[f]] is not None else None
    out = [(name, i, *[cell(r, f) for f in fields]) for i, r in enumerate(sheets[name][at + 1 :], 1)]
    return spark.createDataFrame([r for r in out if any(r[2:])], schema)


def menu_layout(heads: list[str]) -> dict | None:
    """How a menu sheet is laid out: a column for each level, a name with its depth, or a path; and where the URL is."""
    norm = [header(h) for h in heads]
    find = lambda test: next((i for i, h in enumerate(norm) if h and test(h)), None)
    url = find(lambda h: any(k in h for k in URL_SURE))
    if url is None:
        url = find(lambda h: any(h == k or h.endswith(k) for k in URL_MAYBE))
    levels = {n: i for n, keys in LEVELS.items() if (i := find(lambda h, keys=keys: any(k in h for k in keys))) is not None}
    if levels:
        return {"mode": "levels", "levels": levels, "url": url}
    name, depth = find(lambda h: any(k in h for k in NAMES)), find(lambda h: h in DEPTHS)
    if name is not None and depth is not None:
        return {"mode": "depth", "name": name, "depth": depth, "url": url}
    path = find(lambda h: any(k in h for k in PATHS))
    return {"mode": "path", "path": path, "url": None if url == path else url} if path is not None else None


def menu(spark: SparkSession, rows: Rows, separator: str = ">") -> DataFrame:
    """A menu sheet in any layout as MENU: upper levels are filled from above, a new name clears the deeper ones.
    Rows without a URL are folders and give no row; one with a URL but no name is named after its row."""
    at, layout = next(((i, got) for i, r in enumerate(rows[:20]) if (got := menu_layout(r)) and got["url"] is not None), (0, None))
    out = []
    last = [""] * 5
    if layout:
        get = lambda r, i: str(r[i]).strip() if i is not None and i < len(r) and r[i] is not None else ""
        for no, r in enumerate(rows[at + 1 :], 1):
            if layout["mode"] == "levels":
                own = [get(r, layout["levels"].get(n)) for n in range(1, 6)]
                first = next((i for i, x in enumerate(own) if x), None)
                if first is not None:
                    last = [*last[:first], *own[first:]]
                    shown = last
                else:
                    shown = [""] * 5
            elif layout["mode"] == "depth":
                name, depth = get(r, layout["name"]), re.sub(r"\D", "", get(r, layout["depth"]))
                if not name or not depth or not 1 <= int(depth) <= 5:
                    continue
                last = [*last[: int(depth) - 1], name, *[""] * (5 - int(depth))]
                shown = last
            else:
                parts = [p.strip() for p in get(r, layout["path"]).split(separator) if p.strip()]
                shown = [*parts, *[""] * 5][:5] if len(parts) <= 5 else parts[:5]
            url = get(r, layout["url"])
            if url:
                names = [x for x in shown if x] or [f"(menu row {no})"]
                out.append((no, *[x or None for x in shown], url, names[-1], " > ".join(names)))
    return spark.createDataFrame(out, MENU)


def mapping_rows(spark: SparkSession, text: str) -> DataFrame:
    """The rows of a flat mapping document, for migrate.flat_mapping; without the two needed headers there are none."""
    from quarrylane.operators.migrate import MAPPING

    rows = markdown_rows(text)
    place: dict[str, int] = {}
    for i, c in enumerate(rows[0] if rows else []):
        key = re.sub(r"[\s-]", "", c.lower())
        for f, names in MAPPING_HEADERS.items():
            if key in names:
                place.setdefault(f, i)
    fields = [c.split()[0] for c in MAPPING.split(", ")]
    if not {"as_is_table", "as_is_column"} <= set(place):
        return spark.createDataFrame([], MAPPING)
    cell = lambda r, f: (r[place[f]] or None) if f in place and place[f] < len(r) else None
    return spark.createDataFrame([tuple(cell(r, f) for f in fields) for r in rows[1:]], MAPPING)


def load_mapping(text: str) -> tuple[list[dict], list[str]]:
    """A mapping document in YAML as column rows (as migrate.Mapping takes them) and what is wrong with it. Bad entries
    are left out, the others count."""
    import yaml

    try:
        doc = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        return [], [f"not YAML: {e}"]
    rows, wrong = [], []
    tables: dict[str, str | None] = {}
    kinds: dict[str, str] = {}
    for i, t in enumerate(doc.get("tables") or []):
        kind, a, b = t.get("type", "rename"), t.get("as_is"), t.get("to_be")
        if kind not in ("rename", "split", "merge", "drop") or not a:
            wrong.append(f"tables[{i}]: type or as_is")
        elif kind in ("rename", "merge") and not isinstance(b, str):
            wrong.append(f"tables[{i}]: to_be must be one table")
        elif kind == "split" and (not isinstance(b, list) or len(b) < 2):
            wrong.append(f"tables[{i}]: a split needs two targets")
        else:
            for x in a if isinstance(a, list) else [a]:
                if x.upper() in kinds:
                    wrong.append(f"tables[{i}]: {x} is defined twice")
                tables[x.upper()] = b.upper() if isinstance(b, str) and kind != "drop" else None
                kinds[x.upper()] = kind
    known: set[tuple[str, str]] = set()
    for i, c in enumerate(doc.get("columns") or []):
        a, where = c.get("as_is"), f"columns[{i}]"
        sources = a if isinstance(a, list) else [a]
        if not a or not all(isinstance(s, dict) and s.get("table") and s.get("column") for s in sources):
            wrong.append(f"{where}: as_is needs table and column")
            continue
        if "to_be" not in c:
            wrong.append(f"{where}: to_be is missing; null drops the column")
            continue
        b, f = c["to_be"], c.get("transform") or {}
        if isinstance(b, list) and (len(b) < 2 or not all(isinstance(x, dict) and x.get("column") for x in b)):
            wrong.append(f"{where}: a split needs two targets")
            continue
        wrong += [f"{where}: {x}" for x in column_faults(c, sources, known, kinds)]
        known |= {(s["table"].upper(), s["column"].upper()) for s in sources}
        kind = "drop" if b is None else "merge" if isinstance(a, list) else "split" if isinstance(b, list) else "value_map" if c.get("value_map") is not None else "type_convert" if any(f.get(k) for k in ("read", "write", "where", "combine")) else "rename"
        for s in sources:
            t = s["table"].upper()
            to = b if isinstance(b, dict) else {}
            row = {
                "as_is_table": t, "as_is_column": s["column"].upper(), "to_be_table": (to.get("table") or tables.get(t) or t).upper() if b is not None else None, "to_be_column": to["column"].upper() if to.get("column") else None, "kind": kind,
                "read": f.get("read"), "write": f.get("write"), "where_": f.get("where"), "value_map": {str(k): str(v) for k, v in c["value_map"].items()} if c.get("value_map") else None,
            }
            if kinds.get(t, "rename") != "rename":
                row["table_kind"] = kinds[t]
            if c.get("default") is not None:
                row["value_default"] = str(c["default"])
            if kind == "split":
                row |= {"to_be_table": tables.get(t) or t, "targets": [f"{(x.get('table') or tables.get(t) or t).upper()}.{x['column'].upper()}" for x in b], "selects": [x.get("transform_select") for x in b], "reverse": c.get("reverse")}
            if kind == "merge":
                row["combine"] = f.get("combine")
            rows.append(row)
    return rows, wrong


def expression_fault(text: str, known: set[str]) -> str | None:
    """What is wrong with an expression of a mapping: a placeholder that isn't known, or text that can't be read."""
    from quarrylane.operators import sqltext

    strange = sorted({x for x in re.findall(r"\{(\w+)\}", text) if x.upper() not in known and x != "src" or x == "src" and "src" not in known})
    if strange:
        return f"unknown placeholder {', '.join(strange)}"
    fault = sqltext.fault("SELECT " + re.sub(r"\{\w+\}", "X", text) + " FROM DUAL")
    return f"{fault}: {text}" if fault else None


def column_faults(c: dict, sources: list[dict], known: set[tuple[str, str]], tables: dict[str, str]) -> list[str]:
    """What is wrong with a column of a mapping document, all of it at once."""
    b, f, out = c["to_be"], c.get("transform") or {}, []
    merged, split = isinstance(c["as_is"], list), isinstance(b, list)
    for s in sources:
        if (s["table"].upper(), s["column"].upper()) in known:
            out.append(f"{s['table']}.{s['column']} is mapped twice")
        if s["table"].upper() not in tables:
            out.append(f"table {s['table']} isn't among the tables")
    if merged and not f.get("combine"):
        out.append("a merge needs transform.combine")
    if split:
        out += [f"target {x['column']} of a split needs transform_select" for x in b if not x.get("transform_select")]
    if c.get("value_map") is not None and (merged or not isinstance(b, dict)):
        out.append("a value_map needs one column on either side")
    if b is None and any(f.values()):
        out.append("a dropped column has no transform")
    names = {s["column"].upper() for s in sources}
    texts = [(k, f[k], names if merged else names | {"src"}) for k in ("read", "write", "where", "combine") if f.get(k)]
    if split:
        texts += [("transform_select", x["transform_select"], {"src"}) for x in b if x.get("transform_select")]
        if c.get("reverse"):
            texts.append(("reverse", c["reverse"], {x["column"].upper() for x in b}))
    return out + [f"{k}: {fault}" for k, text, ok in texts if (fault := expression_fault(str(text), ok))]


def dump_mapping(rows: list[dict]) -> str:
    """Column rows as a mapping document that load_mapping reads back."""
    import yaml

    tables: dict[tuple, list] = {}
    for r in rows:
        kind = r.get("table_kind") or "rename"
        targets = sorted({t.partition(".")[0] for t in r.get("targets") or []}) if kind == "split" else [r["to_be_table"]] if r.get("to_be_table") else []
        at = tables.setdefault((r["as_is_table"], kind), [])
        at += [t for t in targets if t not in at]
    entries = []
    for (a, kind), to in sorted(tables.items()):
        if to or kind == "drop":
            entries.append({"type": kind, "as_is": a, "to_be": None if kind == "drop" else to if kind == "split" else to[0]})
    columns, merged = [], {}
    for r in rows:
        source = {"table": r["as_is_table"], "column": r["as_is_column"]}
        key = (r.get("to_be_table"), r.get("to_be_column"))
        if r["kind"] == "merge" and key in merged:
            merged[key]["as_is"].append(source)
            continue
        to = {"table": r["to_be_table"], "column": r["to_be_column"]} if r.get("to_be_column") else None
        if r["kind"] == "split":
            to = [{"table": t.partition(".")[0], "column": t.partition(".")[2]} | ({"transform_select": x} if x else {}) for t, x in zip(r["targets"], r["selects"], strict=True)]
        c: dict = {"as_is": [source] if r["kind"] == "merge" else source, "to_be": to}
        f = {k: r.get(n) for k, n in (("read", "read"), ("write", "write"), ("where", "where_"), ("combine", "combine")) if r.get(n)}
        c |= ({"transform": f} if f else {}) | ({"value_map": r["value_map"]} if r.get("value_map") else {}) | ({"default": r["value_default"]} if r.get("value_default") else {}) | ({"reverse": r["reverse"]} if r.get("reverse") else {})
        if r["kind"] == "merge":
            merged[key] = c
        columns.append(c)
    doc = {"version": "1.0", "tables": entries, "columns": columns}
    return yaml.safe_dump(doc, allow_unicode=True, sort_keys=False)
