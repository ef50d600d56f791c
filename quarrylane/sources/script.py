"""React, Polymer and plain scripts read into routes, API calls, buttons, fields, grids, tabs and checks
(survey H26 to H31, J1 to J6). There is no JavaScript parser here: tags and calls are read by a scanner that follows quotes,
braces and nesting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.operators.lineage import normalized_url

# The component and function names that the scanner knows.
INPUTS = ("input", "TextField", "TextInput", "Input", "Select", "Dropdown", "DatePicker", "RangePicker", "Checkbox", "Radio", "RadioGroup", "Switch", "NumberInput", "InputNumber", "TimePicker", "Combobox")
LABELLED = ("SearchItem", "SearchItemArea", "SearchItemBox", "SearchField", "SearchRow", "SearchCondition", "FilterItem", "FilterItemArea", "FilterField", "FormItem", "FormField", "FormRow", "CriteriaItem", "ConditionItem")
TABS, BUTTONS = ("Tab", "TabPanel", "TabPane"), ("button", "Button", "IconButton", "LinkButton")
OPTIONS = ("Option", "MenuItem", "SelectOption", "OptGroup", "option")
API = ("axios.get", "axios.post", "axios.put", "axios.patch", "axios.delete", "axios.request", "axios", "postAxios", "getAxios", "putAxios", "deleteAxios", "patchAxios", "fetch")
NAVIGATION = ("navigate", "push", "replace", "router.push", "router.replace", "history.push", "history.replace", "window.open", "location.assign", "location.replace")
CHECKED = ("required", "pattern", "minLength", "maxLength", "min", "max")
NO_FUNCTION = frozenset("if for while switch catch return function await typeof new".split())

TAG = re.compile(r"<(/?)([A-Za-z][\w.]*)")
FUNCTION = re.compile(r"(?:\bfunction\s*\*?\s+(\w+)\s*\(|\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:useCallback\(\s*)?(?:async\s*)?(?:function\b[^(]*\(|\([^()]*\)\s*(?::\s*[\w<>\[\]]+)?\s*=>|\w+\s*=>)|^\s*(?:async\s+)?(\w+)\s*=?\s*\([^()]*\)\s*(?:=>\s*)?\{)", re.M)
CALLED = re.compile(r"([A-Za-z_$][\w$]*(?:\s*\.\s*[A-Za-z_$][\w$]*)*)\s*\(")


def uncommented(code: str) -> str:
    """The code with comments blanked; what looks like one inside a string or URL stays."""
    def blank(m: re.Match) -> str:
        return m[0] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0])

    return re.sub(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|/\*.*?\*/|(?<![:\\])//[^\n]*", blank, code, flags=re.S)


def matching(code: str, at: int) -> int:
    """The place behind the bracket that closes the one at `at`, past strings; the end if there is none."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    stack, i = [], at
    while i < len(code):
        c = code[i]
        if c in "\"'`":
            j = i + 1
            while j < len(code) and code[j] != c:
                j += 2 if code[j] == "\\" else 1
            i = j
        elif c in pairs:
            stack.append(pairs[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return len(code)


@dataclass
class Tag:
    name: str
    attrs: dict[str, str]
    start: int
    end: int
    closes: bool
    single: bool


def tags(code: str) -> list[Tag]:
    """The markup tags of code in order; an attribute's value is its text without quotes or braces, 'true' without one."""
    out, at = [], 0
    while m := TAG.search(code, at):
        i, attrs = m.end(), {}
        if m[1]:
            j = code.find(">", i)
            if j < 0:
                break
            out.append(Tag(m[2], {}, m.start(), j + 1, True, False))
            at = j + 1
            continue
        good = False
        while i < len(code):
            if s := re.compile(r"\s+").match(code, i):
                i = s.end()
            elif code.startswith("/>", i) or code[i] == ">":
                good = True
                break
            elif code.startswith("{", i):
                i = matching(code, i)
            elif a := re.compile(r"([\w:@.-]+)(\s*=\s*)?").match(code, i):
                i = a.end()
                value = "true"
                if a[2]:
                    if code[i : i + 1] == "{":
                        j = matching(code, i)
                        value = code[i + 1 : j - 1].strip()
                        i = j
                    elif code[i : i + 1] in ("'", '"'):
                        j = code.find(code[i], i + 1)
                        if j < 0:
                            break
                        value, i = code[i + 1 : j], j + 1
                    else:
                        w = re.compile(r"[^\s>]*").match(code, i)
                        value, i = w[0], w.end()
                attrs[a[1]] = value
            else:
                break
        if not good:
            at = m.end()
            continue
        single = code.startswith("/>", i)
        i += 2 if single else 1
        out.append(Tag(m[2], attrs, m.start(), i, False, single))
        at = i
    return out


def inner_text(code: str, all_: list[Tag], k: int) -> tuple[str, int]:
    """The text inside the tag at k, without markup and expressions, and the place of its closing tag."""
    t, depth = all_[k], 0
    if t.single:
        return "", k
    for j in range(k + 1, len(all_)):
        if all_[j].name == t.name:
            if all_[j].closes:
                if depth == 0:
                    inside = code[t.end : all_[j].start]
                    return " ".join(re.sub(r"\{[^{}]*\}", " ", re.sub(r"<[^<>]*>", " ", inside)).split()), j
                depth -= 1
            elif not all_[j].single:
                depth += 1
    return "", k


def literal(value: str) -> str:
    """A text literal's content, or the value as it stands."""
    m = re.fullmatch(r"\s*([\"'`])(.*)\1\s*", value, re.S)
    return m[2] if m else value.strip()


def first_text(args: str) -> str | None:
    """The URL among a call's first arguments: a literal that starts like a path, also within a builder."""
    m = re.search(r"([\"'`])((?:https?:/)?/[^\"'`\n]*)\1", args)
    return re.sub(r"\$\{[^}]*\}", "{p}", m[2]) if m else None


def constants(code: str) -> dict[str, str]:
    """Upper-case names with the paths they stand for."""
    return {m[1]: m[3] for m in re.finditer(r"\b([A-Z][A-Z0-9_]{2,})\s*[:=]\s*([\"'`])(/[^\"'`\n]*)\2", code)}


def api_calls(code: str, extra: tuple[str, ...] = (), known: dict[str, str] | None = None) -> list[tuple[int, str, str]]:
    """Place, verb and URL of each API call: by name, by a saga's effect, with a literal, a builder or a constant."""
    names = {n.lower() for n in (*API, *extra)}
    known = constants(code) | (known or {})
    out = []
    for m in CALLED.finditer(code):
        name = re.sub(r"\s", "", m[1])
        low = name.lower()
        saga = low in ("call", "apply")
        if low not in names and not saga:
            continue
        end = matching(code, m.end() - 1)
        args = code[m.end() : end - 1]
        url = first_text(args)
        if url is None:
            c = next((known[w] for w in re.findall(r"\b[A-Z][A-Z0-9_]{2,}\b", args) if w in known), None)
            url = c
        if url is None:
            continue
        verb = re.search(r"(get|post|put|patch|delete)", low)
        said = re.search(r"\bmethod\s*:\s*[\"'`](\w+)", args)
        effect = re.match(r"\s*[\w.]*\.(get|post|put|patch|delete)\b", args) if saga else None
        out.append((m.start(), (said[1] if said else effect[1] if effect else verb[1] if verb else "ANY").upper(), url))
    return out


def routes(code: str, wrappers: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Path and component of each route: as a tag, with element, component or render, or in a list of objects."""
    out = []
    all_ = tags(code)
    for k, t in enumerate(all_):
        if t.name not in ("Route", *wrappers) or t.closes or "path" not in t.attrs:
            continue
        p = t.attrs["path"]
        path = first_text(p) or (re.sub(r"\$\{[^}]*\}", "{p}", literal(p)) if not re.search(r"[(){}]", literal(p)) else "")
        shown = t.attrs.get("element") or t.attrs.get("component") or t.attrs.get("render") or ""
        c = re.search(r"<\s*([A-Z]\w*)", shown) or re.fullmatch(r"\s*([A-Za-z_]\w*)\s*", shown)
        child = next((x.name for x in all_[k + 1 : k + 2] if not t.single and not x.closes and x.name[0].isupper()), "")
        if path:
            out.append((path, c[1] if c else child))
    for m in re.finditer(r"\{[^{}]*\bpath\s*:\s*([\"'`])([^\"'`]+)\1[^{}]*?\b(?:component|element)\s*:\s*(?:<\s*)?(\w+)", code):
        out.append((re.sub(r"\$\{[^}]*\}", "{p}", m[2]), m[3]))
    lazy = {m[1]: m[2] for m in re.finditer(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:React\.)?lazy\(\s*\(\)\s*=>\s*import\(\s*[\"']([^\"']+)", code)}
    for m in re.finditer(r"\bpage\(\s*([\"'])([^\"']+)\1\s*,", code):
        rest = code[m.end() : matching(code, m.start() + 4) - 1]
        shown = re.findall(r"[\"']([\w-]+)[\"']", rest) or re.findall(r"[\w-]+", rest)
        out.append((m[2], shown[-1] if shown else ""))
    out += [(t.attrs["pattern"], t.attrs.get("data", "")) for t in all_ if t.name == "app" and "pattern" in t.attrs]
    return [(p, lazy.get(c, c)) for p, c in dict.fromkeys(out)]


def elements(code: str) -> list[str]:
    """The custom elements that a script or page defines."""
    return list(dict.fromkeys(m[1] for m in re.finditer(r"(?:customElements\.define\(\s*|Polymer\(\s*\{\s*is\s*:\s*|static\s+get\s+is\s*\(\)\s*\{\s*return\s*|<dom-module\s+id=)[\"']([\w-]+)", code)))


def functions(code: str) -> dict[str, str]:
    """Each function's body by name; of equal names the first."""
    out: dict[str, str] = {}
    for m in FUNCTION.finditer(code):
        name = m[1] or m[2] or m[3]
        if not name or name in NO_FUNCTION:
            continue
        if m[0].rstrip().endswith("{"):
            i = m.end() - 1 - (len(m[0]) - len(m[0].rstrip()))
            out.setdefault(name, code[i : matching(code, i)])
            continue
        i = m.end()
        if m[0].rstrip().endswith("("):
            i = matching(code, m.end() - 1)
        b = re.compile(r"\s*(?:=>)?\s*\{").match(code, i)
        out.setdefault(name, code[b.end() - 1 : matching(code, b.end() - 1)] if b else code[i : code.find("\n", i) if code.find("\n", i) > 0 else len(code)])
    return out


def steps(body: str, known: dict[str, str]) -> list[tuple[str, str, str]]:
    """Action, detail and nearest condition of the API and navigation calls of a body, in order."""
    calls = {at: ("api", f"{verb} {url}") for at, verb, url in api_calls(body, known=known)}
    for m in CALLED.finditer(body):
        name = re.sub(r"\s", "", m[1])
        if name in NAVIGATION and m.start() not in calls:
            url = first_text(body[m.end() : matching(body, m.end() - 1) - 1])
            calls[m.start()] = ("navigate", f"{name} → {url}" if url else f"{name}(...)")
    spans = []
    for m in re.finditer(r"\b(?:else\s+)?if\s*\(", body):
        j = matching(body, m.end() - 1)
        b = re.compile(r"\s*\{").match(body, j)
        spans.append((j, matching(body, b.end() - 1) if b else body.find(";", j), body[m.end() : j - 1].strip()))
    spans += [(m.end() - 1, matching(body, m.end() - 1), "else") for m in re.finditer(r"\belse\s*\{", body)]
    out = []
    for at in sorted(calls):
        around = [s for s in spans if s[0] <= at < s[1]]
        out.append((*calls[at], max(around)[2] if around else ""))
    return out


def followed(name: str, bodies: dict[str, str], known: dict[str, str], depth: int = 3, seen: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """The steps of a function and of the functions it calls, up to a depth, without going round."""
    if name not in bodies or name in seen or depth < 0:
        return []
    own = steps(bodies[name], known)
    for m in CALLED.finditer(bodies[name]):
        inner = re.sub(r"\s", "", m[1]).rpartition(".")[2]
        own += followed(inner, bodies, known, depth - 1, (*seen, name))
    return list(dict.fromkeys(own))


def handler_name(value: str) -> str:
    m = re.search(r"(?:=>\s*(?:\{\s*)?)?(?:this\.)?(?:props\.)?(\w+)\s*(?:\(|$)", value.strip())
    return m[1] if m else ""


def field_kind(tag: str, attrs: dict[str, str]) -> str:
    low = tag.lower()
    for part, kind in (("range", "daterange"), ("date", "date"), ("time", "time"), ("checkbox", "checkbox"), ("radio", "radio"), ("select", "select"), ("dropdown", "select"), ("combobox", "select"), ("number", "number")):
        if part in low and (part != "range" or "date" in low):
            return kind
    return literal(attrs.get("type", "text"))


def fields(code: str) -> list[dict]:
    """The inputs of a form with label, options and events."""
    all_ = tags(code)
    out, label, box = [], "", None
    for k, t in enumerate(all_):
        if t.closes:
            if box and t.name == box[0]:
                box = None
            continue
        if t.name == "label":
            label = inner_text(code, all_, k)[0]
        if t.name in LABELLED and not t.single:
            box = (t.name, literal(t.attrs.get("label", "")), t.attrs.get("required") == "true")
        if t.name in INPUTS:
            _, end = inner_text(code, all_, k)
            options = [literal(o.attrs.get("value", "")) or inner_text(code, all_, j)[0] for j, o in enumerate(all_[k + 1 : end], k + 1) if o.name in OPTIONS and not o.closes]
            out.append(
                {
                    "kind": "field", "label": literal(t.attrs.get("label", "")) or (box[1] if box else "") or label or literal(t.attrs.get("placeholder", "")), "name": literal(t.attrs.get("name") or t.attrs.get("id") or ""),
                    "ui_type": field_kind(t.name, t.attrs), "required": t.attrs.get("required") == "true" or bool(box and box[2]), "detail": ", ".join(options), "events": " ".join(sorted(a for a in t.attrs if re.match(r"on[A-Z]", a))),
                }
            )
            label = ""
    return out


def grid_columns(code: str) -> list[dict]:
    """The columns of column lists: header, key, kind and whether shown."""
    out = []
    for m in re.finditer(r"\{[^{}]*\b(?:headerName|header|title|Header)\s*:[^{}]*\}", code):
        pairs = {k: literal(v) for k, v in re.findall(r"\b(\w+)\s*:\s*(\"[^\"]*\"|'[^']*'|`[^`]*`|[\w.]+)", m[0])}
        key = pairs.get("field") or pairs.get("dataIndex") or pairs.get("accessor") or pairs.get("key") or ""
        look = (pairs.get("cellRenderer", "") + " " + pairs.get("cellEditor", "")).lower()
        ui = next((n for parts, n in ((("checkbox",), "Checkbox"), (("select", "combo"), "Dropdown"), (("date",), "DatePicker"), (("number", "numeric"), "Number Field"), (("link", "anchor", "button"), "Link/Button")) if any(p in look for p in parts)), "Text Field(Basic)")
        hidden = pairs.get("hide") == "true" or pairs.get("hidden") == "true" or pairs.get("visible") == "false"
        mark = "H" if hidden else "E" if pairs.get("editable") == "true" else "R"
        out.append({"kind": "grid", "label": next(pairs[h] for h in ("headerName", "header", "title", "Header") if h in pairs), "name": key, "ui_type": ui, "required": pairs.get("required") == "true", "detail": mark, "events": ""})
    return out


def checks(code: str) -> list[dict]:
    """Checks as attributes of inputs and as chains of a validation schema."""
    out = []
    for t in tags(code):
        name = literal(t.attrs.get("id") or t.attrs.get("name") or t.attrs.get("field") or "")
        if name and not t.closes:
            out += [{"kind": "check", "label": c, "name": name, "ui_type": "jsx_prop", "required": c == "required", "detail": "" if c == "required" else literal(t.attrs[c]), "events": ""} for c in CHECKED if c in t.attrs and (c != "required" or t.attrs[c] == "true")]
    for m in re.finditer(r"([A-Za-z_$][\w$]*)\s*:\s*(yup|zod|joi|z|Y|Z|Joi|Yup)\.\w+\(\)((?:\s*\.\w+\([^)]*\))+)", code):
        for rule, args in re.findall(r"\.(\w+)\(([^)]*)\)", m[3]):
            out.append({"kind": "check", "label": rule, "name": m[1], "ui_type": m[2].lower(), "required": rule == "required", "detail": args.strip(), "events": ""})
    return out


def tabs(code: str) -> list[dict]:
    """Tabs with their labels."""
    all_ = tags(code)
    return [{"kind": "tab", "label": literal(t.attrs.get("label") or t.attrs.get("title") or t.attrs.get("tab") or "") or inner_text(code, all_, k)[0], "name": literal(t.attrs.get("value") or t.attrs.get("key") or ""), "ui_type": t.name, "required": False, "detail": "", "events": ""} for k, t in enumerate(all_) if t.name in TABS and not t.closes]


def buttons(code: str) -> list[tuple[str, str, list[tuple[str, str, str]]]]:
    """Label, handler and steps of each button."""
    bodies, known, all_ = functions(code), constants(code), tags(code)
    out = []
    for k, t in enumerate(all_):
        if t.name in BUTTONS and not t.closes and (click := t.attrs.get("onClick") or t.attrs.get("onclick")):
            name = handler_name(click)
            own = steps(click, known)
            out.append((inner_text(code, all_, k)[0] or literal(t.attrs.get("label") or t.attrs.get("title") or ""), name, own or followed(name, bodies, known)))
    return out


def page_triggers(html: str, scripts: str = "") -> list[tuple[str, str]]:
    """URL and label of a page's triggers: submit buttons of a form, and clicks, directly or through a function."""
    code = re.sub(r"<!--.*?-->|<%--.*?--%>", " ", html, flags=re.S)
    script = uncommented("\n".join(re.findall(r"<script\b[^>]*>(.*?)</script>", code, flags=re.S | re.I)) + "\n" + scripts)
    bodies, all_ = functions(script), tags(re.sub(r"(?is)(<script\b[^>]*>).*?(</script>)", r"\1\2", code))
    page = re.sub(r"(?is)(<script\b[^>]*>).*?(</script>)", r"\1\2", code)
    out, action = [], None

    def urls(text: str) -> list[str]:
        found = re.findall(r"(?:location\s*\.\s*href\s*=\s*|(?:replace|assign|open|post|get|load|fetch)\(\s*|\burl\s*:\s*|\.action\s*=\s*)[\"']([^\"']+)", text)
        return found + ["/" + x for x in re.findall(r"\bhttpSend\(\s*[\"']([\w.$-]+)[\"']", text)] + [m[1] for m in re.finditer(r"\(\s*[\"'](/[^\"']+)[\"']", text) if m[1] not in found]

    for k, t in enumerate(all_):
        if t.name == "form":
            action = None if t.closes else t.attrs.get("action")
        if t.closes:
            continue
        label = literal(t.attrs.get("value", "")) if t.name == "input" else inner_text(page, all_, k)[0]
        label = label or t.attrs.get("title", "")
        if action and (t.name == "input" and t.attrs.get("type") == "submit" or t.name == "button" and t.attrs.get("type", "submit") == "submit"):
            out.append((action, label))
        if click := t.attrs.get("onclick"):
            found = urls(click)
            for m in CALLED.finditer(click):
                found += urls(bodies.get(m[1], "")) if m[1] in bodies else []
            out += [(u, label) for u in found]
        if t.name == "a" and re.match(r"(?:/|[\w-]+\.(?:do|jsp|act))", t.attrs.get("href", "")):
            out.append((t.attrs["href"], label))
    return list(dict.fromkeys(out))


def _each(files: DataFrame, schema: str, of: Callable[[str], list[tuple]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, c in zip(b["path"], b["content"], strict=True) if c for r in of(c)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(work, schema)


def route_table(files: DataFrame, wrappers: tuple[str, ...] = ()) -> DataFrame:
    """Path, url, component."""
    found = _each(files, "path string, raw string, component string", lambda c: routes(uncommented(c), wrappers))
    return found.select("path", normalized_url(F.col("raw")).alias("url"), "component").distinct()


def api_table(files: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Path, verb, url of API calls."""
    found = _each(files, "path string, verb string, raw string", lambda c: [(v, u) for _, v, u in api_calls(uncommented(c), extra)])
    return found.select("path", "verb", normalized_url(F.col("raw")).alias("url")).distinct()


def button_table(files: DataFrame) -> DataFrame:
    """Path, label, handler, step, action, detail, condition; a button without steps has one row with nulls."""
    def rows(c: str) -> list[tuple]:
        out = []
        for label, name, flow in buttons(uncommented(c)):
            out += [(label, name, i, a, d, w) for i, (a, d, w) in enumerate(flow, 1)] or [(label, name, None, None, None, None)]
        return out

    return _each(files, "path string, label string, handler string, step double, action string, detail string, condition string", rows).withColumn("step", F.col("step").cast("int"))


def spec_table(files: DataFrame) -> DataFrame:
    """Path, pos, kind, label, name, ui_type, required, detail, events: fields, grid columns, tabs and checks of screens."""
    def rows(c: str) -> list[tuple]:
        code = uncommented(c)
        return [(i, *r.values()) for i, r in enumerate(fields(code) + grid_columns(code) + tabs(code) + checks(code))]

    return _each(files, "path string, pos bigint, kind string, label string, name string, ui_type string, required boolean, detail string, events string", rows)


def trigger_table(pages: DataFrame) -> DataFrame:
    """Path, url, label of page triggers."""
    found = _each(pages, "path string, raw string, label string", page_triggers)
    return found.select("path", normalized_url(F.regexp_replace(F.regexp_replace("raw", r"^(?:\$\{[^}]*\}|<%=[^%]*%>)+", ""), r"\$\{[^}]*\}", "{p}")).alias("url"), "label").distinct()
