"""One SQL statement read token by token: tables with their roles, aliases, joins and columns.

A tokenizer and a walk over nested scopes, without a grammar, so that text which no parser accepts (Oracle's (+),
FOR UPDATE, CONNECT BY, placeholders of mapper files) is read all the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words that are no table, column or alias.
KEYWORDS = frozenset(
    """ON WHERE SET AND OR LEFT RIGHT INNER OUTER CROSS FULL JOIN SELECT INTO VALUES FROM AS NOT NULL IN EXISTS BETWEEN LIKE CASE WHEN
    THEN ELSE END GROUP ORDER BY HAVING UNION ALL DISTINCT INSERT UPDATE DELETE CREATE ALTER DROP TABLE INDEX VIEW IS ASC DESC LIMIT
    OFFSET FETCH FIRST NEXT ROWS ONLY WITH RECURSIVE MERGE USING MATCHED DUAL ROWNUM SYSDATE SYSTIMESTAMP NVL NVL2 DECODE SUBSTR
    TRIM UPPER LOWER COUNT SUM AVG MAX MIN OVER PARTITION ROW_NUMBER RANK DENSE_RANK""".split()
)
#: Words that end a table list or can't be an alias, beyond KEYWORDS.
CLAUSES = KEYWORDS | frozenset("MINUS INTERSECT EXCEPT NATURAL START CONNECT FOR RETURNING PIVOT UNPIVOT TABLESAMPLE".split())
# Built-ins that look like procedure calls.
BUILTIN_CALLS = frozenset({"NULL", "DBMS_OUTPUT.PUT_LINE", "COMMIT", "ROLLBACK", "SAVEPOINT"})

TOKEN = re.compile(
    r"""/\*.*?(?:\*/|\Z)|--[^\n]*|(?P<string>'(?:''|[^'])*'?)|(?P<quoted>"[^"]*")|(?P<bind>[#$]\{[^}]*\}|:\w+|\?)|(?P<outer>\(\s*\+\s*\))
    |(?P<word>\w+(?:\s*\.\s*(?:\w+|"[^"]*"|\*))*)|(?P<op><>|!=|<=|>=|\|\||[^\s\w])""",
    re.S | re.X,
)
JOIN_WORDS = (("LEFT", "LEFT JOIN"), ("RIGHT", "RIGHT JOIN"), ("FULL", "FULL JOIN"), ("CROSS", "CROSS JOIN"), ("WHERE", "WHERE (implicit)"))


@dataclass
class Token:
    kind: str
    text: str
    at: int


@dataclass
class Scope:
    """What one level of parentheses names: aliases, and the tables of its FROM list in order."""

    start: int
    parent: Scope | None = None
    aliases: dict[str, str] = field(default_factory=dict)
    derived: set[str] = field(default_factory=set)
    tables: list[tuple[str, str]] = field(default_factory=list)
    first: str | None = None
    """The first table of FROM's list."""

    def resolve(self, name: str) -> str | None:
        """The table that a qualifier names, None for a derived one or an unknown one."""
        scope: Scope | None = self
        while scope:
            if name in scope.derived:
                return None
            if name in scope.aliases:
                return scope.aliases[name]
            scope = scope.parent
        return None


@dataclass
class Statement:
    tables: dict[str, set[str]] = field(default_factory=dict)
    """Each table with its roles: read, insert, update, delete, merge."""
    main: str | None = None
    joined: list[str] = field(default_factory=list)
    joins: list[tuple[str, str, str, str, str]] = field(default_factory=list)
    columns: list[tuple[str, str, str]] = field(default_factory=list)
    letters: list[str] = field(default_factory=list)


def tokens(sql: str) -> list[Token]:
    """The tokens of sql in upper case, without comments; a dotted name is one token without blanks."""
    out = []
    for m in TOKEN.finditer(sql.upper()):
        if kind := m.lastgroup:
            text = re.sub(r'\s*\.\s*', ".", m[0]).replace('"', "") if kind in ("word", "quoted") else m[0]
            out.append(Token("word" if kind == "quoted" else kind, text, m.start()))
    return out


def last(name: str) -> str:
    return name.rpartition(".")[2]


class Reader:
    def __init__(self, sql: str):
        self.sql, self.t = sql.upper(), tokens(sql)
        self.out = Statement()
        self.scopes: dict[int, Scope] = {}
        self.ctes: set[str] = set()
        self.named: set[int] = set()
        """The tokens that name a table, or give an alias."""

    def word(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "word" else ""

    def op(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "op" else ""

    def close(self, i: int) -> int:
        """The place of the parenthesis that closes the one at i."""
        depth = 0
        for k in range(i, len(self.t)):
            depth += (self.op(k) == "(") - (self.op(k) == ")")
            if depth == 0:
                return k
        return len(self.t)

    def read(self) -> Statement:
        for i in range(len(self.t)):
            # WITH name AS (, name AS (
            if self.word(i) and self.word(i) not in KEYWORDS and self.word(i + 1) == "AS" and self.op(i + 2) == "(" and (self.word(i - 1) in ("WITH", "RECURSIVE") or self.op(i - 1) == ","):
                self.ctes.add(self.word(i))
        self.level(0, len(self.t), None)
        self.predicates()
        self.set_operations()
        self.main_table()
        self.crud_letters()
        self.used_columns()
        return self.out

    def table(self, name: str, role: str, scope: Scope, alias: str = "") -> str | None:
        """Registers a table under its alias and own name, unless the name is derived or a keyword."""
        name = last(name)
        if not name or name in KEYWORDS or name in self.ctes or name in scope.derived or not re.match(r"\w", name):
            if alias and name in self.ctes:
                scope.derived.add(alias)
            return None
        self.out.tables.setdefault(name, set()).add(role)
        scope.aliases.setdefault(alias or name, name)
        scope.aliases.setdefault(name, name)
        return name

    def level(self, i: int, end: int, parent: Scope | None) -> None:
        """Reads the tokens of one level of parentheses and, below it, its sub-queries."""
        scope = Scope(i, parent)
        inner: list[tuple[int, int]] = []
        while i < end:
            self.scopes[i] = scope
            w = self.word(i)
            if self.op(i) == "(":
                j = self.close(i)
                inner.append((i + 1, j))
                i = j + 1
                continue
            before = self.word(i - 1)
            if w == "INTO" and before in ("INSERT", "MERGE"):
                i = self.operand(i + 1, scope, before.lower(), inner)[1]
                continue
            if w == "UPDATE" and before != "FOR" and self.word(i + 1) != "SET":
                i = self.operand(i + 1, scope, "update", inner)[1]
                continue
            if w == "DELETE" and self.word(i + 1) != "FROM" and before != "THEN" and self.word(i + 1) not in KEYWORDS | {""}:
                i = self.operand(i + 1, scope, "delete", inner)[1]
                continue
            if w in ("FROM", "JOIN", "USING") and (w != "USING" or self.op(i + 1) != "(" or self.word(i + 2) in ("SELECT", "WITH")):
                i = self.operands(i + 1, scope, "delete" if w == "FROM" and before == "DELETE" else "read", w != "FROM", inner)
                continue
            i += 1
        for a, b in inner:
            self.level(a, b, scope)

    def operand(self, i: int, scope: Scope, role: str, inner: list[tuple[int, int]]) -> tuple[str | None, int]:
        """One table or sub-query with its alias; returns the table and the place behind."""
        sub = self.op(i) == "("
        name = ""
        if sub:
            j = self.close(i)
            inner.append((i + 1, j))
            i = j + 1
        elif self.word(i) and self.word(i) not in CLAUSES:
            name, i = self.word(i), i + 1
            self.named.add(i - 1)
        else:
            return None, i
        alias = ""
        if self.word(i) == "AS" and self.word(i + 1) not in CLAUSES | {""}:
            alias, i = self.word(i + 1), i + 2
        elif self.word(i) not in CLAUSES | {""} and "." not in self.word(i):
            alias, i = self.word(i), i + 1
        if alias:
            self.named.add(i - 1)
        if sub:
            if alias:
                scope.derived.add(alias)
            return None, i
        return self.table(name, role, scope, alias), i

    def operands(self, i: int, scope: Scope, role: str, joined: bool, inner: list[tuple[int, int]]) -> int:
        """The comma list behind FROM, or one operand behind JOIN or USING."""
        first = True
        while True:
            name, i = self.operand(i, scope, role, inner)
            if not joined and not scope.first:
                scope.first = name
            if name:
                scope.tables.append((name, role))
                if joined or not first:
                    self.out.joined.append(name)
            first = False
            if joined or self.op(i) != ",":
                return i
            i += 1

    def predicates(self) -> None:
        """Column pairs of different tables joined by equality."""
        for i in range(1, len(self.t) - 1):
            if self.op(i) != "=":
                continue
            a, b = i - 1, i + 1
            left = self.t[a].kind == "outer"
            a -= left
            x, y = self.word(a), self.word(b)
            right = b + 1 < len(self.t) and self.t[b + 1].kind == "outer"
            if x.count(".") < 1 or y.count(".") < 1:
                continue
            scope = self.scopes.get(a) or self.scopes.get(i) or Scope(0)
            (q1, c1), (q2, c2) = x.split(".")[-2:], y.split(".")[-2:]
            t1, t2 = scope.resolve(q1), scope.resolve(q2)
            if not t1 or not t2 or t1 == t2 or c1.isdigit() or c2.isdigit():
                continue
            kind = {(True, True): "FULL OUTER JOIN", (True, False): "RIGHT OUTER JOIN (Oracle +)", (False, True): "LEFT OUTER JOIN (Oracle +)"}.get((left, right))
            if not kind:
                near = self.sql[: self.t[a].at].rstrip()[-30:]
                kind = next((k for w, k in JOIN_WORDS if w in near), "INNER JOIN")
            self.out.joins.append((t1, c1, t2, c2, kind))

    def set_operations(self) -> None:
        """Columns at the same place on either side of MINUS or INTERSECT."""
        cuts = [i for i in range(len(self.t)) if self.word(i) in ("MINUS", "INTERSECT")]
        edges = [0, *[c + 1 for c in cuts], len(self.t) + 1]
        sides = [self.side(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]
        for k, c in enumerate(cuts):
            (t1, c1), (t2, c2) = sides[k], sides[k + 1]
            if t1 and t2:
                for x, y in list(zip(c1, c2, strict=False)) or [("*", "*")]:
                    self.out.joins.append((t1, x or "*", t2, y or "*", self.word(c)))

    def side(self, a: int, b: int) -> tuple[str, list[str]]:
        """The first table of a SELECT and the first column name of each of its items."""
        s = next((i for i in range(a, b) if self.word(i) == "SELECT"), None)
        if s is None:
            return "", []
        depth, items, now, f = 0, [], [], b
        for i in range(s + 1, b):
            depth += (self.op(i) == "(") - (self.op(i) == ")")
            if depth <= 0 and self.word(i) == "FROM":
                f = i
                break
            if depth <= 0 and self.op(i) == ",":
                items.append(now)
                now = []
            else:
                now.append(i)
        items.append(now)
        table = last(self.word(f + 1)) if f < b else ""
        if len(items) == 1 and all(self.op(i) == "*" for i in items[0]):
            return table, []
        names = [next((last(self.word(i)) for i in item if self.word(i) and last(self.word(i)) not in KEYWORDS and not self.word(i).isdigit()), "") for item in items]
        return ("" if table in KEYWORDS else table), names

    def main_table(self) -> None:
        """The target of a write, else the first table behind FROM outside all parentheses."""
        for role in ("insert", "update", "delete"):
            got = [t for t, roles in self.out.tables.items() if role in roles]
            if got:
                self.out.main = got[0]
                return
        if scope := self.scopes.get(0):
            self.out.main = scope.first

    def crud_letters(self) -> None:
        """Letters of the body's keywords, in the order C, R, U, D; a row lock isn't an update."""
        words = [(self.word(i - 1), self.word(i)) for i in range(len(self.t))]
        has = {"C": any(w == "INSERT" for _, w in words), "R": any(w == "SELECT" for _, w in words), "U": any(w == "UPDATE" and b != "FOR" for b, w in words), "D": any(w == "DELETE" for _, w in words)}
        self.out.letters = [k for k in "CRUD" if has[k]]

    def used_columns(self) -> None:
        """Columns of the top-level projection (R), of INSERT lists (C) and of SET's left sides (U)."""
        out, t = self.out.columns, self.t
        top = self.scopes.get(0) or Scope(0)
        named = {n for s in self.scopes.values() for n, _ in s.tables}
        for i in range(len(t)):
            if self.word(i) == "INTO" and self.word(i - 1) == "INSERT":
                target = last(self.word(i + 1))
                if self.op(i + 2) == "(" and self.word(i + 3) not in ("SELECT", "WITH"):
                    out += [(target, last(self.word(k)), "C") for k in range(i + 3, self.close(i + 2)) if self.word(k)]
            if self.word(i) == "INSERT" and self.op(i + 1) == "(" and (m := next((n for n, r in self.out.tables.items() if "merge" in r), None)):
                out += [(m, last(self.word(k)), "C") for k in range(i + 2, self.close(i + 1)) if self.word(k)]
            if self.word(i) == "SET":
                target = next((n for n, r in self.out.tables.items() if r & {"update", "merge"}), "")
                depth, k = 0, i + 1
                while k < len(t):
                    depth += (self.op(k) == "(") - (self.op(k) == ")")
                    if depth < 0 or depth == 0 and self.word(k) in ("WHERE", "WHEN", "FROM", "SET"):
                        break
                    if depth == 0 and self.op(k + 1) == "=" and self.word(k) and (self.op(k - 1) == "," or k == i + 1):
                        q, _, c = self.word(k).rpartition(".")
                        out.append((top.resolve(q) or q or target if q else target, c, "U"))
                    k += 1
        start = next((i for i in range(len(t)) if self.word(i) == "SELECT" and self.scopes.get(i) is top), None)
        if start is None or any(r & {"update", "delete", "merge"} for r in self.out.tables.values()):
            return
        depth, begin, items, k = 0, start + 1, [], start + 1
        while k < len(t):
            depth += (self.op(k) == "(") - (self.op(k) == ")")
            if depth == 0 and (self.op(k) == "," or self.word(k) == "FROM"):
                items.append((begin, k))
                begin = k + 1
                if self.word(k) == "FROM":
                    break
            k += 1
        for a, b in items:
            if self.word(a) == "DISTINCT":
                a += 1
            if not self.word(a) or self.word(a) in KEYWORDS or self.word(a).isdigit() or self.op(a + 1) not in ("", ",") and b > a + 1:
                continue
            q, _, c = self.word(a).rpartition(".")
            if c == "*":
                continue
            table = (top.resolve(last(q)) or last(q)) if q else (next(iter(named)) if len(named) == 1 and not self.ctes else "")
            if table and table not in top.derived and table not in self.ctes:
                out.append((table, c, "R"))


#: Words behind which a bare word is an alias although they are keywords.
OPERANDS = frozenset("END SYSDATE SYSTIMESTAMP ROWNUM NULL".split())
#: Words that are never columns, beyond CLAUSES.
WORDS = frozenset("PRIOR ESCAPE NOWAIT OF NULLS LAST SIBLINGS WITHIN INTERVAL DATE TIMESTAMP YEAR MONTH DAY HOUR MINUTE SECOND CAST PRECEDING FOLLOWING UNBOUNDED CURRENT ROW RANGE KEEP LOG ERRORS".split())


#: Words of which a statement that names columns has one; blocks and calls have none.
DATA = frozenset("SELECT INSERT UPDATE DELETE MERGE".split())


def references(sql: str | None) -> list[tuple[str, str, str, bool]]:
    """Each column that sql names, wherever: qualifier, the table it stands for ('' if none is known), column, and whether
    the qualifier names a sub-query or WITH query."""
    if not sql or not sql.strip():
        return []
    r = Reader(sql)
    if not any(r.word(i) in DATA for i in range(len(r.t))):
        return []
    r.read()
    scope, out = Scope(0), []
    for i in range(len(r.t)):
        scope = r.scopes.get(i, scope)
        w = r.word(i)
        if not w or i in r.named or w in CLAUSES or w in WORDS or w in r.ctes or w[0].isdigit() or r.op(i + 1) == "(" or r.word(i - 1) == "AS":
            continue
        before = r.t[i - 1] if i else None
        operand = before is not None and (before.kind in ("string", "bind", "outer") or before.text == ")" or before.kind == "word" and (before.text not in CLAUSES | WORDS or before.text in OPERANDS))
        if operand and "." not in w:
            continue
        q, _, c = w.rpartition(".")
        q = last(q)
        if c == "*":
            continue
        derived, s = False, scope
        while q and s and not derived:
            if q in s.aliases and q not in s.derived:
                break
            derived, s = q in s.derived or q in r.ctes, s.parent
        out.append((q, (scope.resolve(q) or "") if q else "", c, derived))
    return list(dict.fromkeys(out))


# What a statement may begin with.
VERBS = frozenset("SELECT INSERT UPDATE DELETE MERGE WITH CALL BEGIN DECLARE EXEC EXECUTE CREATE ALTER DROP TRUNCATE".split())
#: Words that something must follow.
OPEN_ENDS = frozenset("SELECT FROM WHERE AND OR ON SET INTO JOIN BY IN HAVING USING NOT LIKE BETWEEN VALUES UPDATE".split())


def fault(sql: str | None) -> str | None:
    """Why sql can't be read as a statement, None if nothing is seen: no verb, open quotes or parentheses, an item missing
    behind a comma or a word, or something behind the end."""
    if not sql or not sql.strip():
        return "empty statement"
    t = tokens(sql)
    if not t:
        return "empty statement"
    first = next((x for x in t if x.text not in ("(", "{", "?", "=")), t[0])
    if first.text not in VERBS:
        return f"no statement begins with {first.text}"
    depth = 0
    for i, x in enumerate(t):
        if x.kind == "string" and (len(x.text) < 2 or not x.text.endswith("'")):
            return "open quote"
        depth += (x.kind == "op" and x.text == "(") - (x.kind == "op" and x.text == ")")
        if depth < 0:
            return "closing parenthesis without an opening one"
        after = t[i + 1] if i + 1 < len(t) else None
        if x.kind == "op" and x.text == "," and (after is None or after.text in (",", ")", "FROM", "WHERE", "SET")):
            return "nothing behind a comma"
        if x.kind == "word" and x.text in OPEN_ENDS and not (x.text == "UPDATE" and i and t[i - 1].text == "FOR") and (after is None or after.text in (")", ",") or after.text in ("FROM", "WHERE", "GROUP", "ORDER") and x.text != "NOT"):
            return f"nothing behind {x.text}"
    return "open parenthesis" if depth else None


def read(sql: str | None) -> Statement:
    """What sql uses; an empty statement uses nothing."""
    return Reader(sql).read() if sql and sql.strip() else Statement()


def table_crud(s: Statement) -> dict[str, list[str]]:
    """Each table with its letters: targets of writes have those of their role, all others R; a merge's target has the
    body's writing letters, C and U if there are none."""
    writes = [x for x in s.letters if x in "CUD"]
    out = {}
    for t, roles in s.tables.items():
        got = {"insert": "C", "update": "U", "delete": "D"}
        letters = {got[r] for r in roles if r in got} | (set(writes or "CU") if "merge" in roles else set())
        out[t] = [x for x in "CRUD" if x in (letters or {"R"})]
    return out


CALL = re.compile(r"\{\s*CALL\s+([\w.]+)\s*\(|\bCALL\s+([\w.]+)\s*\(|\bEXEC(?:UTE)?\s+([\w.]+)\s*\(|\bBEGIN\s+([\w.]+)\s*\(", re.I)


def procedures(sql: str | None) -> list[str]:
    """The procedures that sql calls, in upper case: JDBC calls first, then CALL, EXEC and blocks, each in order."""
    found: list[tuple[int, int, str]] = []
    for m in CALL.finditer(sql or ""):
        found.append((m.lastindex or 0, m.start(), (m[m.lastindex or 0]).upper()))
    return list(dict.fromkeys(n for _, _, n in sorted(found) if n not in BUILTIN_CALLS))
