"""Problem 1: several values packed in one field."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quarrylane.session import cut

# What opens and closes a span that stays together, and what always parts values.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "《": "》"}
HARD = ",;|\t\n\r、，；｜"
BREAK = r"<br\s*/?>"
#: What may part values or belong to one; the column decides.
SOFT = " /-_+·>・／＞&~"
#: Atoms of the values that are looked for at once; longer ones are looked for where two of these meet.
LEVEL = 4
#: Expectation maximisation ends when no delimiter's share moves by more than this, and after so many rounds.
SETTLED, ROUNDS = 0.02, 12


@dataclass(frozen=True)
class PackedField:
    """A field of packed values: its name, and those of SOFT that belong to its identifiers and never part values."""

    name: str
    inside: str = ""


@dataclass
class Piece:
    """What stands between two hard delimiters: atoms and the soft delimiters between them."""

    text: str
    atoms: list[tuple[int, int]]
    between: list[str]


def _quoted(text: str, at: int, parts: str) -> int:
    """Where the quoted span that begins at `at` ends, 0 if there is none: its closing mark isn't doubled, and after it
    the value ends or a delimiter or bracket stands."""
    close = QUOTES[text[at]]
    i, n = at + 1, len(text)
    while True:
        i = text.find(close, i)
        if i < 0:
            return 0
        if close == text[at] and i + 1 < n and text[i + 1] == close:
            i += 2
            continue
        if i + 1 == n or text[i + 1] in parts or text[i + 1] in "([<" or text[at] not in "'\"" :
            return i + 1
        i += 1


class Splitter:
    """Splits cells of one field into pieces, and pieces into atoms."""

    def __init__(self, inside: str = ""):
        self.soft = "".join(c for c in SOFT if c not in inside)
        self.parts = HARD + self.soft
        self.word = re.compile(f"(?:(?!{BREAK})[^{re.escape(self.parts)}\\[「『“‘«《\"'])+", re.I)
        self.gap = re.compile(f"(?:{BREAK}|[{re.escape(self.parts)}])+", re.I)
        self.hard = re.compile(f"{BREAK}|[{re.escape(HARD)}]", re.I)

    def atoms(self, cell: str) -> Iterator[tuple[int, int, bool]]:
        """The cell's atoms and gaps: start, end, whether it is a gap."""
        at, n, start = 0, len(cell), -1
        while at < n:
            if m := self.gap.match(cell, at):
                if start >= 0:
                    yield start, at, False
                    start = -1
                yield at, m.end(), True
                at = m.end()
                continue
            if start < 0:
                start = at
            c = cell[at]
            if c == "[" and (end := cell.find("]", at)) > 0:
                at = end + 1
            elif c in QUOTES and (at == start or c not in "'\"") and (end := _quoted(cell, at, self.parts)):
                at = end
            elif m := self.word.match(cell, at):
                at = m.end()
            else:
                at += 1
        if start >= 0:
            yield start, n, False

    def pieces(self, cell: str) -> list[Piece]:
        """The cell between its hard delimiters. A run of several delimiters, other than blanks, is hard as well."""
        out: list[Piece] = []
        open_: list[tuple[int, int]] = []
        between: list[str] = []
        gap = ""
        for a, b, is_gap in self.atoms(cell):
            if is_gap:
                gap = cell[a:b]
                bare = gap.strip(" ")
                if self.hard.search(gap) or len(bare) > 1 or (bare and gap != bare):
                    gap = "|"
                else:
                    gap = bare or " "
                continue
            if open_ and gap == "|":
                out.append(self._piece(cell, open_, between))
                open_, between = [], []
            elif open_:
                between.append(gap)
            open_.append((a, b))
        if open_:
            out.append(self._piece(cell, open_, between))
        return out

    @staticmethod
    def _piece(cell: str, atoms: list[tuple[int, int]], between: list[str]) -> Piece:
        a, b = atoms[0][0], atoms[-1][1]
        return Piece(cell[a:b], [(x - a, y - a) for x, y in atoms], between)


def unquoted(value: str) -> str:
    """value without blanks at its ends and without enclosing quotes; a doubled quote inside is a single one."""
    value = value.strip()
    if len(value) > 1 and (close := QUOTES.get(value[0])) and value[-1] == close:
        inner = value[1:-1]
        if close == value[0]:
            if close not in inner.replace(close * 2, ""):
                return inner.replace(close * 2, close).strip()
        elif close not in inner and value[0] not in inner:
            return inner.strip()
    return value


def valued(piece: Piece, i: int, j: int) -> str:
    """The value that the atoms from i up to j make."""
    return unquoted(piece.text[piece.atoms[i][0] : piece.atoms[j - 1][1]])


def either(a: float, b: float) -> float:
    """The log of the sum of two probabilities given by their logs."""
    m = max(a, b)
    return m if m == -math.inf else m + math.log(math.exp(a - m) + math.exp(b - m))


@dataclass
class Base:
    """How likely values are that no other piece supports: a field's characters, and its share of new values."""

    total: float
    alpha: float
    chars: dict[str, float]
    rest: float

    def log(self, value: str) -> float:
        return sum(self.chars.get(c, self.rest) for c in value)


class Lattice:
    """All ways to split a piece of n atoms.

    Any run of atoms, however long, may be a value. The weight of one that nothing supports (how likely its characters
    are, that the delimiters inside it don't part and the next one does) adds up along the atoms, so that all of them
    together cost one pass. Runs that other pieces or values support are edges of their own: (first atom, atom behind the
    last, support), whose weight counts beside the other one.
    """

    def __init__(self, piece: Piece, base: Base, part: dict[str, float], supported: list[tuple[int, int, float]]):
        n = self.n = len(piece.atoms)
        norm = math.log(base.total + base.alpha)
        self.new = math.log(base.alpha) + base.chars.get("", base.rest) - norm
        self.begin, within = [0.0], [0.0]
        self.end = [-math.inf]
        parts = [part.get(d, 0.5) for d in piece.between]
        for k, (a, b) in enumerate(piece.atoms):
            ch = base.log(unquoted(piece.text[a:b]))
            lp = math.log(parts[k]) if k < n - 1 else 0.0
            self.end.append(self.begin[k] + ch + lp)
            if k < n - 1:
                stay = math.log(1 - parts[k])
                self.begin.append(self.begin[k] + ch + base.log(piece.between[k]) + stay)
                within.append(within[k] + stay)
        self.edges: list[tuple[int, int, float]] = []
        self.from_: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        self.to: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for i, j, c in supported:
            w = -math.inf
            if c > 0:
                w = math.log(c) - norm + within[j - 1] - within[i] + (math.log(parts[j - 1]) if j < n else 0.0)
                self.from_[i].append((j, w))
                self.to[j].append((i, w))
            self.edges.append((i, j, either(w, self.plain(i, j))))

    def plain(self, i: int, j: int) -> float:
        """The weight of a run of atoms that nothing supports."""
        return self.new + self.end[j] - self.begin[i]

    def expected(self) -> tuple[list[float], list[float]]:
        """How likely each supported run is to be a value, and each delimiter to part, over all ways."""
        n, inf = self.n, -math.inf
        ahead, behind = [0.0] + [inf] * n, [inf] * n + [0.0]
        run = inf
        for j in range(1, n + 1):
            run = either(run, ahead[j - 1] - self.begin[j - 1])
            ahead[j] = run + self.new + self.end[j]
            for i, w in self.to[j]:
                ahead[j] = either(ahead[j], ahead[i] + w)
        run = inf
        for i in range(n - 1, -1, -1):
            run = either(run, behind[i + 1] + self.end[i + 1])
            behind[i] = run + self.new - self.begin[i]
            for j, w in self.from_[i]:
                behind[i] = either(behind[i], behind[j] + w)
        whole = ahead[n]
        return [math.exp(ahead[i] + w + behind[j] - whole) for i, j, w in self.edges], [math.exp(ahead[j] + behind[j] - whole) for j in range(1, n)]

    def best(self) -> list[tuple[int, int]]:
        """Viterbi's likeliest way; of equal ones, that of the fewest values."""
        close: list[list[tuple[int, float]]] = [[] for _ in range(self.n + 1)]
        for i, j, w in self.edges:
            close[j].append((i, w))
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        run = (-math.inf, 0, 0)
        for j in range(1, self.n + 1):
            score, count, _ = best[j - 1]
            run = max(run, (score - self.begin[j - 1], count, 1 - j))
            top = (run[0] + self.new + self.end[j], run[1] - 1, -run[2])
            for i, w in close[j]:
                if (one := (best[i][0] + w, best[i][1] - 1, i))[:2] > top[:2]:
                    top = one
            best.append(top)
        out, j = [], self.n
        while j:
            out.append((best[j][2], j))
            j = best[j][2]
        return out[::-1]


def _pieces(cells: DataFrame, fields: dict[str, PackedField]) -> DataFrame:
    """src_field, row_id, parts: for each piece its text, and whether its splitting is open. Texts of pieces that hold one
    value are final."""
    inside = {f.name: f.inside for f in fields.values()}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {k: Splitter(v) for k, v in inside.items()}
        for b in batches:
            known: dict[tuple[str, str], list] = {}
            out = []
            for f, c in zip(b["src_field"], b["cell"], strict=True):
                got = known.get((f, c))
                if got is None:
                    got = known[f, c] = [{"txt": p.text if p.between else unquoted(p.text), "open": bool(p.between)} for p in by[f].pieces(c)] if c.strip() not in ("", "-") else []
                out.append(got)
            yield pd.DataFrame({"src_field": b["src_field"], "row_id": b["row_id"], "parts": out})

    return cells.mapInPandas(work, "src_field string, row_id string, parts array<struct<txt: string, open: boolean>>")


def _splitters(fields: dict[str, str]) -> dict[str, Splitter]:
    return {k: Splitter(v) for k, v in fields.items()}


SPANS = "pid bigint, src_field string, value string, places array<struct<i: int, j: int>>, n_atoms int"


def _short_spans(pieces: DataFrame, inside: dict[str, str]) -> DataFrame:
    """Each value of up to LEVEL atoms that each piece may hold, once, with its places."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = _splitters(inside)
        for b in batches:
            out = []
            for pid, f, text in zip(b["pid"], b["src_field"], b["piece"], strict=True):
                piece = by[f].pieces(text)[0]
                n = len(piece.atoms)
                own: dict[str, list] = {}
                for i in range(n):
                    for j in range(i + 1, min(n, i + LEVEL) + 1):
                        own.setdefault(valued(piece, i, j), []).append({"i": i, "j": j})
                out += [(pid, f, v, at, max(x["j"] - x["i"] for x in at)) for v, at in own.items()]
            yield pd.DataFrame(out, columns=["pid", "src_field", "value", "places", "n_atoms"])

    return pieces.mapInPandas(work, SPANS)


def _long_spans(pieces: DataFrame, held: DataFrame, top: int, inside: dict[str, str]) -> DataFrame:
    """The values of more than top and up to twice as many atoms whose first and last top atoms are supported in the piece:
    no other can be supported. held: pid, places of supported values."""
    marks = held.select("pid", F.explode("places").alias("p")).filter(F.col("p.j") - F.col("p.i") == top).groupBy("pid").agg(F.collect_set("p.i").alias("starts"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = _splitters(inside)
        for b in batches:
            out = []
            for pid, f, text, starts in zip(b["pid"], b["src_field"], b["piece"], b["starts"], strict=True):
                piece, there = by[f].pieces(text)[0], set(starts)
                own: dict[str, list] = {}
                for i in sorted(there):
                    for j in range(i + top + 1, min(len(piece.atoms), i + 2 * top) + 1):
                        if j - top in there:
                            own.setdefault(valued(piece, i, j), []).append({"i": i, "j": j})
                out += [(pid, f, v, at, max(x["j"] - x["i"] for x in at)) for v, at in own.items()]
            yield pd.DataFrame(out, columns=["pid", "src_field", "value", "places", "n_atoms"])

    return pieces.join(marks, "pid").mapInPandas(work, SPANS)


def _supported(spans: DataFrame, single: DataFrame) -> DataFrame:
    """src_field, value, pieces, single, n_atoms, vid of the values that several pieces hold, or a piece and a value of
    its own, and of those that stand alone (pieces is 0)."""
    each = spans.select("src_field", "value", F.lit(1).alias("pieces"), F.lit(0.0).alias("single"), "n_atoms").unionByName(
        single.select("src_field", "value", F.lit(0).alias("pieces"), F.col("count").alias("single"), F.lit(0).alias("n_atoms"))
    )
    sums = each.groupBy("src_field", "value").agg(F.sum("pieces").alias("pieces"), F.sum("single").alias("single"), F.max("n_atoms").alias("n_atoms"))
    return cut(sums.filter("pieces > 1 or single > 0").withColumn("vid", F.monotonically_increasing_id()))


def _characters(types: DataFrame) -> DataFrame:
    """src_field, name, x: the characters of the types (src_field, value, count), how many types there are, their counts'
    sum, and how many count once; put together in each partition first."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter] = {}
        for b in batches:
            for f, own in b.groupby("src_field"):
                at = sums.setdefault(f, Counter())
                chars = Counter("".join(own["value"]))
                at.update({"c" + c: float(n) for c, n in chars.items()})
                at.update({"types": float(len(own)), "total": float(own["count"].sum()), "once": float((own["count"] < 1.5).sum())})
        yield pd.DataFrame([(f, k, x) for f, own in sums.items() for k, x in own.items()], columns=["src_field", "name", "x"])

    each = types.select("src_field", "value", "count").mapInPandas(work, "src_field string, name string, x double")
    return each.groupBy("src_field", "name").agg(F.sum("x").alias("x"))


def _bases(rows: list[Row]) -> dict[str, Base]:
    """Each field's base from the sums of _characters and of the pieces' new values; rows are bounded by the alphabet."""
    fields: dict[str, dict[str, float]] = {}
    for r in rows:
        own = fields.setdefault(r["src_field"], {})
        own[r["name"]] = own.get(r["name"], 0.0) + r["x"]
    out = {}
    for f, own in fields.items():
        new = max(own.get("new", 0.0), 0.0)
        seen = {k[1:]: max(x, 0.0) for k, x in own.items() if k[0] == "c"}
        seen[""] = own.get("types", 0.0) + new
        mass = sum(seen.values()) + 0.5 * (len(seen) + 1)
        total = own.get("total", 0.0) + new
        if total > 0:
            logs = {c: math.log((n + 0.5) / mass) for c, n in seen.items()}
            out[f] = Base(total, max(own.get("once", 0.0) + new, total * 1e-3), logs, math.log(0.5 / mass))
    return out


def _lattices(pieces: DataFrame, held: DataFrame, counts: DataFrame, bases: dict[str, Base], part: dict[str, dict[str, float]], inside: dict[str, str], decode: bool) -> DataFrame:
    """For each piece its values (src_field, piece, vals); or sums over all pieces (src_field, vid, name, x, seen): the
    expected number of each supported value, of parting delimiters, of new values and of their characters."""
    known = held.join(counts, "vid").groupBy("pid").agg(F.collect_list(F.struct("vid", "places", "count")).alias("known"))

    def lattice(by: dict[str, Splitter], f: str, text: str, known: list | None) -> tuple[Piece, Lattice, list]:
        piece = by[f].pieces(text)[0]
        # a piece's own vote doesn't count: only other pieces support a value
        runs = [(p["i"], p["j"], k["count"] - 1.0, k["vid"]) for k in (known if known is not None else ()) for p in k["places"]]
        return piece, Lattice(piece, bases.get(f, Base(1.0, 1.0, {}, -4.0)), part.get(f, {}), [r[:3] for r in runs]), runs

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = _splitters(inside)
        for b in batches:
            vals = []
            for f, text, known in zip(b["src_field"], b["piece"], b["known"], strict=True):
                piece, ways, _ = lattice(by, f, text, known)
                vals.append([v for i, j in ways.best() if (v := valued(piece, i, j))])
            yield pd.DataFrame({"src_field": b["src_field"], "piece": b["piece"], "vals": vals})

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = _splitters(inside)
        sums: dict[tuple[str, int, str], list[float]] = {}
        chars: dict[str, Counter] = {}
        held: dict[tuple[str, str, int], float] = {}

        def add(f: str, vid: int, name: str, x: float, seen: float = 0.0) -> None:
            at = sums.setdefault((f, vid, name), [0.0, 0.0])
            at[0] += x
            at[1] += seen

        def rows() -> pd.DataFrame:
            for (f, value, vid), p in held.items():
                add("", vid, "v", p)
                for c, n in Counter(value).items():
                    chars.setdefault(f, Counter())[c] -= n * p
            for f, own in chars.items():
                for c, n in own.items():
                    add(f, -1, "c" + c, n)
            out = pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["src_field", "vid", "name", "x", "seen"])
            for d in (sums, chars, held):
                d.clear()
            return out

        for b in batches:
            for f, text, known in zip(b["src_field"], b["piece"], b["known"], strict=True):
                piece, ways, runs = lattice(by, f, text, known)
                likely, parting = ways.expected()
                own = chars.setdefault(f, Counter())
                for a, e in piece.atoms:
                    own.update(unquoted(piece.text[a:e]))
                for d, p in zip(piece.between, parting, strict=True):
                    add(f, -1, "d" + d, p, 1.0)
                    own[d] += 1.0 - p
                add(f, -1, "new", 1.0 + sum(parting) - sum(likely))
                for (i, j, _, vid), p in zip(runs, likely, strict=True):
                    key = (f, valued(piece, i, j), vid)
                    held[key] = held.get(key, 0.0) + p
            if len(held) > 500_000:
                yield rows()
        yield rows()

    rows = pieces.join(known, "pid", "left").select("src_field", "piece", "known")
    return rows.mapInPandas(split, "src_field string, piece string, vals array<string>") if decode else rows.mapInPandas(expect, "src_field string, vid bigint, name string, x double, seen double")


def decoded(pieces: DataFrame, single: DataFrame, inside: dict[str, str], rounds: int = ROUNDS) -> DataFrame:
    """src_field, piece, vals: the likeliest split of each piece (pid, src_field, piece), by frequencies that all pieces and
    the values that stand alone (single: src_field, value, count) teach."""
    top, spans = LEVEL, cut(_short_spans(pieces, inside))
    values = _supported(spans, single)
    alone = values.filter("pieces = 0")
    shared = values.filter("pieces > 0")
    held = cut(spans.join(shared.select("src_field", "value", "vid"), ["src_field", "value"]).select("vid", "pid", "places"))
    longer: list[DataFrame] = []
    while shared.filter(f"n_atoms = {top} and pieces > 1").limit(1).count() if not longer else longer[-1].filter(f"n_atoms = {top} and pieces > 1").limit(1).count():
        spans = cut(_long_spans(pieces, held, top, inside))
        top *= 2
        more = _supported(spans, single).filter("pieces > 0").withColumn("vid", -1 - F.col("vid") - (len(longer) << 60))
        longer.append(cut(more))
        held = cut(held.unionByName(spans.join(longer[-1].select("src_field", "value", "vid"), ["src_field", "value"]).select("vid", "pid", "places")))
    for more in longer:
        shared = shared.unionByName(more)
        alone = alone.join(more.select("src_field", "value"), ["src_field", "value"], "left_anti")
    shared = shared.select("vid", "src_field", "value", "single")
    fixed = _characters(alone.select("src_field", "value", F.col("single").alias("count"))).collect()

    counts = shared.withColumn("count", F.col("single"))
    part: dict[str, dict[str, float]] = {}
    bases = _bases(fixed + _characters(counts.filter("count >= 0.5")).collect())
    for _ in range(rounds):
        step = _lattices(pieces, held, counts.select("vid", "count"), bases, part, inside, decode=False)
        expected = cut(step.groupBy("src_field", "vid", "name").agg(F.sum("x").alias("x"), F.sum("seen").alias("seen")))
        own = expected.filter("name = 'v'").select("vid", "x")
        counts = shared.join(own, "vid", "left").withColumn("count", F.col("single") + F.coalesce("x", F.lit(0.0))).drop("x")
        sums = expected.filter("vid = -1").select("src_field", "name", "x", "seen").unionByName(_characters(counts.filter("count >= 0.5")).withColumn("seen", F.lit(0.0))).collect()
        before, part = part, {}
        for r in sums:
            if r["name"][0] == "d":
                part.setdefault(r["src_field"], {})[r["name"][1:]] = min(max((r["x"] + 0.5) / (r["seen"] + 1.0), 1e-4), 1 - 1e-4)
        bases = _bases(fixed + [r for r in sums if r["name"][0] != "d"])
        if all(abs(p - before.get(f, {}).get(d, 0.5)) <= SETTLED for f, own in part.items() for d, p in own.items()):
            break
    return _lattices(pieces, held, counts.select("vid", "count"), bases, part, inside, decode=True)


def unpack(cells: DataFrame, fields: list[PackedField], rounds: int = ROUNDS) -> DataFrame:
    """One row (src_field, row_id, val_pos, val, n_vals) for each value of each cell.

    cells: src_field, row_id, cell (other columns are ignored). A cell is cut at delimiters that always part values;
    quoted and bracketed spans are atomic. Where only blanks, hyphens and the like stand between atoms, expectation
    maximisation over all distinct pieces of the field learns how frequent each value is and how often each delimiter
    parts values, and a Viterbi lattice picks the likeliest split, of values of any number of atoms. A piece counts once,
    however many rows repeat it, and not for itself; values that no other piece supports are judged by their characters.

    val has no blanks at its ends and no enclosing quotes; empty values are left out and don't count in val_pos;
    repeated values stay. Null and blank cells, and those of '-' alone, hold no value. Repeated rows each
    count, a null row_id stays null. Very long cells are read whole. Without cells the result is empty.

    Pieces are pre-aggregated before each shuffle; each round exchanges numbers of supported values only. Only rows with
    an open piece are joined with the decoded pieces (one row each; adaptive execution splits a frequent one).
    """
    by_name = {f.name: f for f in fields}
    inside = {f.name: f.inside for f in fields}
    cells = cells.select("src_field", F.col("row_id").cast("string").alias("row_id"), "cell").filter(F.col("cell").isNotNull() & F.col("src_field").isin(list(by_name)))
    parts = cut(_pieces(cells, by_name).filter(F.size("parts") > 0))
    each = parts.select("src_field", F.explode("parts").alias("p")).groupBy("src_field", F.col("p.open").alias("open"), F.col("p.txt").alias("piece")).agg(F.count("*").alias("n"))
    each = cut(each.withColumn("pid", F.monotonically_increasing_id()))
    single = each.filter("not open and piece <> ''").select("src_field", F.col("piece").alias("value"), F.col("n").cast("double").alias("count"))
    split = decoded(each.filter("open").select("pid", "src_field", "piece"), single, inside, rounds)

    has_open = F.exists("parts", lambda p: p["open"])
    plain = parts.filter(~has_open).select("src_field", "row_id", F.expr("filter(transform(parts, p -> p.txt), v -> v <> '')").alias("vals"))
    loose = parts.filter(has_open).withColumn("uid", F.when(F.size("parts") > 1, F.monotonically_increasing_id()))
    loose = loose.select("src_field", "row_id", "uid", F.posexplode("parts").alias("at", "p")).select("src_field", "row_id", "uid", "at", F.col("p.open").alias("open"), F.col("p.txt").alias("piece"))
    fixed = loose.filter("not open").select("src_field", "row_id", "uid", "at", F.expr("filter(array(piece), v -> v <> '')").alias("vals"))
    opened = cut(loose.filter("open").join(split, ["src_field", "piece"]).select("src_field", "row_id", "uid", "at", "vals"))
    # cells of one piece are whole already
    several = fixed.unionByName(opened.filter("uid is not null"))
    mixed = several.groupBy("src_field", "row_id", "uid").agg(F.expr("flatten(transform(array_sort(collect_list(struct(at, vals))), x -> x.vals))").alias("vals")).drop("uid")
    return plain.unionByName(opened.filter("uid is null").select("src_field", "row_id", "vals")).unionByName(mixed).select(
        "src_field", F.col("row_id").cast("bigint").alias("row_id"), F.size("vals").alias("n_vals"), F.posexplode("vals").alias("val_pos", "val")
    ).withColumn("val_pos", F.col("val_pos") + 1)
