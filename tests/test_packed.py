import itertools
import math
import random

import pytest

from quarrylane.operators.packed import Base, Lattice, PackedField, Splitter, unpack, unquoted, valued

SCHEMA = "src_field string, row_id bigint, cell string"


def values(spark, cells, name="f", inside="", extra=None):
    rows = [(name, i, c) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", *extra)
    out = {}
    for r in unpack(df, [PackedField(name, inside)]).orderBy("row_id", "val_pos").collect():
        out.setdefault(r["row_id"], []).append(r["val"])
    return [out.get(i, []) for i in range(len(cells))]


def test_hard_delimiters_and_quotes(spark):
    cells = ['a, b;c', '"x, y"|z', "“1/2”\t[p; q]r", 'a,,b', " , a ", '"say ""no"""; b', "'it''s'; c", '「the "n, g" slip」、b', "l1<br>l2<BR/>l3", "a,a"]
    assert values(spark, cells) == [["a", "b", "c"], ["x, y", "z"], ["1/2", "[p; q]r"], ["a", "b"], ["a"], ['say "no"', "b"], ["it's", "c"], ['the "n, g" slip', "b"], ["l1", "l2", "l3"], ["a", "a"]]


def test_defined_results_for_odd_cells(spark):
    cells = [None, "", "   ", "-", ",;,", '""', '"a', "-, a"]
    assert values(spark, cells) == [[], [], [], [], [], [], ['"a'], ["a"]]
    assert values(spark, []) == []


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([("f", 1, "a,b"), ("f", 1, "a,b"), ("f", None, "c,d"), (None, 2, "x,y"), ("other", 3, "x,y")], SCHEMA).selectExpr("*", "'x' as parts", "1 as piece", "2 as vals", "3 as n", "4 as p")
    got = sorted((r["row_id"] or 0, r["val_pos"], r["val"]) for r in unpack(df, [PackedField("f")]).collect())
    assert got == [(0, 1, "c"), (0, 2, "d"), (1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]


def test_very_long_cell(spark):
    cell = ";".join(f"v{i}" for i in range(20_000))
    assert values(spark, [cell])[0] == [f"v{i}" for i in range(20_000)]


def test_the_column_decides_on_soft_delimiters(spark):
    rng = random.Random(1)
    words = ["rate card", "sign-off", "order", "slip", "e-mail", "price"]
    cells = ["/".join(rng.sample(words, 3)) for _ in range(200)] + [w for w in words] * 5
    got = values(spark, cells)
    assert got[:200] == [c.split("/") for c in cells[:200]] and got[200:] == [[w] for w in words] * 5
    parts = ["ab", "cd", "ef", "gh", "ij"]
    cells = [rng.choice([" ", "-", "_", "+"]).join(rng.sample(parts, 2)) for _ in range(200)]
    assert all(len(v) == 2 for v in values(spark, cells))


def test_unique_targets_are_parted_at_blanks(spark):
    rng = random.Random(2)
    name = lambda: f"TB_{rng.choice('ABCDEFG')}{rng.randrange(10**6)}.C_{rng.randrange(10**6)}(R)"
    cells = [" ".join(name() for _ in range(3)) for _ in range(100)] + ["; ".join(name() for _ in range(2)) for _ in range(100)]
    got = values(spark, cells, inside="_")
    assert got[:100] == [c.split(" ") for c in cells[:100]] and got[100:] == [c.split("; ") for c in cells[100:]]


@pytest.mark.parametrize("seed", range(20))
def test_lattice_against_brute_force(seed):
    """Viterbi and expected counts against all ways to split a piece."""
    import itertools
    import math

    rng = random.Random(seed)
    n = rng.randint(1, 6)
    piece = Splitter().pieces(rng.choice("-+/").join("abcdefg"[:n]))[0]
    base = Base(40.0, rng.uniform(1, 20), {c: math.log(rng.random()) for c in ["", *"abcdefg"]}, -5.0)
    part = {d: rng.uniform(0.1, 0.9) for d in piece.between}
    runs = [(i, j, rng.choice([0.0, rng.uniform(0, 9)])) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.4]
    ways = Lattice(piece, base, part, runs)
    counts = {(i, j): c for i, j, c in runs}

    def weight(i, j):
        new = base.alpha * math.exp(base.log(valued(piece, i, j)) + base.chars[""])
        p = (counts.get((i, j), 0.0) + new) / (base.total + base.alpha)
        for d in piece.between[i : j - 1]:
            p *= 1 - part[d]
        return p * (part[piece.between[j - 1]] if j < n else 1)

    every = []
    for cuts in itertools.product([0, 1], repeat=n - 1):
        ends = [k + 1 for k, c in enumerate(cuts) if c] + [n]
        way = list(zip([0, *ends], ends, strict=False))
        every.append((math.prod(weight(*x) for x in way), way))
    total = sum(w for w, _ in every)
    assert ways.best() == max(every)[1]
    likely, parting = ways.expected()
    for (i, j, _), p in zip(runs, likely, strict=True):
        assert p == pytest.approx(sum(w for w, way in every if (i, j) in way) / total)
    for k, p in enumerate(parting, 1):
        assert p == pytest.approx(sum(w for w, way in every if any(j == k for _, j in way)) / total)


def test_values_of_any_number_of_atoms(spark):
    """A value of more atoms than are looked for at once stays whole where the column supports it, split otherwise."""
    long = "bill of lading for goods in free transit zone"
    names = ["red kite", "blue whale", "stone bridge"]
    cells = [f"{n}/{long}" for n in names] + [f"{long}; {n}" for n in names] + [f'"{long}", {n}' for n in names] + ["/".join(names)] * 3
    got = values(spark, cells)
    assert got[:3] == [[n, long] for n in names] and got[3:6] == [[long, n] for n in names]
    alone = values(spark, [" ".join(f"w{i}" for i in range(3000))])[0]
    assert " ".join(alone) == " ".join(f"w{i}" for i in range(3000))


def test_unquoted():
    assert [unquoted(x) for x in (' "a" ', "'a''b'", '"a"b"', "「x「y」", "“ t ”")] == ["a", "a'b", '"a"b"', "「x「y」", "t"]
