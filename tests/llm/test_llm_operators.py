"""The text operators on small fixtures: defined results of odd inputs, and brute force where SQL can't say it."""

import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from quarrylane.llm import bpe, catalog_match, frequency, glyphs, language, leakage, lookalike, mojibake

VALUES = "src_field string, row_id bigint, value string"
DOCS = "doc_id bigint, text string, lang string"
CLASH = ["1 as std_id", "'x' as cost", "2 as seen", "3 as class", "4 as clean_text", "5 as restored", "6 as bin"]


def values(spark, rows, extra=()):
    df = spark.createDataFrame(rows, VALUES)
    return df.selectExpr("*", *extra) if extra else df


# ---- 2: canonical list


CATALOG = [(1, "재고", "Inventory", "INVT"), (2, "단가", "Unitprice", "UPR"), (3, "재고단가", "Inventory Unitprice", "INVT_UPR"), (4, "번호", "Number", "NUM")]


def catalog(spark, rows=CATALOG):
    return spark.createDataFrame(rows, "std_id bigint, std_name string, eng_name string, abbr string")


@pytest.fixture(scope="module")
def names(spark):
    (rows,) = catalog_match.catalog_blocks(catalog(spark))
    return catalog_match.Catalog(rows)


def test_catalog_finds_what_is_meant(spark):
    texts = {
        "재고단가": None, "INVT_UPR": None, "재고 단가": 3, "invt-upr": 3, "InventoryUnitprice": 3, "재고 Unitprice (필수)": 3, "● 재고단가*": 3, "5. 재고단가": 3, "재고단가 - v3": 3, "재고단가 : 10자리": 3,
        "재꼬": 1, "재고다가": 3, "wofh": 1, "ＩＮＶＴ": 1, "Inventroy": 1, "번호호": 0, "재고단": 3, "벼루": 0, "재고 쪽에 물어볼 것": 0, "나": 0, "": None, "   ": None, None: None, "x" * 50_000: 0, "재​고": 1, "(재고)": 1,
    }
    rows = [("f", i, t) for i, t in enumerate(texts)]
    got = {r["row_id"]: r["std_id"] for r in catalog_match.map_to_catalog(values(spark, rows, CLASH), catalog(spark)).collect()}
    assert {t: got.get(i) for i, t in enumerate(texts)} == texts


def test_catalog_blocks_ties_and_empty_tables(spark):
    rows = [("f", 1, "재고 단가"), ("f", 1, "재고 단가"), ("f", None, "재꼬"), (None, 2, "번허"), ("f", 3, "재고단가"), ("f", 4, "INVT 단가"), ("f", 5, "재고: 번호"), ("f", 6, "new inventory unitprice"), ("f", 7, "Number (INVT)"), ("f", 8, " ")]
    one, *several = (sorted(map(tuple, catalog_match.map_to_catalog(values(spark, rows), catalog(spark), block=b).collect()), key=str) for b in (100, 1, 5))
    assert one == sorted([("f", 1, 3), ("f", 1, 3), ("f", None, 1), (None, 2, 4), ("f", 4, 3), ("f", 5, 0), ("f", 6, 3), ("f", 7, 4)], key=str)
    assert several == [one, one]
    assert {r[2] for r in catalog_match.map_to_catalog(values(spark, rows), catalog(spark, [])).collect()} == {0}
    assert catalog_match.map_to_catalog(values(spark, []), catalog(spark)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_edit_distance_against_brute_force(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(2))
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    # common ends are taken off first, which may only help a swap that crosses them
    assert catalog_match.near(a, b, 9) in (d[len(a), len(b)], d[len(a), len(b)] + 1) and catalog_match.near(a, b, 1) == min(2, catalog_match.near(a, b, 9))


def test_mentions_are_the_longest_without_overlap(names):
    found = lambda v: [m[4] for m in catalog_match.longest(m for m in names.mentions(catalog_match.Value(v)) if m[0] == 0)]
    assert found("재고 단가 번호") == [3, 4] and found("재고단가번호") == [] and found("a 재고, 재고단가") == [1, 3]


def test_long_notes_dont_hide_a_name(names):
    for note in (f"({'필수 ' * 300})", f" ※ {'비고 ' * 5000}", f" : {'x' * 50_000}"):
        assert names.find("재고단가" + note) == 3 and names.find("재고다가" + note) == 3 and names.find("벼루" + note) == 0


def test_mentions_decide_beside_notes(names):
    texts = {"재고단가: 10자리": 3, "재고 Unitprice：필수 항목": 3, "● INVT: see page": 1, "재고: 번호": 0, "벼루: 재고": 0, "재고 쪽: 물어볼 것": 0, "새재고: 필수": 0, "재고 번호: 필수": 0}
    assert {t: names.find(t) for t in texts} == texts
    # beside other words a mention decides where it makes up half of the keys
    assert names.find("our inventory unitprice today") == 3 and names.find("재고 쪽에 물어볼 것을 남김") == 0


def test_without_the_automaton_embedded_names_are_lost(spark):
    import ahocorasick

    (rows,) = catalog_match.catalog_blocks(catalog(spark))
    own, mute = catalog_match.Catalog(rows), catalog_match.Catalog(rows)
    mute.automaton = ahocorasick.Automaton()
    mute.automaton.add_word("~", (1, 0))
    mute.automaton.make_automaton()
    text = "our inventory unitprice today"
    assert own.find(text) == 3 and mute.find(text) == 0


def test_mixtures_take_what_is_left_of_a_name(spark):
    rows = [(1, "유형", "Category", "CTG"), (2, "Länge유형", "Laenge Category", "LNG_CTG"), (3, "유형", "Kind", None), (4, None, None, None)]
    (entries,) = catalog_match.catalog_blocks(catalog(spark, rows))
    own = catalog_match.Catalog(entries)
    assert [own.find(v) for v in ("Länge Category", "LNG 유형", "laenge_ctg", "kind", "유형")] == [2, 2, 2, 3, catalog_match.EXACT]


# ---- 3: look-alikes


def test_ordinary_forms(spark):
    texts = {
        "ＢＯＸ수량": "BOX수량", "ΒΟΧ수량": "BOX수량", "РLС주소": "PLC주소", "Σ곰취": None, "Ω 두루미": None, "μ물레": None, "재​고": "재고", "재ㅤ고": "재고", "\xa0재고　단가 ": "재고 단가", "재고": None,
        "Señal": None, "Señal": "Señal", "재고": "재고", "재﻿고": "재고", "𝐊𝐏𝐈": "KPI", "a  b": "a b", "": None, "   ": None, "​": None, None: None, "ﾠ": None, "A_b-C.": None,
        "Ａ" * 100_000: "A" * 100_000, "Α": None, "ΩΔ": None, "Αlpha": "Alpha", " 품질": "품질",
    }
    rows = [("f", i, t) for i, t in enumerate(texts)]
    got = {r["row_id"]: r["clean_text"] for r in lookalike.ordinary_forms(values(spark, rows, CLASH)).collect()}
    assert {t: got.get(i) for i, t in enumerate(texts)} == texts
    assert all(glyphs.ordinary(t) == (w or t) for t, w in texts.items() if t and t.strip(" ​ﾠ") and w)
    assert lookalike.ordinary_forms(values(spark, [])).count() == 0


def test_ordinary_forms_keeps_repeats_and_nulls(spark):
    rows = [("f", 1, "ＡＢ"), ("f", 1, "ＡＢ"), (None, None, "ＡＢ")] + [("g", i, "x\xa0y") for i in range(3000)]
    got = Counter((r["src_field"], r["clean_text"]) for r in lookalike.ordinary_forms(values(spark, rows)).collect())
    assert got == {("f", "AB"): 2, (None, "AB"): 1, ("g", "x y"): 3000}


def test_sql_and_python_forms_agree(spark):
    df = spark.read.parquet(f"{DATA}/word.parquet").selectExpr("'w' src_field", "word_id row_id", "logical value")
    got = {r["row_id"]: r["clean_text"] for r in lookalike.ordinary_forms(df).collect()}
    for r in df.filter("value is not null").collect():
        clean = glyphs.ordinary(r["value"])
        assert got.get(r["row_id"]) == (clean if clean and clean != r["value"] else None)


# ---- 4: encodings


CLEAN = ["재고 기준 (측정 단위 ㎡, 오차 ±52)", "Menge je Größe für 보증", "貿易 實務 用語로 정산", "처리 담당 부서가 정한 말로", "plain", "Übersicht 12", "공지 수량", "최종 확인 창고"]


def garbled(text, right, wrong="cp1252"):
    if wrong == "cp1252":
        return "".join(map(mojibake.SHOWN.__getitem__, text.encode(right)))
    return text.encode(right).decode(wrong)


def test_restore(spark):
    text = "처리 담당 부서가 정한 말로"
    part = "재고 기준 " + garbled("(측정 단위", "utf-8")
    cases = {
        garbled(text, "utf-8"): text, garbled(garbled(text, "utf-8"), "utf-8"): text, garbled(text, "cp949"): text, garbled("Menge je Größe für 보증", "utf-8"): "Menge je Größe für 보증", part: "재고 기준 (측정 단위",
        "공지 �량": "", "¿¿ 수량": "", "Größe ¿¿": "", text: None, "Übersicht 12": None, "plain": None, "": None, "  ": None, None: None, "¿Dónde está?": None, "貿易 實務 用語로 정산": None,
        garbled(text, "utf-8") + "a" * 100_000: text + "a" * 100_000,
    }
    rows = [("f", 1000 + i, t) for i, t in enumerate(CLEAN * 40)] + [("f", i, t) for i, t in enumerate(cases)] + [("f", None, garbled(text, "utf-8"))] * 2
    got = mojibake.restore(values(spark, rows, CLASH)).collect()
    assert {t: next((r["restored"] for r in got if r["row_id"] == i), None) for i, t in enumerate(cases)} == cases
    assert [r["restored"] for r in got if r["row_id"] is None] == [text] * 2 and not [r for r in got if (r["row_id"] or 0) >= 1000]
    assert mojibake.restore(values(spark, [])).count() == 0


def test_held_out_accuracy_of_restoring(spark):
    """Half of the sound labels train, the other half is garbled and must come back."""
    sound = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/screen_field.parquet").select("label").distinct().collect() if r[0] and mojibake.clean(r[0]) and not r[0].isascii()]
    sound.sort()
    train, held = sound[::2], sound[1::2]
    total = np.zeros(mojibake.SINGLES + mojibake.PAIRS)
    for v in train:
        c = mojibake.codes(v)
        np.add.at(total, c, 1)
        np.add.at(total, mojibake.SINGLES + mojibake.pair_bins(c), 1)
    model = mojibake.Model(total[: mojibake.SINGLES], total[mojibake.SINGLES :])
    judge = mojibake.Restorer(model, mojibake.validated_margin(model, train))
    back = [judge.value(garbled(v, "utf-8")) == v for v in held]
    assert np.mean(back) > 0.97 and np.mean([judge.value(v) is None for v in held]) > 0.97


def test_margin_counts_all_clean_words(spark):
    texts = [f"{chr(0xAC00 + i % 2000)}{chr(0xAC00 + 7 * i % 11000)}é 값" for i in range(2600)]
    df = values(spark, [("f", i, t) for i, t in enumerate(texts)])
    model = mojibake.train(df)
    words = {w for t in texts if mojibake.clean(t) for w in t.split(" ")}
    want = mojibake.word_gains(mojibake.Restorer(model, 0.0), words)
    assert len(words) > 2000 and sum(n for (true, _), n in want.items() if true) > 2000
    assert mojibake.all_gains(df, model) == want
    # two false gains of 3 nats, true ones of 2 and 40
    bins = lambda g: int(g / mojibake.STEP)
    assert mojibake.best_margin({(False, bins(3)): 2, (True, bins(2)): 1, (True, bins(40)): 5}) == 3.5
    assert mojibake.best_margin({}) == mojibake.best_margin({(True, mojibake.TOP): 9}) == 1.0


# ---- 5: frequencies


def terms(spark, rows, extra=()):
    """Rows of one term each as records of several rows."""
    return spark.createDataFrame(rows, "src_field string, rec bigint, term string").selectExpr("*", "array(term) as terms", "false as whole", *extra)


def test_frequencies_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "A ", "b", " ", "", None, "é", "é", "hot"]
    rows = [("f" if i % 3 else "g", rng.randrange(60), rng.choice(words + ["hot"] * 20)) for i in range(4000)] + [("f", 1000 + i, f"t{i % 700}") for i in range(1400)]
    df = terms(spark, rows, ["1 as n", "2 as n_occ", "true as heavy", "3 as records", "4 as slots", "5 as kind"])
    occ, rec = Counter(), {}
    for f, r, t in rows:
        if k := frequency.term_key(t):
            occ[f, k] += 1
            rec.setdefault((f, k), set()).add(r)
    held = {f: len({r for (g, _), rs in rec.items() if g == f for r in rs}) for f in "fg"}
    want = {(f, k): (n, len(rec[f, k]), "rare" if len(rec[f, k]) < 3 else "common" if len(rec[f, k]) > 0.03 * held[f] else "usual") for (f, k), n in occ.items()}
    got = {(r["src_field"], r["term_key"]): (r["n_occ"], r["n_rec"], r["freq_mark"]) for r in frequency.frequencies(df).collect()}
    assert got == want


def test_whole_records_against_brute_force(spark):
    """Arrays of one row each beside records of several rows."""
    rng = random.Random(4)
    rows = [("f", i, [rng.choice(["a", "b ", "B", None, " ", "hot"] + [f"t{rng.randrange(300)}"]) for _ in range(rng.randrange(6))], True) for i in range(3000)] + [("f", 9, None, True), ("f", 1, ["hot"], True)]
    rows += [("g", rng.randrange(500), [rng.choice(["x", "y", "hot", None, f"t{rng.randrange(90)}"]) for _ in range(rng.randrange(3))], False) for _ in range(3000)]
    occ, rec = Counter(), {}
    for n, (f, r, ts, whole) in enumerate(rows):
        for t in ts or []:
            if k := frequency.term_key(t):
                occ[f, k] += 1
                rec.setdefault((f, k), set()).add(n if whole else r)
    df = spark.createDataFrame(rows, "src_field string, rec bigint, terms array<string>, whole boolean")
    got = {(r["src_field"], r["term_key"]): (r["n_occ"], r["n_rec"]) for r in frequency.frequencies(df).collect()}
    assert got == {k: (n, len(rec[k])) for k, n in occ.items()}


def test_heavy_terms_only_change_the_way(spark, monkeypatch):
    rows = [("f", i, f"t{i % 50}") for i in range(1000)] + [("f", i, "hot") for i in range(500)]
    df = terms(spark, rows)
    light = sorted(map(tuple, frequency.frequencies(df).collect()))
    monkeypatch.setattr(frequency, "DETECT_ROWS", 1400)
    assert len(frequency.heavy_terms(df)) > 0
    assert sorted(map(tuple, frequency.frequencies(df).collect())) == light


def test_frequencies_of_nothing_and_of_nulls(spark):
    assert frequency.frequencies(terms(spark, [])).count() == 0
    got = frequency.frequencies(terms(spark, [("f", None, "x"), ("f", None, "x"), ("f", 2**60, "x"), ("f", 1, "y" * 100_000)])).collect()
    assert sorted((r["term_key"][:3], r["n_occ"], r["n_rec"]) for r in got) == [("X", 3, 2), ("YYY", 1, 1)]


# ---- 6: token ids


ODD = [
    None, "", " ", "\n\n  \t x ", "a" * 5000, "ab" * 3000, "한" * 3000, "don't I'll THEY'RE", "<|endoftext|> x", "\x00\x01�", "é́🙂👩‍💻" * 80, "1234567890" * 50, "日本語のテキスト。中文文本", "x" * 255 + " " + "y" * 256 + " " + "z" * 257,
]


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    return [[] if not x else t.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_equals_the_public_library(spark):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("abcdeñ한글 1!\n'") for _ in range(rng.randrange(900))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").selectExpr("*", "'x' as ids")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert [got[i] for i in range(len(texts))] == reference_ids(texts)


def test_bpe_equals_the_public_library_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    keys = sorted(texts)
    assert [got[k] for k in keys] == reference_ids([texts[k] for k in keys])


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2**60 + 1, None)], "doc_id bigint, text string")
    assert sorted(map(str, (tuple(r) for r in bpe.encode(df).collect()))) == sorted(map(str, [(1, [87]), (1, [87]), (None, [88]), (2**60 + 1, [])]))
    assert bpe.encode(df.limit(0)).count() == 0


def test_bpe_splits_like_the_public_pattern():
    public = pytest.importorskip("public_tokenizers")
    import regex

    for t in filter(None, ODD):
        assert regex.findall(bpe.PATTERN, t) == regex.findall(public.PATTERN, t)


def test_absent_pairs_walk_to_the_end_of_their_run():
    table = bpe.encoder(bpe.vocabulary_path()).table
    size, held = table.mask + 1, table.keys != -1
    run = np.zeros(size, int)
    for k in range(2 * size - 1, -1, -1):
        run[k % size] = run[(k + 1) % size] + 1 if held[k % size] else 0
    # one absent pair for each home slot, those of the longest runs among them
    a, b = (x.ravel() for x in np.meshgrid(np.arange(50_000, 50_200), np.arange(20_000)))
    home = table.home(a.astype(np.int64) << 17 | b)
    far = np.nonzero((run[home] > 9) & ~np.isin(a.astype(np.int64) << 17 | b, table.keys))[0]
    assert len(far) and (table.keys[table.find(a[far], b[far])] == -1).all()


# ---- 7: leakage


def brute_leaks(doc, item):
    d, w = leakage.words(doc), leakage.words(item)
    for i in range(len(d)):
        for j in range(len(w)):
            k = bad = 0
            while i + k < len(d) and j + k < len(w):
                bad += d[i + k] != w[j + k]
                k += 1
                if k >= 12 and bad * 10 <= k and d[i] == w[j] and d[i + k - 1] == w[j + k - 1]:
                    return True
    return False


@pytest.mark.parametrize("seed", range(6))
def test_leaks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(8, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        src = rng.choice(items)[1].split()
        a = rng.randrange(max(1, len(src) - 8))
        part = src[a : a + rng.randrange(6, 30)]
        part = [rng.choice(vocab) if rng.random() < 0.08 else w for w in part]
        docs.append((d, " ".join([rng.choice(vocab) for _ in range(5)] + part + [rng.choice(vocab) for _ in range(5)])))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block=5)
    found = {(r["doc_id"], r["item_id"]) for r in got.filter("kind = 'verbatim'").collect()}
    assert found == {(d, i) for d, t in docs for i, x in items if brute_leaks(t, x)}


ITEM = "When the Misewyn loader in plant Q926 writes batch 8798, the Misepham ledger keeps 8019 open rows until Braepham confirms the Pelesby checksum."


def leak_kinds(spark, text, items=((1, ITEM),)):
    pad = [(100 + i, f"When the {a} loader in plant Q{i} writes batch {i}77, the {b} ledger keeps {i}19 open rows until {c} confirms the {d} checksum.") for i, (a, b, c, d) in enumerate([("Ka", "Kb", "Kc", "Kd"), ("La", "Lb", "Lc", "Ld"), ("Ma", "Mb", "Mc", "Md")])]
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string").selectExpr("*", "'x' as kind", "0 as item_id")
    got = leakage.leaks(docs, spark.createDataFrame([*items, *pad], "item_id bigint, text string")).collect()
    return {(r["item_id"], r["kind"]) for r in got if r["item_id"] < 100}


def test_leaks_regardless_of_layout(spark):
    w = ITEM.split()
    assert leak_kinds(spark, ITEM) == {(1, "verbatim")}
    assert leak_kinds(spark, "> " + "\n> ".join(ITEM.upper().split())) == {(1, "verbatim")}
    assert leak_kinds(spark, "　".join(f'({x})"' for x in w[:12])) == {(1, "verbatim")}
    assert leak_kinds(spark, "x " + " ".join(w[:5] + ["other"] + w[6:12])) == {(1, "verbatim")}
    assert leak_kinds(spark, " ".join(w[:11])) == set()
    assert leak_kinds(spark, ITEM.replace("Misewyn", "Orbu").replace("Q926", "Q1").replace("8798", "12").replace("Misepham", "Veno").replace("8019", "77").replace("Braepham", "Talo").replace("Pelesby", "Nexa")) == {(1, "reparameterised")}


def test_leaks_of_odd_rows(spark):
    item = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, ""), (4, "x " * 200_000 + ITEM)], "doc_id bigint, text string")
    assert sorted(str((r["doc_id"], r["item_id"])) for r in leakage.leaks(docs, item).collect()) == ["(1, 1)", "(1, 1)", "(4, 1)", "(None, 1)"]
    assert leakage.leaks(docs, item.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), item).count() == 0


def test_verbatim_leaks_come_from_template_windows():
    pad = [(i, ITEM.replace("Misewyn", f"K{chr(97 + i)}").replace("Pelesby", f"P{chr(97 + i)}")) for i in range(2, 5)]
    items = leakage.Items([(1, ITEM), *pad, (9, "Alba Beno Caru Dilo Efta Gano Hemi Jolo Kuma Lino Mavo Nuri")])
    # a window stands as it is only if it has too few literal words for a template
    for table, few in ((items.exact, True), (items.template, False)):
        assert table and all((np.sum(items.typed[k][j : j + leakage.SEED] > 3) < leakage.LITERALS) == few for hits in table.values() for k, j in hits)
    # a replaced name fills its slot inconsistently; the passage is verbatim all the same
    twice = "When the Orbu loader writes a batch the Orbu ledger keeps rows until confirms"
    found = leakage.in_batch([1, 2, 3], [ITEM, "Alba Beno Caru Dilo Efta Gano Hemi Jolo Kuma Lino Mavo Nuri", twice], items)
    assert {(d, i, kind) for d, i, kind, _, _ in found if i in (1, 9)} == {(1, 1, "verbatim"), (2, 9, "verbatim")}
    again = leakage.Items([(1, twice)] + [(i, twice.replace("Orbu", f"N{chr(97 + i)}")) for i in range(2, 6)])
    assert (1, 1, "verbatim", 0, 14) in leakage.in_batch([1], [twice.replace("Orbu", "Veno", 1)], again)
    items.template_keys = items.template_keys[:0]
    assert not [x for x in leakage.in_batch([1], [ITEM], items) if x[1] == 1]


def test_blocks_of_items_dont_matter(spark):
    names = [f"{a}{b}" for a in "klmnprst" for b in ("alo", "eri", "omu")]
    text = "When the {0} loader in plant Q{1} writes batch {1}77, the {2} ledger keeps {1}19 open rows until {3} confirms the checksum."
    items = spark.createDataFrame([(i, text.format(names[i], i, names[i + 5], names[i + 10])) for i in range(8)] + [(20 + i, f"rows {n} loader") for i, n in enumerate(names)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, text.format("Orbu", 91, "Veno", "Talo")), (2, text.format(names[2], 2, names[7], names[12]))], "doc_id bigint, text string")
    one, many = (sorted(tuple(r) for r in leakage.leaks(docs, items, block=n).collect()) for n in (5000, 2))
    assert one == many and {r[2] for r in one} == {"verbatim", "reparameterised"}


# ---- 8: languages


@pytest.fixture(scope="module")
def model(spark):
    return language.train(language.labelled_sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), rows=120))


KO, EN, DE = "담당자가 출하 요청을 등록하면 서비스가 한 줄을 넣고 결과를 돌려준다.", "The training slides show the budget steps backwards; please correct them before next month.", "In der Verknüpfung stand noch der alte Name, deshalb stimmten die Summen der Einlagerung nicht."
JA, ZH, ES = "結合条件に古い名前が残っていたので、割引の件数が合いませんでした。", "没有报价权限的用户点击按钮时只会看到提示。", "El historial de carga permanece durante muchos meses y luego se mueve a otro lugar."


def test_languages_of_single_and_mixed_texts(model):
    texts = [KO, EN, DE, JA, ZH, ES, f"{KO} {EN} {KO}", f"{DE}\n\n{ES}", f"{JA}{ZH}", None, "", " ", "---", "493497\n5072", "SELECT a.X, b.Y\n  FROM TB_A a\n WHERE a.Z = #{p}", "getHandling TB_X", EN * 2000]
    got = [[x for x, _ in s] for s in language.stretches(model, texts)]
    assert got == [["ko"], ["en"], ["de"], ["ja"], ["zh"], ["es"], ["ko", "en", "ko"], ["de", "es"], ["ja", "zh"], [], [], [], [], [], [], [], ["en"]]


def test_held_out_accuracy(spark, model):
    """Documents that the model wasn't fitted on, whose script or function words show their language."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text is not null").collect()
    sure = [(r["text"], language.label_language(r["lang"])) for r in rows]
    sure = [(t, k) for t, k in sure if k in language.LANGS]
    hits = [[x for x, _ in s] == [k] for s, (_, k) in zip(language.stretches(model, [t for t, _ in sure]), sure, strict=True)]
    assert np.mean(hits) > 0.85  # about a tenth of the labels are wrong, or the texts mixed


def test_relabelled(spark, model):
    rows = [(1, KO, "ko"), (2, KO, "ko-KR"), (3, KO, "Korean"), (4, KO, None), (5, KO, "en"), (6, f"{KO} {EN}", "ko"), (7, "123", None), (8, EN, "und"), (8, EN, "und"), (None, EN, "fr"), (9, None, "ko"), (10, "", None)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "0 as label", "1 as seg_no", "2 as confidence")
    got = sorted(str((r["doc_id"], r["seg_no"], r["lang"])) for r in language.relabelled(df, model).collect())
    assert got == sorted(map(str, [(4, 1, "ko"), (5, 1, "ko"), (6, 1, "ko"), (6, 2, "en"), (8, 1, "en"), (8, 1, "en"), (None, 1, "en")]))
    assert language.languages(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("label", "want"), [("KO", "ko"), ("kor", "ko"), ("en_GB", "en"), ("German", "de"), ("zh-Hans", "zh"), ("spa", "es"), ("jpn", "ja"), ("und", None), ("-", None), (" ", None), (None, None), ("unknown", None), ("fr", "?")])
def test_labels(label, want):
    assert language.label_language(label) == want


def test_sentences_in_capitals_are_read():
    assert language.sentences("PICK THE BEST ANSWER. WHEN THE LOADER OF TB_ORDER STOPS, CALL getOrderId.") == ["pick the best answer.", "when the loader of   stops, call  ."]
    assert language.sentences("BITTE NICHT LÖSCHEN!") == ["bitte nicht löschen!"]
    # abbreviations that stand alone or in another sentence
    assert language.sentences("API, DB, URL. HTTP API.") == [] and language.sentences("The HTTP API URL changed.") == ["The       changed."]
    assert language.sentences("SELECT ORDER_ID FROM TB_ORDER WHERE ID = 1") == []
