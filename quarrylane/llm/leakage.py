"""Problem 7: evaluation items inside training text."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.session import cut

#: Words of a passage, at least, and one in so many of them may be replaced.
WORDS, ONE_IN = 12, 10
#: Any such passage holds so many words in a row unchanged: of 12 words with one replaced, 6; longer ones hold no fewer.
SEED = 6
#: A template window needs so many words that aren't placeholders.
LITERALS = 3

# Marks that may open a line without belonging to the text.
LINE_MARK = re.compile(r"^[ \t]*(?:(?:[>|*#•+~=‣▪–—-]|//|--|;;)+[ \t]*|\(?\d{1,2}[.)][ \t]+)+", re.M)
NOT_WORD = re.compile(r"[^\w\s]|_")
NUMBER = re.compile(r"^\d+")
CODE = re.compile(r"\d")
#: A word is a unit, and no literal word, if it follows a number in this share of its places in items.
UNIT_SHARE = 0.5


def words(text: str) -> list[str]:
    """The words of text in lower case, without punctuation, line marks and blanks of any kind."""
    text = LINE_MARK.sub("", unicodedata.normalize("NFC", text).replace("​", "").replace("﻿", ""))
    return NOT_WORD.sub("", text.lower()).split()


def few_items(n: int) -> int:
    """Of n items, how many may hold a word that is a name: a fiftieth, two at least."""
    return max(2, n // 50)


def occurrences(text: str) -> dict[str, tuple[int, int]]:
    """Each word of text that is no number or code: how often it occurs, and how often behind a number."""
    out: dict[str, tuple[int, int]] = {}
    before = ""
    for w in words(text):
        if not CODE.search(w):
            n, behind = out.get(w, (0, 0))
            out[w] = (n + 1, behind + bool(NUMBER.match(before)))
        before = w
    return out


class Kinds(dict):
    """Each word's id, 0 if no item holds it, and its type, in one number; unknown words are looked at when they come."""

    def __init__(self, items: "Items"):
        super().__init__()
        self.items = items

    def __missing__(self, w: str) -> int:
        got = self.items.ids.get(w, 0) << 32 | self.items.type_id(w)
        if len(self) < 500_000:
            self[w] = got
        return got


class Items:
    """Evaluation items, ready to be looked for.

    literal: the words that are neither names nor units, of all items, those of other blocks too; numbers and codes have
    placeholders of their own. A window is kept as a template, or, if it has fewer than LITERALS literal words, as it
    stands.
    """

    def __init__(self, items: list[tuple[int, str]], literal: set[str] | None = None):
        self.items = [(i, words(t)) for i, t in items]
        held = {w for _, ws in self.items for w in ws}
        if literal is None:
            seen = [occurrences(t) for _, t in items]
            counts = {w: [sum(x) for x in zip(*((1, *o[w]) for o in seen if w in o), strict=True)] for w in {w for o in seen for w in o}}
            literal = {w for w, (n, occ, behind) in counts.items() if n > few_items(len(items)) and behind < UNIT_SHARE * occ}
        self.literal = literal
        self.ids = {w: k for k, w in enumerate(sorted(held | self.literal), 4)}
        self.own = [np.array([self.ids[w] for w in ws], np.int64) for _, ws in self.items]
        self.typed = [np.array([self.type_id(w) for w in ws], np.int64) for _, ws in self.items]
        self.kinds = Kinds(self)
        exact, template = defaultdict(list), defaultdict(list)
        for k, (own, typed) in enumerate(zip(self.own, self.typed, strict=True)):
            literal = np.convolve(typed > 3, np.ones(SEED), "valid") if len(typed) >= SEED else []
            for at, (h, t) in enumerate(zip(window_hashes(own, SEED), window_hashes(typed, SEED), strict=True)):
                if literal[at] >= LITERALS:
                    template[int(t)].append((k, at))
                else:
                    exact[int(h)].append((k, at))
        self.exact, self.template = exact, template
        self.exact_keys = np.array(sorted(exact), np.int64)
        self.template_keys = np.array(sorted(template), np.int64)

    def type_id(self, w: str) -> int:
        """1 for a number, with or without a unit, 2 for a code, 3 for a name or unit, else the word's own id."""
        if w in self.literal:
            return self.ids[w]
        if NUMBER.match(w):
            return 1
        return 2 if CODE.search(w) else 3


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of ids; -1 for one that holds an id 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h, zero = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(size):
        part = ids[k : k + n]
        zero |= part == 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    out = (h >> np.uint64(1)).astype(np.int64)
    out[zero] = -1
    return out


def among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where h holds one of the sorted keys."""
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.nonzero(keys[at] == h)[0]


def passage(same: np.ndarray, least: int = WORDS, one_in: int = ONE_IN) -> tuple[int, int] | None:
    """The first longest run (start, length) of at least `least` words with at most one in one_in of them different,
    whose first and last words are the same; None if there is none."""
    # of a passage as short as may be, all words but those that may be replaced are the same
    if np.count_nonzero(same) < least - least // one_in:
        return None
    off = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    best = None
    for k in range(len(off) - 1):
        if k and k * one_in > len(same):
            break
        start, end = off[: len(off) - 1 - k] + 1, off[k + 1 :]
        length = end - start
        # a different word at either end doesn't belong to the run
        sound = (off[1 : len(off) - k] != start) & (off[k : len(off) - 1] != end - 1) if k else length > 0
        good = np.nonzero(sound & (length >= max(least, k * one_in)))[0]
        if len(good) and (best is None or length[good].max() > best[1]):
            i = good[length[good].argmax()]
            best = (int(start[i]), int(length[i]))
    return best


def consistent(mine: np.ndarray, theirs: list[str], typed: np.ndarray) -> bool:
    """Whether the slots of a passage are filled consistently: one value of the item, one value of the document, and
    the other way round."""
    to: dict[int, str] = {}
    back: dict[str, int] = {}
    for a, b, t in zip(mine.tolist(), theirs, typed.tolist(), strict=True):
        if t <= 3 and (to.setdefault(a, b) != b or back.setdefault(b, a) != a):
            return False
    return True


def find(doc: list[str], own: np.ndarray, typed: np.ndarray, items: Items, hits: list[tuple[int, int, int]], verbatim_only: bool = False) -> list[tuple[int, str, int, int]]:
    """Of a document's window hits (place, item, place in the item): (item, kind, first word, words).

    A diagonal whose windows all fill their slots inconsistently holds no verbatim passage, which has SEED words in a row
    unchanged."""
    diagonals: dict[tuple[int, int], bool] = {}
    for at, k, j in hits:
        if not diagonals.get((k, at - j)):
            diagonals[k, at - j] = consistent(items.own[k][j : j + SEED], doc[at : at + SEED], items.typed[k][j : j + SEED])
    found: dict[tuple[int, str], tuple[int, int]] = {}
    for (k, shift), sound in diagonals.items():
        low, high = max(0, -shift), min(len(items.own[k]), len(doc) - shift)
        mine, theirs = items.own[k][low:high], own[low + shift : high + shift]
        kind = "verbatim"
        got = passage(mine == theirs) if sound else None
        if got is None and not verbatim_only:
            kind, got = "reparameterised", passage(items.typed[k][low:high] == typed[low + shift : high + shift])
            if got is not None:
                a, b = low + got[0], low + got[0] + got[1]
                if not consistent(items.own[k][a:b], doc[a + shift : b + shift], items.typed[k][a:b]):
                    got = None
        if got is not None:
            was = found.get((k, kind))
            if was is None or (-got[1], got[0] + low + shift) < (-was[1], was[0]):
                found[k, kind] = (got[0] + low + shift, got[1])
    return [(items.items[k][0], kind, a, n) for (k, kind), (a, n) in found.items() if kind == "verbatim" or (k, "verbatim") not in found]


def literal_words(items: DataFrame) -> set[str]:
    """The words of more than few_items of all items that aren't numbers, codes or units: at most fifty times as many as an
    item has on average, or, of up to 150 items, a third of all their words."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # the row of no word counts the items
            out = [(w, *n) for t in b["text"] for w, n in [("", (0, 0)), *occurrences(t).items()]]
            yield pd.DataFrame(out, columns=["word", "occ", "behind"])

    own = items.filter("text is not null and item_id is not null").select("text")
    held = cut(own.mapInPandas(each, "word string, occ bigint, behind bigint").groupBy("word").agg(F.count("*").alias("n"), F.sum("occ").alias("occ"), F.sum("behind").alias("behind")))
    total = held.filter("word = ''").collect()
    if not total:
        return set()
    often = held.filter("word <> ''").filter(F.col("n") > few_items(total[0]["n"])).filter(F.col("behind") < UNIT_SHARE * F.col("occ"))
    return {r["word"] for r in often.select("word").collect()}


def item_blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    rows: list[tuple[int, str]] = []
    for r in items.select("item_id", "text").filter("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        if len(rows) == block:
            yield rows
            rows = []
    if rows:
        yield rows


def leaks(documents: DataFrame, items: DataFrame, block: int = 5000, verbatim_only: bool = False) -> DataFrame:
    """One row (doc_id, item_id, kind, first_word, n_words) for each document and item whose passages meet.

    Numbers, codes, names and units become typed placeholders; windows of SEED words are hashed and joined with those of
    the items, as templates, or, those with fewer than LITERALS literal words, as they stand; what meets, and fills the
    slots of a window consistently, is aligned word by word. kind is 'verbatim' where at least
    WORDS words in a row stand in the text with at most one in ONE_IN replaced, and 'reparameterised' where only the
    template does and each slot is filled consistently; verbatim_only leaves these out. first_word and n_words give the longest such passage, of
    equal ones the first.

    Null, empty and too short texts and items, and items without an id, give no row; a null doc_id stays null. Repeated documents each give their rows; of items with the
    same id, each counts. Very long texts are read whole. Without items or documents the result is empty. The items
    are handed to all executors in blocks of bounded size, each of which is looked for in all documents. Which words
    are names is counted once over all items, so that blocks don't matter; nothing but these counts is shuffled.
    """
    documents = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("text is not null")
    schema = "doc_id string, item_id bigint, kind string, first_word int, n_words int"
    found: DataFrame | None = None
    literal = literal_words(items)
    for rows in item_blocks(items, block):
        shared = documents.sparkSession.sparkContext.broadcast((rows, literal))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            wanted = Items(*shared.value)
            for b in batches:
                out = []
                for at in range(0, len(b), 256):
                    part = b.iloc[at : at + 256]
                    out += in_batch(part["doc_id"].tolist(), part["text"].tolist(), wanted, verbatim_only)
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "first_word", "n_words"])

        one = documents.mapInPandas(search, schema)
        found = one if found is None else found.unionByName(one)
    found = found if found is not None else documents.sparkSession.createDataFrame([], schema)
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def in_batch(keys: list[int], texts: list[str], items: Items, verbatim_only: bool = False) -> list[tuple]:
    """The rows of some documents; their windows are hashed at once."""
    docs = [words(t) for t in texts]
    gap = [""] * SEED
    items.kinds[""] = 0
    both = np.fromiter(map(items.kinds.__getitem__, itertools.chain.from_iterable(itertools.chain(d, gap) for d in docs)), np.int64, sum(len(d) + SEED for d in docs))
    kinds = np.stack([both >> 32, both & 0xFFFFFFFF], axis=1)
    start = np.cumsum([0] + [len(d) + SEED for d in docs])
    hits = defaultdict(list)
    for column, keyed, table in ((0, items.exact_keys, items.exact), (1, items.template_keys, items.template)):
        h = window_hashes(kinds[:, column], SEED)
        for at in among(h, keyed):
            d = int(np.searchsorted(start, at, "right")) - 1
            hits[d] += [(int(at - start[d]), k, j) for k, j in table[int(h[at])]]
    out = []
    for d, h in hits.items():
        part = kinds[start[d] : start[d] + len(docs[d])]
        out += [(keys[d], *x) for x in find(docs[d], part[:, 0], part[:, 1], items, h, verbatim_only)]
    return out
