"""Problem 5: how often every distinct term occurs, and in how many records."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylane.session import cut

#: Rows, at most, in which heavy terms are looked for; and terms, at most, that are counted in local arrays. Both
#: only decide which way a term is counted, never whether.
DETECT_ROWS, HEAVY_TERMS = 200_000, 4096
#: Share of the detection rows from which a term is heavy.
HEAVY_SHARE = 0.001


def term_key(term: str | None) -> str | None:
    """The term in composed form, without blanks at its ends, in upper case; None if nothing is left."""
    if term is None:
        return None
    return unicodedata.normalize("NFC", term).strip().upper() or None


@F.pandas_udf(T.StringType())
def keys(terms: pd.Series) -> pd.Series:
    """The terms' keys; each distinct term of a batch is worked on once."""
    return terms.map({t: term_key(t) for t in terms.unique()})


def heavy_terms(records: DataFrame) -> list[tuple[str, str]]:
    """The terms that are frequent in a bounded sample of records, the most frequent first."""
    part = records.limit(DETECT_ROWS).select("src_field", F.explode("terms").alias("term")).select("src_field", keys("term").alias("term")).filter("term is not null").groupBy("src_field", "term").count()
    top = part.filter(F.col("count") >= DETECT_ROWS * HEAVY_SHARE / 4).orderBy(F.desc("count"), "src_field", "term").limit(HEAVY_TERMS)
    return [(r["src_field"], r["term"]) for r in top.collect()]


#: What the pass over the records gives: kind h (a heavy term's numbers in a partition), l (a light term's), m (a light
#: term of a record that may have other rows), r (a record that may have other rows, with its heavy terms), w (whole records).
MARKS = "kind string, src_field string, term string, rec string, n_occ bigint, n_rec bigint, slots array<int>"
_COLUMNS = ["kind", "src_field", "term", "rec", "n_occ", "n_rec", "slots"]


class Counter:
    """The counts of one partition: exact arrays for heavy terms, rows for all else."""

    def __init__(self, heavy: dict[tuple[str, str], int]):
        self.heavy, self.known = heavy, {}
        self.occ, self.rec = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)

    def batch(self, fields: pd.Series, recs: pd.Series, terms: pd.Series, whole: np.ndarray) -> pd.DataFrame:
        """Counts the heavy terms of a batch; the rows of the rest."""
        out: list[tuple] = []
        sizes = np.array([len(t) if t is not None else 0 for t in terms], np.int64)
        flat = [x for t in terms if t is not None for x in t]
        row = np.repeat(np.arange(len(sizes)), sizes)
        raw, texts = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
        named = [self.known.get(t) or self.known.setdefault(t, term_key(t)) for t in texts]
        if len(self.known) > 500_000:
            self.known = {}
        code, names = pd.factorize(np.array([*named, None], object))
        # nulls and blank terms have the code -1
        row, raw = row[raw >= 0], raw[raw >= 0]
        code = code[raw]
        row, code = row[code >= 0], code[code >= 0]
        field, field_names = pd.factorize(fields)
        rec, rec_names = pd.factorize(recs, use_na_sentinel=False)
        k = max(len(names), 1)
        for f, name in enumerate(field_names):
            slot = np.array([self.heavy.get((name, n), -1) for n in names], np.int64)
            for is_whole in (True, False):
                mine = (field[row] == f) & (whole[row] == is_whole)
                if mine.any():
                    # a record is a row, or all rows of one id
                    own = row[mine] if is_whole else rec[row[mine]]
                    pair, n = np.unique(own * k + code[mine], return_counts=True)
                    self.pairs(out, name, is_whole, pair // k, pair % k, n, slot, names, rec_names)
        return pd.DataFrame(out, columns=_COLUMNS)

    def pairs(self, out: list[tuple], field: str, whole: bool, rec: np.ndarray, code: np.ndarray, n: np.ndarray, slot: np.ndarray, names: np.ndarray, recs: pd.Index) -> None:
        """Counts distinct pairs of record and term."""
        at = slot[code]
        hit = at >= 0
        np.add.at(self.occ, at[hit], n[hit])
        if whole:
            np.add.at(self.rec, at[hit], 1)
            occ, held = np.bincount(code[~hit], n[~hit], len(names)), np.bincount(code[~hit], minlength=len(names))
            out += [("l", field, names[c], None, int(occ[c]), int(held[c]), None) for c in np.nonzero(held)[0]]
            out.append(("w", field, None, None, 0, len(np.unique(rec)), None))
            return
        named = lambda r: None if pd.isna(recs[r]) else recs[r]
        out += [("m", field, names[c], named(r), int(x), 1, None) for r, c, x in zip(rec[~hit], code[~hit], n[~hit], strict=True)]
        starts = np.nonzero(np.r_[True, np.diff(rec) > 0])[0]
        for a, b in zip(starts, [*starts[1:], len(rec)], strict=True):
            out.append(("r", field, None, named(rec[a]), 0, 0, at[a:b][hit[a:b]].tolist()))

    def rest(self) -> pd.DataFrame:
        """The heavy terms' numbers."""
        names = list(self.heavy)
        used = np.nonzero(self.occ)[0]
        return pd.DataFrame([("h", *names[i], None, int(self.occ[i]), int(self.rec[i]), None) for i in used], columns=_COLUMNS)


def frequencies(records: DataFrame, rare_below: int = 3, common_share: float = 0.03) -> DataFrame:
    """One row (src_field, term_key, n_occ, n_rec, freq_mark) for each field and distinct term.

    records: src_field, rec, terms (an array), whole (other columns are ignored). Heavy terms, found in a bounded sample,
    are counted in exact arrays local to each partition; only the remaining terms are shuffled, and the two count tables
    are united. A whole record is a row: nothing of it is shuffled but light terms, pre-aggregated. Of records that may
    have other rows, each row set of a partition sends its heavy terms as one array of slots, for the record counts.
    freq_mark is 'rare' if n_rec is below rare_below, else 'common' if it exceeds common_share of the field's records
    that hold a term, else 'usual'.

    Null and blank terms and null arrays are left out; all rows with a null record are one record, where whole is false,
    and each its own, where it is true. Repeated rows are occurrences; of whole ones each is a record.
    Without terms the result is empty. Terms are the same if their keys are (see term_key).
    """
    own = records.select("src_field", F.col("rec").cast("string").alias("rec"), "terms", "whole").filter("size(terms) > 0")
    shared = records.sparkSession.sparkContext.broadcast({k: i for i, k in enumerate(heavy_terms(own))})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = Counter(shared.value)
        for b in batches:
            yield local.batch(b["src_field"], b["rec"], b["terms"], b["whole"].to_numpy(bool))
        yield local.rest()

    marks = cut(own.mapInPandas(count, MARKS))
    sums = [F.sum("n_occ").alias("n_occ"), F.sum("n_rec").alias("n_rec")]
    slots = records.sparkSession.createDataFrame([(i, f, t) for (f, t), i in shared.value.items()], "slot int, src_field string, term string")
    each = marks.filter("kind = 'r'").groupBy("src_field", "rec").agg(F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    # one row for each heavy term of a record, and one of no slot for the record itself
    parted = cut(each.select("src_field", F.explode(F.array_append("slots", F.lit(-1))).alias("slot")).groupBy("src_field", "slot").agg(F.count("*").alias("n_rec")))
    held = parted.join(F.broadcast(slots.drop("src_field")), "slot").select("src_field", "term", F.lit(0).cast("bigint").alias("n_occ"), "n_rec")
    heavy = marks.filter("kind = 'h'").select("src_field", "term", "n_occ", "n_rec").unionByName(held).groupBy("src_field", "term").agg(*sums)
    by_record = marks.filter("kind = 'm'").groupBy("src_field", "term", "rec").agg(F.sum("n_occ").alias("n_occ")).select("src_field", "term", "n_occ", F.lit(1).cast("bigint").alias("n_rec"))
    light = marks.filter("kind = 'l'").select("src_field", "term", "n_occ", "n_rec").unionByName(by_record).groupBy("src_field", "term").agg(*sums)
    holding = marks.filter("kind = 'w'").select("src_field", "n_rec").unionByName(parted.filter("slot = -1").select("src_field", "n_rec")).groupBy("src_field").agg(F.sum("n_rec").alias("records"))
    return heavy.unionByName(light).join(F.broadcast(holding), "src_field").select(
        "src_field",
        F.col("term").alias("term_key"),
        "n_occ",
        "n_rec",
        F.when(F.col("n_rec") < rare_below, "rare").when(F.col("n_rec") > common_share * F.col("records"), "common").otherwise("usual").alias("freq_mark"),
    )
