"""Problem 6: a whole corpus encoded with a public byte-level BPE vocabulary."""

from __future__ import annotations

import functools
import importlib.util
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed value: the public pattern by which byte_bpe_50k splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of up to so many bytes are merged in matrices; longer ones in a row of their own.
LONGEST = 256
#: Cells of a matrix, at most.
CELLS = 1 << 21
#: Pieces that a worker remembers.
REMEMBERED = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The vocabulary's file: in folder, or that of QUARRYLANE_TOKENIZERS, or that of the public package."""
    folder = folder or os.environ.get("QUARRYLANE_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


def byte_symbols() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class PairTable:
    """Pairs of ids with their rank and merged id, in an open-addressing hash table of numpy arrays."""

    def __init__(self, a: np.ndarray, b: np.ndarray, merged: np.ndarray, bits: int = 18):
        while len(a) * 3 > 1 << bits:
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        if len(a) and max(a.max(), b.max(), merged.max()) >= 1 << 31:
            raise ValueError("ids must fit 31 bits")
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, np.iinfo(np.int32).max, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        key = a.astype(np.int64) << 31 | b.astype(np.int64)
        slot, left = self.home(key), np.arange(len(key))
        while len(left):
            free = self.keys[slot[left]] == -1
            # of those that want the same free slot, the last one written gets it
            self.keys[slot[left[free]]] = key[left[free]]
            got = self.keys[slot[left]] == key[left]
            self.rank[slot[left[got]]], self.merged[slot[left[got]]] = left[got], merged[left[got]]
            left = left[~got]
            slot[left] = (slot[left] + 1) & self.mask

    def home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, or that of an unused slot with the highest rank."""
        key = a.astype(np.int64) << 31 | b.astype(np.int64)
        slot = self.home(key)
        out = slot.copy()
        todo = np.nonzero(self.keys[slot] != key)[0]
        # an absent pair walks to the end of its run, which may be longer than any present pair's way
        while len(todo):
            empty = self.keys[out[todo]] == -1
            todo = todo[~empty]
            out[todo] = (out[todo] + 1) & self.mask
            todo = todo[self.keys[out[todo]] != key[todo]]
        return out


class Encoder:
    """Encodes texts by a vocabulary of bytes and ranked merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols = model["vocab"], byte_symbols()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.table = PairTable(*ids.T)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.byte_id[b] = vocab[c]
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def texts(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for None and ''."""
        pieces = [self.split(t) if t else () for t in texts]
        new = {p for ps in pieces for p in ps if p not in self.known}
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {}
                new = {p for ps in pieces for p in ps}
            self.learn(sorted(new, key=len))
        known = self.known
        return [[i for p in ps for i in known[p]] for ps in pieces]

    def learn(self, pieces: list[str]) -> None:
        """Merges new pieces, in matrices of similar lengths."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            n = len(raw[order[at]])
            if n > LONGEST:
                for i in order[at:]:
                    self.known[pieces[i]] = self.long_row(self.byte_id[np.frombuffer(raw[i], np.uint8)])
                return
            # a bucket holds lengths up to a quarter more, and no more rows than fit the cells
            width, end = max(n + n // 4, 4), at
            most = max(1, CELLS // width)
            while end < len(order) and end - at < most and len(raw[order[end]]) <= width:
                end += 1
            bucket = order[at:end]
            for i, ids in zip(bucket, self.matrix([raw[i] for i in bucket]), strict=True):
                self.known[pieces[i]] = ids
            at = end

    def matrix(self, raw: list[bytes]) -> list[list[int]]:
        """Every row merges its leftmost pair of the lowest rank in each round, until none can merge."""
        n = np.array([len(r) for r in raw])
        width = int(n.max())
        filled = np.arange(width) < n[:, None]
        m = np.full((len(raw), width), -1, np.int32)
        m[filled] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        none = np.iinfo(np.int32).max
        slots = np.zeros((len(raw), max(width - 1, 1)), np.int64)
        ranks = np.full((len(raw), max(width - 1, 1)), none, np.int32)
        both = filled[:, 1:]
        if both.any():
            s = self.table.find(m[:, :-1][both], m[:, 1:][both])
            slots[:, : width - 1][both], ranks[:, : width - 1][both] = s, self.table.rank[s]
        out: list[list[int] | None] = [None] * len(raw)
        rows = np.arange(len(raw))
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == none
            if done.any():
                for r, k, line in zip(rows[done], n[done], m[done], strict=True):
                    out[r] = line[:k].tolist()
                keep = ~done
                rows, m, n, slots, ranks, at = rows[keep], m[keep], n[keep], slots[keep], ranks[keep], at[keep]
                if not len(rows):
                    break
                if (w := int(n.max())) < m.shape[1]:
                    m, slots, ranks = m[:, :w].copy(), slots[:, : max(w - 1, 1)].copy(), ranks[:, : max(w - 1, 1)].copy()
            every = np.arange(len(rows))
            m[every, at] = self.table.merged[slots[every, at]]
            # close the gap behind the merged pair
            if m.shape[1] > 1:
                cols = np.arange(m.shape[1] - 1)
                source = cols + (cols > at[:, None])
                m[:, :-1] = np.take_along_axis(m, source, 1)
                pair = np.arange(ranks.shape[1] - 1)
                source = pair + (pair > at[:, None])
                slots[:, :-1] = np.take_along_axis(slots, source, 1)
                ranks[:, :-1] = np.take_along_axis(ranks, source, 1)
            n -= 1
            m[every, n] = -1
            ranks[every, np.maximum(n - 1, 0)] = none
            for side in (-1, 0):
                i = at + side
                ok = (i >= 0) & (i + 1 < n)
                r, c = every[ok], i[ok]
                s = self.table.find(m[r, c], m[r, c + 1])
                slots[r, c], ranks[r, c] = s, self.table.rank[s]
        return out

    def long_row(self, ids: np.ndarray) -> list[int]:
        """A long piece: all places of the lowest rank merge in one round, from left to right, which gives the same
        result, since a merge's product only takes part in later ranks."""
        while len(ids) > 1:
            s = self.table.find(ids[:-1], ids[1:])
            r = self.table.rank[s]
            best = r.min()
            if best == np.iinfo(np.int32).max:
                break
            places = np.nonzero(r == best)[0]
            # of overlapping places, as in a run of one symbol, every second one merges
            first = np.r_[True, np.diff(places) > 1]
            start = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - start) % 2 == 0]
            ids = ids.copy()
            ids[places] = self.table.merged[s[places[0]]]
            ids = np.delete(ids, places + 1)
        return ids.tolist()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", rows: int = 512) -> DataFrame:
    """One row (doc_id, ids) for each document: its text as it stands, by a byte-level BPE vocabulary, without special
    tokens.

    The pieces that the vocabulary's pattern makes of a batch are merged once each, in padded matrices of similar
    lengths: every row merges its leftmost pair of the lowest rank in each round, pairs are looked up in a hash table
    of arrays, and finished rows leave the matrix. A worker remembers pieces, up to a bound.

    Empty and null texts give an empty list; repeated rows each give one; a null key stays null. Very long texts and
    pieces are encoded whole. Without rows the result is empty. Other columns are ignored. Nothing is shuffled.
    path: the vocabulary's file, which each executor reads by itself.
    """
    path = path or vocabulary_path()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for b in batches:
            for at in range(0, len(b), rows):
                part = b.iloc[at : at + rows]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": coder.texts(part["text"].tolist())})

    named = documents.selectExpr(f"cast(`{key}` as string) doc_id", f"`{text}` text")
    return named.mapInPandas(work, "doc_id string, ids array<int>").selectExpr("cast(doc_id as bigint) doc_id", "ids")
