"""Problem 4: text that was decoded with the wrong character encoding."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of the hashed pair counts; single characters have 2^16 of their own. This bounds the model's size.
PAIRS, SINGLES = 1 << 18, 1 << 16
#: The histogram of gains on which the margin is validated: nats of a bin, and the bin of all higher gains.
STEP, TOP = 1 / 16, 1 << 14


def _table(codec: str) -> dict[int, int]:
    """Each character that codec makes of one byte, with that byte; bytes without a character stand for themselves."""
    out = {b: b for b in range(256)} if codec == "cp1252" else {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            pass
    return out | {b: b for b in range(128)}


#: Codecs of one byte by name. cp1252 also stands for latin-1, which maps its undefined bytes.
BYTES = {c: _table(c) for c in ("cp1252", "mac_roman", "cp437", "cp850")}
#: What cp1252 shows for each byte.
SHOWN = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)}
WIDE = ("cp949", "gb18030", "cp932", "big5")
#: What a text was read as, and what it really was. The first of them may have happened several times over.
TWICE = [(w, "utf-8") for w in BYTES]
CHAINS = [*TWICE, *((w, "utf-8") for w in WIDE), *((w, "cp949") for w in BYTES), ("cp932", "cp949"), ("gb18030", "cp949")]
#: Nothing but what any of these encodings leaves alone.
ASCII = re.compile(r"^[\x00-\x7f]*$")
LOST = re.compile("[�-]|[?¿]{2}|\\w\\?\\w|¿(?!\\w[^?]*\\?)")
#: A word of which nothing over 127 but the mark for a lost character is left; in Spanish, the mark opens a question.
GONE = re.compile(r"^[\x00-\x7f]*¿[\x00-\x7f¿]*$")
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ue000-\uf8ff]")
#: A question as Spanish writes it.
QUESTION = re.compile(r"(?:^|\s)¿\w[^¿]*\?")
HANGUL = re.compile("^[가-힣]+$")
#: Characters that a one-byte decoding makes of bytes over 127 and that hardly occur side by side in any text.
RUINED = re.compile("[\x80-\xbf‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸÀ-ÿ]{2}")
FOREIGN = re.compile("[\x80-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]+")


def _bytes(text: str, codec: str) -> bytes | None:
    if codec in BYTES:
        try:
            return bytes(map(BYTES[codec].__getitem__, map(ord, text)))
        except KeyError:
            return None
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        return None


def readings(word: str, depth: int = 3) -> set[str]:
    """What word may have been before up to depth wrong decodings; without word itself. Only a reading without
    control characters and private ones is one, but others are steps on the way."""
    out: set[str] = set()
    new, chains = {word}, CHAINS
    for _ in range(depth):
        found = set()
        for w in new:
            for wrong, right in chains:
                if (raw := _bytes(w, wrong)) is not None:
                    try:
                        x = raw.decode(right)
                    except UnicodeDecodeError:
                        continue
                    if x != w and x not in out:
                        found.add(x)
        out |= found
        # what was read as UTF-8 may itself have been read wrongly before
        new, chains = {x for x in found if not ASCII.match(x)}, [*TWICE, ("cp1252", "cp949")]
        if not new:
            break
    return {x for x in out if x != word and not UNFIT.search(x)}


def suspect(word: str) -> bool:
    """Whether word has a reading that is valid UTF-8, or Hangul bytes, or has lost a character."""
    if LOST.search(word):
        return True
    if len(word) == 1:
        return False
    for wrong, right in CHAINS:
        if right == "utf-8" or wrong == "cp1252" and right == "cp949":
            if (raw := _bytes(word, wrong)) is not None:
                try:
                    x = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if x != word and (right == "utf-8" or all(c.isascii() or HANGUL.match(c) for c in x)):
                    return True
    return False


def clean(text: str) -> bool:
    return bool(ASCII.match(text)) and not LOST.search(text) or not any(suspect(w) for w in text.split(" ") if not ASCII.match(w)) and not LOST.search(text)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)


def pair_bins(c: np.ndarray) -> np.ndarray:
    return (c[:-1] * 65599 + c[1:]) * 2654435761 % (1 << 40) >> 22


class Model:
    """Character pairs, smoothed with single characters, both with counts over all clean records."""

    def __init__(self, singles: np.ndarray, pairs: np.ndarray, weight: float = 4.0):
        self.one = np.log((singles + 0.02) / (singles.sum() + 0.02 * SINGLES))
        self.singles, self.pairs, self.weight = singles, pairs, weight

    def score(self, text: str) -> float:
        """The log likelihood of text."""
        c = codes(text)
        seen = self.pairs[pair_bins(c)]
        p1 = np.exp(self.one[c[1:]])
        return float(np.log((seen + self.weight * p1) / (self.singles[c[:-1]] + self.weight)).sum())


#: What a syllable outside the 2350 of the Korean standard set costs, in nats: under one in ten thousand is one, but
#: readings by chance are full of them.
RARE = 10.0


def rare(text: str) -> int:
    """Hangul syllables of text that the standard set lacks."""
    # the codec writes the others as a sequence of their letters
    return sum("가" <= c <= "힣" and len(c.encode("euc_kr")) > 2 for c in text)


class Restorer:
    def __init__(self, model: Model, margin: float):
        self.model, self.margin, self.known = model, margin, {}

    def word(self, word: str) -> str | None:
        """The original of word, itself if it is sound, None if it can't be had."""
        if ASCII.match(word) and "?" not in word:
            return word
        if word in self.known:
            return self.known[word]
        got = self._word(word)
        if len(self.known) < 300_000:
            self.known[word] = got
        return got

    def _word(self, word: str) -> str | None:
        if LOST.search(word) and GONE.match(word):
            return None
        best, gain = self.best(word)
        if best is not None and gain > self.margin:
            return None if LOST.search(best) else best
        if LOST.search(word):
            return None
        # a part of the word may be garbled
        parts = FOREIGN.split(word)
        if len(parts) > 1 and any(not ASCII.match(p) for p in parts):
            out, at = [], 0
            for m in FOREIGN.finditer(word):
                best, gain = self.best(m[0])
                out += [word[at : m.start()], best if best is not None and gain > self.margin else m[0]]
                at = m.end()
            new = "".join(out) + word[at:]
            if new != word:
                return new
        if RUINED.search(word) and self.model.score(word) < -7.5 * (len(word) + 1):
            return None
        return word

    def best(self, word: str) -> tuple[str | None, float]:
        options = readings(word)
        if not options:
            return None, 0.0
        score, text = max((self.model.score(x) - RARE * rare(x), x) for x in options)
        return text, score - self.model.score(word)

    def value(self, text: str) -> str | None:
        """The restored value, '' if it is lost, None if text is sound."""
        if ASCII.match(text) and not LOST.search(text):
            return None
        words = [self.word(w) for w in text.split(" ")]
        if None in words and QUESTION.search(text):
            words = [w[:1] + x if w[:1] == "¿" and (x := self.word(w[1:])) is not None else self.word(w) for w in text.split(" ")]
        if None in words:
            return ""
        new = " ".join(words)
        return None if new == text else new


def count(values: DataFrame) -> DataFrame:
    """Counts of single characters and of pairs over all clean values: bin, n. Bins below 2^16 are single characters."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SINGLES + PAIRS)
        for b in batches:
            for v, n in b["value"].value_counts().items():
                if clean(v):
                    c = codes(v)
                    np.add.at(total, c, n)
                    np.add.at(total, SINGLES + pair_bins(c), n)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"bin": at, "n": total[at]})

    return values.select("value").mapInPandas(tally, "bin bigint, n double").groupBy("bin").agg(F.sum("n").alias("n"))


def train(values: DataFrame) -> Model:
    """The model over all clean values; what comes to the driver is bounded by the bins."""
    total = np.zeros(SINGLES + PAIRS)
    rows = count(values).toPandas()
    total[rows["bin"].to_numpy(np.int64)] = rows["n"]
    return Model(total[:SINGLES], total[SINGLES:])


def word_gains(judge: Restorer, words: set[str]) -> Counter:
    """How many gains fall into each bin, (true, bin): of false readings of clean words, and of true readings of the same
    words garbled. A bin holds gains above the one before it; those below 0 are in the first."""
    out: Counter = Counter()

    def add(true: bool, gain: float) -> None:
        out[true, min(max(math.ceil(gain / STEP), 0), TOP)] += 1

    for w in words:
        best, gain = judge.best(w)
        if best is not None:
            add(False, gain)
        for wrong, right in (("cp1252", "utf-8"), ("cp1252", "cp949")):
            try:
                bad = "".join(map(SHOWN.__getitem__, w.encode(right)))
            except UnicodeEncodeError:
                continue
            best, gain = judge.best(bad)
            if best == w:
                add(True, gain)
    return out


def clean_words(values: Iterable[str]) -> set[str]:
    """The words of clean values that aren't ASCII."""
    return {w for v in values if clean(v) for w in v.split(" ") if not ASCII.match(w)}


def best_margin(gains: dict[tuple[bool, int], int]) -> float:
    """The smallest margin of those that decide the fewest gains wrongly."""
    false, true = np.zeros(TOP + 1, np.int64), np.zeros(TOP + 1, np.int64)
    for (is_true, at), n in gains.items():
        (true if is_true else false)[at] += n
    # margins lie on bins' ends, so that the counts are exact: what is in a bin up to m's doesn't exceed m
    tried = sorted({1.0, 2.0, *(float(k * STEP + 0.5) for k in np.nonzero(false[:TOP])[0] if k * STEP > 1)})
    up_to = lambda c, m: c[: min(int(m / STEP), TOP - 1) + 1].sum()
    return min(tried, key=lambda m: (false.sum() - up_to(false, m) + up_to(true, m), m))


def validated_margin(model: Model, sample: list[str]) -> float:
    """The margin between the gains of false readings of clean words and of true readings of the same words garbled."""
    return best_margin(word_gains(Restorer(model, 0.0), clean_words(sample)))


def all_gains(values: DataFrame, model: Model) -> dict[tuple[bool, int], int]:
    """word_gains over the distinct words of all clean values; at most two histograms come to the driver."""
    shared = values.sparkSession.sparkContext.broadcast((model.singles, model.pairs))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": sorted(clean_words(b["value"]))}, dtype=object)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Restorer(Model(*shared.value), 0.0)
        total: Counter = Counter()
        for b in batches:
            total += word_gains(judge, set(b["word"]))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["true", "at", "n"])

    each = values.select("value").filter("value rlike '[^\\\\x00-\\\\x7f]'").distinct().mapInPandas(words, "word string").distinct()
    rows = each.mapInPandas(tally, "true boolean, at int, n bigint").groupBy("true", "at").agg(F.sum("n").alias("n")).collect()
    return {(r["true"], r["at"]): r["n"] for r in rows}


def restore(values: DataFrame) -> DataFrame:
    """One row (src_field, row_id, restored) for each value that is garbled in full or in part.

    values: src_field, row_id, value (other columns are ignored). A character model is trained on all clean values;
    of each word, every chain of up to three wrong decodings is undone, and the likeliest reading counts if it beats
    the word as it stands by a margin, which is validated on the distinct words of all clean values.

    restored is '' if any character is lost: replacement marks, or bytes that no chain explains. Null and blank
    values, and sound ones, give no row; repeated rows each give one, a null row_id stays null. Where no value is clean, all characters are
    as likely, and the fewest characters win. Without rows the result is empty. Nothing but the model's
    bins, distinct values, their words and histograms is shuffled.
    """
    values = values.select("src_field", F.col("row_id").cast("string").alias("row_id"), "value").filter(F.length(F.trim("value")) > 0)
    sc = values.sparkSession.sparkContext
    model = train(values)
    margin = best_margin(all_gains(values, model))
    shared = sc.broadcast((model.singles, model.pairs, margin))

    def undo(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        singles, pairs, most = shared.value
        judge = Restorer(Model(singles, pairs), most)
        for b in batches:
            unique = {v: judge.value(v) for v in b["value"].unique()}
            b = b.assign(restored=b["value"].map(unique))
            yield b[b["restored"].notna()][["src_field", "row_id", "restored"]]

    return values.mapInPandas(undo, "src_field string, row_id string, restored string").withColumn("row_id", F.col("row_id").cast("bigint"))
