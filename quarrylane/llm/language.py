"""Problem 8: the language of every document and of each stretch of it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

LANGS = ("ko", "en", "ja", "zh", "de", "es")
#: Labelled rows of each language on which the model is fitted, and rows at most.
TRAIN_ROWS, TRAIN_MOST = 700, 6000
#: Hashed features; characters of a feature, at most.
BITS, ORDER = 17, 3
#: Letters that a piece of text needs to speak for a language, and from which it speaks with full weight.
FEWEST, FULL = 4, 24
#: The lowest temperature.
COOLEST = 0.7
#: What a change of language must gain, in nats.
SWITCH = 2.0

# Writings of the languages' names and codes, in lower case and without region.
NAMES = {
    "ko": "ko kor korean 한국어 한국말 korea kr hangul",
    "en": "en eng english 영어 englisch inglés ingles",
    "ja": "ja jpn jp japanese 日本語 일본어 japanisch japonés",
    "zh": "zh zho chi cmn cn chinese mandarin 中文 汉语 漢語 중국어 chinesisch chino",
    "de": "de deu ger german deutsch 독일어 alemán",
    "es": "es spa esp spanish español espanol castellano castilian 스페인어 spanisch",
}
CODE_OF = {w: k for k, ws in NAMES.items() for w in ws.split()}

CODE_BLOCK = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|<(pre|code)\b[^>]*>.*?(?:</\1>|\Z)|`[^`\n]*`", re.S | re.I)
TAG = re.compile(r"</?\w+[^<>\n]*>")
SQL_LINE = re.compile(r"^[ \t]*(?:SELECT|INSERT|UPDATE|DELETE|MERGE|FROM|WHERE|JOIN|LEFT|INNER|AND|OR|ORDER BY|GROUP BY|VALUES|SET|CREATE|ALTER|DROP)\b(?=.*(?:[=(_,*]|\bFROM\b|\bINTO\b)).*$", re.M)
CODE_LINE = re.compile(r"^[ \t]*(?:[\w.<>\[\]]+[ \t]+)*[\w.]+[ \t]*(?:\([^()\n]*\)[ \t]*[{;]|=[^=\n]*;|\{)[ \t]*$|^[ \t]*[})\]]+[;,]?[ \t]*$|^[ \t]*(?://|#!|@\w|import |package |public |private |return |function |const |var |let ).*[;{)]$", re.M)
#: Identifiers, codes, addresses and numbers; words in capitals are taken for abbreviations, but in
#: sentences that are written wholly in capitals.
IDENTIFIER = re.compile(r"https?://\S+|\S+@\S+\.\w+|[#$]\{[^}]*\}|\b[A-Za-z]*\d[A-Za-z0-9_-]*|\b\w*_\w*|\b[a-z]+(?:[A-Z][a-z0-9]*)+\w*|\b(?:[A-Z][a-z0-9]+){2,}\b|\b[A-Z]{2,}(?:-\w+)*\b|[A-Za-z]\w*(?:[./:]\w+)+", re.A)
WORD = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")
#: Three words in capitals in a row; in a sentence without lower-case letters they aren't abbreviations that stand alone.
ROW = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ]{2,}[ \t]+[A-ZÀ-ÖØ-Þ]+[ \t]+[A-ZÀ-ÖØ-Þ]{2,}(?!\w)")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？])|\s*\n+\s*|\s+/\s+|\s+\|\s+")
LATIN_RUN = re.compile(r"(?:[A-Za-zÀ-ɏ'’,;:()\"“”-]+[ \t.]+){4,}[A-Za-zÀ-ɏ'’]+[.!?]?")
LETTER = re.compile(r"[^\W\d_]")
NO_LETTERS = re.compile(r"[\W\d_]+")
EAST = re.compile("[ᄀ-ᇿ぀-ヿ㐀-鿿가-힣]")
NOT_EAST = re.compile("[^ᄀ-ᇿ぀-ヿ㐀-鿿가-힣]+")


def label_language(label: str | None) -> str | None:
    """The language that a label names: its code, None if it names none, '?' if it names another one."""
    if label is None:
        return None
    key = label.strip().lower()
    if not re.search(r"[^\W\d_]", key) or key in {"und", "unknown", "none", "null", "n/a", "na", "nan", "xx", "zxx", "mul", "mis", "other", "undefined", "unk", "tbd", "auto"}:
        return None
    return CODE_OF.get(key) or CODE_OF.get(re.split(r"[-_ (]", key)[0], "?")


def without_capitals(text: str) -> str:
    """text, its sentences that are written wholly in capitals, but for identifiers, in lower case."""
    if not ROW.search(text):
        return text
    out, at = [], 0
    for start, end in [*(m.span() for m in SENTENCE.finditer(text)), (len(text), len(text))]:
        s = text[at:start]
        if ROW.search(s) and not EAST.search(s) and not any(map(str.islower, IDENTIFIER.sub(" ", s))):
            s = WORD.sub(lambda m: m[0].lower() if m[0].isupper() else m[0], s)
        out += [s, text[start:end]]
        at = end
    return "".join(out)


def sentences(text: str) -> list[str]:
    """The sentences of text without code and identifiers; those that hold no letters are left out."""
    text = TAG.sub(" ", CODE_BLOCK.sub("\n", text))
    text = CODE_LINE.sub("", SQL_LINE.sub("", text))
    text = IDENTIFIER.sub(" ", without_capitals(text))
    out = []
    for s in SENTENCE.split(text):
        if not s:
            continue
        # a run of Latin words beside an East Asian sentence stands for itself
        if EAST.search(s) and LATIN_RUN.search(s):
            at = 0
            for m in LATIN_RUN.finditer(s):
                out += [s[at : m.start()], m[0]]
                at = m.end()
            out.append(s[at:])
        else:
            out.append(s)
    return [s for s in out if LETTER.search(s)]


def letters(s: str) -> int:
    """Letters of s; an East Asian one counts twice."""
    return len(NO_LETTERS.sub("", s)) + (0 if s.isascii() else len(NOT_EAST.sub("", s)))


class Features:
    """Hashed character n-grams of many sentences at once: feature of each place, and where each sentence starts."""

    def __init__(self, texts: list[str]):
        plain = [NO_LETTERS.sub(" ", t.lower()).strip() for t in texts]
        raw = " ".join(f" {p} " for p in plain)
        sizes = [len(p) + 2 for p in plain]
        c = np.frombuffer(raw.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.starts = np.cumsum([0] + [n + 1 for n in sizes[:-1]]) if texts else np.zeros(0, np.int64)
        self.lengths = np.array(sizes, np.int64)
        self.orders = []
        h = np.zeros(len(c), np.uint64)
        for n in range(ORDER):
            part = np.zeros(len(c), np.uint64)
            part[: len(c) - n] = c[n:]
            h = (h * np.uint64(0x100000001B3) ^ part) * np.uint64(0x9E3779B97F4A7C15)
            self.orders.append((h >> np.uint64(64 - BITS)).astype(np.int64) ^ n)

    def one(self, i: int) -> np.ndarray:
        """All features of sentence i."""
        a, n = self.starts[i], self.lengths[i]
        return np.concatenate([f[a : a + max(n - k, 1)] for k, f in enumerate(self.orders)])

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """For each sentence the mean of its features' weights."""
        if not len(self.lengths):
            return np.zeros((0, weights.shape[1]))
        total = np.zeros((len(self.lengths), weights.shape[1]))
        for k, f in enumerate(self.orders):
            w = np.vstack([np.zeros((1, weights.shape[1])), np.cumsum(weights[f], 0, dtype=np.float64)])
            end = self.starts + np.maximum(self.lengths - k, 1)
            total += w[end] - w[self.starts]
        return total / (self.lengths * ORDER)[:, None]


class Model:
    """Multinomial logistic regression on TF-IDF of character n-grams, with calibrated confidence."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        z = (scored(texts, self.weights) + self.bias) / self.temperature
        z -= z.max(1, keepdims=True, initial=-np.inf) if len(z) else 0
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def scored(texts: list[str], weights: np.ndarray, some: int = 1024) -> np.ndarray:
    """Features.scores of many texts, some at a time, which bounds the memory."""
    return np.vstack([Features(texts[at : at + some]).scores(weights) for at in range(0, len(texts), some)] or [np.zeros((0, weights.shape[1]))])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(texts: list[str], y: np.ndarray, alpha: float = 0.012, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2, rounds: int = 2, scale: float = 20.0, batch: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Weights (scaled by IDF) and bias, by the follow-the-regularised-leader proximal rule with elastic net, a few
    sentences at a time."""
    features, n, k = Features(texts), 1 << BITS, len(LANGS)
    rows = [tuple(a.astype(np.int32) for a in np.unique(features.one(i), return_counts=True)) for i in range(len(texts))]
    lengths = features.lengths
    del features
    df = np.bincount(np.concatenate([f for f, _ in rows]), minlength=n)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    values = [scale * c * idf[f] / (lengths[i] * ORDER) for i, (f, c) in enumerate(rows)]
    z, g2, bias = np.zeros((n, k)), np.zeros((n, k)), np.zeros(k)

    def weights(z: np.ndarray, g2: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g2)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(rounds):
        shuffled = order.permutation(len(texts))
        for at in range(0, len(texts), batch):
            some = shuffled[at : at + batch]
            sizes = [len(values[i]) for i in some]
            f, where = np.unique(np.concatenate([rows[i][0] for i in some]), return_inverse=True)
            x = np.concatenate([values[i] for i in some])
            w = weights(z[f], g2[f])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            p = softmax(np.add.reduceat(x[:, None] * w[where], starts, axis=0) + bias)
            p[np.arange(len(some)), y[some]] -= 1
            part = x[:, None] * np.repeat(p, sizes, axis=0)
            g = np.stack([np.bincount(where, part[:, j], len(f)) for j in range(k)], axis=1)
            new = g2[f] + g * g
            z[f] += g - (np.sqrt(new) - np.sqrt(g2[f])) / alpha * w
            g2[f] = new
            bias -= 0.01 * p.sum(0)
    return (weights(z, g2) * scale * idf[:, None]).astype(np.float32), bias


def calibrate(weights: np.ndarray, bias: np.ndarray, texts: list[str], y: np.ndarray) -> float:
    """The temperature under which held-out sentences are the likeliest. Those that agree with their labels can't tell how
    wrong others may be, so it isn't below COOLEST."""
    z = scored(texts, weights) + bias
    best = (np.inf, 1.0)
    for t in np.geomspace(COOLEST, 5, 25):
        p = softmax(z / t)
        best = min(best, (float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-9)).mean()), float(t)))
    return best[1]


def train(labelled: list[tuple[str, str]]) -> Model:
    """The model from (text, language) pairs. Some labels are wrong and some texts mixed: after a first fit, sentences
    that it gives another language are left out of the second. A tenth of the others is held out for the temperature."""
    texts, y = [], []
    for text, lang in labelled:
        for s in sentences(text):
            if letters(s) >= FEWEST:
                texts.append(s)
                y.append(LANGS.index(lang))
    if not texts:
        return Model(np.zeros((1 << BITS, len(LANGS)), np.float32), np.zeros(len(LANGS)), 1.0)
    y = np.array(y)
    weights, bias = fit_ftrl(texts, y, rounds=1)
    sound = np.nonzero((scored(texts, weights) + bias).argmax(1) == y)[0]
    held, fit = sound[::10], np.setdiff1d(sound, sound[::10])
    if not len(fit):
        held = fit = sound if len(sound) else np.arange(len(y))
    weights, bias = fit_ftrl([texts[i] for i in fit], y[fit], rounds=1)
    return Model(weights, bias, calibrate(weights, bias, [texts[i] for i in held], y[held]))


def stretches(model: Model, texts: list[str | None]) -> list[list[tuple[str, float]]]:
    """For each text its stretches: language and confidence.

    The likeliest course of languages over the sentences, where each change costs SWITCH; short sentences weigh less.
    The confidence is the weighted mean probability of the language over the stretch's sentences.
    """
    parts = [[(s, n) for s in sentences(t) if (n := letters(s)) >= FEWEST] if t else [] for t in texts]
    flat = [s for p in parts for s, _ in p]
    logp = np.maximum(model.log_probabilities(flat), -12.0) if flat else np.zeros((0, len(LANGS)))
    weight = np.minimum(np.array([n for p in parts for _, n in p], float) / FULL, 1.0)
    out, at = [], 0
    for p in parts:
        e, w = logp[at : at + len(p)], weight[at : at + len(p)]
        at += len(p)
        if not len(p):
            out.append([])
            continue
        score, back = e[0] * w[0], []
        for i in range(1, len(p)):
            stay, move = score, score.max() - SWITCH
            back.append(np.where(stay >= move, np.arange(len(LANGS)), int(score.argmax())))
            score = np.maximum(stay, move) + e[i] * w[i]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        runs: list[list] = []
        for i, k in enumerate(path):
            if not runs or runs[-1][0] != k:
                runs.append([k, 0.0, 0.0])
            runs[-1][1] += float(np.exp(e[i, k]) * w[i])
            runs[-1][2] += float(w[i])
        out.append([(LANGS[k], a / b if b else 0.0) for k, a, b in runs])
    return out


@F.pandas_udf(T.StringType())
def named(labels: pd.Series) -> pd.Series:
    """label_language of each label; each distinct one of a batch is read once."""
    return labels.map({x: label_language(x) for x in labels.unique()})


def labelled_sample(documents: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_MOST) -> list[tuple[str, str]]:
    """Of each language `rows` labelled texts, `most` at most in all: those of the smallest hashes of key and text, however
    their labels are written."""
    rows = min(rows, most // len(LANGS))
    own = documents.filter("length(text) >= 40 and lang is not null").select("doc_id", "text", named("lang").alias("label")).filter(F.col("label").isin(*LANGS))
    counts = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    # more than enough of them, so that only few are ranked
    share = F.coalesce(*[F.when(F.col("label") == c, F.lit(min(1.0, (1.5 * rows + 100) / n))) for c, n in counts.items()], F.lit(0.0))
    near = own.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))).filter(F.col("h") < share * (1 << 40))
    order = W.Window.partitionBy("label").orderBy("h", "doc_id", "text")
    picked = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows).select("text", "label")
    return [(r[0], r[1]) for r in sorted(picked.collect())]


def languages(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row (doc_id, label, seg_no, lang, confidence, n_stretches) for each language stretch of each document.

    documents: doc_id, text, lang (other columns are ignored). The model is fitted on a bounded sample of labelled
    rows. label is what the document's own label names: a code, null if it is missing, '?' for a language not known
    here. Code, identifiers and single foreign terms are of no language; a text with nothing else gives no row.

    Null, empty and blank texts give no row; a null doc_id stays null; repeated rows each give their rows; very long texts are read whole.
    Of equally likely languages, the first of LANGS counts. Without labelled rows all languages are as likely.
    Nothing but the labels' counts is shuffled.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter("text is not null")
    keyed = documents.withColumn("doc_id", F.col("doc_id").cast("string"))
    model = model or train(labelled_sample(documents))
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.temperature))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for b in batches:
            out = []
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                for key, label, found in zip(part["doc_id"], part["lang"], stretches(own, part["text"].tolist()), strict=True):
                    out += [(key, label_language(label), i, lang, c, len(found)) for i, (lang, c) in enumerate(found, 1)]
            yield pd.DataFrame(out, columns=["doc_id", "label", "seg_no", "lang", "confidence", "n_stretches"])

    found = keyed.mapInPandas(work, "doc_id string, label string, seg_no int, lang string, confidence double, n_stretches int")
    return found.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def relabelled(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The stretches of those documents whose label is missing or wrong, or whose text is in several languages."""
    return languages(documents, model).filter("n_stretches > 1 or label is null or label <> lang")
