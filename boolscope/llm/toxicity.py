"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, save, scratch, text_of, trimmed

#: Labelled rows that are learned from, about; of more, those with the smallest hashes.
MAX_LABELLED = 20_000
#: A term of the lexicon is in so many toxic texts, and so many times as frequent in them as in others.
MIN_TOXIC, MIN_RATIO, MAX_TERMS = 8, 8.0, 5_000
PREFIXES = range(3, 8)
MIN_CLEAN, MAX_EXCEPTIONS = 5, 5_000

# Letters of other scripts that look like Latin ones, digits and signs that stand for letters, and signs
# without width. l and 1 may stand for i.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i", "|": "i",
}
HIDDEN = "­​‌‍⁠﻿"
TABLE = str.maketrans(LOOKALIKES | dict.fromkeys(HIDDEN))
SIGNS = re.compile(r"[@$!](?=\w)")
SIGN = {"@": "a", "$": "s", "!": "i"}
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, compatibility forms composed, look-alikes, digits and signs before letters as the letters they stand for."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "$" in text or "@" in text or "!" in text:
        text = SIGNS.sub(lambda m: SIGN[m[0]], text)
    return text.translate(TABLE)


class Lexicon:
    """Terms with weights, whole words ("word ") or beginnings of words ("wor"), and phrases that excuse a match."""

    def __init__(self, terms: dict[str, float], exceptions: set[str]):
        self.exceptions, self.found = exceptions, ahocorasick.Automaton()
        for term, weight in terms.items():
            word = term.rstrip(" ")
            whole, start = self.found.get(word, (0.0, 0.0)) if word in self.found else (0.0, 0.0)
            self.found.add_word(word, (max(whole, weight), start) if term.endswith(" ") else (whole, max(start, weight)))
        self.empty = not len(self.found)
        if not self.empty:
            items = list(self.found.items())
            for word, (whole, start) in items:
                self.found.add_word(word, (len(word), whole, start))
            self.found.make_automaton()

    def matches(self, text: str) -> dict[int, float]:
        """Where a word of a folded text matches: the largest weight of a term there."""
        out: dict[int, float] = {}
        if self.empty:
            return out
        for end, (n, whole, start) in self.found.iter(text):
            at = end - n + 1
            if at and text[at - 1].isalnum():
                continue
            weight = max(start, 0.0 if end + 1 < len(text) and text[end + 1].isalnum() else whole)
            if weight > out.get(at, 0.0):
                out[at] = weight
        return out

    def phrases(self, text: str, at: int) -> tuple[str, str]:
        """A match's word with the one before it and with the one after it."""
        word = WORD.match(text, at)[0]
        after = WORD.search(text, at + len(word))
        before = WORD.findall(text, max(0, at - 60), at)
        return f"{before[-1] if before else ''} {word}", f"{word} {after[0] if after else ''}"

    def features(self, text: str) -> tuple[float, ...]:
        """FEATURES numbers: the largest weight, the sum of weights plain and by length, the matches, and the length."""
        text = fold(text)
        found = self.matches(text)
        if self.exceptions and found:
            found = {at: w for at, w in found.items() if not self.exceptions.intersection(self.phrases(text, at))}
        total, n = sum(found.values()), len(text) / 6
        return max(found.values(), default=0.0), log(1 + total), 20 * total / (n + 20), log(1 + len(found)), log(20 + n) - 3 if found else 0.0


FEATURES = 5


#: Terms that a task counts before it passes counts on.
HELD = 150_000


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each whole word and each beginning of a word: the toxic texts, and uses in toxic and other texts. The empty
    term counts words. Counts are partial: a task passes them on whenever it holds HELD terms."""
    uses, texts = (Counter(), Counter()), Counter()

    def counted() -> pa.RecordBatch:
        terms = list(uses[0].keys() | uses[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (texts, uses[1], uses[0]))], ["term", "texts", "toxic", "clean"])
        for c in (*uses, texts):
            c.clear()
        return out

    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"]):
            y, found = toxic.as_py(), WORD.findall(fold(text.as_py()))
            counts = Counter({"": len(found)})
            for w, n in Counter(found).items():
                if len(w) > 2:
                    counts[f"{w} "] += n
                for k in PREFIXES:
                    if len(w) >= k:
                        counts[w[:k]] += n
            uses[y].update(counts)
            if y:
                texts.update(counts.keys())
            if len(uses[0]) + len(uses[1]) > HELD:
                yield counted()
    yield counted()


def _phrases(terms: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts = Lexicon(terms, set()), (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                t = fold(text.as_py())
                counts[toxic.as_py()].update({p for at in lexicon.matches(t) for p in lexicon.phrases(t, at)})
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["term", "toxic", "clean"])

    return run


def _features(terms: dict[str, float], exceptions: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms, exceptions)
        for b in batches:
            x = np.array([lexicon.features(t.as_py()) for t in b["text"]]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([b["toxic"], *(pa.array(x[:, i]) for i in range(FEATURES))], ["toxic", *(f"x{i}" for i in range(FEATURES))])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a logistic model with an intercept last, by Newton's method with a ridge penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.diag([*[1.0] * (len(w) - 1), 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(labelled: DataFrame) -> tuple[dict[str, float], set[str], list[float]]:
    """(terms, exceptions, weights) from (text, toxic 0 or 1); rows with other labels are ignored.

    A term's weight is the logarithm of its frequency in toxic texts over that in others; terms need MIN_TOXIC toxic
    texts, or a hundredth of them, and MIN_RATIO, and MAX_TERMS are kept. A match is excused in phrases of two words that MIN_CLEAN clean texts and hardly any toxic
    ones hold. The driver gets only these bounded lists and FEATURES numbers per labelled row, about MAX_LABELLED.
    """
    with scratch(labelled.sparkSession):
        rows = save(labelled.where("toxic in (0, 1)").select(text_of(labelled).alias("text"), F.col("toxic").cast("int").alias("toxic")), "toxic")
        total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        toxic, clean = total.get(1, 0), total.get(0, 0)
        if not toxic or not clean:  # nothing to tell apart
            return {}, set(), [*[0.0] * FEATURES, log((toxic + 0.5) / (clean + 0.5))]
        counts = rows.mapInArrow(trimmed(_terms), "term string, texts long, toxic long, clean long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("texts", "toxic", "clean")))
        counts = save(counts.where("toxic > 0"), "terms")
        words = counts.where("term = ''").first()
        ratio = (F.col("toxic") + 0.5) / (words["toxic"] + 1) / ((F.col("clean") + 0.5) / (words["clean"] + 1)) if words else F.lit(0.0)
        found = counts.where((F.col("term") != "") & (F.col("texts") >= max(MIN_TOXIC, toxic // 100)) & (ratio >= MIN_RATIO)).select("term", F.log(ratio).alias("w"), "texts")
        found = found.orderBy(F.desc(F.col("w") * F.sqrt("texts")), "term").limit(MAX_TERMS)
        terms = {r["term"]: r["w"] for r in found.collect()}
        said = rows.mapInArrow(trimmed(_phrases(terms)), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        said = said.where((F.col("clean") >= MIN_CLEAN) & (F.col("clean") >= 9 * F.col("toxic") * clean / toxic)).orderBy(F.desc("clean"), "term").limit(MAX_EXCEPTIONS)
        exceptions = {r["term"] for r in said.collect()}
        x = rows.mapInArrow(trimmed(_features(terms, exceptions)), "toxic int, " + ", ".join(f"x{i} double" for i in range(FEATURES))).collect()
        a = np.array([tuple(r) for r in x])
        return terms, exceptions, _logistic(a[:, 1:], a[:, 0]).tolist()


def _scores(terms: dict[str, float], exceptions: set[str], weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(terms, exceptions), np.array(weights)
        for b in batches:
            x = np.array([lexicon.features(t.as_py()) for t in b["text"]]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(p)], ["id", "score"])

    return run


def score(docs: DataFrame, model: tuple[dict[str, float], set[str], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document, by its text alone; higher is likelier toxic.

    A null text counts as empty and has the score of a text without a match. Null and repeated ids are returned as
    they are, extra columns are ignored, and an empty table gives an empty result. Whole texts are read, one at a
    time; the model that each task gets has a bounded size.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(trimmed(_scores(*model)), "id long, score double").withColumnRenamed("id", id_col)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of about the given number of labelled documents at most, chosen by a hash of their ids: of rows
    that repeat an id, the smallest text and the largest label. Null ids and labels are ignored."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")  # bounded by most
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first(label).alias(label)).select("text", label)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(labelled_sample(docs, labels.where(crc32_mod("doc_id", 5) != 0), "toxic"))
    out = score(docs, model)
    held = F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
