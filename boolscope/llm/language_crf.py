"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_mod, save, scratch, text_of, trimmed

#: Labelled texts learned from, about: per language, and in all, shared out where there are many languages.
MAX_LABELLED, MAX_ROWS = 400, 80_000
#: Bytes of text learned from: per language, and in all.
LEARN_BYTES, LEARN_ALL = 2 << 20, 400 << 20
#: Whole texts are learned from; a text's words are cut into chains of this many for learning only.
CHAIN = 64
BITS, LEXICON = 16, 2_000
#: Languages whose counts are sent to all tasks; more are joined by language.
MOST_SENT = 100_000
#: Words that a task keeps the scores of, and words in a padded block.
CACHE, BLOCK = 150_000, 200_000
#: Words times languages that are held at once for one text, and for texts that are read together.
CELLS, TOGETHER = 2_000_000, 40_000_000
UNKNOWN = "und"


STRIP = ".,;:!?\"'()[]{}|#*$%&<>-"


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def words(text: str) -> list[str]:
    return text.lower().split()


def features(cores: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of many words at once.

    A word's features are the n-grams of 1 to 3 letters of <word>, those of 4 at its beginning and end (so that
    beginnings and endings of up to 3 letters are features), all hashed, and itself if it is in the lexicon.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in cores).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(cores)), np.fromiter(map(len, cores), np.int64, len(cores)) + 2)
    found, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        last = len(codes) - n + 1
        h = (h[:last] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n))
        inside = word[:last] == word[n - 1 :]
        if n == 4:
            inside &= (codes[:last] == ord("<")) | (codes[n - 1 :] == ord(">"))
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((word[:last][inside], (mixed[inside] >> np.uint64(64 - BITS)).astype(np.int64)))
    known = [(i, lexicon[w]) for i, w in enumerate(cores) if w in lexicon]
    if known:
        found.append((np.array([i for i, _ in known]), (1 << BITS) + np.array([x for _, x in known])))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def forward_backward(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word's label, and of each label pair over all chains.

    scores: (chains, words, labels), positive; moves: (labels, labels), positive; sizes: words per chain, in
    descending order, so that the chains that still run are the first ones at every step.
    """
    n, longest, k = scores.shape
    ahead, back = np.ones_like(scores), np.ones_like(scores)
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains with more words than t
    a = scores[:, 0] / scores[:, 0].sum(1, keepdims=True)
    ahead[:, 0] = a
    for t in range(1, longest):
        m = live[t]
        a = (a[:m] @ moves) * scores[:m, t]
        a /= a.sum(1, keepdims=True)
        ahead[:m, t] = a
    pairs = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        m = live[t + 1]
        right = scores[:m, t + 1] * back[:m, t + 1]
        b = right @ moves.T
        pairs += moves * ((ahead[:m, t] / (ahead[:m, t] * b).sum(1, keepdims=True)).T @ right)
        back[:m, t] = b / b.sum(1, keepdims=True)
    marginals = ahead * back
    marginals /= marginals.sum(2, keepdims=True)
    return marginals, pairs


class Model:
    """Languages, feature weights (features, languages), transition weights, and the lexicon's words by number."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: dict[str, int]):
        self.languages, self.weights, self.moves, self.lexicon = languages, weights, moves, lexicon

    def word_scores(self, cores: list[str]) -> np.ndarray:
        """A row of positive scores per word, 1 at most."""
        of, feature = features(cores, self.lexicon)
        s = np.stack([np.bincount(of, self.weights[feature, j], len(cores)) for j in range(len(self.languages))], 1)
        return np.exp(np.clip(s - s.max(1, keepdims=True), -30, 0))


def learn(texts: list[tuple[str, str]], rounds: int = 40) -> Model:
    """A model from (text, language). Words start with their document's language; after half of the rounds, words that
    the chain holds to be of another language are labelled so, and transitions are learned from the mixed chains."""
    languages = sorted({y for _, y in texts})
    k = len(languages)
    counts = {y: Counter() for y in languages}
    for text, y in texts:
        counts[y].update({w.strip(STRIP) for w in words(text)})
    common = dict.fromkeys(w for c in counts.values() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON] if n > 2)
    lexicon = {w: i for i, w in enumerate(common)}
    ids: dict[str, int] = {}
    chains, gold = [], []
    for text, y in texts:
        row = [ids.setdefault(w.strip(STRIP), len(ids)) for w in words(text) if has_letter(w)]
        for at in range(0, len(row), CHAIN):
            chains.append(row[at : at + CHAIN])
            gold.append(languages.index(y))
    size = (1 << BITS) + len(lexicon)
    weights, moves = np.zeros((size, k), np.float32), np.eye(k) * 2.0
    if not chains or k < 2:
        return Model(languages, weights, moves, lexicon)
    order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
    sizes = np.array([len(chains[i]) for i in order])
    grid, mask = np.zeros((len(order), sizes[0]), np.int64), np.arange(sizes[0]) < sizes[:, None]
    grid[mask] = np.concatenate([chains[i] for i in order])
    y = np.repeat(np.array([gold[i] for i in order])[:, None], sizes[0], 1)
    of, feature = features(list(ids), lexicon)
    used = len(ids)
    speed_w, speed_m = np.full_like(weights, 1e-2), np.full((k, k), 1e-2)
    total = sizes.sum()
    for step in range(rounds):
        s = np.zeros((used, k))
        for j in range(k):
            s[:, j] = np.bincount(of, weights[feature, j], used)
        e = np.exp(np.clip(s - s.max(1, keepdims=True), -30, 0))
        got, pairs = forward_backward(e[grid], np.exp(moves - moves.max()), sizes)
        if step == rounds // 2:
            y = np.where(got.max(2) > 0.9, got.argmax(2), y)
        right = np.eye(k)[y] - got
        g = np.column_stack([np.bincount(grid[mask], right[..., j][mask], used) for j in range(k)]) / total
        gw = np.column_stack([np.bincount(feature, g[of, j], size) for j in range(k)]) - 1e-6 * weights
        both = mask[:, 1:]
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
        gm = (seen + 0.5 - pairs) / total - 1e-3 * moves
        speed_w += (gw * 100) ** 2
        speed_m += (gm * 10) ** 2
        weights += (0.5 * gw * 100 / np.sqrt(speed_w)).astype(np.float32)
        moves += 0.2 * gm * 10 / np.sqrt(speed_m)
    return Model(languages, weights, moves, lexicon)


class Scores(dict):
    """Row of each word in a table of scores; row 0 is for words without a letter."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.table = np.ones((1, len(self.model.languages)), np.float32)

    def add(self, texts: list[list[str]]) -> None:
        new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self]
        cores = [w.strip(STRIP) for w in new]
        lettered = [i for i, w in enumerate(cores) if has_letter(w)]
        self.update(dict.fromkeys(new, 0))
        for at in range(0, len(lettered), 20_000):
            part = lettered[at : at + 20_000]
            self.update(zip((new[i] for i in part), range(len(self.table), len(self.table) + len(part))))
            self.table = np.concatenate([self.table, self.model.word_scores([cores[i] for i in part]).astype(np.float32)])


def long_sums(cores: list[str], model: Model) -> np.ndarray:
    """Sums of the word marginals of one chain, of any length, in blocks.

    The way forward keeps its state at the blocks' borders only; the way back goes forward through each block once more.
    """
    step, moves = max(1, CELLS // len(model.languages)), np.exp(model.moves - model.moves.max())
    starts = range(0, len(cores), step)

    def rows(at: int) -> np.ndarray:
        part = cores[at : at + step]
        place = {w: i for i, w in enumerate(dict.fromkeys(part))}
        return model.word_scores(list(place))[[place[w] for w in part]]

    def ahead(a: np.ndarray | None, block: np.ndarray) -> np.ndarray:
        out = np.empty_like(block)
        for j, s in enumerate(block):
            a = s if a is None else (a @ moves) * s
            out[j] = a = a / a.sum()
        return out

    borders: list[np.ndarray | None] = [None]
    for at in starts[:-1]:
        borders.append(ahead(borders[-1], rows(at))[-1].copy())
    sums, right = np.zeros(len(model.languages)), None
    for at in reversed(starts):
        block = rows(at)
        left = ahead(borders.pop(), block)
        for j in range(len(block) - 1, -1, -1):
            b = np.ones(len(sums)) if right is None else moves @ right
            b /= b.sum()
            here = left[j] * b
            sums += here / here.sum()
            right = block[j] * b
    return sums


def predict(texts: list[str], model: Model, scores: Scores) -> list[tuple[str, float]]:
    """The language with the largest sum of word marginals, and its share of that sum."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    k, moves = len(model.languages), np.exp(model.moves - model.moves.max()).astype(np.float32)

    def named(sums: np.ndarray) -> tuple[str, float]:
        best = int(sums.argmax())
        return model.languages[best], float(min(1.0, sums[best] / sums.sum()))

    def together(split: dict[int, list[str]]) -> None:
        scores.add(list(split.values()))
        rows = {i: np.array(list(map(scores.__getitem__, t)), np.int64) for i, t in split.items()}
        rows = {i: r[r > 0] for i, r in rows.items()}
        order, at = sorted((i for i, r in rows.items() if len(r)), key=lambda i: -len(rows[i])), 0
        while at < len(order):
            part = order[at : at + max(1, min(BLOCK, CELLS // k) // len(rows[order[at]]))]
            at += len(part)
            sizes = np.array([len(rows[i]) for i in part])
            mask = np.arange(sizes[0]) < sizes[:, None]
            grid = np.zeros(mask.shape, np.int64)
            grid[mask] = np.concatenate([rows[i] for i in part])
            got, _ = forward_backward(scores.table[grid], moves, sizes)
            got[~mask] = 0
            for i, s in zip(part, got.sum(1, dtype=np.float64)):
                out[i] = named(s)
        if max(len(scores) / CACHE, len(scores) * k / TOGETHER) > 1:
            scores.forget()

    held, size = {}, 0
    for i, text in enumerate(texts):
        found = words(text)
        if len(found) * k > CELLS:
            cores = [c for w in found if has_letter(c := w.strip(STRIP))]
            if cores:
                out[i] = named(long_sums(cores, model))
            continue
        held[i] = found
        size += len(found) * k
        if size > TOGETHER:
            together(held)
            held, size = {}, 0
    together(held)
    return out


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                found = predict(part["text"].to_pylist(), model, scores)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([x[0] for x in found]), pa.array([x[1] for x in found])], ["id", "lang_pred", "score"])

    return run


def labelled_sample(docs: DataFrame, most: int = MAX_LABELLED, most_bytes: int = LEARN_BYTES, rows: int = MAX_ROWS, all_bytes: int = LEARN_ALL) -> list[tuple[str, str]]:
    """(text, lang) of about the given number of distinct texts per language, chosen by their hashes, and of so many
    bytes a language at most: texts beyond that stay out, but each language has its shortest chosen one at least.

    The sample is bounded by rows and bytes in all: where there are many languages, each gets its share of these.
    Every language is learned, however rare. Texts and counts are distinct, so copies of a text are one row however
    many there are. Null texts and languages are ignored.
    """
    labelled = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("th"))
    texts = labelled.groupBy("lang", "th").agg(F.max(F.octet_length("text")).alias("size"))
    counts = texts.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("th").alias("h"), "th")).alias("least"))
    with scratch(docs.sparkSession):
        counts = save(counts, "languages")
        languages = max(1, counts.count())
        most, most_bytes = max(1, min(most, rows // languages)), min(most_bytes, all_bytes // languages)
        h, sent = F.pmod(F.xxhash64("th"), F.lit(1 << 20)), F.broadcast(counts) if languages <= MOST_SENT else counts
        kept = texts.join(sent, "lang").where((h < F.round(F.least(F.lit(1.0), most / F.col("n")) * (1 << 20))) | (F.col("th") == F.col("least.th")))
        by = Window.partitionBy("lang")  # of about most rows each
        sized = kept.select("lang", "th", F.sum("size").over(by.orderBy("size", "th").rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.row_number().over(by.orderBy("size", "th")).alias("at"))
        chosen = sized.where((F.col("sum") <= most_bytes) | (F.col("at") == 1)).select("lang", "th")
        got = labelled.join(F.broadcast(chosen), ["lang", "th"]).groupBy("lang", "th").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["lang"], r["th"]))]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every document, by its whole text alone.

    A null text, or one without a letter, is und with score 0; so is every text if the model knows no language. Null
    and repeated ids are returned as they are, extra columns are ignored, an empty table gives an empty result. A text
    is one chain of its words, however long; a very long one is worked through in blocks, with the same result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    if not model.languages:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(trimmed(_predict(model)), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    model = learn(labelled_sample(docs.where(~held)))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
