"""Packing of tokenised documents along a Hilbert curve through hashed document vectors."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CACHES, save, text_of, trimmed

LENGTH = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
DIMS, BITS = 4, 6
#: Bits of a hash below a place on the curve, by which documents at one place are told apart.
LOW = 30
#: Tokens per bucket of the range sort, about, up to MAX_BUCKETS buckets; beyond, buckets grow.
BUCKET_TOKENS, MAX_BUCKETS = 3_000_000, 100_000
#: Leading bits of the curve by which running sums over its cells are dealt to tasks.
TOP = 12
#: Words that a worker process keeps the tokens of, and signs that end a word.
CACHE, SIGNS = 1_000_000, ".,;:!?\"()[]{}#*$%&|"
#: Runs without white space as the tokenizer takes it: unlike Python's, U+001C to U+001F are none.
SEPARATORS = "\x1c\x1d\x1e\x1f"
RUNS = re.compile("[^" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in SEPARATORS) + "]+")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split(text: str) -> list[str]:
    """The words of a text: its runs without what the tokenizer takes as white space."""
    return RUNS.findall(text) if any(c in text for c in SEPARATORS) else text.split()


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers, each below 2 ** bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Table:
    """Rows of tokens, end to end."""

    def __init__(self):
        self.flat, self.starts = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint16)])

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.starts[rows + 1] - self.starts[rows]

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.sizes(rows)
        ends = np.cumsum(sizes)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[rows] - ends + sizes, sizes)]


class Words(dict):
    """Row of each word, as split at white space, in tables of its tokens and of their projected sum.

    The tokenizer splits at white space before anything else, so a text's tokens are those of its words, and words are
    kept, as most have been seen before. It also parts letters from signs, so a new word is a core and the signs after
    its last letter; cores recur more than words. Cores of letters alone are encoded many at a time: each gives
    one token that ends a word, its last. ASCII cores are lower-cased, as the tokenizer does itself.
    """

    def __init__(self, tokenizer, projection: np.ndarray):
        self.tokenizer, self.projection = tokenizer, projection.astype(np.float32)
        self.new: list[str] = []
        self.table, self.vectors = Table(), np.zeros((0, projection.shape[1]), np.float32)
        self.cores, self.core_table = {"": 0}, Table()
        self.core_table.append(np.zeros(0), np.zeros(1, np.int64))
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return len(self) - 1

    def learn(self) -> None:
        """Tokens of the words that were asked for and not known."""
        new, self.new = self.new, []
        if not new:
            return
        cut = [w.rstrip(SIGNS) for w in new]
        cut = [c if c and c[-1].isalpha() else w for c, w in zip(cut, new)]
        tails = [w[len(c) :] for c, w in zip(cut, new)]
        cores = [c.lower() if c.isascii() else c for c in cut]
        self._add_cores([w for w in {*cores, *tails} if w not in self.cores])
        both = np.empty(2 * len(new), np.int64)
        both[::2], both[1::2] = list(map(self.cores.__getitem__, cores)), list(map(self.cores.__getitem__, tails))
        sizes, flat = self.core_table.sizes(both).reshape(-1, 2).sum(1), self.core_table.tokens(both)
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros((1, self.projection.shape[1])), np.cumsum(self.projection[flat], axis=0, dtype=np.float64)])
        self.vectors = np.concatenate([self.vectors, (sums[ends] - sums[ends - sizes]).astype(np.float32)])
        self.table.append(flat, sizes)

    def _add_cores(self, new: list[str]) -> None:
        plain = [w for w in new if w.isalpha()]
        other = [w for w in new if not w.isalpha()]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            lines = [" ".join(part[i : i + 200]) for i in range(0, len(part), 200)]
            flat = np.array([i for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.int64)
            last = np.nonzero(self.ends[flat])[0]
            if len(last) != len(part) or (len(last) and last[-1] + 1 != len(flat)):
                other += part  # letters to us, but not to the tokenizer
                continue
            self.cores.update(zip(part, range(len(self.cores), len(self.cores) + len(part))))
            self.core_table.append(flat, np.diff(last, prepend=-1))
        if other:
            made = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            self.cores.update(zip(other, range(len(self.cores), len(self.cores) + len(other))))
            self.core_table.append(np.array([i for ids in made for i in ids], np.int64), np.array([len(ids) for ids in made]))

    def rows(self, words: Iterable[str], many: int) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, many)


#: The words that a worker process knows, kept from task to task.
_KNOWN: dict[tuple, Words] = CACHES.setdefault("words", {})


def known_words(path: str, dims: int) -> Words:
    found = _KNOWN.get((path, dims))
    if found is None or len(found) > CACHE:
        from tokenizers import Tokenizer

        tokenizer = found.tokenizer if found is not None else Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        found = _KNOWN[path, dims] = Words(tokenizer, np.random.default_rng(0).standard_normal((1 << 16, dims)))
    return found


def _tokenise(path: str, dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, known = b.slice(at, 500), known_words(path, dims)
                texts = [split(t.as_py()) for t in part["text"]]
                words = np.cumsum([0, *map(len, texts)])
                rows = known.rows(chain.from_iterable(texts), int(words[-1]))
                known.learn()
                flat, ends = known.table.tokens(rows), np.concatenate([[0], np.cumsum(known.table.sizes(rows))])[words]
                sums = np.concatenate([np.zeros((1, dims)), np.cumsum(known.vectors[rows], axis=0, dtype=np.float64)])[words]
                sizes = np.diff(ends) + 1
                cells = (np.diff(sums, axis=0) + known.projection[END]) / sizes[:, None]
                flat = np.insert(flat.astype("<u2", copy=False), ends[1:], END).tobytes()
                at_ = 2 * np.concatenate([[0], np.cumsum(sizes)])
                ids = [flat[x:y] for x, y in zip(at_[:-1].tolist(), at_[1:].tolist())]
                grid = np.clip(((np.arctan(4 * cells) / np.pi + 0.5) * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(sizes, pa.int64()), pa.array(hilbert(grid, bits)), pa.array(ids, pa.binary())], ["id", "n", "curve", "ids"])

    return run


def _bounds(made: DataFrame, total: int, buckets: int) -> list[int]:
    """Keys that cut the line in buckets of equal size, about.

    Tokens are summed by place on the curve; a bound that falls inside a place's tokens cuts its hashes in that
    proportion, so a place that a third of all documents share is dealt to as many buckets as it needs. Running sums
    are made per TOP leading bits, each in a task; the driver gets their 2 ** TOP totals and the bounds.
    """
    spark = made.sparkSession
    cells = made.groupBy(F.shiftright("key", LOW).alias("cell")).agg(F.sum("n").alias("n"))
    cells = cells.withColumn("top", F.shiftright("cell", DIMS * BITS - TOP))
    tops, at, firsts = {r["top"]: r["n"] for r in cells.groupBy("top").agg(F.sum("n").alias("n")).collect()}, 0, []
    for top in sorted(tops):
        firsts.append((top, at))
        at += tops[top]
    cells = cells.join(F.broadcast(spark.createDataFrame(firsts, "top long, first long")), "top")  # 2 ** TOP rows at most
    before = F.sum("n").over(Window.partitionBy("top").orderBy("cell")) - F.col("n") + F.col("first")
    cells = cells.select("cell", F.col("n").cast("double").alias("n"), before.cast("double").alias("before"))
    size = total / buckets
    lo = F.greatest(F.ceil(F.col("before") / size), F.lit(1))
    hi = F.least(F.ceil((F.col("before") + F.col("n")) / size) - 1, F.lit(buckets - 1))
    cut = cells.where(lo <= hi).select("cell", "n", "before", F.explode(F.sequence(lo, hi)).alias("b"))
    low = F.floor((F.col("b") * size - F.col("before")) / F.col("n") * (1 << LOW)).cast("long")
    return sorted(r["key"] for r in cut.select((F.shiftleft("cell", LOW) + low).alias("key")).distinct().collect())


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the key: first counted in steps, then within a step."""
    step = max(1, round(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not parts:
        return F.lit(0).cast("long")
    count = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    at = count(F.lit([p[0] for p in parts])) - 1
    inner = F.element_at(F.array(*(F.lit(p) for p in parts)), F.greatest(at + 1, F.lit(1)))
    return F.when(at < 0, 0).otherwise(at * step + count(inner)).cast("long")


def _pieces(starts: dict[int, int], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at = None, 0
        for b in batches:
            out: list[tuple] = []
            for doc, n, data, to in zip(b["id"].to_pylist(), b["n"].to_pylist(), b["ids"], b["bucket"].to_pylist()):
                if to != bucket:
                    bucket, at = to, starts[to]
                ids, done = np.frombuffer(data.as_buffer(), "<u2").astype("<u4"), 0
                while done < n:
                    size = min(n - done, length - at % length)
                    out.append((doc, done, size, zlib.crc32(ids[done : done + size]), n, at // length, at % length))
                    done, at = done + size, at + size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its tokens and END. Documents are laid end to end in the order of the Hilbert curve through
    their vectors (the mean of random projections of their ids), and the line is cut at every length ids: so only the
    last sequence needs padding, and documents of a sequence are neighbours on the curve.

    The line is made of buckets, ranges of the curve with about as many tokens each: each bucket is sorted in a task
    of its own and starts where the sums of the buckets before it end. Only bounds and sums, at most MAX_BUCKETS,
    reach the driver. A hash of the id is the lower part of the key, so copies of a text, which share a place
    on the curve, can be dealt to many buckets.

    A null text counts as empty and has the id END alone. Null and repeated ids are rows like others. Extra columns
    are ignored; an empty table gives an empty result. Whole texts are packed, however long.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    made = rows.mapInArrow(trimmed(_tokenise(path or tokenizer_path(), DIMS, BITS), "words"), "id long, n long, curve long, ids binary")
    low = F.pmod(F.xxhash64("id", "n"), F.lit(1 << LOW))
    made = save(made.select("id", "n", "ids", F.shiftleft("curve", LOW).bitwiseOR(low).alias("key")), "tokens")
    total = made.agg(F.sum("n")).first()[0] or 0
    buckets = int(min(MAX_BUCKETS, total // bucket_tokens + 1))
    bounds = _bounds(made, total, buckets) if buckets > 1 else []
    made = made.withColumn("bucket", _bucket(F.col("key"), bounds))
    sums = made.groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(sums, key=lambda r: r["bucket"]):
        starts[r["bucket"]] = at
        at += r["n"]
    dealt = made.repartitionById(len(bounds) + 1, F.col("bucket").cast("int"))
    dealt = dealt.sortWithinPartitions("bucket", "key", "id", "n", F.xxhash64("ids"))
    return dealt.mapInArrow(trimmed(_pieces(starts, length)), PIECE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
