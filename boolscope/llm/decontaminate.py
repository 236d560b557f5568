"""Benchmark decontamination by latent semantic retrieval, and by shared words where it can't reach; then by common subsequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch, text_of, trimmed

#: Signs that are taken off both ends of a word.
SIGNS = ".,;:!?\"'`()[]{}<>|#*$%&_~=+-/\\…“”‘’«»¿¡–—"
#: Words per block; a passage is two neighbouring blocks, so passages overlap by half.
BLOCK = 16
#: Dimensions of the latent space, and extra ones while it is fitted.
RANK, EXTRA = 256, 8
#: Words in more than this share of the distinct texts have no weight in the latent search.
STOP_SHARE = 0.05
#: Times that the benchmark's passages together weigh as much as all documents' in the fit of the latent space.
SCALE = 10.0
MIN_COSINE, MIN_LCS, MIN_ANSWER, SURE_LCS = 0.36, 0.65, 0.6, 0.85
#: Cosine that an item's copy must have for the latent search to do: what then keeps MIN_LCS of it has MIN_COSINE still.
KEPT = MIN_COSINE / MIN_LCS
CHUNK = 64
MATCH = "id long, th long, item_id long, cosine double, lcs double, answer double"


def words(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(SIGNS))]


def answer(text: str) -> list[str]:
    """The words of an item's answer: what follows its last "answer:", else its last sentence of 3 words or more,
    else all of them."""
    said = re.split(r"(?i)\banswer\s*:", text)
    if len(said) > 1 and words(said[-1]):
        return words(said[-1])
    parts = [w for w in map(words, re.split(r"[.?!\n]+", text)) if len(w) >= 3]
    return parts[-1] if parts else words(text)


def lcs(masks: dict[int, int], size: int, other: list[int]) -> int:
    """Length of the longest common subsequence; masks has each word's places in the first sequence as bits."""
    full = (1 << size) - 1
    row = full
    for x in other:
        here = row & masks.get(x, 0)
        row = (row + here | row - here) & full
    return size - row.bit_count()


def masks(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(ids):
        out[x] = out.get(x, 0) | 1 << i
    return out


class Benchmark:
    """The items' words as numbers from 1; 0 is any other word."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, list[int], list[int]]] = []
        for item, text in items:
            for w in words(text):
                self.number.setdefault(w, len(self.number) + 1)
            ids, last = ([self.number[w] for w in x] for x in (words(text), answer(text)))
            if ids:
                self.items.append((item, ids, last))
        self.size = len(self.number) + 1


def _kind(size: int) -> str:
    """How word numbers below size are stored."""
    return "<u2" if size <= 1 << 16 else "<u4"


def _numbers(number: dict[str, int]):
    kind = _kind(len(number) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for b in batches:
            # as words(), but that signs alone stay as other words
            made = [np.array([get(w) or get(w.strip(SIGNS), 0) for w in t.as_py().lower().split()], kind).tobytes() for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["id"], b["th"], pa.array(made, pa.binary())], ["id", "th", "words"])

    return run


def _read(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents' words, numbers below size, in a row, and where each document starts, with the end last."""
    data, kind = [x.as_buffer() if x.is_valid else b"" for x in column], np.dtype(_kind(size))
    starts = np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in data])]).astype(np.int64)
    return np.frombuffer(b"".join(data), kind), starts


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size + 1, np.int64)  # the last counts texts
        for b in batches:
            flat, starts = _read(b["words"], size)
            doc = np.repeat(np.arange(b.num_rows), np.diff(starts))
            seen[:size] += np.bincount(np.unique(doc * size + flat) % size, minlength=size)
            seen[size] += b.num_rows
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    return run


def _blocks(flat: np.ndarray, starts: np.ndarray, weight: np.ndarray, other: float) -> tuple[np.ndarray, ...]:
    """Weighted words of documents cut into blocks: (word numbers, their blocks, energy of each block, document of each
    block). Words without a number weigh other, stop words nothing."""
    sizes = np.diff(starts)
    many = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(many)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    block = first[doc] + (np.arange(len(flat)) - starts[doc]) // BLOCK
    w = weight[flat]
    energy = np.bincount(block, np.where(flat == 0, other * other, w * w), int(first[-1]))
    live = w > 0
    return flat[live], block[live], energy, np.repeat(np.arange(len(sizes)), many)


def _products(weight: np.ndarray, other: float, basis: np.ndarray):
    """Sums of a' (a basis) over all passages a, here the pairs of blocks without overlap, by chunks of rows."""
    basis = basis.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(basis.shape), False
        for b in batches:
            for at in range(0, b.num_rows, 100):
                some = True
                add_products(*_read(b["words"].slice(at, 100), len(weight)), weight, other, basis, total)
        for at in range(0, len(basis) if some else 0, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at : at + CHUNK].tobytes()], pa.binary())], ["at", "rows"])

    return run


def add_products(flat: np.ndarray, starts: np.ndarray, weight: np.ndarray, other: float, basis: np.ndarray, out: np.ndarray) -> None:
    term, block, energy, doc = _blocks(flat, starts, weight, other)
    if not len(term):
        return
    pair = np.arange(len(doc)) - (np.arange(len(doc)) - np.searchsorted(doc, doc)) % 2  # the even block of each pair
    row = pair[block]
    value = (weight[term] / np.sqrt(np.bincount(pair, energy, len(doc)))[row]).astype(np.float32)[:, None]
    new = np.concatenate([[True], row[1:] != row[:-1]])
    ahead = np.add.reduceat(basis[term] * value, np.nonzero(new)[0], axis=0)
    order = np.argsort(term, kind="stable")
    back = ahead[(np.cumsum(new) - 1)[order]] * value[order]
    term = term[order]
    cut = np.nonzero(np.concatenate([[True], term[1:] != term[:-1]]))[0]
    out[term[cut]] += np.add.reduceat(back, cut, axis=0)


def _sum(tables: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer()) for x in tables["rows"])
    return pa.table({"at": tables["at"].slice(0, 1), "rows": pa.array([total.tobytes()], pa.binary())})


def _product(numbers: DataFrame, bench: tuple[np.ndarray, np.ndarray], scale: float, weight: np.ndarray, other: float, basis: np.ndarray) -> np.ndarray:
    parts = numbers.mapInArrow(trimmed(_products(weight, other, basis)), "at long, rows binary").groupBy("at").applyInArrow(_sum, "at long, rows binary")
    out = np.zeros(basis.shape)
    add_products(*bench, weight, other, basis, out)
    out *= scale
    for r in parts.collect():  # a row of RANK + EXTRA numbers per word of the benchmark
        got = np.frombuffer(r["rows"]).reshape(-1, basis.shape[1])
        out[r["at"] : r["at"] + len(got)] += got
    return out


class Space:
    """Term weights, the weight of other words, the latent basis (terms, rank), and the items' passages in it."""

    def __init__(self, bench: Benchmark, weight: np.ndarray, other: float, basis: np.ndarray):
        self.bench, self.weight, self.other, self.basis = bench, weight, other, (basis * weight[:, None]).astype(np.float32)
        vectors, owners = [], []
        for i, (_, ids, _) in enumerate(bench.items):
            v, norm, _, _ = self.passages(np.array(ids, np.int64), np.array([0, len(ids)]))
            size = np.linalg.norm(v, axis=1)
            vectors.append(v[size > 0] / size[size > 0, None])
            owners += [i] * int((size > 0).sum())
        self.queries, self.owners = (np.concatenate(vectors) if vectors else np.zeros((0, basis.shape[1]), np.float32)), np.array(owners, np.int64)
        self.exact = pieces(bench, [i for i in range(len(bench.items)) if not self.reaches(i)], weight > 0)

    def reaches(self, i: int) -> bool:
        """Whether the latent search can be trusted with an item: all its passages have a vector, and its copy between
        other words, wherever blocks begin in it, has a cosine of KEPT with it. A space of fixed rank holds a smaller share of
        passages the larger the benchmark is, and short items weigh little beside other words."""
        _, ids, _ = self.bench.items[i]
        own = self.queries[self.owners == i]
        if len(own) != -(-len(ids) // BLOCK):
            return False
        copies = [[0] * (BLOCK + n) + ids + [0] * (2 * BLOCK) for n in range(BLOCK)]
        v, norm, doc, _ = self.passages(np.array([x for c in copies for x in c], np.int64), np.cumsum([0, *map(len, copies)]))
        best = np.zeros(BLOCK)
        np.maximum.at(best, doc, (v @ own.T).max(axis=1) / norm)
        return bool(best.min() >= KEPT)

    def passages(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(latent vectors, norms, documents, first blocks in their documents) of the passages that can have a cosine of
        MIN_COSINE with anything: the benchmark's words must have that share of their norm."""
        term, block, energy, doc = _blocks(flat, starts, self.weight, self.other)
        n = len(doc)
        own = np.bincount(block, self.weight[term] ** 2, n)
        pair = np.append(doc[1:] == doc[:-1], False) if n else np.zeros(0, bool)  # blocks with another after them
        energy = energy + np.where(pair, np.append(energy[1:], 0)[:n], 0)
        own = own + np.where(pair, np.append(own[1:], 0)[:n], 0)
        near = (own >= MIN_COSINE**2 * energy) & (own > 0)
        needed = near | np.append(False, (near & pair)[:-1])[:n]
        live = needed[block]
        term, block = term[live], block[live]
        v = np.zeros((n, self.basis.shape[1]), np.float32)
        if len(term):
            cut = np.concatenate([[0], np.nonzero(np.diff(block))[0] + 1])
            v[block[cut]] = np.add.reduceat(self.basis[term], cut, axis=0)
        v[:-1][pair[:-1]] += v[1:][pair[:-1]]
        at = np.nonzero(near)[0]
        return v[at], np.sqrt(energy[at]), doc[at], at - np.searchsorted(doc, doc[at])

    def candidates(self, flat: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(document, item, first block, cosine) of passages near one of an item's, the best first for each pair."""
        v, norm, doc, place = self.passages(flat, starts)
        best: dict[tuple[int, int], list[tuple[float, int]]] = {}
        at = np.nonzero(np.linalg.norm(v, axis=1) >= MIN_COSINE * norm)[0]  # no cosine can be larger than this share
        for lo in range(0, len(at), 8192):
            part = at[lo : lo + 8192]
            for q in range(0, len(self.queries), 4096):
                cos = (v[part] @ self.queries[q : q + 4096].T) / norm[part, None]
                for i, j in zip(*np.nonzero(cos >= MIN_COSINE)):
                    best.setdefault((int(doc[part[i]]), int(self.owners[q + j])), []).append((float(cos[i, j]), int(place[part[i]])))
        return [(d, i, p, c) for (d, i), found in sorted(best.items()) for c, p in sorted(found, reverse=True)]

    def cosine(self, ids: np.ndarray, item: int, block: int) -> float:
        """The best cosine of a document's passage with an item's; 0 if either has no vector that counts."""
        v, norm, _, place = self.passages(ids, np.array([0, len(ids)]))
        at, own = np.nonzero(place == block)[0], self.queries[self.owners == item]
        return float((own @ v[at[0]]).max() / norm[at[0]]) if len(at) and len(own) else 0.0

    def verify(self, ids: np.ndarray, item: int, block: int) -> tuple[float, float]:
        """Shares of an item and of its answer that are subsequences of the text around a passage."""
        _, own, last = self.bench.items[item]
        lo = max(0, block * BLOCK - len(own))
        region = ids[lo : (block + 2) * BLOCK + len(own)].tolist()
        return lcs(masks(own), len(own), region) / len(own), lcs(masks(last), len(last), region) / len(last)


def leaked(whole: float, last: float) -> bool:
    return whole >= SURE_LCS or (whole >= MIN_LCS and last >= MIN_ANSWER)


def required(size: int) -> int:
    """Words of an item that a leak has at least."""
    return int(np.ceil(MIN_LCS * size - 1e-9))


def pieces(bench: Benchmark, some: list[int], rare: np.ndarray) -> list[Pieces]:
    """Exact searches for items: together those whose regions round up to the same power of two, by their rare words where a
    leak must have a fair number of these, else by all words."""
    groups: dict[tuple[int, bool], list[int]] = {}
    for i in some:
        ids = np.array(bench.items[i][1])
        enough = 10 * (required(len(ids)) - int((~rare[ids]).sum())) >= len(ids)
        groups.setdefault(((2 * BLOCK + 2 * len(ids) - 1).bit_length(), enough), []).append(i)
    return [Pieces(bench, group, rare if enough else np.ones(bench.size, bool)) for (_, enough), group in groups.items()]


class Pieces:
    """Exact search for some items of like size, without weights or dimensions.

    Documents are cut into pieces of two halves, each half in two pieces; a half is as long as the longest region that
    verify() reads, so every region lies in a piece. An item can leak only where a piece shares MIN_LCS of its words,
    repeats counted: the j-th of a word in a piece meets the j-th in the item. If only some words are counted, the
    item's others are taken as shared. What passes is held against the item by the common subsequence with the piece,
    then passage by passage.
    """

    def __init__(self, bench: Benchmark, some: list[int], counted: np.ndarray):
        self.bench, self.some = bench, some
        self.half = 1 << (2 * BLOCK + 2 * max(len(bench.items[i][1]) for i in some) - 1).bit_length()
        self.need = np.array([required(len(bench.items[i][1])) for i in some])
        own = [np.bincount(bench.items[i][1], minlength=bench.size) for i in some]
        self.least = np.maximum(1, self.need - [int(c[~counted].sum()) for c in own])
        own = [c * counted for c in own]
        self.most = np.max(own, axis=0)
        self.first = np.cumsum(self.most) - self.most
        rows = [np.repeat(self.first, c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for c in own]
        holder, row = np.repeat(np.arange(len(some)), [len(x) for x in rows]), np.concatenate(rows)
        self.holders = holder[np.argsort(row, kind="stable")]  # items by the row, a word and its place among its repeats
        self.ends = np.cumsum(np.bincount(row, minlength=int(self.most.sum())))
        self.masks = [masks(bench.items[i][1]) for i in some]

    def shared(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, place of the piece in it, place of the item) of pieces that share enough of an item's words."""
        sizes = np.diff(starts)
        halves = np.maximum(1, -(-sizes // self.half))
        many = np.maximum(1, halves - 1)
        first = np.cumsum(many) - many
        live = np.nonzero(self.most[flat])[0]
        doc = np.searchsorted(starts, live, "right") - 1
        half = (live - starts[doc]) // self.half
        term = flat[live].astype(np.int64)
        left, right = half > 0, half < many[doc]
        key = np.concatenate([(first[doc] + half - 1)[left] * self.bench.size + term[left], (first[doc] + half)[right] * self.bench.size + term[right]])
        key, count = np.unique(key, return_counts=True)
        piece, term = key // self.bench.size, key % self.bench.size
        count = np.minimum(count, self.most[term])
        row = np.repeat(self.first[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        many_items = np.diff(self.ends, prepend=0)[row]
        at = np.repeat(self.ends[row], many_items) - np.repeat(np.cumsum(many_items), many_items) + np.arange(many_items.sum())
        pair, got = np.unique(np.repeat(np.repeat(piece, count), many_items) * len(self.some) + self.holders[at], return_counts=True)
        owner = np.repeat(np.arange(len(sizes)), many)
        for x in pair[got >= self.least[pair % len(self.some)]].tolist():
            p, n = divmod(x, len(self.some))
            yield int(owner[p]), p - int(first[owner[p]]), n

    def found(self, space: Space, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """(document, item, first block, share of the item, share of its answer) of leaks, the best block of each piece."""
        for doc, at, n in self.shared(flat, starts):
            ids, item = flat[starts[doc] : starts[doc + 1]], self.some[n]
            part = ids[at * self.half : (at + 2) * self.half].tolist()
            if lcs(self.masks[n], len(self.bench.items[item][1]), [x for x in part if x in self.masks[n]]) < self.need[n]:
                continue
            blocks = range(at * self.half // BLOCK, -(-(at * self.half + len(part)) // BLOCK))
            best = max(((*space.verify(ids, item, b), -b) for b in blocks), key=lambda x: (leaked(*x[:2]), x))
            if leaked(*best[:2]):
                yield doc, item, -best[2], best[0], best[1]


def _matches(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                flat, starts = _read(part["words"], space.bench.size)
                ids, hashes, found = part["id"].to_pylist(), part["th"].to_pylist(), {}
                for doc, item, block, cosine in space.candidates(flat, starts):
                    if (doc, item) in found:
                        continue
                    whole, last = space.verify(flat[starts[doc] : starts[doc + 1]], item, block)
                    if leaked(whole, last):
                        found[doc, item] = (ids[doc], hashes[doc], space.bench.items[item][0], cosine, whole, last)
                for search in space.exact:
                    for doc, item, block, whole, last in search.found(space, flat, starts):
                        if (doc, item) not in found:
                            cosine = space.cosine(flat[starts[doc] : starts[doc + 1]], item, block)
                            found[doc, item] = (ids[doc], hashes[doc], space.bench.items[item][0], cosine, whole, last)
                rows = list(found.values())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["id", "th", "item_id", "cosine", "lcs", "answer"])

    return run


def fit(numbers: DataFrame, bench: Benchmark, seed: int = 0) -> Space:
    """Weights and the latent space, from all documents.

    The matrix has a row per passage of documents and items, of TF-IDF weights of the benchmark's words; its norm
    counts other words too. Items are scaled up to weigh SCALE times as much as all documents, else a space of
    RANK dimensions would have no room for what tells items apart. Randomised SVD: a random basis is multiplied by A'A in one pass over the passages and made
    orthonormal; a second pass gives the small matrix whose eigenvectors turn it to the singular directions.
    The driver gets matrices of the benchmark's terms by RANK + EXTRA.
    """
    size = bench.size
    texts = numbers.dropDuplicates(["th"])  # else copies of a text make its words common
    counts = texts.mapInArrow(trimmed(_frequencies(size)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(size + 1)
    for r in counts:
        seen[r["term"]] = r["n"]
    seen, docs = seen[:size], max(1, seen[size])
    weight = np.where(seen <= max(1, STOP_SHARE * docs), np.log((docs + 1) / (seen + 1)) + 1, 0.0)
    weight[0] = 0
    other = float(np.median(weight[weight > 0])) if (weight > 0).any() else 1.0
    flat = np.array([x for _, ids, _ in bench.items for x in ids], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(ids) for _, ids, _ in bench.items])]).astype(np.int64)
    rank = min(RANK + EXTRA, size)
    basis = np.random.default_rng(seed).standard_normal((size, rank))
    scale = None
    for step in range(2):
        if scale is None:  # the trace over a random basis tells how much each part weighs
            own = np.zeros(basis.shape)
            add_products(flat, starts, weight, other, basis, own)
            got = _product(numbers, (flat, starts), 0.0, weight, other, basis)
            scale = max(1.0, SCALE * float(np.linalg.norm(got) / max(np.linalg.norm(own), 1e-9)))
            got += scale * own
        else:
            got = _product(numbers, (flat, starts), scale, weight, other, basis)
        if step == 0:
            basis, _ = np.linalg.qr(got)
        else:
            small = basis.T @ got
            _, turn = np.linalg.eigh((small + small.T) / 2)
            basis = basis @ turn[:, ::-1][:, :RANK]
    return Space(bench, weight, other, basis)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, item_id, cosine, lcs, answer): a row per document and benchmark item that it leaks; th is a hash of the
    document's text.

    Passages of documents whose cosine in the latent space with a passage of an item is MIN_COSINE or more are
    candidates; all passages are held against all items. Items that the space can't hold (Space.reaches) are also
    searched by the words that they share with pieces of documents, exactly. Around a candidate, the longest common subsequence of words must
    reach MIN_LCS of the item and MIN_ANSWER of its answer, or SURE_LCS of the item, so paraphrases that keep most
    words in order are found.

    The benchmark is the query set: its items (texts without words are none) are sent to every task. Words are split
    once; the texts' word numbers are a table in the shared folder that four passes read. Null texts are empty and leak
    nothing; a null id is returned as null; rows that repeat an id each give rows; extra columns are ignored. Empty
    documents or an empty benchmark give an empty result. Whole texts are searched, in passages, however long.
    """
    spark = docs.sparkSession
    items = [(r["item_id"], r["text"]) for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().orderBy("item_id", "text").collect()]
    bench = Benchmark(items)
    if not bench.items:
        return spark.createDataFrame([], MATCH).withColumnRenamed("id", id_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text")
    numbers = save(rows.mapInArrow(trimmed(_numbers(bench.number)), "id long, th long, words binary"), "words")
    return numbers.mapInArrow(trimmed(_matches(fit(numbers, bench))), MATCH).withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that leak an item."""
    with scratch(docs.sparkSession) as keep:
        found = matches(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("th").alias("_th")).distinct()
        found = keep(save(found, "leaks"))
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("id"), F.xxhash64(text_of(docs, text_col)).alias("th"))
    return rows.join(found, rows["id"].eqNullSafe(found["_id"]) & (rows["th"] == found["_th"]), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matches(docs, benchmark).drop("th")
