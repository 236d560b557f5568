"""SentencePiece encoding that keeps each piece's bytes in the original text, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, slices, text_of, trimmed
from .piece_model import PieceModel

MODEL = "piece_bpe_32k.model"
#: Bytes of text that a task holds in the forms between text and ids at a time (one text at least), and words that a
#: worker process keeps the ids of.
SLICE, KEPT_WORDS = 2 << 20, 1_000_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words:
    """Ids of the words that were met, in flat arrays: a word's number gives their range."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.first, self.ids, self.sizes = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words in a row, the normalised bytes that each stands for, and how many ids each word has."""
        if len(self.numbers) > KEPT_WORDS:
            self.clear()
        number = np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            number[missing] = self.add([words[i] for i in missing.tolist()])
        start = self.first[number]
        n = self.first[number + 1] - start
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids[at], self.sizes[at], n

    def add(self, words: list[str]) -> list[int]:
        """Numbers of words that were not met before, of which some may be the same."""
        ids, counts, exact, out, known = [], [], [], [], self.numbers
        for word in words:
            if (number := known.get(word)) is None:
                number = known[word] = len(known)
                own, sizes = self.model.encode(word)
                if sizes is not None:
                    exact.append((len(ids), sizes))
                ids += own
                counts.append(len(own))
            out.append(number)
        new = np.array(ids, np.int32)
        sizes = self.model.sizes[new]
        for at, own in exact:
            sizes[at : at + len(own)] = own
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts, dtype=np.int64)])
        self.ids, self.sizes = np.concatenate([self.ids, new]), np.concatenate([self.sizes, sizes])
        return out


def _encode(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        kept = CACHES.setdefault("pieces", {})
        if kept.get("path") != path:
            with open(path, "rb") as f:
                data = f.read()
            kept.update(path=path, words=_Words(PieceModel(data)), library=sentencepiece.SentencePieceProcessor(model_proto=data))
        known, library = kept["words"], kept["library"]
        for part in (s for b in batches for s in slices(b, SLICE)):
            normal = [known.model.normalise(t.as_py()) for t in part["text"]]
            words = [known.model.words.findall(text.decode()) for text, _ in normal]
            ids, sizes, per_word = known.encoded([w for ws in words for w in ws])
            # where each text's ids begin; texts' places follow each other, with one more a text for its end
            first = np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0, *map(len, words)])]
            place = np.concatenate([np.asarray(place, np.int32) for _, place in normal])
            end = np.cumsum(sizes, dtype=np.int64) + np.repeat(np.arange(len(words)), np.diff(first))
            offsets = pa.array(first, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32())) for c in (ids, place[end - sizes], place[end])]
            flat, to = ids.tolist() if decoded else [], first.tolist()
            back = [library.decode(flat[a:b]) if decoded and b > a else "" if decoded else None for a, b in zip(to, to[1:])]
            yield pa.RecordBatch.from_arrays([part["row"], *lists, pa.array(back, pa.string())], ["row", "ids", "begins", "ends", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """A row per document: id, and for its pieces in order the arrays ids, begins and ends, the bytes of
    the text in UTF-8 that each piece stands for; decoded, the text that the ids give back (null if not asked for).

    Text is normalised by the longest prefix that the model's compiled character map holds, at each place, which records
    where each normalised byte comes from; pieces merge by score within words, as no piece crosses from a word into the
    white space after it (checked when the model is read; else a text is one word); and each piece is projected through
    the record. Ids and spans equal the library's. Spans follow each other and cover the text, but for white space
    that the model squeezes; the mark put before the text has no bytes. Of a character that falls back to bytes, the last
    byte's piece has its span, the others an empty one at its beginning. A byte that is no UTF-8 counts as U+FFFD.

    Null and empty texts have no pieces and decode to the empty text. Null and repeated ids are rows like others, extra
    columns are ignored, an empty table gives an empty result. Texts are encoded whole; a task holds SLICE bytes of them
    at a time, or one text and some 20 times its size. The model's path is read on each executor.
    """
    rows = docs.select(docs[id_col].cast("long").alias("row"), text_of(docs, text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(trimmed(_encode(path or model_path(), decoded), "pieces"), "row long, ids array<int>, begins array<int>, ends array<int>, decoded string")
    return made.select(F.col("row").alias(id_col), "ids", "begins", "ends", "decoded")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c, 256)
    spans = F.aggregate(F.zip_with("begins", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"), spans.alias("span_bytes"))
