"""Exact line deduplication across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, save, scratch, text_of


def _key_text(text: Column) -> Column:
    """A text in which A-Z is lower-cased, for comparing only.

    The UTF-8 bytes are taken as Latin-1 and lower-cased. That also moves the lead bytes C0-DE of two-byte
    characters to E0-FE, but one continuation byte follows those and two or more follow the leads that are there
    already, so texts are equal after it exactly if they are equal with A-Z lower-cased.
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))


def _held(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc, th, at, a, b): the lines whose keys have min_chars code points, by document, hash of its text and place,
    with 128 bits of hash of the key."""
    lines = rows.select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.where(F.char_length(F.btrim("line", F.lit(SPACE))) >= min_chars)
    key = F.btrim(_key_text(F.col("line")), F.lit(SPACE))
    return lines.select("doc", "th", "at", F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept (the text of the lines that stay), row (a struct of its columns).

    Lines are split at \\n; a key is the line trimmed of ASCII white space with A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs documents lose all their lines but those of the smallest id.

    Null or empty text is one empty line. A null id is returned as null and counts as the largest id. Rows that
    repeat an id count as one document. Other columns are ignored. An empty table gives an empty result.

    Lines are hashed once, into a table of the shared folder. Documents per key are counted by (key, id) first, so a
    line that a third of the documents hold is spread over all tasks; the hot side of the join with the dropped keys is
    split by the adaptive skew join. Documents are then reassembled by the places of the lines that go, in time linear
    in their length.
    """
    rank = F.coalesce(docs[id_col].cast("long"), F.lit(2**63 - 1))
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"), F.struct("*").alias("row"), rank.alias("doc"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    with scratch(docs.sparkSession) as keep:
        held = save(_held(rows, min_chars), "lines")
        common = held.groupBy("a", "b").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("keeper")).where(F.col("n") >= min_docs)
        # one more key than was grouped by: the join then shuffles both sides, so that a hot line can be split
        both_keys = F.col("a").bitwiseXOR(F.col("b")).alias("c")
        lost = held.select("*", both_keys).join(common.select("*", both_keys), ["a", "b", "c"]).where(F.col("doc") != F.col("keeper"))
        lost = keep(save(lost.groupBy("doc", "th").agg(F.collect_set(F.col("at") + 1).alias("lost")), "lost"))
    both = rows.join(lost, ["doc", "th"], "left")
    lines = F.split("text", "\n", -1)
    n = F.size(lines).cast("long")
    stay = let(lines, lambda xs: F.transform(F.array_except(F.sequence(F.lit(1), F.size(xs)), F.col("lost")), lambda i: F.element_at(xs, i)))
    out = both.select("id", "row", n.alias("n_lines"), F.coalesce(F.size("lost").cast("long"), F.lit(0)).alias("n"), F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("kept"))
    return out.select(F.col("id").alias(id_col), "n_lines", F.greatest("n", F.lit(0)).alias("n_dropped"), "kept", "row")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with the lines that stay as text, and its code points in size_col if there is such a column."""
    out = dedup_lines(docs, id_col, text_col)
    new = {text_col: F.col("kept"), size_col: F.char_length("kept").cast("long")}
    return out.select(*(new.get(c, F.col("row")[c]).cast(t).alias(c) for c, t in docs.dtypes))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT a.doc_id, a.line, a.pos, (c.k IS NOT NULL AND c.keeper <> a.doc_id) AS gone FROM keyed a LEFT JOIN common c ON a.k = c.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
