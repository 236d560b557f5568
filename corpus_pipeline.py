"""The corpus pipeline: five stages over documents, each by an operator of boolscope.llm.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents. No stage takes a limit, a sample or a subset of its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boolscope.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from boolscope.llm.common import remove, save, saved_path, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or that the weighed rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in several documents stay in the one with the smallest id; n_chars follows the text."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id: texts whose five-word shingles have a
    Jaccard similarity of 0.8 or more, found by deletion variants of several fingerprints and by least hashes.

    The operator's own query keeps its contract, three words and two bits of one fingerprint.
    """
    with small_batches(spark):
        return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of the benchmark go."""
    with small_batches(spark):
        return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    with small_batches(spark):
        return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express the fingerprints, the latent space, the tokenizer or the packing order; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage returns is written as Parquet and read again as the next one's docs."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            remove(spark, last)
        last = saved_path(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
