"""All queries of the engine by name, and the oracle's SQL for them.

A query is a function of a dialect that returns SQL text over the operators; rows-only ones are functions of (spark,
sf_dir). Networks come from three places: all of a size, the rows of lineitem or orders taken as draws of functions,
and, for layouts and vectors, the embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Dialect, Oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def run_sql(spark: SparkSession, text: Callable[[Dialect], str], sf_dir: str) -> DataFrame:
    return spark.sql(text(Dialect(sf_dir, spark)))


def sql(text: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """Register a query that both engines can run, under its function's name."""
    name = text.__name__
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, text, sf_dir)
    ORACLES[name] = text(Oracle())
    return text


def over_draws(text: Callable[[Dialect], str]) -> None:
    """Register a query over all networks of three nodes once more, over the different ones that a table's rows draw."""
    name = text.__name__.removesuffix("_d3") + "_of_draws"
    assert name not in QUERIES
    QUERIES[name] = lambda spark, sf_dir: spark.sql(text(Dialect(sf_dir, spark, True)))
    ORACLES[name] = text(Oracle(drawn=True))


def rows(made: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query that SQL can't express: iterative, random, or by a Python function."""
    QUERIES[made.__name__] = made
    return made


def paired(oracle: str):
    """Register a query of DataFrame operators with an oracle of its own."""

    def register(made: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[made.__name__] = made
        ORACLES[made.__name__] = oracle
        return made

    return register
