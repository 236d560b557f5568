"""What the jobs share: configuration, writing, the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("jobs")


def config(defaults: dict, given: dict | None) -> dict:
    """The defaults with what is given; a name that the defaults lack is an error."""
    unknown = set(given or {}) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {**defaults, **(given or {})}


def write(df: DataFrame, path: str, partitions: list[str], fmt: str = "parquet", replace: str = "static", **options: str) -> DataFrame:
    """Write partitioned rows over what is there: all of it, or with replace = dynamic the partitions that the rows have.
    Returns the table as it then is."""
    df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", replace).options(**options).partitionBy(*partitions).save(path)
    return df.sparkSession.read.format(fmt).schema(df.schema).options(**options).load(path)


def wrote(rows: DataFrame, path: str) -> int:
    """Count rows that were written, and log it."""
    n = rows.count()
    log.info("wrote %d rows to %s", n, path)
    return n


def command_line(doc: str, names: list[str], run: Callable[..., dict], argv: list[str] | None = None) -> None:
    """Parse paths and a config file, and run in a session of its own, which ends with the job."""
    p = argparse.ArgumentParser(description=doc)
    for n in names:
        p.add_argument(f"--{n}", required=True)
    p.add_argument("--config", help="JSON file of settings, next to the code or where the driver runs")
    args = p.parse_args(argv)
    settings = None
    if args.config:
        with open(args.config) as f:
            settings = json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        log.info("%s", run(spark, *(getattr(args, n) for n in names), settings))
    finally:
        spark.stop()
