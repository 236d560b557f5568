"""Standing searches over a growing table of dialogue turns.

    python -m jobs.dialogue_watch --turns PATH --output PATH --checkpoint PATH [--config jobs/dialogue_watch.json]

Reads the files of turns (conv_id, turn, role, text) that are new since the checkpoint, and keeps two tables:

* hits/ by batch and search: turns in which a regular expression is found (letters in either case; a search may ask for a role), with the
  number of places and an extract of the squeezed text around the first.
* sessions/ by bucket of conversations: per conversation its turns, characters, first and last turn, turns by role and hits
  by search.

A batch first writes its hits and its own share of the sessions (shares/, by batch and bucket) over what an earlier attempt at the
same batch left, then makes the touched buckets of sessions anew from all shares. So a batch may be repeated at any
point and leaves the same rows. Only new files are read; of older ones only the shares of touched buckets, a row per conversation
and batch. A file that was read isn't read again when its content changes. Other searches need another output folder.

Null texts count as empty, null roles as none of the roles, null conversations as one conversation. Turns that files repeat count as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, config, log, write, wrote

DEFAULTS = {
    "searches": [{"name": "endings", "pattern": "tion", "role": None}, {"name": "articles", "pattern": "the [a-z]+", "role": "user"}],
    "roles": ["system", "user", "assistant"],
    "width": 60,
    "buckets": 16,
    "files_per_batch": 1000,
}
SPACE = "[ \\t\\n\\r]+"


def as_pattern(path: str) -> str:
    """A pattern that only the path itself matches: a stream then takes a single file as well as a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def searched(turns: DataFrame, searches: list[dict], width: int) -> DataFrame:
    """(conv_id, turn, role, search, places, extract) of every turn in which a search finds something."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    rows = turns.select("conv_id", "turn", "role", text.alias("text"))

    def found(s: dict) -> Column:
        pattern = F.lit(f"(?i){s['pattern']}")
        before = F.char_length(F.regexp_extract("text", f"(?is)^(.*?)(?:{s['pattern']})", 1))
        start = F.greatest(before - F.lit(width // 3), F.lit(0))
        cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring("text", start + 1, F.lit(width)), F.when(F.char_length("text") > start + width, "...").otherwise(""))
        asked = F.lit(True) if s.get("role") is None else F.coalesce(F.col("role") == s["role"], F.lit(False))
        places = F.when(asked, F.regexp_count("text", pattern)).otherwise(0).cast("long")
        return F.struct(F.lit(s["name"]).alias("search"), places.alias("places"), cut.alias("extract"))

    hits = rows.select("conv_id", "turn", "role", F.inline(F.array(*map(found, searches))))
    return hits.where("places > 0")


def shares(turns: DataFrame, hits: DataFrame, settings: dict) -> DataFrame:
    """What the turns and hits of a batch add to their conversations."""
    by_role = [F.count_if(F.col("role") == r).alias(f"{r}_turns") for r in settings["roles"]]
    of_turns = turns.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("characters"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), *by_role)
    by_search = [F.sum(F.when(F.col("search") == s["name"], F.col("places")).otherwise(0)).alias(f"{s['name']}_places") for s in settings["searches"]]
    of_hits = hits.groupBy(F.col("conv_id").alias("of")).agg(*by_search)
    both = of_turns.join(of_hits, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return both.fillna(0, [f"{s['name']}_places" for s in settings["searches"]])


def merged(parts: DataFrame) -> DataFrame:
    """Sessions from all their shares."""
    how = {"first_turn": F.min, "last_turn": F.max}
    return parts.groupBy("bucket", "conv_id").agg(*(how.get(c, F.sum)(c).alias(c) for c in parts.columns if c not in ("batch", "bucket", "conv_id")))


def take(batch: DataFrame, number: int, output: str, settings: dict) -> dict:
    """One batch of new turns."""
    turns = batch.select("conv_id", "turn", "role", "text")
    hits = searched(turns, settings["searches"], settings["width"])
    all_hits = write(hits.withColumn("batch", F.lit(number)), f"{output}/hits", ["batch", "search"], replace="dynamic")
    n_hits = wrote(all_hits.where(F.col("batch") == number), f"{output}/hits")
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(settings["buckets"])).cast("int")
    own = shares(turns, hits, settings).withColumn("bucket", bucket).withColumn("batch", F.lit(number))
    every = write(own, f"{output}/shares", ["batch", "bucket"], replace="dynamic")
    mine = every.where(F.col("batch") == number)
    touched = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # at most the number of buckets
    now = write(merged(every.where(F.col("bucket").isin(touched))), f"{output}/sessions", ["bucket"], replace="dynamic")
    wrote(now.where(F.col("bucket").isin(touched)), f"{output}/sessions")
    n_turns = mine.agg(F.coalesce(F.sum("turns"), F.lit(0))).first()[0]
    log.info("batch %d: read %d new turns, %d hits, buckets %s", number, n_turns, n_hits, sorted(touched))
    return {"turns": n_turns, "hits": n_hits}


def run(spark: SparkSession, turns: str, output: str, checkpoint: str, settings: dict | None = None) -> dict:
    """Take what is new under turns; returns how many batches, turns and hits that was. Ends when nothing new is left."""
    settings, done = config(DEFAULTS, settings), []
    schema = spark.read.parquet(turns).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(as_pattern(turns))
    stream = new.writeStream.foreachBatch(lambda df, n: done.append(take(df, n, output, settings))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return {"batches": len(done), "turns": sum(d["turns"] for d in done), "hits": sum(d["hits"] for d in done)}


def result(spark: SparkSession, output: str, settings: dict | None = None, kind: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """The tables as they stand: hits, sessions. kind is the type of conversations."""
    settings = config(DEFAULTS, settings)
    sums = [*(f"{r}_turns" for r in settings["roles"]), *(f"{s['name']}_places" for s in settings["searches"])]
    hits = spark.read.schema(f"conv_id {kind}, turn bigint, role string, places bigint, extract string, batch int, search string").parquet(f"{output}/hits")
    sessions = f"conv_id {kind}, turns bigint, characters bigint, first_turn bigint, last_turn bigint, {', '.join(f'{c} bigint' for c in sums)}, bucket int"
    return hits, spark.read.schema(sessions).parquet(f"{output}/sessions")


if __name__ == "__main__":
    command_line(__doc__, ["turns", "output", "checkpoint"], run)
