"""Readers and writers of network tables, edge lists, vectors, layouts, solver answers and dialogues."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the one that the cluster names in spark.checkpoint.dir. Where none is named, in a temporary
    one in local mode; on a cluster that is an error, as executors would write to their own disks."""
    sc = spark.sparkContext
    to = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not to:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        to = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(to)
    return f"{to.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def network_schema(d: int, tree: bool = False, weights: bool = True) -> T.StructType:
    """The columns of a result file of d nodes; with weights, functions as bitstrings and the weights too."""
    fields = [(f"v_{k}", T.IntegerType()) for k in range(d, -1, -1)]
    fields += [("tree", T.StringType())] if tree else []
    if weights:
        fields += [(f"f_{i}", T.StringType()) for i in range(1, d + 1)]
        fields += [(f"w_{i},{j}", T.IntegerType()) for i in range(1, d + 1) for j in range(1, d + 1)]
    fields += [("CycleLenMSQ", T.DoubleType()), ("NumAttractors", T.IntegerType()), ("GenotypeCount", T.DecimalType(38, 0)), ("Robustness_std", T.DoubleType()), ("Robustness_mean", T.DoubleType()), ("Evolvability", T.IntegerType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def read_networks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result file or folder, gzipped or not. Trees that were written without quotes, so that their commas tear them
    apart, are put together again: a row with more fields than columns gives the surplus to the tree."""
    names = [f.name for f in schema.fields]
    lines = spark.read.text(path).where(~F.col("value").startswith("v_") & (F.length("value") > 0))
    if "tree" not in names:
        parsed = lines.select(F.from_csv("value", _ddl(schema)).alias("r"))
        return parsed.select("r.*")
    before, after = names.index("tree"), len(names) - names.index("tree") - 1
    parts = F.split(F.regexp_replace("value", '"', ""), ",")
    tree = F.array_join(F.slice(parts, before + 1, F.size(parts) - before - after), ",")
    fields = [F.get(parts, F.lit(i)) for i in range(before)] + [tree] + [F.get(parts, F.size(parts) - after + i) for i in range(after)]
    return lines.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(fields, schema.fields)))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def write_networks(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.csv(path, header=True, compression="gzip" if compress else "none", quote='"')


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, weight) of an edge list whose first line holds its sizes."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) == 3)
    return rows.select(parts[0].cast("long").alias("a"), parts[1].cast("long").alias("b"), parts[2].cast("double").alias("weight"))


def write_edges(edges: DataFrame, vertices: int, path: str) -> None:
    head = edges.agg(F.concat_ws(" ", F.lit(vertices), F.count("*")).alias("value"))
    body = edges.select(F.concat_ws(" ", "a", "b", "weight").alias("value"))
    head.withColumn("o", F.lit(0)).unionByName(body.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(v array<float>) of a vector file whose first line holds number and size."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(parts) > 2).select(parts.cast("array<float>").alias("v"))


def write_vectors(vectors: DataFrame, size: int, path: str) -> None:
    """A vector file: a line of number and size, then a line per vector in order of id."""
    head = vectors.agg(F.concat_ws(" ", F.count("*"), F.lit(size)).alias("value")).withColumn("id", F.lit(-1).cast("long"))
    body = vectors.select(F.array_join(F.transform("v", lambda x: x.cast("string")), " ").alias("value"), F.col("id").cast("long").alias("id"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("id").select("value").write.text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(place, label) of a label file: an integer a line, that of the vector in the same place."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("place", "label"))
    return rows.select(F.col("place").cast("long").alias("place"), F.col("label").cast("int").alias("label"))


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(a, place, b) of saved lists of nearest neighbours: in line a the numbers of its neighbours, the nearest first."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("a", "line"))
    near = lines.where("trim(line) <> ''").select("a", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("place", "b"))
    return near.select(F.col("a").cast("long").alias("a"), (F.col("place") + 1).cast("long").alias("place"), F.col("b").cast("long").alias("b"))


def write_layout(places: DataFrame, path: str) -> None:
    places.select(F.format_string("%d %.6f %.6f", "id", "x", "y").alias("value")).write.text(path)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].cast("long").alias("id"), parts[1].cast("double").alias("x"), parts[2].cast("double").alias("y"))


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """(type, timestamp, text) of JSON lines; lines that don't parse are skipped, blocks in tags taken out."""
    schema = "type string, timestamp string, message struct<content:string>, _corrupt string"
    rows = spark.read.json(path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    rows = rows.where("_corrupt is null and type in ('user', 'assistant') and message.content is not null")
    return rows.select("type", "timestamp", F.regexp_replace("message.content", r"(?s)<(\w+)>.*?</\1>", "").alias("text"))


def answers(text: DataFrame, d: int) -> DataFrame:
    """(f_1 .. f_d, w_1_1 .. w_d_d) of solver answers, one in each value: atoms transition_function_bit(node,state) for the
    states where a node's function is 1, weights as w(i,j)=v, and sigma(a,b), the new number b of node a.

    Functions are given in new numbers and weights in old ones, so weights are renumbered, rows and columns; without a
    sigma of all nodes they are left. Weights that aren't given are 0.
    """

    def found(pattern: str, group: int):
        return F.regexp_extract_all("value", F.lit(pattern), F.lit(group))

    one, pair, weight, sigma = F.lit(1).cast("long"), r"transition_function_bit\((\d+,\d+)\)", r"w\((\d+,\d+)\)=(-?\d+)", r"sigma\((\d+),(\d+)\)"
    rows = text.select(found(pair, 1).alias("ones"), F.map_from_arrays(found(weight, 1), found(weight, 2)).alias("given"), F.map_from_arrays(found(sigma, 2), found(sigma, 1)).alias("old"))

    def table(node: int):
        states = F.filter("ones", lambda x: F.startswith(x, F.lit(f"{node},")))
        return F.aggregate(states, F.lit(0).cast("long"), lambda s, x: s + F.call_function("shiftleft", one, F.split(x, ",")[1].cast("int")))

    def old(node: int):
        return F.when(F.size("old") == d, F.try_element_at("old", F.lit(str(node)))).otherwise(str(node))

    nodes = range(1, d + 1)
    weights = [F.coalesce(F.try_element_at("given", F.concat_ws(",", old(i), old(j))).cast("int"), F.lit(0)).alias(f"w_{i}_{j}") for i in nodes for j in nodes]
    return rows.select(*(table(i).alias(f"f_{i}") for i in nodes), *weights)


def embedded_json(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per vertex as JSON with its neighbours, as pages embed it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("near"))
    rows = vertices.join(near, vertices["id"] == near["a"], "left").drop("a")
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def summary(steps: dict[str, dict]) -> tuple[str, str]:
    """A run's manifest as JSON and its expected and obtained values as a Markdown table."""
    lines = ["| step | expected | obtained | ok |", "|-|-|-|-|"]
    lines += [f"| {k} | {v.get('expected')} | {v.get('obtained')} | {'yes' if v.get('expected') == v.get('obtained') else 'no'} |" for k, v in steps.items()]
    return json.dumps(steps, sort_keys=True), "\n".join(lines)
