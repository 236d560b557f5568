"""Queries that write files to the shared folder and read them back; the oracle makes the same rows without files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import Dialect, Oracle
from ..operators import decomposition as dec
from ..operators import dynamics as dyn
from ..operators import networks as net
from ..operators import sbf
from ..operators import vectors as vec
from ..sources import files
from . import oracles
from .networks import every
from .registry import paired, run_sql
from .vectors import points, queries


def _result_rows(q: Dialect) -> str:
    """Result rows of the networks of 2 nodes, one per labelled tree."""
    stats = net.with_statistics(dyn.with_attractors(q, dec.decomposed(every(q, 2), 2, True), 2), sbf.statistics(q, 2), 2)
    return f"SELECT CAST(v_2 AS INT) AS v_2, CAST(v_1 AS INT) AS v_1, CAST(v_0 AS INT) AS v_0, tree, round(cycle_len_msq, 9) AS cycles, CAST(num_attractors AS INT) AS attractors, CAST(genotype_count AS BIGINT) AS genotypes, CAST(evolvability AS INT) AS evolvability FROM {stats} AS s"


def _written(spark, sf_dir):
    """The result rows under the names of result files, and the schema of those."""
    schema = files.network_schema(2, tree=True, weights=False)
    made = run_sql(spark, _result_rows, sf_dir)
    columns = ["v_2", "v_1", "v_0", "tree", "cycles", "attractors", "genotypes", F.lit(0.0), F.lit(0.0), "evolvability"]
    return made.select(*(F.col(c).alias(f.name) if isinstance(c, str) else c.alias(f.name) for c, f in zip(columns, schema.fields))), schema


def _read(spark, path, schema):
    return files.read_networks(spark, path, schema).selectExpr("v_2", "v_1", "v_0", "tree", "CycleLenMSQ AS cycles", "NumAttractors AS attractors", "CAST(GenotypeCount AS BIGINT) AS genotypes", "Evolvability AS evolvability")


@paired(_result_rows(Oracle()))
def result_file_round_trip(spark, sf_dir):
    """Result rows through gzipped CSV with a header and quoted trees."""
    made, schema = _written(spark, sf_dir)
    path = files.new_folder(spark, "networks")
    files.write_networks(made, path)
    return _read(spark, path, schema)


@paired(_result_rows(Oracle()))
def torn_trees(spark, sf_dir):
    """Result rows whose trees were written without quotes."""
    made, schema = _written(spark, sf_dir)
    path = files.new_folder(spark, "torn")
    made.select(F.concat_ws(",", *(F.col(f"`{f.name}`") for f in schema.fields)).alias("value")).write.text(path)
    return _read(spark, path, schema)


@paired(f"SELECT a, b, 1.0::DOUBLE AS weight FROM ({oracles.ORACLES['mutation_edges_d2']}) AS e")
def edge_list_round_trip(spark, sf_dir):
    """Mutation edges through an edge list file."""
    from .graphs import mutation_edges_d2

    path = files.new_folder(spark, "edges")
    files.write_edges(run_sql(spark, mutation_edges_d2, sf_dir).withColumn("weight", F.lit(1.0)), 36, path)
    return files.read_edges(spark, path)


@paired("SELECT count(*) AS vectors, round(sum(list_sum(embedding)), 2) AS total, round(sum(embedding[1]), 3) AS first_places FROM embeddings")
def vector_file_round_trip(spark, sf_dir):
    """Vectors through a file of floats."""
    path = files.new_folder(spark, "vectors")
    files.write_vectors(run_sql(spark, lambda q: f"SELECT id, v FROM {points(q)} AS p", sf_dir), 64, path)
    total = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return files.read_vectors(spark, path).agg(F.count("*").alias("vectors"), F.round(F.sum(total), 2).alias("total"), F.round(F.sum(F.col("v")[0].cast("double")), 3).alias("first_places"))


@paired("SELECT label, count(*) AS vectors, CAST(sum(vec_id) AS BIGINT) AS places FROM embeddings GROUP BY label")
def label_file_round_trip(spark, sf_dir):
    """Labels through a file of one a line."""
    path = files.new_folder(spark, "labels")
    labels = run_sql(spark, lambda q: f"SELECT id, label FROM {points(q)} AS p", sf_dir)
    labels.coalesce(1).sortWithinPartitions("id").select(F.col("label").cast("string").alias("value")).write.text(path)
    return files.read_labels(spark, path).groupBy("label").agg(F.count("*").alias("vectors"), F.sum("place").alias("places"))


def _near(q: Dialect) -> str:
    return f"SELECT CAST(a / 100 AS BIGINT) AS a, CAST(place AS BIGINT) AS place, b FROM {vec.nearest(q, queries(q), points(q), 5)} AS n"


@paired(_near(Oracle()))
def neighbour_lists_round_trip(spark, sf_dir):
    """The queries' nearest vectors through a file of lists, a line for each query in order."""
    path = files.new_folder(spark, "neighbours")
    lists = run_sql(spark, _near, sf_dir).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "b"))).alias("x"))
    lists.coalesce(1).sortWithinPartitions("a").select(F.array_join(F.transform("x", lambda r: r["b"].cast("string")), " ").alias("value")).write.text(path)
    return files.read_neighbours(spark, path)


@paired("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y FROM embeddings")
def layout_file_round_trip(spark, sf_dir):
    """Places through a layout file."""
    from .vectors import plane

    path = files.new_folder(spark, "layout")
    files.write_layout(run_sql(spark, lambda q: f"SELECT id, x, y FROM {plane(q)} AS p", sf_dir), path)
    return files.read_layout(spark, path)


@paired(f"WITH e AS ({oracles.ORACLES['mutation_edges_d2']}) SELECT id, count(*) AS degree, CAST(sum(other) AS BIGINT) AS others FROM (SELECT a AS id, b AS other FROM e UNION ALL SELECT b, a FROM e) AS x GROUP BY id")
def embedded_vertices(spark, sf_dir):
    """Vertices with their neighbours as JSON, parsed again."""
    from .graphs import mutation_edges_d2, pairs

    made = files.embedded_json(run_sql(spark, lambda q: f"SELECT id FROM {pairs(q)} AS p", sf_dir), run_sql(spark, mutation_edges_d2, sf_dir))
    back = made.select(F.from_json("value", "id long, near array<long>").alias("r")).select("r.*")
    return back.select("id", F.size("near").cast("long").alias("degree"), F.aggregate("near", F.lit(0).cast("long"), lambda s, x: s + x).alias("others"))


@paired("SELECT * FROM (VALUES ('networks', TRUE), ('edges', TRUE), ('orbits', FALSE)) AS t(step, ok)")
def run_summary(spark, sf_dir):
    """A run's table of expected and obtained values, from its text: two counts that agree and one that is stated wrong."""
    n = run_sql(spark, lambda q: f"SELECT count(*) AS n FROM {every(q, 3)} AS n", sf_dir).first()["n"]
    _, table = files.summary({"networks": {"expected": 32 ** 3, "obtained": n}, "edges": {"expected": 1, "obtained": 1}, "orbits": {"expected": 10, "obtained": 11}})
    lines = spark.createDataFrame([(x,) for x in table.splitlines()[2:]], "line string")
    return lines.select(F.trim(F.split("line", "[|]")[1]).alias("step"), (F.trim(F.split("line", "[|]")[4]) == "yes").alias("ok"))
