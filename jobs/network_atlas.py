"""An atlas of the networks that a table draws: result rows, the graph of their mutations, and what each vector holds.

    python -m jobs.network_atlas --draws PATH --output PATH [--config jobs/network_atlas.json]

Each row of draws (Parquet) picks a network of three nodes: the numbers in the three columns of picks, modulo the number of
threshold functions, give the nodes' functions. Written are

* networks/ by leaves: a result row per different network: the finest vector v_3 .. v_0, bitstrings f_1 .. f_3, weights w_1,1 .. w_3,3 (from node, to node)
  that realize it, cycles, genotypes, robustness, evolvability, draws and degree in the graph;
* edges/ by node: pairs of networks (a, b), numbered f_1 * 65536 + f_2 * 256 + f_3, that one weight of one node parts, a before b;
* vectors/ by leaves: per finest vector its networks, draws and means.

Each table replaces what an earlier run left, so a rerun over the same draws gives the same rows, also after a run that broke off. Draws with a null
pick no network; negative numbers count from the end. Formats are parquet, orc and csv, the latter as result files with a header.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolscope.functions import bits
from boolscope.functions.dialect import Dialect
from boolscope.operators import decomposition, dynamics, graph, networks, sbf
from boolscope.sources import scans
from jobs.common import command_line, config, log, write, wrote

DEFAULTS = {"picks": ["l_orderkey", "l_partkey", "l_suppkey"], "format": "parquet", "compression": "zstd"}
D = 3
NODES = range(1, D + 1)
NAMES = [f"f_{i}" for i in NODES]
WEIGHTS = [f"w_{i},{j}" for i in NODES for j in NODES]


def drawn(q: Dialect, rows: str, picks: list[str]) -> str:
    """(f_1, f_2, f_3, draws): the different networks that the rows of a relation draw."""
    functions = sbf.functions(q, D)
    total = f"(SELECT count(*) FROM {functions} AS n)"
    numbers = f"(SELECT {', '.join(f'pmod({c}, {total}) AS p_{i}' for i, c in enumerate(picks, 1))} FROM {rows} AS r)"
    # numbers are counted before they become functions: all that follows is per network
    once = f"(SELECT {', '.join(f'p_{i}' for i in NODES)}, count(*) AS draws FROM {numbers} AS n GROUP BY {', '.join(f'p_{i}' for i in NODES)})"
    found = scans.drawn_networks(once, functions, [f"draw.p_{i}" for i in NODES])
    return f"SELECT {', '.join(NAMES)}, draws FROM {found} AS d"


def result_rows(q: Dialect, drawn_: str, edges: str) -> str:
    """The result row of each network, with draws and degree."""
    known = decomposition.finest(dynamics.with_attractors(q, drawn_, D), D)
    known = networks.with_statistics(f"(SELECT {', '.join(NAMES)}, draws, code, num_attractors, cycle_len_msq FROM {known} AS k)", sbf.statistics(q, D), D)
    weights = q.named("columns_of_functions_3", f"(SELECT f.tt, w.w_1, w.w_2, w.w_3 FROM {sbf.functions(q, D)} AS f JOIN {scans.weights(q, D)} AS w ON w.id = f.rep)")
    of_node = " ".join(f"JOIN {weights} AS c{j} ON k.f_{j} = c{j}.tt" for j in NODES)
    v = [f"CAST({bits.digit('code', D, k, q.div)} AS BIGINT)" for k in range(D + 1)]
    columns = [f"{v[k]} AS v_{k}" for k in range(D, -1, -1)] + [f"{q.bits(f, 1 << D)} AS {f}" for f in NAMES] + [f"CAST(c{j}.w_{i} AS BIGINT) AS `w_{i},{j}`" for i in NODES for j in NODES]
    columns += ["cycle_len_msq AS CycleLenMSQ", "CAST(num_attractors AS BIGINT) AS NumAttractors", "genotype_count AS GenotypeCount", "robustness_std AS Robustness_std", "robustness_mean AS Robustness_mean", "evolvability AS Evolvability"]
    degree = graph.degrees(edges)
    return f"SELECT {', '.join(columns)}, draws, coalesce(g.degree, 0) AS degree, {' + '.join(v)} AS leaves FROM {known} AS k {of_node} LEFT JOIN {degree} AS g ON g.id = k.f_1 * 65536 + k.f_2 * 256 + k.f_3"


def run(spark: SparkSession, draws: str, output: str, settings: dict | None = None) -> dict:
    """Write the atlas of a table of draws; returns rows read and written."""
    settings = config(DEFAULTS, settings)
    out = {"fmt": settings["format"], "compression": settings["compression"], **({"header": "true"} if settings["format"] == "csv" else {})}
    q, made = Dialect("", spark), []

    def view(df: DataFrame) -> str:
        made.append(f"atlas_{uuid.uuid4().hex}")
        df.createOrReplaceTempView(made[-1])
        return made[-1]

    try:
        read = spark.read.parquet(draws).select(*settings["picks"])
        spark.sql(drawn(q, view(read), settings["picks"])).write.mode("overwrite").parquet(f"{output}/drawn")
        counts = {"draws": read.count()}
        log.info("read %d draws from %s", counts["draws"], draws)
        different = spark.read.parquet(f"{output}/drawn").withColumn("id", F.expr("f_1 * 65536 + f_2 * 256 + f_3"))
        nets = view(different)
        edges = spark.sql(f"SELECT a, b, CASE WHEN a DIV 65536 <> b DIV 65536 THEN 1 WHEN a DIV 256 <> b DIV 256 THEN 2 ELSE 3 END AS node FROM {graph.mutation_edges(nets, sbf.neighbours(q, D), D)} AS e")
        edges = write(edges, f"{output}/edges", ["node"], **out)
        found = write(spark.sql(result_rows(q, nets, view(edges))), f"{output}/networks", ["leaves"], **out)
        of_vector = found.groupBy("leaves", F.concat(F.lit("<"), F.concat_ws(",", *(f"v_{k}" for k in range(D, -1, -1))), F.lit(">")).alias("vector"))
        means = [F.avg(c).alias(f"mean_{c.lower()}") for c in ("Robustness_mean", "Evolvability", "degree")]
        vectors = write(of_vector.agg(F.count("*").alias("networks"), F.sum("draws").alias("draws"), *means), f"{output}/vectors", ["leaves"], **out)
        counts |= {name: wrote(df, f"{output}/{name}") for name, df in (("networks", found), ("edges", edges), ("vectors", vectors))}
    finally:
        for name in made:
            spark.catalog.dropTempView(name)
    return counts


LONGS = ", ".join([*(f"v_{k} bigint" for k in range(D, -1, -1)), *(f"{f} string" for f in NAMES), *(f"`{w}` bigint" for w in WEIGHTS)])
SCHEMAS = {
    "edges": "a bigint, b bigint, node int",
    "networks": f"{LONGS}, CycleLenMSQ double, NumAttractors bigint, GenotypeCount bigint, Robustness_std double, Robustness_mean double, Evolvability bigint, draws bigint, degree bigint, leaves bigint",
    "vectors": "vector string, networks bigint, draws bigint, mean_robustness_mean double, mean_evolvability double, mean_degree double, leaves bigint",
}


def table(spark: SparkSession, output: str, name: str, settings: dict | None = None) -> DataFrame:
    """A table of the atlas, read back."""
    settings = config(DEFAULTS, settings)
    return spark.read.format(settings["format"]).schema(SCHEMAS[name]).options(**({"header": "true"} if settings["format"] == "csv" else {})).load(f"{output}/{name}")


if __name__ == "__main__":
    command_line(__doc__, ["draws", "output"], run)
