"""Queries over graphs of networks: edges, components, distances, sampling, layouts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import bits
from ..functions.dialect import Dialect
from ..operators import clusters
from ..operators import decomposition as dec
from ..operators import dynamics as dyn
from ..operators import graph, layout
from ..operators import networks as net
from ..operators import sampling, sbf
from . import oracles
from .networks import drawn_once, every, vector
from .registry import paired, rows, run_sql, sql

PAIR = "f_1 * 16 + f_2"


def pairs(q: Dialect) -> str:
    return f"(SELECT {PAIR} AS id, f_1, f_2 FROM {every(q, 2)} AS n)"


def triples(q: Dialect) -> str:
    return f"(SELECT f_1 * 65536 + f_2 * 256 + f_3 AS id, f_1, f_2, f_3 FROM {drawn_once(q)} AS n)"


def pair_edges(q: Dialect) -> str:
    return graph.mutation_edges(pairs(q), sbf.neighbours(q, 2), 2)


@sql
def mutation_edges_d2(q):
    return f"SELECT a, b FROM {pair_edges(q)} AS e"


@sql
def mutation_edge_count_d3(q):
    v = f"(SELECT f_1 * 65536 + f_2 * 256 + f_3 AS id, f_1, f_2, f_3 FROM {every(q, 3)} AS n)"
    return f"SELECT count(*) AS edges FROM {graph.mutation_edges(v, sbf.neighbours(q, 3), 3)} AS e"


@sql
def draw_degrees(q):
    """Degrees of the drawn networks in their own mutation graph."""
    return f"SELECT degree, count(*) AS networks FROM {graph.degrees(graph.mutation_edges(triples(q), sbf.neighbours(q, 3), 3))} AS d GROUP BY degree"


@sql
def mean_degree_of_draws(q):
    e = graph.mutation_edges(triples(q), sbf.neighbours(q, 3), 3)
    return f"SELECT e.edges, v.networks, round(2.0 * e.edges / v.networks, 6) AS mean_degree FROM (SELECT count(*) AS edges FROM {e} AS e) AS e CROSS JOIN (SELECT count(*) AS networks FROM {triples(q)} AS t) AS v"


@sql
def two_hops_d2(q):
    return f"SELECT a, b, CAST(hops AS BIGINT) AS hops FROM {graph.hops(pair_edges(q), 2)} AS h"


def rare(q: Dialect) -> str:
    """Networks of few genotypes: their mutation graph is in pieces."""
    stats = net.with_statistics(pairs(q), sbf.statistics(q, 2), 2)
    return f"(SELECT id, f_1, f_2 FROM {stats} AS s WHERE genotype_count <= 2)"


def _components_oracle() -> str:
    from ..functions.dialect import Oracle

    q = Oracle()
    e = graph.mutation_edges(rare(q), sbf.neighbours(q, 2), 2)
    return f"""WITH RECURSIVE v AS (SELECT id FROM {rare(q)} AS r), e AS (SELECT a, b FROM {e} AS x UNION SELECT b, a FROM {e} AS y),
    reach(id, root) AS (SELECT id, id FROM v UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id)
    SELECT id, min(root) AS component FROM reach GROUP BY id"""


@paired(_components_oracle())
def components_of_rare_networks(spark, sf_dir):
    vertices = run_sql(spark, lambda q: f"SELECT id FROM {rare(q)} AS r", sf_dir)
    edges = run_sql(spark, lambda q: f"SELECT a, b FROM {graph.mutation_edges(rare(q), sbf.neighbours(q, 2), 2)} AS e", sf_dir)
    return graph.components(vertices, edges)


@rows
def components_of_draws(spark, sf_dir):
    """Components of the drawn networks' mutation graph: sizes, the giant's share."""
    vertices = run_sql(spark, lambda q: f"SELECT id FROM {triples(q)} AS t", sf_dir)
    edges = run_sql(spark, lambda q: f"SELECT a, b FROM {graph.mutation_edges(triples(q), sbf.neighbours(q, 3), 3)} AS e", sf_dir)
    sizes = graph.components(vertices, edges).groupBy("component").agg(F.count("*").alias("networks"))
    return sizes.agg(F.count("*").alias("components"), F.max("networks").alias("giant"), (F.max("networks") / F.sum("networks")).alias("giant_share"), F.sum(F.when(F.col("networks") == 1, 1).otherwise(0)).alias("isolated"))


def cycles(q: Dialect) -> str:
    """(id, s, size, seq): for each state of each network of 2 nodes the cycle that it leads to, twice around."""
    limits = f"(SELECT *, {PAIR} AS id, {dyn.limit_states(q, 2)} AS lim FROM {dyn.with_cycles(q, every(q, 2), 2)} AS c)"
    parts = []
    for s in range(4):
        at = q.at("lim", s)
        seq = q.array([f"CAST({at} AS BIGINT)", *(f"CAST({q.at(f't_{(k - 1) % 4 + 1}', at) if k <= 4 else q.at(f't_{k - 4}', q.at('t_4', at))} AS BIGINT)" for k in range(1, 8))])
        parts.append(f"SELECT id, {s} AS s, {q.at('cycle', at)} AS size, {seq} AS seq FROM {limits} AS n{s}")
    return f"({' UNION ALL '.join(parts)})"


def distances(q: Dialect) -> str:
    """(id_1, id_2, dda): distances of all pairs of networks of 2 nodes by the cycles that states lead to."""
    return f"(SELECT x.id AS id_1, y.id AS id_2, CAST(sum({graph.cycle_distance(q, 4)}) AS BIGINT) AS dda FROM {cycles(q)} AS x JOIN {cycles(q)} AS y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id)"


def hamming(q: Dialect) -> str:
    return f"(SELECT x.id AS id_1, y.id AS id_2, {q.ones(q.xor('x.f_1', 'y.f_1'))} + {q.ones(q.xor('x.f_2', 'y.f_2'))} AS far FROM {pairs(q)} AS x JOIN {pairs(q)} AS y ON x.id < y.id)"


@sql
def attractor_distances_d2(q):
    return f"SELECT id_1, id_2, dda FROM {distances(q)} AS d"


@sql
def attractor_distances_within_d2(q):
    return f"SELECT dda, count(*) AS pairs FROM {distances(q)} AS d WHERE dda <= 3 GROUP BY dda"


@sql
def distance_graph_with_vectors_d2(q):
    """Edges of close networks with both ends' finest vectors."""
    v = f"(SELECT {PAIR} AS id, {vector(q, 'code', 2)} AS vector FROM {dec.finest(every(q, 2), 2)} AS n)"
    return f"SELECT d.id_1, d.id_2, d.dda, a.vector AS vector_1, b.vector AS vector_2 FROM {distances(q)} AS d JOIN {v} AS a ON d.id_1 = a.id JOIN {v} AS b ON d.id_2 = b.id WHERE d.dda <= 2"


@sql
def two_distance_graph_d2(q):
    """Edges close by functions and not far by attractors; identical attractors weigh 3, others the inverse."""
    return f"SELECT h.id_1, h.id_2, CASE WHEN d.dda = 0 THEN 3.0E0 ELSE round(1.0E0 / d.dda, 9) END AS weight FROM {hamming(q)} AS h JOIN {distances(q)} AS d ON h.id_1 = d.id_1 AND h.id_2 = d.id_2 WHERE h.far <= 2 AND d.dda <= 4"


@sql
def positions_back_to_draws(q):
    """Every draw with the place of its network on a circle; networks out of the giant class have none."""
    from .networks import drawn

    numbered = f"(SELECT f_1, f_2, f_3, row_number() OVER (ORDER BY f_1, f_2, f_3) - 1 AS i, count(*) OVER () AS n FROM {dec.finest(drawn_once(q), 3)} AS x WHERE code <> {bits.leaf_code(3, 3)})"
    circle = f"(SELECT *, round(cos(2 * pi() * i / n), 6) + 0E0 AS x, round(sin(2 * pi() * i / n), 6) + 0E0 AS y FROM {numbered} AS p)"
    return f"SELECT d.l_orderkey, d.l_linenumber, c.x AS metagraph_x, c.y AS metagraph_y FROM {drawn(q)} AS d LEFT JOIN {circle} AS c ON d.f_1 = c.f_1 AND d.f_2 = c.f_2 AND d.f_3 = c.f_3"


@sql
def edge_similarities_d2(q):
    """exp(-weight), scaled so that all add up to the number of vertices."""
    e = f"(SELECT id_1, id_2, exp(-CAST(dda AS DOUBLE)) AS s FROM {distances(q)} AS d WHERE dda <= 3)"
    return f"SELECT id_1, id_2, round(s * 36 / sum(s) OVER (), 9) AS similarity FROM {e} AS e"


@sql
def symmetrised_edges_d2(q):
    """Directed edges made symmetric: the mean of both directions, a missing one counting 0."""
    one = f"(SELECT id_1 AS a, id_2 AS b, CAST(dda AS DOUBLE) AS w FROM {distances(q)} AS d WHERE (id_1 + id_2) % 3 <> 0 UNION ALL SELECT id_2 AS a, id_1 AS b, CAST(dda AS DOUBLE) + 1 AS w FROM {distances(q)} AS e WHERE (id_1 + id_2) % 3 <> 1)"
    return f"SELECT coalesce(x.a, y.b) AS a, coalesce(x.b, y.a) AS b, (coalesce(x.w, 0) + coalesce(y.w, 0)) / 2 AS w FROM {one} AS x FULL OUTER JOIN {one} AS y ON x.a = y.b AND x.b = y.a"


@sql
def negative_sampling_weights_d2(q):
    return f"SELECT id, round(power(CAST(degree AS DOUBLE), 0.75), 9) AS weight FROM {graph.degrees(pair_edges(q))} AS d"


@sql
def hypercube_edges_d4(q):
    return f"SELECT CAST(s AS BIGINT) AS a, CAST(s + (CAST(1 AS BIGINT) << CAST(b AS INT)) AS BIGINT) AS b FROM range(16) AS states(s) CROSS JOIN range(4) AS nodes(b) WHERE (s & (CAST(1 AS BIGINT) << CAST(b AS INT))) = 0"


@sql
def circle_layout_d2(q):
    n = f"(SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM {pairs(q)} AS p)"
    return f"SELECT id, round(cos(2 * pi() * i / n), 6) + 0E0 AS x, round(sin(2 * pi() * i / n), 6) + 0E0 AS y FROM {n} AS c"


@sql
def layout_stress_d2(q):
    """Stress of the circle against hops: the best scale, then the mean squared error."""
    n = f"(SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM {pairs(q)} AS p)"
    xy = f"(SELECT id, cos(2 * pi() * i / n) AS x, sin(2 * pi() * i / n) AS y FROM {n} AS c)"
    far = f"(SELECT h.hops, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM {graph.hops(pair_edges(q), 3)} AS h JOIN {xy} AS a ON h.a = a.id JOIN {xy} AS b ON h.b = b.id)"
    scale = f"(SELECT sum(d / hops) / sum(d * d / (hops * hops)) AS alpha FROM {far} AS f)"
    return f"SELECT round(max(alpha), 6) AS alpha, round(avg(power(alpha * d - hops, 2) / (hops * hops)), 6) AS stress, count(*) AS pairs FROM {far} AS f CROSS JOIN {scale} AS s"


@sql
def neighbourhood_preservation_d2(q):
    """Mean Jaccard share of a vertex's neighbours and its nearest places in the layout, as many as it has neighbours."""
    n = f"(SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM {pairs(q)} AS p)"
    xy = f"(SELECT id, cos(2 * pi() * i / n) AS x, sin(2 * pi() * i / n) AS y FROM {n} AS c)"
    deg = graph.degrees(pair_edges(q))
    near = f"(SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(power(a.x - b.x, 2) + power(a.y - b.y, 2), 9), b.id) AS place FROM {xy} AS a JOIN {xy} AS b ON a.id <> b.id)"
    both = f"(SELECT a, b FROM {pair_edges(q)} AS e UNION SELECT b AS a, a AS b FROM {pair_edges(q)} AS e2)"
    hit = f"(SELECT n.a, count(*) AS hits FROM {near} AS n JOIN {deg} AS d ON n.a = d.id JOIN {both} AS e ON e.a = n.a AND e.b = n.b WHERE n.place <= d.degree GROUP BY n.a)"
    return f"SELECT round(avg(coalesce(h.hits, 0) / CAST(2 * d.degree - coalesce(h.hits, 0) AS DOUBLE)), 6) AS preservation, count(*) AS vertices FROM {deg} AS d LEFT JOIN {hit} AS h ON h.a = d.id"


@sql
def layout_divergence_d2(q):
    """Divergence of the edges' shares from those of a heavy-tailed kernel of the circle's distances."""
    n = f"(SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM {pairs(q)} AS p)"
    xy = f"(SELECT id, cos(2 * pi() * i / n) AS x, sin(2 * pi() * i / n) AS y FROM {n} AS c)"
    s = f"(SELECT d.id_1, d.id_2, exp(-CAST(d.dda AS DOUBLE)) AS w, 1 / (1 + power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS l FROM {distances(q)} AS d JOIN {xy} AS a ON d.id_1 = a.id JOIN {xy} AS b ON d.id_2 = b.id)"
    p = f"(SELECT w / sum(w) OVER () AS ns, l / sum(l) OVER () AS lp FROM {s} AS s)"
    return f"SELECT round(sum(ns * ln(ns / lp)), 6) AS divergence FROM {p} AS p"


# --- graphs of the 32,768 networks of 3 nodes


def cube_nets(q: Dialect) -> str:
    return f"(SELECT f_1 * 65536 + f_2 * 256 + f_3 AS id, f_1, f_2, f_3 FROM {every(q, 3)} AS n)"


def cube_edges(q: Dialect) -> str:
    return graph.mutation_edges(cube_nets(q), sbf.neighbours(q, 3), 3)


def cube_cycles(q: Dialect, networks: str | None = None) -> str:
    """(id, s, size, seq): for each state of each network of 3 nodes (default: all) the cycle that it leads to, twice around."""
    limits = f"(SELECT *, f_1 * 65536 + f_2 * 256 + f_3 AS id, {dyn.limit_states(q, 3)} AS lim FROM {dyn.with_cycles(q, networks or every(q, 3), 3)} AS c)"
    steps = [f"t_{k}" for k in range(1, 9)]
    each = f"SELECT id, s, {q.at('cycle', 'at')} AS size, {q.array(['at', *(f'CAST({q.at(t, "at")} AS BIGINT)' for t in steps), *(f'CAST({q.at(t, q.at("t_8", "at"))} AS BIGINT)' for t in steps[:7])])} AS seq"
    return "(" + each + f" FROM (SELECT n.*, CAST({q.at('lim', 's')} AS BIGINT) AS at, s FROM {limits} AS n CROSS JOIN range(8) AS states(s)) AS l)"


def cube_distances(q: Dialect) -> str:
    """(a, b, dda): distances by attractors of all networks of 3 nodes that a mutation parts."""
    return f"(SELECT e.a, e.b, CAST(sum({graph.cycle_distance(q, 8)}) AS BIGINT) AS dda FROM {cube_edges(q)} AS e JOIN {cube_cycles(q)} AS x ON x.id = e.a JOIN {cube_cycles(q)} AS y ON y.id = e.b AND y.s = x.s GROUP BY e.a, e.b)"


@sql
def mutation_degrees_d3(q):
    return f"SELECT degree, count(*) AS networks FROM {graph.degrees(cube_edges(q))} AS d GROUP BY degree"


@rows
def attractor_distances_of_mutations_d3(spark, sf_dir):
    """Distances by attractors along all 451,584 mutation edges of 3 nodes; tests hold single edges against the definition."""
    return run_sql(spark, lambda q: f"SELECT dda, count(*) AS edges FROM {cube_distances(q)} AS d GROUP BY dda", sf_dir)


@paired(oracles.CLOSE_ATTRACTORS)
def close_attractors_of_draws(spark, sf_dir):
    """All pairs of drawn networks whose attractors are at most 2 apart: how many at each distance."""
    cycles = graph.shared(run_sql(spark, lambda q: f"SELECT * FROM {cube_cycles(q, drawn_once(q))} AS c", sf_dir))
    name = _view(cycles)
    try:
        found = graph.shared(run_sql(spark, lambda q: f"SELECT * FROM {graph.profiles(q, name)} AS p", sf_dir))
        table = graph.shared(run_sql(spark, lambda q: f"SELECT * FROM {graph.cycle_table(q, name)} AS t", sf_dir))
    finally:
        spark.catalog.dropTempView(name)
    size = found.select(F.concat_ws("|", "profile").alias("name"), "networks")
    apart = graph.close_profiles(found, table, 8, 2)
    for end in ("a", "b"):
        apart = apart.join(size.select(F.col("name").alias(end), F.col("networks").alias(f"n_{end}")), end)
    pairs = apart.select("dda", (F.col("n_a") * F.col("n_b")).alias("pairs")).unionByName(found.select(F.lit(0).cast("bigint").alias("dda"), F.expr("networks * (networks - 1) DIV 2").alias("pairs")))
    return pairs.groupBy("dda").agg(F.sum("pairs").alias("pairs"))


@rows
def edge_similarities_d3(spark, sf_dir):
    """exp(-distance) along mutation edges, scaled so that all add up to the number of vertices; a row per vertex and kind of
    distance."""
    return run_sql(spark, lambda q: f"SELECT a, dda, count(*) AS edges, round(sum(exp(-CAST(dda AS DOUBLE))) * 32768 / max(total), 9) AS similarity FROM {cube_distances(q)} AS d CROSS JOIN (SELECT sum(exp(-CAST(dda AS DOUBLE))) AS total FROM {cube_distances(q)} AS t) AS t GROUP BY a, dda", sf_dir)


@sql
def negative_table_d2(q):
    """Vertices by their weight in negative sampling, with the ends of their ranges of the running sum."""
    weights = f"(SELECT id, power(CAST(degree AS DOUBLE), 0.75) AS w FROM {graph.degrees(pair_edges(q))} AS d)"
    return f"SELECT id, round(coalesce(sum(w) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS lo, round(sum(w) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING), 9) AS hi FROM {weights} AS w"


@rows
def negative_draws_d2(spark, sf_dir):
    """20,000 vertices drawn by their weights: a number is looked up in the running sums."""
    table = F.broadcast(run_sql(spark, negative_table_d2, sf_dir))  # 36 rows
    total = table.agg(F.max("hi")).first()[0]
    draws = spark.range(20_000).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 40)) / (1 << 40) * total).alias("u"))
    return draws.join(table, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("id").agg(F.count("*").alias("drawn"))


# --- sampling and iterative operators


def _draw_weights(q: Dialect) -> str:
    """(id, w): drawn networks with their weights in negative sampling."""
    return f"SELECT id, power(CAST(degree AS DOUBLE), 0.75) AS w FROM {graph.degrees(graph.mutation_edges(triples(q), sbf.neighbours(q, 3), 3))} AS d"


@paired(f"""WITH {oracles._columns(3, 2)}, {oracles._neutral(3)}, {oracles._DRAWS},
    near AS ({" UNION ALL ".join(f"SELECT x.f_1, x.f_2, x.f_3 FROM networks AS x JOIN neighbours AS n ON n.src = x.f_{k} JOIN networks AS y ON {' AND '.join(f'y.f_{j} = ' + ('n.dst' if j == k else f'x.f_{j}') for j in (1, 2, 3))}" for k in (1, 2, 3))})
    SELECT f_1 * 65536 + f_2 * 256 + f_3 AS id, round(power(count(*), 0.75), 6) AS w FROM near GROUP BY f_1, f_2, f_3""")
def alias_table_of_draws(spark, sf_dir):
    """The weights of the drawn networks as an alias table gives them back."""
    return sampling.masses(sampling.alias_table(run_sql(spark, _draw_weights, sf_dir), 2_000)).select("id", F.round("w", 6).alias("w"))


@rows
def negative_draws_of_draws(spark, sf_dir):
    """As many draws by these weights as there are drawn networks, by an alias table: how often each comes."""
    weights = graph.shared(run_sql(spark, _draw_weights, sf_dir))
    table = graph.shared(sampling.alias_table(weights, 2_000))
    return sampling.draws(spark, table, weights.count(), 11).groupBy("id").agg(F.count("*").alias("drawn"))


def _table(spark, d: int):
    return run_sql(spark, lambda q: f"SELECT * FROM {sbf.functions(q, d)} AS f", "")


def _view(df) -> str:
    """The rows as a table in the shared folder, by a name of its own."""
    name = f"drawn_{uuid.uuid4().hex}"
    graph.shared(df).createOrReplaceTempView(name)
    return name


@rows
def variety_sample_d4(spark, sf_dir):
    """10,000 different networks of 4 nodes with their statistics."""
    names = ", ".join(f"f_{i}" for i in range(1, 5))
    draws = _view(graph.variety_draws(spark, _table(spark, 4), 4, 10_000))
    return run_sql(spark, lambda q: f"SELECT {names}, genotype_count, robustness_mean, robustness_std, evolvability FROM {net.with_statistics(draws, sbf.statistics(q, 4), 4)} AS n", sf_dir)


@rows
def variety_rows_d4(spark, sf_dir):
    """100,000 different networks of 4 nodes as result rows: finest vectors, cycles and all statistics."""
    draws = graph.variety_draws(spark, _table(spark, 4), 4, 100_000)  # a total order ends in one partition; deal it out again
    drawn = _view(draws.repartition(spark.sparkContext.defaultParallelism, "f_1", "f_2"))

    def text(q: Dialect) -> str:
        names = ", ".join(f"f_{i}" for i in range(1, 5))
        cycles = f"(SELECT {names}, num_attractors, cycle_len_msq FROM {dyn.with_attractors(q, drawn, 4)} AS c)"
        vectors = f"(SELECT {names}, num_attractors, cycle_len_msq, code FROM {dec.finest(cycles, 4)} AS v)"
        bitstrings = ", ".join(q.bits(f"f_{i}", 16) + f" AS f_{i}" for i in range(1, 5))
        return f"SELECT {vector(q, 'code', 4)} AS vector, {bitstrings}, cycle_len_msq, num_attractors, genotype_count, robustness_std, robustness_mean, evolvability FROM {net.with_statistics(vectors, sbf.statistics(q, 4), 4)} AS s"

    return run_sql(spark, text, sf_dir)


@rows
def genotype_sample_d3(spark, sf_dir):
    return graph.variety_draws(spark, _table(spark, 3), 3, 2_000, by_genotype=True)


@rows
def prototype_sample_d3(spark, sf_dir):
    """Networks of one vector's class: two functions are forced to projections, and the vector then checked."""
    forced = graph.variety_draws(spark, _table(spark, 3), 3, 2_000).select(F.lit(bits.projection(3, 3)).cast("long").alias("f_3"), "f_1", F.lit(bits.projection(3, 2)).cast("long").alias("f_2"))
    prototypes = _view(forced.distinct())
    return run_sql(spark, lambda q: f"SELECT f_1, f_2, f_3 FROM {dec.finest(prototypes, 3)} AS n WHERE code = {4 * bits.leaf_code(3, 1)}", sf_dir)


@rows
def metropolis_walk_d3(spark, sf_dir):
    seeds = run_sql(spark, lambda q: f"SELECT row_number() OVER (ORDER BY f_1, f_2, f_3) AS chain, f_1, f_2, f_3 FROM (SELECT f_1, f_2, f_3 FROM {dec.finest(drawn_once(q), 3)} AS x WHERE code = {4 * bits.leaf_code(3, 1)}) AS n", sf_dir).selectExpr("CAST(chain AS BIGINT) AS chain", "f_1", "f_2", "f_3")
    return graph.metropolis_walks(seeds, run_sql(spark, lambda q: f"SELECT * FROM {sbf.neighbours(q, 3)} AS n", sf_dir), 3, 50)


@rows
def frontier_from_core_d3(spark, sf_dir):
    """The most decomposed drawn networks, then layers of their mutants among the draws."""
    base = bits.code_base(3) ** 4
    seeds = run_sql(spark, lambda q: f"SELECT f_1 * 65536 + f_2 * 256 + f_3 AS id FROM {dec.finest(drawn_once(q), 3)} AS n ORDER BY code DIV {base} DESC, id LIMIT 10", sf_dir)
    edges = run_sql(spark, lambda q: f"SELECT a, b FROM {graph.mutation_edges(triples(q), sbf.neighbours(q, 3), 3)} AS e", sf_dir)
    return graph.frontier(seeds, edges, 500, 4)


def _weighted(spark, sf_dir):
    edges = run_sql(spark, lambda q: f"SELECT id_1 AS a, id_2 AS b, 1.0D / (1 + dda) AS weight FROM {distances(q)} AS d WHERE dda <= 3", sf_dir)
    return edges.withColumn("component", F.lit(0).cast("long"))


@rows
def spring_layout_d2(spark, sf_dir):
    return graph.spring_layout(_weighted(spark, sf_dir))


@rows
def sampled_layout_d2(spark, sf_dir):
    return graph.sampled_layout(_weighted(spark, sf_dir))


@rows
def coarsened_graph_d2(spark, sf_dir):
    return graph.coarsened(_weighted(spark, sf_dir))


@rows
def coarsening_levels_of_draws(spark, sf_dir):
    """Edges and weight of each coarser form of the drawn networks' mutation graph."""
    edges = run_sql(spark, lambda q: f"SELECT a, b, 1.0D AS weight FROM {graph.mutation_edges(triples(q), sbf.neighbours(q, 3), 3)} AS e", sf_dir)
    parts = [e.agg(F.lit(i).alias("level"), F.count("*").alias("edges"), F.sum("weight").alias("weight")) for i, e in enumerate(graph.levels(edges))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@rows
def hulls_of_vectors(spark, sf_dir):
    """Hull of each vector's points in the plot of statistics."""
    from .networks import _scatter

    return graph.hulls(run_sql(spark, lambda q: f"SELECT {vector(q, 'code', 3)} AS kind, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {_scatter(q)} AS p", sf_dir))


def _graph_of_draws(spark, sf_dir):
    """The drawn networks and the edges of their mutation graph, written once."""
    vertices = graph.shared(run_sql(spark, lambda q: f"SELECT id FROM {triples(q)} AS t", sf_dir))
    return vertices, graph.shared(run_sql(spark, lambda q: f"SELECT a, b, 1.0D AS weight FROM {graph.mutation_edges(triples(q), sbf.neighbours(q, 3), 3)} AS e", sf_dir))


@rows
def sampled_layout_of_draws(spark, sf_dir):
    """Places of the drawn networks by descent with sampled vertices pushed away, in rounds."""
    return layout.descent(*_graph_of_draws(spark, sf_dir), rounds=10)[0]


@rows
def spring_layout_of_draws(spark, sf_dir):
    """Places of the drawn networks by springs and repulsion through cells, in rounds."""
    return layout.spring(*_graph_of_draws(spark, sf_dir), rounds=6)[0]


@rows
def communities_of_draws(spark, sf_dir):
    """The drawn networks' communities by modularity of their mutation graph."""
    return clusters.communities(_graph_of_draws(spark, sf_dir)[1])[0]


@rows
def systems_of_draws(spark, sf_dir):
    """Each drawn network's sun and its hops to it."""
    return clusters.systems(*_graph_of_draws(spark, sf_dir))


@rows
def system_links_of_draws(spark, sf_dir):
    """Links between the suns of the drawn networks, with the mean length of the ways between them: the next coarser graph."""
    vertices, edges = _graph_of_draws(spark, sf_dir)
    found = graph.shared(clusters.systems(vertices, edges))
    return clusters.between_suns(edges.withColumn("length", F.lit(1.0)), found)


def _id(n: str) -> str:
    return f"{n}.f_1 * 65536 + {n}.f_2 * 256 + {n}.f_3"


@paired(f"""WITH {oracles._columns(3, 2)}, {oracles._neutral(3)}, {oracles._DRAWS},
    e AS MATERIALIZED ({" UNION ALL ".join(f"SELECT {_id('x')} AS a, {_id('y')} AS b FROM networks AS x JOIN neighbours AS n ON n.src = x.f_{k} JOIN networks AS y ON {' AND '.join(f'y.f_{j} = ' + ('n.dst' if j == k else f'x.f_{j}') for j in (1, 2, 3))}" for k in (1, 2, 3))}),
    two AS (SELECT DISTINCT x.a, y.b FROM e AS x JOIN e AS y ON y.a = x.b WHERE x.a <> y.b)
    SELECT a AS id, CAST(1 AS BIGINT) AS hops, count(*) AS reached FROM e GROUP BY a
    UNION ALL SELECT two.a, 2, count(*) FROM two ANTI JOIN e ON e.a = two.a AND e.b = two.b GROUP BY two.a""")
def hops_of_draws(spark, sf_dir):
    """How many others each drawn network reaches in one and in two mutations, and no fewer."""
    return clusters.hops_from_all(*_graph_of_draws(spark, sf_dir), 2)
