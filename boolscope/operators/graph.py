"""Graphs of networks: mutation edges, components, hops, distances of attractors, layouts and their quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dialect import Dialect
from ..sources.files import new_folder


def mutation_edges(vertices: str, neighbours: str, d: int) -> str:
    """(a, b): pairs of vertices (id, f_1 .. f_d) that one weight parts, a before b.

    A vertex's key with one function replaced by a neighbour of it is looked up: equality joins, never all pairs.
    """
    parts = []
    for k in range(1, d + 1):
        same = " AND ".join(f"v.f_{i} = u.f_{i}" for i in range(1, d + 1) if i != k)
        parts.append(f"SELECT v.id AS a, u.id AS b FROM {vertices} AS v JOIN {neighbours} AS n ON v.f_{k} = n.src JOIN {vertices} AS u ON u.f_{k} = n.dst{' AND ' + same if same else ''} WHERE v.id < u.id")
    return f"({' UNION ALL '.join(parts)})"


def degrees(edges: str) -> str:
    return f"(SELECT id, count(*) AS degree FROM (SELECT a AS id FROM {edges} AS e UNION ALL SELECT b AS id FROM {edges} AS e2) AS ends GROUP BY id)"


def hops(edges: str, most: int) -> str:
    """(a, b, hops): pairs of vertices at most so many hops apart, a before b."""
    both = f"(SELECT a, b FROM {edges} AS e UNION SELECT b AS a, a AS b FROM {edges} AS e2)"
    reached, parts = both, [f"SELECT a, b, 1 AS hops FROM {both} AS h1"]
    for k in range(2, most + 1):
        reached = f"(SELECT DISTINCT r.a, e.b FROM {reached} AS r JOIN {both} AS e ON r.b = e.a WHERE r.a <> e.b)"
        parts.append(f"SELECT a, b, {k} AS hops FROM {reached} AS h{k}")
    return f"(SELECT a, b, min(hops) AS hops FROM ({' UNION ALL '.join(parts)}) AS h WHERE a < b GROUP BY a, b)"


def cycle_distance(q: Dialect, n: int) -> str:
    """Distance of the cycles of rows x and y, each with size and seq, its states twice around from the smallest on.

    The least, over rotations of the longer one, sum of differing bits; the shorter one is padded with state 0.
    """

    def turned(a: str, b: str) -> str:
        sums = []
        for r in range(n):
            terms = " + ".join(f"CASE WHEN {i} < {a}.size THEN {q.ones(q.xor(q.at(f'{a}.seq', i + r), f'CASE WHEN {i} < {b}.size THEN {q.at(f"{b}.seq", i)} ELSE 0 END'))} ELSE 0 END" for i in range(n))
            sums.append(f"CASE WHEN {r} < {a}.size THEN {terms} END")
        return f"least({', '.join(sums)})"

    return f"CASE WHEN x.size >= y.size THEN {turned('x', 'y')} ELSE {turned('y', 'x')} END"


def profiles(q: Dialect, cycles: str) -> str:
    """(profile, networks): the different lists of the cycles that states lead to, state 0 first, with the number of networks
    that have each. cycles: id, s, size, seq, as cycle_distance takes them; a cycle is named by its states."""
    own = f"(SELECT id, s, concat_ws(':', slice(seq, 1, CAST(size AS INT))) AS cycle FROM {cycles} AS c)"
    lists = f"(SELECT id, transform(array_sort(collect_list(struct(s, cycle))), x -> x.cycle) AS profile FROM {own} AS o GROUP BY id)"
    return f"(SELECT profile, count(*) AS networks FROM {lists} AS l GROUP BY profile)"


def cycle_table(q: Dialect, cycles: str) -> str:
    """(cycle, size, seq): the dictionary of the cycles that occur. Their number is bounded by the states, not by the networks."""
    return f"(SELECT DISTINCT concat_ws(':', slice(seq, 1, CAST(size AS INT))) AS cycle, CAST(size AS INT) AS size, seq FROM {cycles} AS c)"


def close_profiles(found: DataFrame, table: DataFrame, n: int, most: int) -> DataFrame:
    """(a, b, dda): pairs of different profiles, a before b, whose distances add up to most at most over the n states.

    Different cycles are at least 1 apart, so of a pair within most, at most so many states have different cycles: of most + 1
    runs of states one is the same in both. Profiles are joined by equal runs, and only those pairs are measured; each pair of
    cycles among them is measured once, whatever the number of profiles and states it stands for.
    """
    ends = [-(-i * n // (most + 1)) for i in range(most + 2)]  # longer ones first: state 0 is the same in all
    runs = F.array(*(F.concat_ws("|", F.lit(str(i)), F.slice("profile", a + 1, b - a)) for i, (a, b) in enumerate(zip(ends, ends[1:]))))
    keyed = shared(found.select(F.concat_ws("|", "profile").alias("name"), F.explode(runs).alias("run")))
    x, y = keyed.select("run", F.col("name").alias("a")), keyed.select("run", F.col("name").alias("b"))
    pairs = shared(x.join(y, "run").where("a < b").select("a", "b").distinct())
    states = pairs.select("a", "b", F.inline(F.arrays_zip(F.split("a", "[|]").alias("p"), F.split("b", "[|]").alias("q")))).where("p <> q")
    states = shared(states.groupBy("a", "b", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.count("*").alias("times")))
    one, other = (table.select(F.col("cycle").alias(k), F.struct("size", "seq").alias(r)) for k, r in (("p", "x"), ("q", "y")))
    apart = states.select("p", "q").distinct().join(one, "p").join(other, "q")
    apart = apart.selectExpr("p", "q", "IF(x.size >= y.size, x, y) AS l", "IF(x.size >= y.size, y, x) AS k")
    # as cycle_distance, with lambdas: unrolled, the text outgrows code generation
    turned = "aggregate(sequence(0, l.size - 1), 0, (sum, i) -> sum + bit_count(l.seq[i + r] ^ IF(i < k.size, k.seq[i], 0)))"
    apart = shared(apart.selectExpr("p", "q", f"CAST(array_min(transform(sequence(0, l.size - 1), r -> {turned})) AS BIGINT) AS d"))
    return states.join(apart, ["p", "q"]).groupBy("a", "b").agg(F.sum(F.col("times") * F.col("d")).alias("dda")).where(F.col("dda") <= most)


# --- iterative operators


def shared(df: DataFrame) -> DataFrame:
    """The rows as a new table in the shared folder: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): component is the smallest vertex reachable; vertices without edges are their own.

    Every vertex hangs on the smallest one around it, larger neighbours first and smaller ones then, until nothing moves:
    rounds grow with the logarithm of the longest path. Minima are aggregated before their shuffle, so that no hub's
    edges meet in one task.
    """
    at = shared(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        state = tuple(at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return vertices.select("id").join(at, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("component"))
        seen = state
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = shared(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")


def coarsened(edges: DataFrame, salt: int = 0) -> DataFrame:
    """(a, b, weight) between clusters, one level of coarsening: suns are local minima of a hash, and each other vertex
    joins the smallest neighbour. edges: a, b, weight."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    ranked = both.select("a", F.struct(F.xxhash64(F.lit(salt), "b").alias("h"), F.col("b").alias("v")).alias("x"))
    best = ranked.groupBy("a").agg(F.min("x").alias("x"))
    own = F.struct(F.xxhash64(F.lit(salt), "a").alias("h"), F.col("a").alias("v"))
    parent = best.select("a", F.when(own < F.col("x"), F.col("a")).otherwise(F.col("x.v")).alias("cluster"))
    x, y = parent.select("a", F.col("cluster").alias("ca")), parent.select(F.col("a").alias("b"), F.col("cluster").alias("cb"))
    out = edges.join(x, "a").join(y, "b").where("ca <> cb")
    return out.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))


def levels(edges: DataFrame, least: int = 100, worst_ratio: float = 0.9, most: int = 30) -> list[DataFrame]:
    """The graph and its coarser and coarser forms, until few vertices are left or a level hardly shrinks."""
    out = [shared(edges.select("a", "b", "weight"))]

    def vertices(e: DataFrame) -> int:
        return e.select("a").union(e.select("b")).distinct().count()

    size = vertices(out[0])
    while size > least and len(out) < most:
        coarse = shared(coarsened(out[-1], len(out)))
        fewer = vertices(coarse)
        if not fewer or fewer > worst_ratio * size:
            break
        out.append(coarse)
        size = fewer
    return out


def convergence(moves: list[float], window: int = 5) -> list[float | None]:
    """Per step the mean displacement of the last few steps over that of the few before; None while there are too few."""
    means = [sum(moves[i - window : i]) / window for i in range(window, len(moves) + 1)]
    ratios = [means[i] / means[i - window] if means[i - window] else 0.0 for i in range(window, len(means))]
    return [None] * (len(moves) - len(ratios)) + ratios


def frontier(seeds: DataFrame, edges: DataFrame, most: int, fanout: int, layers: int = 20, salt: int = 0) -> DataFrame:
    """(id, layer): vertices found from the seeds, a layer at a time, each vertex passing on to at most fanout new
    neighbours that a hash picks, until most are found. The cap is the operator's own."""
    both = shared(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    seen = shared(seeds.select("id", F.lit(0).alias("layer")).distinct())
    for layer in range(1, layers + 1):
        if seen.count() >= most:
            break
        new = seen.where(F.col("layer") == layer - 1).join(both, F.col("id") == F.col("a")).select("a", "b")
        new = new.join(seen.select(F.col("id").alias("b")), "b", "left_anti")
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64(F.lit(salt), "a", "b"), "b"))
        picked = new.withColumn("place", place).where(F.col("place") <= fanout).select(F.col("b").alias("id"))
        grown = shared(seen.unionByName(picked.distinct().select("id", F.lit(layer).alias("layer"))))
        if grown.count() == seen.count():
            break
        seen = grown
    return seen.orderBy("layer", F.xxhash64(F.lit(salt), "id")).limit(most)


# --- layouts: a graph that is drawn is small; a component is a group


def _spring(pdf: pd.DataFrame, rounds: int, seed: int) -> pd.DataFrame:
    ids = np.unique(pdf[["a", "b"]].to_numpy())
    a, b = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
    n = len(ids)
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2))
    k = 1 / math.sqrt(n)
    for step in range(rounds):
        move = np.zeros_like(x)
        for at in range(0, n, 512):
            d = x[at : at + 512, None] - x[None]
            r2 = (d**2).sum(2) + 1e-9
            move[at : at + 512] += (d * (k * k / r2)[..., None]).sum(1)
        d = x[a] - x[b]
        pull = d * (np.sqrt((d**2).sum(1)) / k)[:, None]
        np.add.at(move, a, -pull)
        np.add.at(move, b, pull)
        size = np.sqrt((move**2).sum(1, keepdims=True)) + 1e-9
        x += move / size * np.minimum(size, 0.1 * (1 - step / rounds))
    return pd.DataFrame({"component": pdf["component"].iloc[0], "id": ids, "x": x[:, 0], "y": x[:, 1]})


def spring_layout(edges: DataFrame, rounds: int = 50, seed: int = 1) -> DataFrame:
    """(component, id, x, y) by attraction along edges and repulsion between all, per component. edges: component, a, b."""
    return edges.groupBy("component").applyInPandas(lambda pdf: _spring(pdf, rounds, seed), "component long, id long, x double, y double")


def _descent(pdf: pd.DataFrame, rounds: int, negatives: int, seed: int) -> pd.DataFrame:
    ids = np.unique(pdf[["a", "b"]].to_numpy())
    a, b = np.searchsorted(ids, pdf["a"]), np.searchsorted(ids, pdf["b"])
    weight = pdf["weight"].to_numpy() / pdf["weight"].sum()
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((len(ids), 2)) * 1e-2
    for step in range(rounds):
        rate = 1.0 - step / rounds
        e = rng.choice(len(a), size=len(a), p=weight)
        d = x[a[e]] - x[b[e]]
        g = -2 * d / (1 + (d**2).sum(1, keepdims=True))
        np.add.at(x, a[e], rate * np.clip(g, -1, 1))
        np.add.at(x, b[e], -rate * np.clip(g, -1, 1))
        for _ in range(negatives):
            c = rng.integers(0, len(ids), len(a))
            d = x[a[e]] - x[c]
            r2 = (d**2).sum(1, keepdims=True)
            np.add.at(x, a[e], rate * np.clip(2 * d / ((0.1 + r2) * (1 + r2)), -1, 1))
    return pd.DataFrame({"component": pdf["component"].iloc[0], "id": ids, "x": x[:, 0], "y": x[:, 1]})


def sampled_layout(edges: DataFrame, rounds: int = 60, negatives: int = 3, seed: int = 1) -> DataFrame:
    """(component, id, x, y) by stochastic descent on sampled edges, with random vertices pushed away. edges: component, a,
    b, weight."""
    return edges.groupBy("component").applyInPandas(lambda pdf: _descent(pdf, rounds, negatives, seed), "component long, id long, x double, y double")


def _walk(pdf: pd.DataFrame, steps: int, near: dict[int, list[int]], d: int, seed: int) -> pd.DataFrame:
    rng = np.random.default_rng([seed, int(pdf["chain"].iloc[0])])
    at, out = [int(v) for v in pdf.iloc[0][[f"f_{i}" for i in range(1, d + 1)]]], []
    for step in range(steps):
        size = np.array([len(near[f]) for f in at])
        k = int(rng.choice(d, p=size / size.sum()))
        to = near[at[k]][int(rng.integers(size[k]))]
        if rng.random() < size.sum() / (size.sum() - size[k] + len(near[to])):
            at[k] = to
        out.append((int(pdf["chain"].iloc[0]), step, *at))
    return pd.DataFrame(out, columns=["chain", "step", *(f"f_{i}" for i in range(1, d + 1))])


def metropolis_walks(seeds: DataFrame, neighbours: DataFrame, d: int, steps: int, seed: int = 0) -> DataFrame:
    """(chain, step, f_1 .. f_d): independent walks over the mutation graph that end up uniform over its networks.

    seeds: chain, f_1 .. f_d. A function is picked by its share of the degree and replaced by one of its neighbours; moves
    are accepted by the ratio of degrees. The neighbour table has as many rows as one size of network has, a constant.
    """
    near: dict[int, list[int]] = {}
    for r in neighbours.orderBy("src", "dst").collect():
        near.setdefault(r["src"], []).append(r["dst"])
    schema = "chain long, step long, " + ", ".join(f"f_{i} long" for i in range(1, d + 1))
    return seeds.groupBy("chain").applyInPandas(lambda pdf: _walk(pdf, steps, near, d, seed), schema)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the leftmost lowest point."""
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def side(ps: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return side(ordered) + side(ordered[::-1])


def hulls(points: DataFrame) -> DataFrame:
    """(kind, place, x, y): the hull of each kind's points (kind, x, y). Points are first thinned to the lowest and highest
    y per x, which loses no corner."""
    thin = points.groupBy("kind", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = hull([(x, y) for x, lo, hi in pdf[["x", "lo", "hi"]].itertuples(index=False) for y in (lo, hi)])
        return pd.DataFrame({"kind": pdf["kind"].iloc[0], "place": range(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    return thin.groupBy("kind").applyInPandas(one, "kind string, place long, x double, y double")


def variety_draws(spark: SparkSession, table: DataFrame, d: int, n: int, seed: int = 0, by_genotype: bool = False) -> DataFrame:
    """Up to n different networks; functions are drawn evenly, or by the sizes of their column sets.

    table: tt, n_cols, idx. The number of draws is fixed beforehand, a few times n or, where there are far more networks
    than are asked for, a little more, so that all run at once; repeats are dropped. By genotype, a place among all columns is drawn, and the function that holds it is found by its range.
    """
    sized = table.selectExpr("tt", "n_cols", "idx", "sum(n_cols) OVER (ORDER BY idx) - n_cols AS first")
    total = table.agg(F.sum("n_cols" if by_genotype else F.lit(1))).first()[0]
    many = table.count() ** d > 100 * n and not by_genotype
    draws = spark.range(n + n // 20 + 200 if many else 4 * n + 200)
    for i in range(1, d + 1):
        draws = draws.withColumn(f"u_{i}", F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(total)))
        t = F.broadcast(sized.select(F.col("tt").alias(f"f_{i}"), "idx", "first", "n_cols"))  # one row per function of d nodes
        found = (F.col(f"u_{i}") >= t["first"]) & (F.col(f"u_{i}") < t["first"] + t["n_cols"]) if by_genotype else F.col(f"u_{i}") == t["idx"]
        draws = draws.join(t, found).drop("idx", "first", "n_cols")
    names = [f"f_{i}" for i in range(1, d + 1)]
    return draws.groupBy(*names).agg(F.min("id").alias("id")).orderBy("id").limit(n).select(*names)
