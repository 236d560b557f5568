"""Layouts by rounds: positions are a table, a round is a few joins, and no group grows with the graph.

Positions are (id, x, y). A step gives each vertex its pull and push; ``settled`` moves all at once, writes the positions to the shared folder
and stops by the convergence of the moves. Vertices without edges are pushed only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling
from .graph import convergence, shared

#: Halvings of the square at most: points that share such a cell count as one body.
DEEPEST = 16
#: Cells at most so far apart in either direction are opened, or, at the last depth, met body by body.
NEAR = 2
#: Points of a cell that are met one by one.
LEAF = 16
#: Depths whose lists go to all tasks: at most 4^5 cells of 75 others, whatever the number of points.
COARSE = 5
SOFT = 1e-9


def scattered(vertices: DataFrame, seed: int = 0) -> DataFrame:
    """(id, x, y): a place in the unit square for each vertex, by a hash of its id."""
    place = (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 40)) / float(1 << 40) for k in (1, 2))
    return vertices.select("id", *(p.alias(c) for p, c in zip(place, "xy"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, weight): each edge from either end; loops are left out."""
    edges = edges.where("a <> b").select("a", "b", F.col("weight").cast("double").alias("weight"))
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def _along(pairs: DataFrame, at: DataFrame, factor: Callable[[Column], Column]) -> DataFrame:
    """(id, fx, fy): for each a of pairs (a, b, weight) the sum of (place of a - place of b) * weight * factor(squared distance)."""
    one, other = (at.select(F.col("id").alias(v), F.col("x").alias(f"x_{v}"), F.col("y").alias(f"y_{v}")) for v in "ab")
    met = pairs.join(one, "a").join(other, "b").withColumns({"dx": F.col("x_a") - F.col("x_b"), "dy": F.col("y_a") - F.col("y_b")})
    met = met.withColumn("by", F.col("weight") * factor(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return met.groupBy(F.col("a").alias("id")).agg(F.sum(F.col("dx") * F.col("by")).alias("fx"), F.sum(F.col("dy") * F.col("by")).alias("fy"))


# --- repulsion by summaries of cells


def gridded(at: DataFrame) -> DataFrame:
    """(id, x, y, cx, cy): the cell of the deepest grid over the square that holds all points."""
    lo_x, hi_x, lo_y, hi_y = at.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max(hi_x - lo_x, hi_y - lo_y) or 1.0 if lo_x is not None else 1.0
    last = (1 << DEEPEST) - 1
    cell = {f"c{c}": F.least(F.floor((F.col(c) - F.lit(lo or 0.0)) / side * (last + 1)), F.lit(last)).cast("int") for c, lo in (("x", lo_x), ("y", lo_y))}
    return at.select("id", "x", "y").withColumns(cell)


def cells(points: DataFrame) -> DataFrame:
    """(depth, cx, cy, n, mx, my): points and their mean of every cell in use, at all depths from 2 on."""
    least = points.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    deep = least.select("*", F.explode(F.sequence(F.lit(2), F.lit(DEEPEST))).alias("depth"))
    up = [F.expr(f"shiftright({c}, {DEEPEST} - depth)").alias(c) for c in ("cx", "cy")]
    summed = deep.select("depth", *up, "n", "sx", "sy").groupBy("depth", "cx", "cy").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy")))
    return summed.select("depth", "cx", "cy", "n", (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"))


def _around(df: DataFrame, reach: int) -> DataFrame:
    """With ox, oy: every cell up to reach away."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    return df.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumns({"ox": F.col("cx") + F.col("i"), "oy": F.col("cy") + F.col("j")})


def meetings(at: DataFrame) -> DataFrame:
    """(id, x, y, n, mx, my): the bodies that each point is pushed by, n points around (mx, my) each.

    A cell is met as one body where it is not near the point's own of the same depth but their parents are near: then it is at least two
    sides away. At the last depth, the first where no cell holds over ``LEAF`` points, the near cells' points are met one by one;
    a cell of the deepest grid that still holds more is one body. So each point meets every other once, at most 75 bodies a depth and
    25 times ``LEAF`` at the last.
    """
    points = shared(gridded(at))
    summed = shared(cells(points))
    fullest = {r["depth"]: r["n"] for r in summed.groupBy("depth").agg(F.max("n").alias("n")).collect()}
    last = next((d for d in sorted(fullest) if fullest[d] <= LEAF), DEEPEST)
    far = _around(summed.where(F.col("depth") <= last).select("depth", "cx", "cy"), 2 * NEAR + 1)
    far = far.where((F.abs("i") > NEAR) | (F.abs("j") > NEAR))
    for o, c in (("ox", "cx"), ("oy", "cy")):
        far = far.where(F.abs(F.shiftright(o, 1) - F.shiftright(c, 1)) <= NEAR)
    others = summed.select("depth", F.col("cx").alias("ox"), F.col("cy").alias("oy"), "n", "mx", "my")
    far = far.join(others, ["depth", "ox", "oy"]).select("depth", "cx", "cy", "n", "mx", "my")

    def at_depths(low: int, high: int) -> DataFrame:
        deep = points.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        return deep.withColumns({c: F.expr(f"shiftright({c}, {DEEPEST} - depth)") for c in ("cx", "cy")})

    body = ["id", "x", "y", "n", "mx", "my"]
    met = at_depths(2, min(last, COARSE)).join(F.broadcast(far.where(F.col("depth") <= COARSE)), ["depth", "cx", "cy"]).select(body)
    if last > COARSE:
        met = met.unionByName(at_depths(COARSE + 1, last).join(far.where(F.col("depth") > COARSE), ["depth", "cx", "cy"]).select(body))
    leaf = at_depths(last, last)
    single = leaf.join(summed.where((F.col("depth") == last) & (F.col("n") <= LEAF)).select("cx", "cy"), ["cx", "cy"])
    bodies = single.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.lit(1).cast("long").alias("n"), F.col("x").alias("mx"), F.col("y").alias("my"))
    bodies = bodies.unionByName(others.where((F.col("depth") == last) & (F.col("n") > LEAF)).drop("depth"))
    return met.unionByName(_around(leaf, NEAR).join(bodies, ["ox", "oy"]).select(body))


def repulsion(at: DataFrame) -> DataFrame:
    """(id, fx, fy): the sum over all other points of (difference of places) / (squared distance), by ``meetings``."""
    met = meetings(at).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    met = met.withColumn("by", F.col("n") / (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + SOFT))
    return met.groupBy("id").agg(F.sum(F.col("dx") * F.col("by")).alias("fx"), F.sum(F.col("dy") * F.col("by")).alias("fy"))


# --- rounds


def settled(at: DataFrame, step: Callable[[DataFrame, int], DataFrame], rate: float, rounds: int, window: int = 3, slow: float = 0.9, least: float = 0.02) -> tuple[DataFrame, list[float]]:
    """The positions after the rounds, and each round's mean move.

    step(at, round) gives (id, fx, fy); a vertex moves along it by rate at most. Where the mean move of the last few rounds is over
    ``slow`` of that of the few before, vertices go to and fro, and the rate is halved; under ``least`` of the first rate all stop.
    """
    at, now, since, moves = shared(at), rate, 0, []
    for k in range(rounds):
        far = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
        by = F.when(far > now, now / far).otherwise(1.0)
        step_by = at.join(step(at, k), "id", "left").withColumn("by", by)
        at = shared(step_by.select("id", *((F.col(c) + F.coalesce(F.col(f"f{c}") * F.col("by"), F.lit(0.0))).alias(c) for c in "xy"), F.coalesce(far * F.col("by"), F.lit(0.0)).alias("moved")))
        moves.append(at.agg(F.avg("moved")).first()[0] or 0.0)
        at = at.select("id", "x", "y")
        ratio = convergence(moves[since:], window)[-1]
        if not moves[-1] or (ratio is not None and ratio > slow):
            now, since = now / 2, len(moves)
            if not moves[-1] or now < least * rate:
                break
    return at, moves


def smoothed(at: DataFrame, both: DataFrame, rounds: int) -> DataFrame:
    """Positions after as many rounds of half a step to the neighbours' mean, each time centred, x and y made uncorrelated, and scaled to
    a variance of 1: what changes least along edges is left, so a layout need not untangle it. both: a, b, weight, from either end."""
    load = both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("load"))
    pull = lambda at: _along(both, at, lambda r2: F.lit(-0.5)).join(load, "id")
    for k in range(rounds + 1):
        if k:
            to = pull(at).select("id", *((F.col(f"f{c}") / F.col("load")).alias(f"f{c}") for c in "xy"))
            at = at.join(to, "id", "left").select("id", *((F.col(c) + F.coalesce(f"f{c}", F.lit(0.0))).alias(c) for c in "xy"))
        at = shared(at)
        mx, my, vx, xy = (v or 0.0 for v in at.agg(F.avg("x"), F.avg("y"), F.var_pop("x"), F.covar_pop("x", "y")).first())
        at = at.select("id", (F.col("x") - mx).alias("x"), (F.col("y") - my - (F.col("x") - mx) * (xy / vx if vx else 0.0)).alias("y"))
        sx, sy = (v or 1.0 for v in at.agg(F.stddev_pop("x"), F.stddev_pop("y")).first())
        at = at.select("id", (F.col("x") / sx).alias("x"), (F.col("y") / sy).alias("y"))
    return at


def spring(vertices: DataFrame, edges: DataFrame, rounds: int = 30, seed: int = 1, smooth: int = 10) -> tuple[DataFrame, list[float]]:
    """Positions, from smoothed ones, by attraction along edges, by the squared distance, and repulsion between all, by its inverse, through cells.

    edges: a, b, weight; the unit of length is the one at which n points fill the unit square.
    """
    both = shared(both_ways(edges))
    n = max(1, vertices.select("id").distinct().count())
    unit = n**-0.5

    def step(at: DataFrame, k: int) -> DataFrame:
        pull = _along(both, at, lambda r2: -F.sqrt(r2) / unit)
        push = repulsion(at).select("id", *((F.col(f) * (unit * unit)).alias(f) for f in ("fx", "fy")))
        return pull.unionByName(push).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))

    start = smoothed(scattered(vertices, seed), both, smooth).select("id", (F.col("x") / 4).alias("x"), (F.col("y") / 4).alias("y"))
    return settled(start, step, 0.05, rounds)


def negatives(vertices: DataFrame, edges: DataFrame, each: int, rounds: int, seed: int) -> DataFrame:
    """(round, a, b, weight): for each vertex and round so many vertices to push it, drawn by degree^0.75. The pushes of a vertex weigh
    together as much as its edges. edges: a, b, weight, from either end."""
    size = shared(vertices.select("id").distinct().join(edges.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("load")), "id", "left"))
    table = shared(sampling.alias_table(size.select("id", F.pow(F.coalesce("degree", F.lit(1)), F.lit(0.75)).alias("w"))))
    asked = size.select(F.col("id").alias("a"), (F.coalesce("load", F.lit(1.0)) / each).alias("weight"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    asked = asked.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(each)))).withColumn("draw", F.xxhash64("a", "round", "j"))
    return sampling.picked(asked, table, seed).where("a <> picked").select("round", "a", F.col("picked").alias("b"), "weight")


def descent(vertices: DataFrame, edges: DataFrame, rounds: int = 30, each: int = 8, push: float = 0.2, seed: int = 1, smooth: int = 10) -> tuple[DataFrame, list[float]]:
    """Positions, from smoothed ones, by descent on the edges' likelihood under the kernel 1 / (1 + squared distance), with sampled vertices pushed away.

    All vertices move at once, each by its mean gradient, so a hub moves no farther than others. edges: a, b, weight.
    """
    both = shared(both_ways(edges))
    drawn = shared(negatives(vertices, both, each, rounds, seed))
    load = shared(both.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("load")))

    def step(at: DataFrame, k: int) -> DataFrame:
        pull = _along(both, at, lambda r2: -2 / (1 + r2))
        away = _along(drawn.where(F.col("round") == k), at, lambda r2: 2 * push / ((0.1 + r2) * (1 + r2)))
        total = pull.unionByName(away).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        return total.join(load, "id", "left").select("id", *((F.col(f) / F.coalesce("load", F.lit(1.0))).alias(f) for f in ("fx", "fy")))

    return settled(smoothed(scattered(vertices, seed), both, smooth), step, 0.2, rounds)
