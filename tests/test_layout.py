"""Layouts by rounds: every point met once, forces near the exact ones, neighbours kept, odd graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boolscope.operators import layout


def points(spark, places):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "id long, x double, y double")


def exact(places):
    d = places[:, None] - places[None]
    return (d / ((d**2).sum(2) + layout.SOFT)[..., None]).sum(1)


@pytest.mark.parametrize("clumped", [False, True])
def test_force_of_cells_is_near_the_exact_one(spark, clumped):
    rng = np.random.default_rng(4)
    places = rng.random((1500, 2))
    if clumped:  # a third of all in one small place
        places[:500] = 0.3 + places[:500] * 1e-3
    at = points(spark, places)
    met = layout.meetings(at)
    per = met.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("bodies")).collect()
    assert {r["n"] for r in per} == {1500}  # itself included
    if not clumped:
        assert sum(r["bodies"] for r in per) < 0.25 * 1500**2
    got = np.array([(r["fx"], r["fy"]) for r in layout.repulsion(at).orderBy("id").collect()])
    want = exact(places)
    assert np.linalg.norm(got - want) / np.linalg.norm(want) < 0.02


def test_points_of_one_place_are_one_body(spark):
    at = points(spark, [(0.5, 0.5)] * 100 + [(0.0, 0.0), (1.0, 1.0)])
    assert layout.meetings(at).where("id = 100").agg(F.sum("n")).first()[0] == 102
    assert layout.meetings(at).count() < 102 * 10
    assert layout.repulsion(points(spark, [(2.0, 3.0)])).first()["fx"] == 0


def grid(spark, k):
    edges = [(i * k + j, i * k + j + 1) for i in range(k) for j in range(k - 1)] + [(i * k + j, i * k + j + k) for i in range(k - 1) for j in range(k)]
    return spark.range(k * k), spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a long, b long, weight double"), edges


def preservation(at, edges):
    places = np.array([(r["x"], r["y"]) for r in at.orderBy("id").collect()])
    near = [set() for _ in places]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    far = ((places[:, None] - places[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    close = [set(np.argsort(far[i])[: len(near[i])]) for i in range(len(places))]
    return float(np.mean([len(a & b) / len(a | b) for a, b in zip(near, close)]))


@pytest.mark.parametrize("way", [layout.spring, layout.descent])
def test_layouts_keep_neighbours(spark, way):
    vertices, edges, pairs = grid(spark, 9)
    at, moves = way(vertices, edges, rounds=10)
    assert at.count() == 81 and len(moves) <= 10
    start = preservation(layout.scattered(vertices, 1), pairs)
    assert preservation(at, pairs) > max(0.2, 3 * start)


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "a long, b long, weight double")
    for way in (layout.spring, layout.descent):
        assert way(spark.range(0), none, rounds=2, smooth=1)[0].count() == 0
        at, _ = way(spark.range(2), spark.createDataFrame([(0, 0, 1.0)], none.schema), rounds=2, smooth=1)  # a loop only
        assert at.where("x IS NULL OR y IS NULL OR isnan(x)").count() == 0 and at.count() == 2


def test_rounds_stop_when_nothing_moves(spark):
    still = lambda at, k: at.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    at, moves = layout.settled(points(spark, [(0, 0), (1, 1)]), still, 1.0, 50)
    assert moves == [0.0]
    to_and_fro = lambda at, k: at.select("id", F.lit(float((-1) ** k)).alias("fx"), F.lit(0.0).alias("fy"))
    _, moves = layout.settled(points(spark, [(0, 0)]), to_and_fro, 1.0, 60, window=1)
    assert len(moves) < 30 and moves[-1] < 0.1
