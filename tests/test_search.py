"""Approximate nearest neighbours against exact ones; graphs and files by definition."""

import numpy as np
import pytest

from boolscope.operators import graph
from boolscope.operators import vectors as vec
from boolscope.sources import files


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 24)) * 4
    x = centres[rng.integers(0, 60, 3000)] + rng.standard_normal((3000, 24))
    x[100:180] = x[100]  # copies fill more than a leaf
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").cache()


@pytest.mark.parametrize("index", [vec.forest_pairs, vec.kd_pairs, vec.hash_pairs])
def test_indexes_compare_few_pairs_and_find_neighbours(clustered, index):
    x, points = clustered
    pairs = graph.shared(vec.measured(index(points), points))
    assert pairs.count() < 0.1 * len(x) * (len(x) - 1)
    found = {(r["a"], r["b"]) for r in vec.propagated(pairs, points, 10, 1).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2) + np.diag([np.inf] * len(x))
    asked = [i for i in range(0, len(x), 10) if not 100 <= i < 180]  # neighbours of copies are tied
    hits = sum((i, int(j)) in found for i in asked for j in np.argsort(d[i])[:10])
    assert hits >= 0.9 * 10 * len(asked)


def test_leaves_stay_small_among_copies(spark):
    points = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "id long, v array<double>")
    sizes = [r["count"] for r in vec._split(points, [[[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, -1.0]]], 40).groupBy("tree", "node").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 120


def test_components_of_a_path_and_of_lone_vertices(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    vertices = spark.createDataFrame([(i,) for i in [*range(201), 400, 500, 900]], "id long")
    got = {r["id"]: r["component"] for r in graph.components(vertices, edges).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400, 900: 900}


def test_solver_answers_renumber_weights(spark):
    text = "Answer: 1\ntransition_function_bit(1,2) transition_function_bit(1,3) sigma(1,2) sigma(2,1)\n\nw(1,1)=-1 w(1,2)=2 w(2,2)=3"
    rows = files.answers(spark.createDataFrame([(text,), ("",)], "value string"), 2).collect()
    assert [rows[0][c] for c in ("f_1", "f_2", "w_1_1", "w_1_2", "w_2_1", "w_2_2")] == [12, 0, 3, 0, 2, -1]
    assert list(rows[1]) == [0] * 6


def test_label_and_neighbour_files(spark, tmp_path):
    (tmp_path / "l").write_text("3\n1\n\n2\n")
    (tmp_path / "n").write_text("1 2\n0\n0 1\n")
    assert sorted(map(tuple, files.read_labels(spark, str(tmp_path / "l")).collect())) == [(0, 3), (1, 1), (2, 2)]
    assert sorted(map(tuple, files.read_neighbours(spark, str(tmp_path / "n")).collect())) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (2, 1, 0), (2, 2, 1)]


def test_negative_draws_follow_the_weights(spark):
    from boolscope.plans import graphs
    from boolscope.plans.registry import run_sql

    table = {r["id"]: r["hi"] - r["lo"] for r in run_sql(spark, graphs.negative_table_d2, "").collect()}
    drawn = {r["id"]: r["drawn"] for r in graphs.negative_draws_d2(spark, "").collect()}
    assert sum(drawn.values()) == 20_000
    assert all(abs(drawn[i] / 20_000 - w / sum(table.values())) < 0.01 for i, w in table.items())


def test_distances_of_mutations(spark):
    """Single edges by the definition: the least differing bits over rotations, the shorter cycle padded with 0."""
    from boolscope.plans import graphs
    from boolscope.plans.registry import run_sql

    def cycle(f, s):
        step = lambda x: sum((f[i] >> x & 1) << i for i in range(3))
        for _ in range(8):
            s = step(s)
        seen = [s]
        while step(seen[-1]) != s:
            seen.append(step(seen[-1]))
        at = seen.index(min(seen))
        return seen[at:] + seen[:at]

    def far(x, y):
        x, y = sorted((x, y), key=len, reverse=True)
        y = y + [0] * (len(x) - len(y))
        return min(sum((x[(i + r) % len(x)] ^ y[i]).bit_count() for i in range(len(x))) for r in range(len(x)))

    rows = run_sql(spark, lambda q: f"SELECT * FROM {graphs.cube_distances(q)} AS d WHERE (a * 31 + b) % 4001 = 0", "").collect()
    assert len(rows) > 50
    for r in rows:
        x, y = ([v >> 16, v >> 8 & 255, v & 255] for v in (r["a"], r["b"]))
        assert r["dda"] == sum(far(cycle(x, s), cycle(y, s)) for s in range(8))


def test_exact_neighbours_by_blocks(spark):
    """Blocks of any size give the lists of all pairs: with copies, ties, a point without a vector, and distances whose order
    rounding changes."""
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (300, 6)).astype(float) + rng.standard_normal((300, 1)) * 1e-10
    x[40:90] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    asked = points.where("id % 10 = 0 OR id > 299")
    want = set()
    for i, v in rows:
        if i % 10 and i < 300:
            continue
        gone = [j for j, w in rows if j != i and (i > 299 or j > 299)]
        far = [] if i > 299 else [(round(float(sum((p - r) ** 2 for p, r in zip(v, w))), 9), j) for j, w in rows if j != i and j < 300]
        want |= {(i, b, d, n) for n, (d, b) in enumerate((sorted(far) + [(None, j) for j in sorted(gone)])[:7], 1)}
    for most in ((4096, 32768), (9, 40), (100, 3)):
        assert {tuple(r) for r in vec.nearest_lists(asked, points, 7, *most).collect()} == want


def test_exact_neighbours_hold_no_pairs(spark, tmp_path):
    """The queries' plans have blocks meet; no join holds a pair of vectors."""
    from boolscope.plans import registry

    spark.range(400).selectExpr("id AS vec_id", "transform(sequence(0, 3), j -> CAST((id * 37 + j * 11) % 101 AS FLOAT)) AS embedding", "CAST(id % 3 AS INT) AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("nearest_vectors", "classifier_accuracy", "perplexity_weights"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "zip_with" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("index", [vec.forest_leaves, vec.kd_leaves, vec.hash_leaves])
def test_leaves_measure_their_own_pairs(clustered, index):
    """Lists from leaves find neighbours, and what a shuffle carries is a vector a leaf, not two vectors a pair."""
    x, points = clustered
    lists = vec.leaf_lists(index(points, 8, 60), points)
    assert "zip_with" not in lists._jdf.queryExecution().executedPlan().toString()
    rows = vec.propagated(lists, points, 10, 1).collect()
    assert all(abs(r["d"] - np.sqrt(((x[r["a"]] - x[r["b"]]) ** 2).sum())) < 1e-9 and r["a"] != r["b"] for r in rows[::50])
    found, d = {(r["a"], r["b"]) for r in rows}, ((x[:, None] - x[None]) ** 2).sum(2) + np.diag([np.inf] * len(x))
    asked = [i for i in range(0, len(x), 10) if not 100 <= i < 180]
    assert sum((i, int(j)) in found for i in asked for j in np.argsort(d[i])[:10]) >= 0.9 * 10 * len(asked)
