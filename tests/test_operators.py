"""Files, graphs and vectors on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from boolscope.operators import graph
from boolscope.operators import vectors as vec
from boolscope.plans import registry
from boolscope.sources import files

EXAMPLE = '0,2,0,"1[*,*]",0101,0000,1,0,0,0,1.0,2,4,0.0,0.25,7'
BARE = "0,2,0,1[*,*],0101,0000,1,0,0,0,1.0,2,4,0.0,0.25,7"


@pytest.mark.parametrize("row", [EXAMPLE, BARE])
def test_network_files(spark, tmp_path, row):
    """Quoted trees, and trees whose commas no quotes keep together."""
    schema = files.network_schema(2, tree=True)
    (tmp_path / "in.csv").write_text("v_2,v_1,v_0,tree\n" + row + "\n")
    got = files.read_networks(spark, str(tmp_path / "in.csv"), schema).first()
    assert (got["tree"], got["f_1"], got["w_1,1"], got["GenotypeCount"], got["Evolvability"]) == ("1[*,*]", "0101", 1, 4, 7)


def test_network_round_trip(spark, tmp_path):
    schema = files.network_schema(2)
    df = spark.createDataFrame([(0, 2, 0, "0101", "0000", 1, 0, 0, 0, 1.0, 2, 4, 0.0, 0.25, 7)], files.network_schema(2).fieldNames()).select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields))
    files.write_networks(df, f"{tmp_path}/out")
    assert files.read_networks(spark, f"{tmp_path}/out", schema).collect() == df.collect()


def test_edges_vectors_layouts(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2.5), (1, 2, 1.0)], "a long, b long, weight double")
    files.write_edges(edges, 3, f"{tmp_path}/edges")
    assert sorted(files.read_edges(spark, f"{tmp_path}/edges").collect()) == sorted(edges.collect())
    (tmp_path / "v.txt").write_text("2 3\n1 2 3\n4 5 6\n")
    assert sorted(r["v"] for r in files.read_vectors(spark, f"{tmp_path}/v.txt").collect()) == [[1, 2, 3], [4, 5, 6]]
    files.write_layout(spark.createDataFrame([(1, 0.5, -0.25)], "id long, x double, y double"), f"{tmp_path}/xy")
    assert files.read_layout(spark, f"{tmp_path}/xy").first() == (1, 0.5, -0.25)


def test_dialogues(spark, tmp_path):
    lines = [json.dumps({"type": "user", "timestamp": "t", "message": {"content": "a <x>hidden</x> b"}}), "{broken", json.dumps({"type": "system", "message": {"content": "no"}})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert [r["text"] for r in files.read_dialogues(spark, f"{tmp_path}/log.jsonl").collect()] == ["a  b"]


def test_embedding_and_summary(spark):
    v = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {json.loads(r["value"])["id"]: json.loads(r["value"]).get("near") for r in files.embedded_json(v, spark.createDataFrame([(1, 2)], "a long, b long")).collect()}
    assert got == {1: [2], 2: [1], 3: None}
    manifest, table = files.summary({"edges": {"expected": 3, "obtained": 3}, "trees": {"expected": 1, "obtained": 2}})
    assert json.loads(manifest)["trees"]["obtained"] == 2 and table.endswith("| trees | 1 | 2 | no |")


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)]
    rnd.shuffle(edges)
    v = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102, 200]], "id long")
    got = {r["id"]: r["component"] for r in graph.components(v, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}


def test_frontier_is_bounded_and_repeatable(spark):
    edges = spark.createDataFrame([(i, j) for i in range(30) for j in range(i + 1, 30)], "a long, b long")
    seeds = spark.createDataFrame([(0,)], "id long")
    a, b = ([tuple(r) for r in graph.frontier(seeds, edges, 12, 3).collect()] for _ in range(2))
    assert a == b and len(a) == 12 and a[0] == (0, 0) and sum(layer == 1 for _, layer in a) == 3


def test_coarsening_shrinks(spark):
    edges = spark.createDataFrame([(0, i, 1.0) for i in range(1, 9)] + [(8, 9, 1.0), (9, 10, 1.0), (10, 11, 1.0)], "a long, b long, weight double")
    assert graph.coarsened(edges).count() < 11


def test_layouts_pull_neighbours_together(spark):
    ring = [(0, i, (i + 1) % 12, 1.0) for i in range(12)]
    edges = spark.createDataFrame(ring, "component long, a long, b long, weight double")
    for made in (graph.spring_layout(edges), graph.sampled_layout(edges)):
        at = {r["id"]: (r["x"], r["y"]) for r in made.collect()}
        far = lambda a, b: sum((p - q) ** 2 for p, q in zip(at[a], at[b])) ** 0.5
        near = sum(far(i, (i + 1) % 12) for i in range(12))
        assert near < sum(far(i, (i + 6) % 12) for i in range(12))


def test_walks_stay_on_edges(spark):
    near = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src long, dst long")
    seeds = spark.createDataFrame([(1, 0, 0), (2, 2, 1)], "chain long, f_1 long, f_2 long")
    rows = graph.metropolis_walks(seeds, near, 2, 200).orderBy("chain", "step").collect()
    assert len(rows) == 400
    for a, b in zip(rows, rows[1:]):
        if a["chain"] == b["chain"]:
            assert abs(a["f_1"] - b["f_1"]) + abs(a["f_2"] - b["f_2"]) <= 1


def test_hull():
    assert graph.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2), (1, 0)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert graph.hull([(1, 1)]) == [(1, 1)]


def test_samples(spark):
    table = spark.createDataFrame([(10, 1, 0), (20, 98, 1), (30, 1, 2)], "tt long, n_cols long, idx long")
    even = graph.variety_draws(spark, table, 2, 9).collect()
    assert len(even) == len(set(even)) == 9
    sized = graph.variety_draws(spark, table, 1, 3, by_genotype=True).collect()
    assert sized[0]["f_1"] == 20


def test_perplexity(spark):
    rows = [(1, b, float(b * b) / 50) for b in range(2, 40)]
    got = vec.perplexity_similarities(spark.createDataFrame(rows, "a long, b long, d double"), 8.0).toPandas()["similarity"]
    import numpy as np

    assert abs(np.exp(-(got * np.log(got)).sum()) - 8) < 0.01 and abs(got.sum() - 1) < 1e-9


def test_propagation_finds_neighbours(spark):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, v array<double>")
    start = spark.createDataFrame([(i, (i + 2) % 20, 2.0) for i in range(20)] + [(i, (i - 1) % 20, 1.0) for i in range(20)], "a long, b long, d double")
    got = {(r["a"], r["b"]) for r in vec.propagated(start, points, 2, 3).collect()}
    assert {(10, 9), (10, 11)} <= got


def test_levels_and_convergence(spark):
    edges = spark.createDataFrame([(i, (i + j) % 300, 1.0) for i in range(300) for j in (1, 2)], "a long, b long, weight double")
    made = graph.levels(edges, least=20)
    assert len(made) > 2 and [e.count() for e in made] == sorted((e.count() for e in made), reverse=True)
    assert graph.convergence([1.0] * 5 + [0.5] * 5) == [None] * 9 + [0.5]


def test_hover_looks_into_cells_around(spark, tmp_path):
    """Nearest places by brute force, across borders of cells and for places alone in theirs."""
    rnd = random.Random(3)
    at = {i: (rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for i in range(0, 4000, 20)} | {5000: (0.26, 3.1), 5001: (0.24, 3.1), 5002: (0.45, 3.1), 5100: (7.0, 7.0), 5101: (7.2, 7.2)}
    spark.createDataFrame([(i, [x, y], 0) for i, (x, y) in at.items()], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    far = lambda a, b: (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2
    want = {(a, min((b for b in at if b != a), key=lambda b: far(a, b))) for a in at if a % 100 == 0}
    want = {(a, b) for a, b in want if far(a, b) < 0.25**2}
    got = registry.QUERIES["hover_nearest"](spark, str(tmp_path)).collect()
    assert {(r["a"], r["b"]) for r in got} == want and (5000, 5001) in want and len(got) == len(want) > 30
