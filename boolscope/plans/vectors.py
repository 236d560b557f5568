"""Queries over the embeddings: searches take the vectors whose number 100 divides against all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import Dialect
from ..operators import vectors as vec
from .registry import rows, run_sql, sql


def points(q: Dialect) -> str:
    return f"(SELECT vec_id AS id, embedding AS v, label FROM {q.table('embeddings')})"


def queries(q: Dialect) -> str:
    return f"(SELECT * FROM {points(q)} AS p WHERE id % 100 = 0)"


def queries_tenth(q: Dialect) -> str:
    return f"(SELECT * FROM {points(q)} AS p WHERE id % 10 = 0)"


def plane(q: Dialect) -> str:
    """The first two dimensions as places in a plane."""
    return f"(SELECT id, label, CAST({q.at('v', 0)} AS DOUBLE) AS x, CAST({q.at('v', 1)} AS DOUBLE) AS y FROM {points(q)} AS p)"


def dims(q: Dialect) -> str:
    if q.name == "spark":
        return f"(SELECT id, j, CAST(x AS DOUBLE) AS x FROM {points(q)} AS p LATERAL VIEW posexplode(v) AS j, x)"
    return f"(SELECT id, j, CAST(v[j + 1] AS DOUBLE) AS x FROM {points(q)} AS p CROSS JOIN range(64) AS places(j))"


@sql
def vector_means(q):
    return f"SELECT CAST(j AS BIGINT) AS j, round(avg(x), 9) AS mean, round(max(abs(x)), 9) AS largest FROM {dims(q)} AS d GROUP BY j"


@sql
def normalised_vectors(q):
    """Vectors centred, and divided by the largest absolute value of all."""
    means = f"(SELECT j, avg(x) AS mean FROM {dims(q)} AS d GROUP BY j)"
    centred = f"(SELECT d.id, d.j, d.x - m.mean AS x FROM {dims(q)} AS d JOIN {means} AS m ON d.j = m.j)"
    most = f"(SELECT max(abs(x)) AS most FROM {centred} AS c)"
    return f"SELECT id, round(sum(x / most), 6) AS total, round(max(x / most), 6) AS largest, round(sum(x * x) / max(most * most), 6) AS energy FROM {centred} AS c CROSS JOIN {most} AS m GROUP BY id"


@sql
def nearest_vectors(q):
    return f"SELECT a, b, CAST(place AS BIGINT) AS place, round(d, 6) AS d FROM {vec.nearest(q, queries(q), points(q), 10)} AS n"


@sql
def angles_to_first_vector(q):
    dot, aa, bb = q.dot("a.v", "b.v"), q.dot("a.v", "a.v"), q.dot("b.v", "b.v")
    return f"SELECT b.id, round({dot}, 6) AS dot, round(sqrt({bb}), 6) AS norm, round(2 - 2 * {dot} / sqrt({aa} * {bb}), 6) AS angular FROM {queries(q)} AS a JOIN {points(q)} AS b ON a.id = 0"


@sql
def classifier_accuracy(q):
    """Share of the held-out tenth whose label is that of most of its k nearest others; the smallest label of a tie."""
    train = f"(SELECT * FROM {points(q)} AS p WHERE id % 10 <> 0)"
    near = f"(SELECT n.a, n.place, p.label FROM {vec.nearest(q, queries_tenth(q), train, 50)} AS n JOIN {points(q)} AS p ON n.b = p.id)"
    parts = []
    for k in (1, 5, 10, 20, 30, 40, 50):
        counts = f"(SELECT a, label, count(*) AS n FROM {near} AS x WHERE place <= {k} GROUP BY a, label)"
        best = f"(SELECT a, label FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS first FROM {counts} AS c) AS r WHERE first = 1)"
        parts.append(f"SELECT CAST({k} AS BIGINT) AS k, round(avg(CASE WHEN b.label = p.label THEN 1E0 ELSE 0E0 END), 6) AS accuracy FROM {best} AS b JOIN {points(q)} AS p ON b.a = p.id")
    return " UNION ALL ".join(parts)


@sql
def held_out_split(q):
    return f"SELECT CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS held_out, count(*) AS vectors, count(DISTINCT label) AS labels FROM {points(q)} AS p GROUP BY 1"


def placed(q: Dialect, margin: str = "1") -> str:
    """Places with the corner x0, y0 of all and their larger span: ends are aggregated once, to one row."""
    ends = f"(SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) * {margin} AS span FROM {plane(q)} AS e)"
    return f"(SELECT p.*, e.x0, e.y0, e.span FROM {plane(q)} AS p CROSS JOIN {ends} AS e)"


@sql
def min_max_places(q):
    """Places scaled by the larger span, with a margin of 4 percent."""
    return f"SELECT id, round(0.04 + 0.92 * (x - x0) / span, 5) AS x, round(0.04 + 0.92 * (y - y0) / span, 5) AS y FROM {placed(q)} AS e"


@sql
def quadtree_cells(q):
    """Cells of a grid of depth 4 with their number and centre of mass."""
    return f"SELECT CAST(floor(16 * (x - x0) / span) AS BIGINT) AS cx, CAST(floor(16 * (y - y0) / span) AS BIGINT) AS cy, count(*) AS vectors, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM {placed(q, '1.000001')} AS e GROUP BY 1, 2"


@sql
def quadtree_leaves(q):
    """Leaves of a quadtree over the different places: cells of at most 16 places whose parent holds more, down to depth 8,
    with their centre of mass. Each depth is a grid; a cell looks its parent up."""
    once = f"(SELECT DISTINCT x, y, x0, y0, span FROM {placed(q, '1.000001')} AS e)"
    cells = " UNION ALL ".join(
        f"SELECT {k} AS depth, CAST(floor({1 << k} * (x - x0) / span) AS BIGINT) AS cx, CAST(floor({1 << k} * (y - y0) / span) AS BIGINT) AS cy, count(*) AS places, avg(x) AS x, avg(y) AS y FROM {once} AS o{k} GROUP BY 1, 2, 3" for k in range(9)
    )
    up = f"c.depth = p.depth + 1 AND {q.div('c.cx', 2)} = p.cx AND {q.div('c.cy', 2)} = p.cy AND p.places > 16"
    return f"SELECT CAST(c.depth AS BIGINT) AS depth, c.cx, c.cy, c.places, round(c.x, 6) AS x, round(c.y, 6) AS y FROM ({cells}) AS c LEFT JOIN ({cells}) AS p ON {up} WHERE (c.places <= 16 OR c.depth = 8) AND (c.depth = 0 OR p.depth IS NOT NULL)"


def hovered(q: Dialect, cells: int, below: str, asked: str) -> str:
    """Asked places with the nearest other whose squared distance is below a bound of (1 / cells)^2 at most: such places lie in
    the same cell of a grid or in one of the eight around it."""
    grid = f"(SELECT *, CAST(floor(x * {cells}) AS BIGINT) AS cx, CAST(floor(y * {cells}) AS BIGINT) AS cy FROM {plane(q)} AS p)"
    steps = "(SELECT * FROM (VALUES (-1), (0), (1)) AS s(step))"
    around = f"(SELECT id, x, y, cx + i.step AS cx, cy + j.step AS cy FROM {grid} AS g CROSS JOIN {steps} AS i CROSS JOIN {steps} AS j WHERE {asked})"
    far = "round(power(a.x - b.x, 2) + power(a.y - b.y, 2), 9)"
    return f"(SELECT a, b FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY {far}, b.id) AS place FROM {around} AS a JOIN {grid} AS b ON a.cx = b.cx AND a.cy = b.cy AND a.id <> b.id WHERE {far} < {below}) AS r WHERE place = 1)"


@sql
def hover_nearest(q):
    """For the places that queries point at, the nearest other place less than 1/4 away; a place without one has no row.
    Those with one less than 0.0078 away are found on a fine grid, without the pairs of a wide one."""
    close = hovered(q, 128, "0.000061", "id % 100 = 0")
    wide = hovered(q, 4, "0.0625", f"id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM {close} AS f WHERE f.a = g.id)")
    return f"SELECT a, b FROM {close} AS c UNION ALL SELECT a, b FROM {wide} AS w"


def _vectors(spark, sf_dir):
    return run_sql(spark, lambda q: f"SELECT id, v FROM {points(q)} AS p", sf_dir)


#: Trees or tables of an index, and points of a leaf.
TREES, LEAF = 16, 4096


def _improved(leaves, data):
    return vec.propagated(vec.leaf_lists(leaves, data), data, 10)


@rows
def approximate_neighbours(spark, sf_dir):
    """Trees of random hyperplanes, then neighbours of neighbours."""
    data = _vectors(spark, sf_dir)
    return _improved(vec.forest_leaves(data, TREES, LEAF), data)


@rows
def kd_tree_neighbours(spark, sf_dir):
    """Trees along single dimensions, then neighbours of neighbours."""
    data = _vectors(spark, sf_dir)
    return _improved(vec.kd_leaves(data, TREES, LEAF), data)


@rows
def hash_index_neighbours(spark, sf_dir):
    """Tables of sign codes, then neighbours of neighbours."""
    data = _vectors(spark, sf_dir)
    return _improved(vec.hash_leaves(data, TREES, LEAF, 4 * LEAF), data)


@rows
def approximate_recall(spark, sf_dir):
    """Per index, the share of the exact neighbours of the queries that its lists hold."""
    exact = run_sql(spark, lambda q: f"SELECT a, b FROM {vec.nearest(q, queries(q), points(q), 10)} AS n", sf_dir)
    out = None
    for made in (approximate_neighbours, kd_tree_neighbours, hash_index_neighbours):
        found = made(spark, sf_dir).select("a", "b", F.lit(1).alias("hit"))
        one = exact.join(found, ["a", "b"], "left").agg(F.lit(made.__name__).alias("name"), F.count("hit").alias("hits"), F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


@rows
def perplexity_weights(spark, sf_dir):
    near = run_sql(spark, lambda q: f"SELECT a, b, d FROM {vec.nearest(q, queries(q), points(q), 30)} AS n", sf_dir)
    return vec.perplexity_similarities(near, 10.0)


@rows
def vector_clusters(spark, sf_dir):
    return vec.clusters(run_sql(spark, lambda q: f"SELECT id, v FROM {points(q)} AS p", sf_dir), 8).groupBy("cluster").count()
