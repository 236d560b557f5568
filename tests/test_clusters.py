"""Suns and systems, communities and hops against plain searches on small graphs."""

import random

import pytest

from boolscope.operators import clusters

EDGES = "a long, b long, weight double"


def graph_of(spark, edges):
    return spark.createDataFrame([(a, b, 1.0) for a, b in edges], EDGES)


def near_of(n, edges):
    near = [set() for _ in range(n)]
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def reached(near, v, most):
    seen, layer, out = {v}, {v}, []
    for _ in range(most):
        layer = set().union(*(near[u] for u in layer)) - seen if layer else set()
        seen |= layer
        out.append(layer)
    return out


def some_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, i) for i in range(1, n, 7)]  # a hub


def test_systems(spark):
    n, edges = 300, some_edges(290, 330, 3)
    near = near_of(n, edges)
    got = {r["id"]: (r["sun"], r["hops"]) for r in clusters.systems(spark.range(n), graph_of(spark, edges)).collect()}
    assert got.keys() == set(range(n))  # each in one system
    suns = {v for v, (s, h) in got.items() if h == 0}
    assert all(got[v][0] == v for v in suns) and 295 in suns
    for v, (s, h) in got.items():
        ways = reached(near, v, 2)
        assert s in suns and (s == v if h == 0 else s in ways[h - 1])
        if v in suns:
            assert not suns & (ways[0] | ways[1])
    e = graph_of(spark, edges).selectExpr("a", "b", "weight", "1.0D AS length")
    links = clusters.between_suns(e, clusters.systems(spark.range(n), graph_of(spark, edges))).collect()
    want = {}
    for a, b in edges:
        (x, h), (y, g) = got[a], got[b]
        if x != y:
            want.setdefault((min(x, y), max(x, y)), []).append(1 + h + g)
    assert {(r["a"], r["b"]): (r["weight"], round(r["length"], 9)) for r in links} == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}
    assert 0 < len(suns) < n / 3


@pytest.mark.parametrize("most", [1, 3])
def test_hops_from_all(spark, most):
    n, edges = 400, some_edges(380, 420, 5)
    near = near_of(n, edges)
    want = {(v, k + 1, len(layer)) for v in range(n) for k, layer in enumerate(reached(near, v, most)) if layer}
    got = [(r["id"], r["hops"], r["reached"]) for r in clusters.hops_from_all(spark.range(n), graph_of(spark, edges + edges[:20]), most).collect()]
    assert len(got) == len(want) and set(got) == want


def planted(k, size, inner, outer, seed):
    rng = random.Random(seed)
    n = k * size
    return n, [(a, b) for a in range(n) for b in range(a) if rng.random() < (inner if a // size == b // size else outer)]


def one_by_one(n, edges):
    """Greedy moves of single vertices until none gains, and once more over the communities made: the plain sequential way."""
    weight = {}
    for a, b in edges:
        weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0) + 1
    names = list(range(n))
    while True:
        near, load = {}, {}
        for (a, b), w in weight.items():
            load[a], load[b] = load.get(a, 0) + w, load.get(b, 0) + w
            if a != b:
                near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
        total, at, mass, moved = sum(load.values()), {v: v for v in load}, dict(load), False
        while True:
            again = False
            for v in sorted(near):
                to = {at[v]: 0}
                for u, w in near[v].items():
                    to[at[u]] = to.get(at[u], 0) + w
                mass[at[v]] -= load[v]
                best = max(sorted(to), key=lambda c: (to[c] - load[v] * mass[c] / total, c == at[v]))
                again |= best != at[v]
                at[v] = best
                mass[best] += load[v]
            moved |= again
            if not again:
                break
        names = [at.get(c, c) for c in names]
        if not moved:
            return names
        joined = {}
        for (a, b), w in weight.items():
            key = min(at[a], at[b]), max(at[a], at[b])
            joined[key] = joined.get(key, 0) + w
        weight = joined


@pytest.mark.parametrize("inner,outer", [(0.5, 0.02), (0.25, 0.04)])
def test_communities(spark, inner, outer):
    n, edges = planted(6, 30, inner, outer, 2)
    e = graph_of(spark, edges)
    found, quality = clusters.communities(e)
    assert abs(quality - clusters.modularity(e, found)) < 1e-9
    plain = spark.createDataFrame(list(enumerate(one_by_one(n, edges))), "id long, community long")
    assert quality >= clusters.modularity(e, plain) - 0.02
    if outer < 0.03:
        parts = {}
        for r in found.collect():
            parts.setdefault(r["community"], set()).add(r["id"] // 30)
        assert len(parts) == 6 and all(len(p) == 1 for p in parts.values())


def test_odd_graphs(spark):
    none = spark.createDataFrame([], EDGES)
    assert clusters.systems(spark.range(0), none).count() == 0 and clusters.hops_from_all(spark.range(0), none, 2).count() == 0
    assert clusters.communities(none)[0].count() == 0
    loop = graph_of(spark, [(1, 1), (2, 3), (3, 2)])
    assert {(r["id"], r["community"]) for r in clusters.communities(loop)[0].collect()} == {(1, 1), (2, 2), (3, 2)}
    assert clusters.hops_from_all(spark.range(5), loop, 2).count() == 2
