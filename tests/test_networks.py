"""Known counts of threshold networks, and every query that has an oracle against it on the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal
from itertools import product

import duckdb
import pytest

from boolscope.functions import bits, trees
from boolscope.functions.dialect import Dialect, Oracle
from boolscope.operators import decomposition as dec
from boolscope.operators import dynamics as dyn
from boolscope.operators import sbf
from boolscope.plans import registry
from boolscope.plans.networks import every

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "nation", "supplier", "part", "orders", "lineitem", "events", "embeddings", "conversations")


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, (float, Decimal)):
        return "0" if v == 0 else f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_oracle(spark, oracle, name):
    df = registry.QUERIES[name](spark, DATA)
    found = oracle.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted("|".join(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted("|".join(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 1


def duck(text):
    return duckdb.sql(text).fetchall()


def test_function_counts():
    q = Oracle()
    assert [duck(f"SELECT count(*) FROM {sbf.functions(q, d)}")[0][0] for d in (1, 2, 3, 4, 5)] == [2, 6, 32, 370, 11292]


def test_orbits():
    q = Oracle()
    assert [duck(f"SELECT count(DISTINCT {sbf.canonical('tt', d)}) FROM {sbf.functions(q, d)} AS f")[0][0] for d in (1, 2, 3, 4)] == [2, 4, 10, 36]


def test_counts_without_enumeration():
    q = Oracle()
    got = [int(duck(f"SELECT * FROM {dec.guarded_decomposable_count(q, sbf.functions(q, d), d)}")[0][0]) for d in (1, 2, 3, 4, 5)]
    assert got == [1, 5, 658, 11_923_831, 475_605_031_121_746]


def test_tree_rows():
    q = Oracle()
    rows = dict(((m, a), b) for m, a, b in [("free", *duck(f"SELECT 0, sum(trees) FROM {dec.finest(every(q, 3), 3, False, 'trees', 'count')}")[0]), ("guarded", *duck(f"SELECT 0, sum(trees) FROM {dec.finest(every(q, 3), 3, True, 'trees', 'count')}")[0])])
    assert rows == {("free", 0): 39_020, ("guarded", 0): 34_343}
    assert duck(f"SELECT count(*) FROM {dec.decomposed(every(q, 2), 2, True)}")[0][0] == 50


def test_dynamics_per_vector():
    """Guarded networks per vector, and how many of them decompose further."""
    got = {tuple(r[:4]): (r[4], r[5], r[6]) for r in duck(registry.ORACLES["labelled_trees_by_vector_d3"])}
    assert got[1, 0, 0, 0] == (32_768, 32_768, 658) and got[0, 2, 0, 0] == (675, 658, 139)
    assert sum(v[0] for v in got.values()) == 34_343


def test_fixed_tree():
    got = {(m, h): n for m, h, n in duck(registry.ORACLES["fixed_tree_d3"])}
    assert got["guarded_mode", "equal"] == 36 and got["guarded_mode", "different"] == 189
    assert got["free_mode", "equal"] + got["free_mode", "different"] == 1024
    assert duck(registry.ORACLES["fixed_tree_difference_d3"]) == [(799,)]


def test_published_counts():
    assert duck(registry.ORACLES["mutation_edge_count_d3"]) == [(451_584,)]
    assert duck(registry.ORACLES["free_only_networks_d3"])[0][0] == 2_319
    assert sum(r[-1] for r in duck(registry.ORACLES["labels_required_d3"])) == 24
    assert sum(n for trivial, face, _, n in duck(registry.ORACLES["invariant_faces_d3"]) if trivial and face) == 25_697
    assert sum(r[1] for r in duck(registry.ORACLES["inhibitor_networks_d3"])) == 216
    assert dict(duck(registry.ORACLES["slices_of_first_function_d3"])) == {"000": 6144, "001": 10240, "010": 10240, "011": 6144}
    assert duck(registry.ORACLES["finest_ties_d3"])[0][1] == 0
    assert duck(registry.ORACLES["spearman_robustness_evolvability_d2"])[0][0] == pytest.approx(0.6248, abs=5e-5)
    assert duck(registry.ORACLES["spearman_of_statistics_d3"])[0][2] == pytest.approx(0.8128, abs=5e-5)
    assert duck(registry.ORACLES["genotype_total_d3"])[0][:2] == (5**9, 19_683)
    assert all(r[3] == 0 for r in duck(registry.ORACLES["control_tests_agree_d3"]))
    assert {d: p for d, p in duck(registry.ORACLES["trivial_share"])}[4] == pytest.approx(98.9233)


def paths(f, n):
    """Cycles of a state map by walking it."""
    cycles = set()
    for s in range(n):
        seen = []
        while s not in seen:
            seen.append(s)
            s = f[s]
        cycles.add(tuple(sorted(seen[seen.index(s) :])))
    return cycles


def test_attractors(spark):
    q = Dialect()
    rows = spark.sql(f"SELECT f_1, f_2, num_attractors, cycle_len_msq FROM {dyn.with_attractors(q, every(q, 2), 2)} AS n").collect()
    assert len(rows) == 36
    for r in rows:
        f = [(r["f_1"] >> s & 1) | (r["f_2"] >> s & 1) << 1 for s in range(4)]
        c = paths(f, 4)
        assert (r["num_attractors"], r["cycle_len_msq"]) == (len(c), sum(len(x) ** 2 for x in c) / len(c))


def best(f, d, face=None):
    """The finest vector by plain recursion."""
    face = face or bits.Face(d, 0, 0)
    options = [(1, *(int(k == face.dim) for k in range(d + 1)))]
    for n in face.free:
        if f[n - 1] & face.mask == bits.projection(d, n) & face.mask:
            a, b = best(f, d, face.with_node(n, 0)), best(f, d, face.with_node(n, 1))
            options.append(tuple(x + y for x, y in zip(a, b)))
    return max(options)


def test_finest_vectors(spark):
    q = Dialect()
    for r in spark.sql(f"SELECT f_1, f_2, f_3, code FROM {dec.finest('(SELECT f_1, f_2, f_3 FROM ' + every(q, 3) + ' AS x WHERE f_1 % 7 = 0)', 3)} AS n").collect():
        want = best((r["f_1"], r["f_2"], r["f_3"]), 3)
        assert r["code"] == sum(v * 9 ** (4 - i) for i, v in enumerate(want))


def test_functions_by_definition():
    for d, bound in ((1, 1), (2, 1), (3, 2)):
        tables = {sum(1 << s for s in range(1 << d) if sum(w[i] for i in range(d) if s >> i & 1) > 0) for w in product(range(-bound, bound + 1), repeat=d)}
        assert sorted(tables) == bits.realized(d, bound)
    assert [len(bits.trees(bits.Face(d, 0, 0))) for d in (1, 2, 3)] == [2, 9, 244]
    assert [len(bits.shapes(d)) for d in (1, 2, 3, 4)] == [2, 5, 26, 677]
    assert [len({v for _, v in bits.shapes(d)}) for d in (1, 2, 3, 4)] == [2, 4, 10, 36]


def test_trees_as_text():
    for t in bits.trees(bits.Face(3, 0, 0)):
        tree = trees.parse(t.text)
        assert trees.serialize(tree) == t.text and len(trees.depths(tree)) == len(t.leaves)
        assert math.isclose(sum(2.0**-x for x in trees.depths(tree)), 1)
    assert trees.one_label_a_depth(trees.parse("2[1[*,*],1[*,*]]")) and not trees.one_label_a_depth(trees.parse("3[2[*,*],1[*,*]]"))
    assert trees.arguments("a(1,2),b,c(d(3),4)") == ["a(1,2)", "b", "c(d(3),4)"]
