"""Pairs of networks with close attractors, against the definition over all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from boolscope.operators import graph
from boolscope.plans import graphs
from boolscope.plans.registry import run_sql


def cycle(tables, s):
    """The cycle that a state leads to, from its smallest state on."""
    step = lambda x: sum((t >> x & 1) << i for i, t in enumerate(tables))
    for _ in range(8):
        s = step(s)
    out = [s]
    while (s := step(s)) != out[0]:
        out.append(s)
    at = out.index(min(out))
    return tuple(out[at:] + out[:at])


def far(a, b):
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    padded = short + (0,) * (len(long) - len(short))
    return min(sum((long[(i + r) % len(long)] ^ padded[i]).bit_count() for i in range(len(long))) for r in range(len(long)))


@pytest.mark.parametrize("most", [0, 1, 2, 4, 7])
def test_close_profiles_equal_all_pairs(spark, most):
    functions = [r["tt"] for r in run_sql(spark, lambda q: f"SELECT tt FROM {graphs.sbf.functions(q, 3)} AS f ORDER BY tt", "").collect()]
    rnd = random.Random(most)
    nets = sorted({tuple(rnd.choice(functions) for _ in range(3)) for _ in range(150)})
    spark.createDataFrame(nets, "f_1 bigint, f_2 bigint, f_3 bigint").createOrReplaceTempView("some_networks")
    cycles = run_sql(spark, lambda q: f"SELECT * FROM {graphs.cube_cycles(q, 'some_networks')} AS c", "")
    cycles.createOrReplaceTempView("some_cycles")
    found = run_sql(spark, lambda q: f"SELECT * FROM {graph.profiles(q, 'some_cycles')} AS p", "")
    table = run_sql(spark, lambda q: f"SELECT * FROM {graph.cycle_table(q, 'some_cycles')} AS t", "")
    name = lambda p: "|".join(":".join(map(str, c)) for c in p)
    profiles = {}
    for n in nets:
        p = tuple(cycle(n, s) for s in range(8))
        profiles[p] = profiles.get(p, 0) + 1
    assert {"|".join(r["profile"]): r["networks"] for r in found.collect()} == {name(p): n for p, n in profiles.items()}
    want = {}
    for p, q in combinations(profiles, 2):
        d = sum(far(a, b) for a, b in zip(p, q))
        if d <= most:
            want[tuple(sorted((name(p), name(q))))] = d
    got = {(r["a"], r["b"]): r["dda"] for r in graph.close_profiles(found, table, 8, most).collect()}
    assert got == want
    for view in ("some_networks", "some_cycles"):
        spark.catalog.dropTempView(view)


def test_runs_leave_few_pairs_to_measure(spark, tmp_path):
    """At the full size of three nodes, 6,019 profiles or so: under a twentieth of the pairs share a run at distance 2."""
    cycles = run_sql(spark, lambda q: f"SELECT * FROM {graphs.cube_cycles(q)} AS c", "")
    cycles.write.parquet(f"{tmp_path}/cycles")
    spark.read.parquet(f"{tmp_path}/cycles").createOrReplaceTempView("all_cycles")
    found = run_sql(spark, lambda q: f"SELECT * FROM {graph.profiles(q, 'all_cycles')} AS p", "")
    n, networks = found.agg(F.count("*"), F.sum("networks")).first()
    ends = [(0, 3), (3, 6), (6, 8)]
    runs = found.select(F.explode(F.array(*(F.concat_ws("|", F.lit(str(i)), F.slice("profile", a + 1, b - a)) for i, (a, b) in enumerate(ends)))).alias("run"))
    pairs = runs.groupBy("run").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert networks == 32768 and pairs < n * (n - 1) / 2 / 20
    spark.catalog.dropTempView("all_cycles")
