"""Functions of 6 nodes and networks of 5, against published counts and plain recursion."""

import random
from itertools import permutations, product

import duckdb

from boolscope.functions import bits
from boolscope.functions.dialect import Dialect, Oracle
from boolscope.operators import decomposition as dec
from boolscope.operators import orbits


def code(weights):
    return sum(1 << (s - 1) for s in range(1, 1 << len(weights)) if sum(w for i, w in enumerate(weights) if s >> i & 1) > 0)


def permuted(value, order):
    """A code when node order[i] takes the place of node i."""
    return sum((value >> (sum(1 << n for i, n in enumerate(order) if s >> i & 1) - 1) & 1) << (s - 1) for s in range(1, 1 << len(order)))


def test_published_counts():
    q = Oracle()
    got = [duckdb.sql(f"SELECT count(*), CAST(sum(members) AS BIGINT) FROM {orbits.orbits(q, d)} AS o").fetchall()[0] for d in range(1, 7)]
    assert got == [(2, 2), (4, 6), (10, 32), (36, 370), (224, 11292), (3024, 1066044)]


def test_orbits_by_all_orders():
    """Bounds and sizes of 4 nodes' orbits from all columns of weights and all orders of nodes."""
    functions = {}
    for w in product(range(-3, 4), repeat=4):
        functions[code(w)] = min(functions.get(code(w), 9), max(map(abs, w)))
    want = {}
    for c, b in functions.items():
        want.setdefault(min(permuted(c, p) for p in permutations(range(4))), []).append((c, b))
    got = {min(permuted(c, p) for p in permutations(range(4))): (b, n) for c, b, n in duckdb.sql(f"SELECT code, bound, members FROM {orbits.orbits(Oracle(), 4)} AS o").fetchall()}
    assert got == {k: (min(b for _, b in v), len(v)) for k, v in want.items()}


def test_separable_functions(spark):
    """All functions of 3 nodes without state 0: those that weights realize, and no others."""
    q = Dialect(spark=spark)
    got = {r["code"] for r in spark.sql(f"SELECT code FROM {orbits.separable(q, '(SELECT id AS code FROM range(128))', 3)} AS s").collect()}
    assert got == {code(w) for w in product(range(-2, 3), repeat=3)} and len(got) == 32


def test_flips_reach_all_orbits():
    """Steps by single states from the constant function reach every orbit, of 6 nodes too; steps of 4 nodes as counted."""
    q = Oracle()
    for d, n in ((4, 36), (5, 224), (6, 3024)):
        steps = {}
        for a, b in duckdb.sql(f"SELECT DISTINCT code, to_orbit FROM {orbits.flips(q, orbits.orbits(q, d), d)} AS f").fetchall():
            steps.setdefault(a, set()).add(b)
        seen, front = {0}, {0}
        while front:
            front = {b for a in front for b in steps[a]} - seen
            seen |= front
        assert len(seen) == n
    all_ = {code(w) for w in product(range(-3, 4), repeat=4)}
    for c, n in duckdb.sql(f"SELECT code, count(*) FROM {orbits.flips(q, orbits.orbits(q, 4), 4)} AS f GROUP BY code").fetchall():
        assert n == sum(c ^ (1 << i) in all_ for i in range(15))


def finest(tables, d, fixed, values):
    """The code of the finest vector of a face, by recursion over all its splits."""
    face = bits.Face(d, fixed, values)
    best = bits.leaf_code(d, face.dim)
    for n in face.free:
        if all((tables[n - 1] >> s & 1) == (s >> (n - 1) & 1) for s in face.states):
            low, high = face.with_node(n, 0), face.with_node(n, 1)
            best = max(best, finest(tables, d, low.fixed, low.values) + finest(tables, d, high.fixed, high.values))
    return best


def test_packed_faces(spark):
    """1,000 networks of 5 nodes, most of which split: nodes keep their value on random faces."""
    rnd = random.Random(3)
    rows = set()
    while len(rows) < 1000:
        tables = []
        for n in range(1, 6):
            fixed = rnd.choice([0, 0, *range(32)])
            mask = bits.Face(5, fixed, rnd.randrange(32) & fixed).mask
            tables.append(bits.projection(5, n) & mask | rnd.getrandbits(32) & ~mask)
        rows.add(tuple(tables))
    spark.createDataFrame(sorted(rows), ", ".join(f"f_{i} long" for i in range(1, 6))).createOrReplaceTempView("networks_of_five")
    got = {tuple(r)[:5]: r["code"] for r in spark.sql(dec.finest_packed("networks_of_five", 5)[1:-1]).collect()}
    assert got == {t: finest(t, 5, 0, 0) for t in rows} and len(set(got.values())) > 20


def test_vectors_by_batches_equal_those_by_arrays(spark, tmp_path):
    """Columns of a batch give what arrays give row by row, and the query's plan has no lambda a row."""
    from boolscope.plans import registry

    rows = "xxhash64(id, {i}) & 4294967295"
    made = spark.range(300).selectExpr(*(f"CASE WHEN id % 7 = {i} THEN CAST({bits.projection(5, i)} AS BIGINT) ELSE {rows.format(i=i)} & {rows.format(i=i + 9)} END AS f_{i}" for i in range(1, 6)))
    made.createOrReplaceTempView("networks_by_batches")
    want = {tuple(r)[:5]: r["code"] for r in spark.sql(dec.finest_packed("networks_by_batches", 5)[1:-1]).collect()}
    assert {tuple(r)[:5]: r["code"] for r in dec.with_finest(made, 5).collect()} == want and len(set(want.values())) > 1
    spark.range(60).selectExpr("id AS l_orderkey", "id * 7 AS l_partkey", "id % 5 AS l_suppkey", "CAST(id % 5 + 1 AS INT) AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = registry.QUERIES["vectors_of_draws_d5"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "MapInArrow" in plan
