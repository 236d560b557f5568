"""Alias tables: weights kept, shares of draws, odd weights."""

import math

import pytest

from boolscope.operators import sampling


@pytest.mark.parametrize("per_bucket", [1, 7, 1000])
def test_tables_keep_weights_and_draws_follow_them(spark, per_bucket):
    weights = {i: (i % 10 + 1) ** 2.0 if i else 500.0 for i in range(60)}
    given = spark.createDataFrame([*weights.items(), (100, 0.0), (101, None), (102, -1.0)], "id long, w double")
    table = sampling.alias_table(given, per_bucket).cache()
    assert table.count() == 60
    got = {r["id"]: r["w"] for r in sampling.masses(table).collect()}
    assert got.keys() == weights.keys() and all(math.isclose(got[i], w, rel_tol=1e-9) for i, w in weights.items())
    n, total = 40_000, sum(weights.values())
    drawn = {r["id"]: r["count"] for r in sampling.draws(spark, table, n, 5).groupBy("id").count().collect()}
    assert sum(drawn.values()) == n
    for i, w in weights.items():
        p = w / total
        assert abs(drawn.get(i, 0) - n * p) <= 4.5 * math.sqrt(n * p * (1 - p)), i
    again = {r["id"]: r["count"] for r in sampling.draws(spark, table, n, 5).groupBy("id").count().collect()}
    assert again == drawn


def test_no_weights_no_draws(spark):
    none = sampling.alias_table(spark.createDataFrame([], "id long, w double"))
    assert sampling.draws(spark, none, 10).count() == 0 and sampling.masses(none).count() == 0
