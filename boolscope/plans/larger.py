"""Queries over functions of 6 nodes and networks of 5 that lineitem's rows draw."""

from __future__ import annotations

from ..functions import bits
from ..functions.dialect import Dialect, Oracle
from ..operators import decomposition as dec
from ..operators import orbits, sbf
from ..sources import scans
from .networks import vector
from .registry import paired, run_sql

#: A row's six weights from -9 to 9, as numbers from 0 to 18, and its five functions' places in order.
WEIGHTS = ("l_orderkey % 19", "l_partkey % 19", "l_suppkey % 19", "{div_order} % 19", "{div_part} % 19", "(l_suppkey * 7 + l_linenumber) % 19")
PLACES = ("l_orderkey % 11292", "l_partkey % 11292", "l_suppkey % 11292", "(l_orderkey * 7 + l_linenumber) % 11292", "(l_partkey + 13 * l_linenumber) % 11292")


def drawn_functions(q: Dialect) -> str:
    """(code, orbit, draws): the different functions of 6 nodes that rows draw by their weights, which are counted first. The
    orbit's code is that of the same weights in falling order."""
    div = {"div_order": q.div("l_orderkey", 19), "div_part": q.div("l_partkey", 19)}
    names = [f"w_{i}" for i in range(1, 7)]
    rows = f"(SELECT {', '.join(f'CAST({w.format(**div)} - 9 AS INT) AS {n}' for w, n in zip(WEIGHTS, names))} FROM {q.table('lineitem')})"
    counted = f"(SELECT {', '.join(names)}, count(*) AS draws FROM {rows} AS r GROUP BY {', '.join(names)})"
    ordered = f"(SELECT *, {q.ascending(q.array(names))} AS rising FROM {counted} AS c)"
    ordered = f"(SELECT *, {', '.join(f'{q.at("rising", 5 - i)} AS u_{i}' for i in range(6))} FROM {ordered} AS o)"
    coded = f"(SELECT {orbits.code_of(names)} AS code, {orbits.code_of([f'u_{i}' for i in range(6)])} AS orbit, draws FROM {ordered} AS u)"
    return f"(SELECT code, min(orbit) AS orbit, CAST(sum(draws) AS BIGINT) AS draws FROM {coded} AS f GROUP BY code)"


#: The same in other words: codes state by state, nodes arranged as lists.
_FUNCTIONS = """weighted AS (SELECT [l_orderkey % 19 - 9, l_partkey % 19 - 9, l_suppkey % 19 - 9, l_orderkey // 19 % 19 - 9, l_partkey // 19 % 19 - 9, (l_suppkey * 7 + l_linenumber) % 19 - 9] AS w, count(*) AS draws FROM lineitem GROUP BY 1),
    valued AS (SELECT w, any_value(draws) AS draws, CAST(sum(CASE WHEN list_sum([w[i] * ((s >> (i - 1)) & 1) for i in range(1, 7)]) > 0 THEN 1::BIGINT << (s - 1) ELSE 0 END) AS BIGINT) AS code FROM weighted, range(1, 64) AS r(s) GROUP BY w),
    functions AS (SELECT code, CAST(sum(draws) AS BIGINT) AS draws FROM valued GROUP BY code),
    held AS (SELECT code, i, count(*) AS n FROM functions, range(1, 64) AS r(s), range(6) AS x(i) WHERE (code >> (s - 1)) & 1 = 1 AND (s >> i) & 1 = 1 GROUP BY ALL),
    all_held AS (SELECT code, i, coalesce(n, 0) AS n FROM (SELECT code, i FROM functions, range(6) AS x(i)) LEFT JOIN held USING (code, i)),
    ordered AS (SELECT code, list(1 << CAST(i AS INT) ORDER BY n DESC, i) AS nodes FROM all_held GROUP BY code),
    alike AS (SELECT code, CAST(720 / product(many) AS INT) AS members FROM (SELECT code, n, CAST(product(place) AS BIGINT) AS many FROM (SELECT code, n, row_number() OVER (PARTITION BY code, n ORDER BY i) AS place FROM all_held) GROUP BY code, n) GROUP BY code),
    orbit_of AS (SELECT code, CAST(sum(((code >> CAST(list_sum([nodes[p + 1] * ((s >> p) & 1) for p in range(6)]) - 1 AS BIGINT)) & 1) << (s - 1)) AS BIGINT) AS orbit FROM ordered, range(1, 64) AS r(s) GROUP BY code)"""
_BOUNDS = """columns_ AS (SELECT a, b, c, d, e, f FROM range(-9, 10) AS r1(a), range(-9, 10) AS r2(b), range(-9, 10) AS r3(c), range(-9, 10) AS r4(d), range(-9, 10) AS r5(e), range(-9, 10) AS r6(f) WHERE a >= b AND b >= c AND c >= d AND d >= e AND e >= f),
    realized AS (SELECT max(greatest(abs(a), abs(f))) AS bound, CAST(sum(CASE WHEN a * (s & 1) + b * ((s >> 1) & 1) + c * ((s >> 2) & 1) + d * ((s >> 3) & 1) + e * ((s >> 4) & 1) + f * ((s >> 5) & 1) > 0 THEN 1::BIGINT << (s - 1) ELSE 0 END) AS BIGINT) AS orbit
      FROM columns_, range(1, 64) AS r(s) GROUP BY a, b, c, d, e, f)"""


@paired(f"""WITH {_FUNCTIONS}, {_BOUNDS}
    SELECT orbit, count(*) AS functions, CAST(sum(draws) AS BIGINT) AS draws, any_value(members) AS members, any_value(b.bound) AS bound
    FROM functions JOIN orbit_of USING (code) JOIN alike USING (code) JOIN (SELECT orbit, CAST(min(bound) AS INT) AS bound FROM realized GROUP BY orbit) AS b USING (orbit) GROUP BY orbit""")  # fmt: skip
def orbits_of_drawn_functions(spark, sf_dir):
    """Orbits of 6 nodes' functions that rows draw: the functions and draws in each, all its functions' number, and the
    least bound of weights that realizes them."""

    def text(q: Dialect) -> str:
        drawn = f"(SELECT orbit, count(*) AS functions, CAST(sum(draws) AS BIGINT) AS draws FROM {drawn_functions(q)} AS f GROUP BY orbit)"
        return f"SELECT d.*, o.members, o.bound FROM {drawn} AS d LEFT JOIN {orbits.orbits(q, 6)} AS o ON d.orbit = o.code"

    return run_sql(spark, text, sf_dir)


def walls(q: Dialect) -> str:
    drawn = f"(SELECT DISTINCT orbit AS code FROM {drawn_functions(q)} AS s)"
    return f"SELECT code AS orbit, count(*) AS walls, count(DISTINCT to_orbit) AS neighbours, min(to_orbit) AS least FROM {orbits.flips(q, drawn, 6)} AS f GROUP BY code"


@paired(walls(Oracle()))
def walls_of_drawn_orbits(spark, sf_dir):
    """How many states of each drawn orbit's function can change their value so that it stays a threshold function, and to how
    many orbits that leads."""
    return run_sql(spark, walls, sf_dir)


def five_nodes(q: Dialect) -> str:
    """(f_1 .. f_5, draws): the different networks of 5 nodes that rows draw; node l_linenumber keeps its own value."""
    names = [f"f_{i}" for i in range(1, 6)]
    rows = f"(SELECT l_linenumber, {', '.join(f'{p} AS p_{i}' for i, p in enumerate(PLACES, 1))} FROM {q.table('lineitem')})"
    drawn = scans.drawn_networks(rows, sbf.functions(q, 5), [f"draw.p_{i}" for i in range(1, 6)])
    kept = ", ".join(f"CASE WHEN l_linenumber = {i} THEN CAST({bits.projection(5, i)} AS BIGINT) ELSE f_{i} END AS f_{i}" for i in range(1, 6))
    return f"(SELECT {', '.join(names)}, count(*) AS draws FROM (SELECT {kept} FROM {drawn} AS d) AS k GROUP BY {', '.join(names)})"


def finest_five(q: Dialect) -> str:
    return f"SELECT f_1, f_2, f_3, f_4, f_5, draws, {vector(q, 'code', 5)} AS vector FROM {dec.finest(five_nodes(q), 5)} AS n"


@paired(finest_five(Oracle()))
def vectors_of_draws_d5(spark, sf_dir):
    """Finest vectors of the networks of 5 nodes that rows draw: layers of faces as columns of a batch; the oracle unrolls
    them into columns of a table, which the engine's generated code can't hold."""
    found = dec.with_finest(run_sql(spark, lambda q: f"SELECT * FROM {five_nodes(q)} AS n", sf_dir), 5)
    return found.selectExpr("f_1", "f_2", "f_3", "f_4", "f_5", "draws", f"{vector(Dialect(), 'code', 5)} AS vector")
