"""Tables of threshold functions: column sets, neutral neighbours, evolvability, neighbour graph, orbits."""

from __future__ import annotations

from itertools import permutations

from ..functions import bits
from ..functions.dialect import Dialect
from ..sources import scans


def functions(q: Dialect, d: int, bound: int | None = None) -> str:
    """(tt, n_cols, rep, idx): truth tables with the number of columns that realize them, the first of these, and
    their place in order."""
    text = f"(SELECT tt, count(*) AS n_cols, min(id) AS rep, row_number() OVER (ORDER BY tt) - 1 AS idx FROM {scans.weights(q, d, bound)} AS w GROUP BY tt)"
    return q.named(f"functions_{d}_{bound or 0}", text)


def mutants(q: Dialect, d: int, bound: int | None = None) -> str:
    """(id, tt, to_id, to_tt): pairs of columns that differ in one weight, by arithmetic on ids."""
    b = bits.weight_bound(d) if bound is None else bound
    base, w = 2 * b + 1, scans.weights(q, d, bound)
    value = "CASE j " + " ".join(f"WHEN {i} THEN w_{i}" for i in range(1, d + 1)) + " END"
    place = "CASE j " + " ".join(f"WHEN {i} THEN {base ** (d - i)}" for i in range(1, d + 1)) + " END"
    moved = f"(SELECT id, tt, CAST(id + (v - {b} - {value}) * {place} AS BIGINT) AS to_id FROM {w} AS w CROSS JOIN range(1, {d + 1}) AS nodes(j) CROSS JOIN range({base}) AS new_weights(v) WHERE v - {b} <> {value})"
    return f"(SELECT m.id, m.tt, m.to_id, o.tt AS to_tt FROM {moved} AS m JOIN (SELECT id, tt FROM {w} AS w2) AS o ON m.to_id = o.id)"


def statistics(q: Dialect, d: int, bound: int | None = None) -> str:
    """(tt, n_cols, rep, neutral_mean, neutral_var, evolvability, idx)."""
    each = f"(SELECT id, tt, CAST(sum(CASE WHEN to_tt = tt THEN 1 ELSE 0 END) AS BIGINT) AS neutral FROM {mutants(q, d, bound)} AS m GROUP BY id, tt)"
    other = f"(SELECT tt, count(DISTINCT to_tt) AS evolvability FROM {mutants(q, d, bound)} AS m WHERE to_tt <> tt GROUP BY tt)"
    own = f"(SELECT tt, count(*) AS n_cols, min(id) AS rep, avg(neutral) AS neutral_mean, var_pop(neutral) AS neutral_var FROM {each} AS e GROUP BY tt)"
    text = f"(SELECT own.*, coalesce(other.evolvability, 0) AS evolvability, row_number() OVER (ORDER BY own.tt) - 1 AS idx FROM {own} AS own LEFT JOIN {other} AS other ON own.tt = other.tt)"
    return q.named(f"function_statistics_{d}_{bound or 0}", text)


def neighbours(q: Dialect, d: int, bound: int | None = None) -> str:
    """(src, dst): different truth tables that one weight parts; symmetric."""
    return q.named(f"function_neighbours_{d}_{bound or 0}", f"(SELECT DISTINCT tt AS src, to_tt AS dst FROM {mutants(q, d, bound)} AS m WHERE to_tt <> tt)")


def minimal_bounds(q: Dialect, d: int) -> str:
    """(tt, bound): the smallest bound of weights that realizes each truth table."""
    largest = "greatest(" + ", ".join(f"abs(w_{i})" for i in range(1, d + 1)) + ")" if d > 1 else "abs(w_1)"
    return f"(SELECT tt, min({largest}) AS bound FROM {scans.weights(q, d)} AS w GROUP BY tt)"


def permuted(table: str, d: int, order: tuple[int, ...]) -> str:
    """A truth table when node i + 1 takes the place of node order[i] + 1."""
    terms = []
    for s in range(1 << d):
        to = sum(1 << order[i] for i in range(d) if s >> i & 1)
        terms.append(f"CASE WHEN ({table} & {1 << s}) <> 0 THEN CAST({1 << to} AS BIGINT) ELSE CAST(0 AS BIGINT) END")
    return "(" + " + ".join(terms) + ")"


def canonical(table: str, d: int) -> str:
    """The smallest truth table among all orders of the nodes."""
    forms = [permuted(table, d, p) for p in permutations(range(d))]
    return f"least({', '.join(forms)})" if len(forms) > 1 else forms[0]


def canonical_forms(q: Dialect, d: int) -> str:
    """(tt, canonical): the smallest truth table among all orders of the nodes, which are rows of a table: plans stay small
    for any size."""
    moves = ", ".join(f"({k}, {s}, {sum(1 << order[i] for i in range(d) if s >> i & 1)})" for k, order in enumerate(permutations(range(d))) for s in range(1 << d))
    one = "shiftleft(CAST(1 AS BIGINT), at)" if q.name == "spark" else "(CAST(1 AS BIGINT) << at)"
    bit = "(shiftright(f.tt, s) & 1)" if q.name == "spark" else "((f.tt >> s) & 1)"
    images = f"(SELECT f.tt, m.k, sum({bit} * {one}) AS image FROM {functions(q, d)} AS f CROSS JOIN (SELECT * FROM (VALUES {moves}) AS m(k, s, at)) AS m GROUP BY f.tt, m.k)"
    return f"(SELECT tt, CAST(min(image) AS BIGINT) AS canonical FROM {images} AS i GROUP BY tt)"


def fixed_function_models(q: Dialect, d: int, tables: list[int]) -> str:
    """(models): networks of weights whose functions are the given ones: the product of their column sets."""
    counts = " CROSS JOIN ".join(f"(SELECT n_cols AS n_{i} FROM {functions(q, d)} AS f WHERE tt = {t}) AS c{i}" for i, t in enumerate(tables))
    return f"(SELECT CAST({' * '.join(f'n_{i}' for i in range(len(tables)))} AS BIGINT) AS models FROM {counts})"
