"""Generated relations: weights, states, faces, vectors, all networks, and networks drawn by the rows of a table."""

from __future__ import annotations

from ..functions import bits
from ..functions.dialect import Dialect


def columns(q: Dialect, d: int, bound: int | None = None) -> str:
    """(id, w_1 .. w_d): all columns of weights in order."""
    b = bits.weight_bound(d) if bound is None else bound
    base = 2 * b + 1
    digits = ", ".join(f"CAST({q.div('id', base ** (d - i))} % {base} - {b} AS INT) AS w_{i}" for i in range(1, d + 1))
    return f"(SELECT id, {digits} FROM range({base**d}) AS ids(id))"


def weights(q: Dialect, d: int, bound: int | None = None) -> str:
    """(id, w_1 .. w_d, tt): all columns of weights in order, and their truth tables."""
    return f"(SELECT *, {bits.threshold_table([f'w_{i}' for i in range(1, d + 1)])} AS tt FROM {columns(q, d, bound)} AS w)"


def states(d: int) -> str:
    return f"(SELECT CAST(s AS INT) AS s FROM range({1 << d}) AS states(s))"


def faces(d: int) -> str:
    """(face, fixed, fixed_values, dim, mask): all 3 ** d sub-cubes."""
    rows = ", ".join(f"({i}, {f.fixed}, {f.values}, {f.dim}, CAST({f.mask} AS BIGINT))" for i, f in enumerate(bits.faces(d)))
    return f"(SELECT * FROM (VALUES {rows}) AS f(face, fixed, fixed_values, dim, mask))"


def vectors(d: int) -> str:
    """(v_d .. v_0): all with sum of v_k 2^k = 2^d and v_k <= 2^(d-k)."""
    froms = " CROSS JOIN ".join(f"range({(1 << (d - k)) + 1}) AS r_{k}(v_{k})" for k in range(d, -1, -1))
    total = " + ".join(f"v_{k} * {1 << k}" for k in range(d + 1))
    return f"(SELECT {', '.join(f'CAST(v_{k} AS INT) AS v_{k}' for k in range(d, -1, -1))} FROM {froms} WHERE {total} = {1 << d})"


def all_networks(sbf: str, d: int) -> str:
    """(f_1 .. f_d): every combination of the truth tables of a relation with tt."""
    return "(SELECT " + ", ".join(f"s{i}.tt AS f_{i}" for i in range(1, d + 1)) + " FROM " + " CROSS JOIN ".join(f"{sbf} AS s{i}" for i in range(1, d + 1)) + ")"


def drawn_networks(rows: str, sbf: str, numbers: list[str]) -> str:
    """(row columns, f_1 .. f_d): each row's numbers pick truth tables by their place idx in order."""
    joins = " ".join(f"JOIN {sbf} AS s{i} ON s{i}.idx = {n}" for i, n in enumerate(numbers, 1))
    return "(SELECT draw.*, " + ", ".join(f"s{i}.tt AS f_{i}" for i in range(1, len(numbers) + 1)) + f" FROM {rows} AS draw {joins})"
