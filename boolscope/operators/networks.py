"""Statistics of networks: lookups into the function table, and products and sums of what they find."""

from __future__ import annotations

from ..functions import bits
from ..functions.dialect import Dialect


def with_statistics(networks: str, stats: str, d: int, bound: int | None = None) -> str:
    """networks with genotype_count, robustness_mean, robustness_std, evolvability: a join per node with the small
    function table, of which everything else is arithmetic."""
    b = bits.weight_bound(d) if bound is None else bound
    k = d * d * 2 * b
    nodes = range(1, d + 1)
    joins = " ".join(f"JOIN {stats} AS t{i} ON net.f_{i} = t{i}.tt" for i in nodes)
    kind = "BIGINT" if d <= 4 else "DECIMAL(38,0)"
    product = " * ".join(f"CAST(t{i}.n_cols AS {kind})" for i in nodes)
    return (
        f"(SELECT net.*, {product} AS genotype_count, ({' + '.join(f't{i}.neutral_mean' for i in nodes)}) / {k} AS robustness_mean, "
        f"sqrt({' + '.join(f't{i}.neutral_var' for i in nodes)}) / {k} AS robustness_std, CAST({' + '.join(f't{i}.evolvability' for i in nodes)} AS BIGINT) AS evolvability "
        f"FROM {networks} AS net {joins})"
    )


def constant_zeros(d: int) -> str:
    """How many of a network's functions are constant 0."""
    return "(" + " + ".join(f"CASE WHEN f_{i} = 0 THEN 1 ELSE 0 END" for i in range(1, d + 1)) + ")"


def prefix(table: str, d: int) -> str:
    """The first d bits of a truth table, state 0 leftmost."""
    return " || ".join(f"CASE WHEN ({table} & {1 << s}) <> 0 THEN '1' ELSE '0' END" for s in range(d))


def prefix_of_weights(d: int) -> str:
    """The first d bits of the truth table of weights w_1 .. w_d, state 0 leftmost, without the rest of it."""
    totals = [" + ".join(f"w_{i + 1}" for i in range(d) if s >> i & 1) or "0" for s in range(d)]
    return " || ".join(f"CASE WHEN {t} > 0 THEN '1' ELSE '0' END" for t in totals)


def inhibitor_functions(q: Dialect, d: int, node: int) -> str:
    """(tt): functions of a node that only inhibiting arcs from other nodes realize."""
    from ..sources import scans

    others = " AND ".join(f"w_{i} <= 0" for i in range(1, d + 1) if i != node) or "TRUE"
    return f"(SELECT DISTINCT tt FROM {scans.weights(q, d)} AS w WHERE {others})"
