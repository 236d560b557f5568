"""State maps of networks: successors, cycles, attractors, basins, invariant faces, autonomous nodes."""

from __future__ import annotations

from itertools import combinations

from ..functions import bits
from ..functions.dialect import Dialect


def _columns(d: int) -> list[str]:
    return [f"f_{i}" for i in range(1, d + 1)]


def with_successors(q: Dialect, networks: str, d: int) -> str:
    """networks with t_1, the array of each state's successor."""
    return f"(SELECT net.*, {q.array([bits.successor(_columns(d), s) for s in range(1 << d)])} AS t_1 FROM {networks} AS net)"


def with_cycles(q: Dialect, networks: str, d: int) -> str:
    """networks with t_1 .. t_N, the states after k steps, and cycle, per state the length of its cycle or 0 off cycles."""
    n = 1 << d
    out = with_successors(q, networks, d)
    for k in range(2, n + 1):
        out = f"(SELECT *, {q.each(f't_{k - 1}', 'x', q.at('t_1', 'x'))} AS t_{k} FROM {out} AS step_{k})"
    lengths = ["CASE " + " ".join(f"WHEN {q.at(f't_{k}', s)} = {s} THEN {k}" for k in range(1, n + 1)) + " ELSE 0 END" for s in range(n)]
    return f"(SELECT *, {q.array(lengths)} AS cycle FROM {out} AS stepped)"


def with_attractors(q: Dialect, networks: str, d: int) -> str:
    """networks with num_attractors and cycle_len_msq, the mean of the cycles' squared lengths.

    A state on a cycle of length L counts for 1 / L of a cycle and L of a sum of squares.
    """
    cycles = f"round({q.total(q.each('cycle', 'x', 'CASE WHEN x > 0 THEN 1E0 / x ELSE 0E0 END'))})"
    squares = q.total(q.each("cycle", "x", "CAST(x AS DOUBLE)"))
    return f"(SELECT *, CAST({cycles} AS INT) AS num_attractors, {squares} / {cycles} AS cycle_len_msq FROM {with_cycles(q, networks, d)} AS cycled)"


def limit_states(q: Dialect, d: int) -> str:
    """Per state the smallest state of the cycle that it leads to, over columns t_1 .. t_N."""
    n = 1 << d
    least = [f"least({', '.join(q.at(f't_{k}', q.at(f't_{n}', s)) for k in range(1, n + 1))})" for s in range(n)]
    return q.array(least)


def attractor_text(q: Dialect, d: int) -> str:
    """The legacy column of dynamics: per state its cycle from the smallest state on, as 0|1:5|4, over t_1 .. t_N and lim."""
    n = 1 << d
    parts = []
    for s in range(n):
        start = q.at("lim", s)
        cycle = [f"CAST({start} AS STRING)"]
        cycle += [f"CASE WHEN {q.at('cycle', start)} > {k} THEN ':' || CAST({q.at(f't_{k}', start)} AS STRING) ELSE '' END" for k in range(1, n)]
        parts.append(" || ".join(cycle))
    return " || '|' || ".join(parts)


def invariant_faces(d: int, proper: bool = True) -> str:
    """How many faces no transition leaves; proper ones have 1 to d - 1 dimensions."""
    among = [f for f in bits.faces(d) if not proper or 1 <= f.dim <= d - 1]
    return "(" + " + ".join(f"CASE WHEN {f.closed(_columns(d))} THEN 1 ELSE 0 END" for f in among) + ")"


def covered_states(d: int) -> str:
    """The mask of the states in invariant proper faces."""
    return "(" + " | ".join(f"CASE WHEN {f.closed(_columns(d))} THEN CAST({f.mask} AS BIGINT) ELSE CAST(0 AS BIGINT) END" for f in bits.faces(d) if 1 <= f.dim <= d - 1) + ")"


def autonomous(d: int, nodes: tuple[int, ...]) -> str:
    """Whether the next values of a set of nodes depend on that set alone: a function is constant over the states that
    agree on it."""
    tests = []
    for values in range(1 << len(nodes)):
        states = [s for s in range(1 << d) if all((s >> (n - 1) & 1) == (values >> i & 1) for i, n in enumerate(nodes))]
        mask = sum(1 << s for s in states)
        tests += [f"(f_{n} & {mask}) IN (0, {mask})" for n in nodes]
    return "(" + " AND ".join(tests) + ")"


def autonomous_sets(d: int) -> str:
    """How many proper sets of nodes are autonomous."""
    sets = [c for k in range(1, d) for c in combinations(range(1, d + 1), k)]
    return "(" + " + ".join(f"CASE WHEN {autonomous(d, c)} THEN 1 ELSE 0 END" for c in sets) + ")"
