"""Threshold functions of up to 6 nodes up to the order of their nodes, and which functions are threshold functions.

A function is a code: its truth table without state 0, where it is always 0, so that 6 nodes fit a BIGINT. If weights fall
from node to node, so does what the nodes add to a state; functions of one orbit that both have such weights are
equal, as the order they give the nodes is the same. So each orbit has one code among all falling weights, and nodes
needn't be permuted: 134,596 columns of weights stand for the 47 million of 6 nodes.
"""

from __future__ import annotations

from math import factorial

from ..functions.dialect import Dialect

#: Bounds of the weights that realize all threshold functions of 1 to 6 nodes.
BOUNDS = (1, 1, 2, 3, 5, 9)


def code_of(weights: list[str]) -> str:
    """The code of: the weighted sum of the state's nodes is above 0."""
    terms = []
    for s in range(1, 1 << len(weights)):
        total = " + ".join(w for i, w in enumerate(weights) if s >> i & 1)
        terms.append(f"CASE WHEN {total} > 0 THEN CAST({1 << (s - 1)} AS BIGINT) ELSE CAST(0 AS BIGINT) END")
    return "(" + " + ".join(terms) + ")"


def falling(d: int, bound: int) -> str:
    """(w_1 .. w_d): all weights up to a bound that don't rise from node to node."""
    out = f"(SELECT CAST(w AS INT) AS w_1 FROM range({-bound}, {bound + 1}) AS r(w))"
    for i in range(2, d + 1):
        out = f"(SELECT f.*, CAST(w AS INT) AS w_{i} FROM {out} AS f JOIN range({-bound}, {bound + 1}) AS r(w) ON w <= f.w_{i - 1})"
    return out


def _alike(code: str, d: int, i: int) -> str:
    """Whether nodes i and i + 1 can be swapped: states with the first alone and with the second alone have equal values."""
    ours = [s for s in range(1, 1 << d) if s >> (i - 1) & 3 == 1]
    step = 1 << (i - 1)
    first, second = sum(1 << (s - 1) for s in ours), sum(1 << (s + step - 1) for s in ours)
    return f"({code} & {first}) * {1 << step} = ({code} & {second})"


def orbits(q: Dialect, d: int) -> str:
    """(code, bound, members): a row per orbit of threshold functions of d nodes: its code, the least bound of weights that
    realizes it, and the number of functions in it.

    Nodes that can be swapped follow each other; runs of n such nodes leave d! / (n! ..) functions.
    """
    b, names = BOUNDS[d - 1], [f"w_{i}" for i in range(1, d + 1)]
    out = f"(SELECT {code_of(names)} AS code, greatest(abs(w_1), abs(w_{d})) AS bound FROM {falling(d, b)} AS w)"
    out = f"(SELECT code, CAST(min(bound) AS INT) AS bound, 1 AS run_1 FROM {out} AS c GROUP BY code)"
    for i in range(1, d):
        out = f"(SELECT *, CASE WHEN {_alike('code', d, i)} THEN run_{i} + 1 ELSE 1 END AS run_{i + 1} FROM {out} AS s_{i})"
    runs = " * ".join(f"run_{i}" for i in range(1, d + 1))
    members = f"CAST({q.div(str(factorial(d)), '(' + runs + ')')} AS INT)"
    return q.named(f"orbits_{d}", f"(SELECT code, bound, {members} AS members FROM {out} AS o)")


def arranged(q: Dialect, relation: str, d: int) -> str:
    """relation (code, ..) with arranged, the code after its nodes are put in falling order of how many states that hold
    them have the value 1.

    For a threshold function that is its orbit's code: a larger weight never has the smaller count, and nodes of
    one count can be swapped. Any other function gets the code of a function that isn't one either.
    """
    shift = (lambda a, n: f"shiftright({a}, CAST({n} AS INT))") if q.name == "spark" else (lambda a, n: f"({a} >> ({n}))")
    counts = [q.ones(f"c & {sum(1 << (s - 1) for s in range(1, 1 << d) if s >> i & 1)}") for i in range(d)]
    # a node's bit after the count it is sorted by; lambdas bind code and order once, as filters on join keys repeat definitions
    order = q.ascending(q.array([f"(64 - {n}) * 64 + {1 << i}" for i, n in enumerate(counts)]))
    bits = []
    for s in range(1, 1 << d):
        state = " + ".join(f"{q.at('o', p)} % 64" for p in range(d) if s >> p & 1)
        bits.append(f"({shift('c', f'{state} - 1')} & 1) * CAST({1 << (s - 1)} AS BIGINT)")
    once = q.at(q.each(q.array([order]), "o", " + ".join(bits)), 0)
    return f"(SELECT r.*, CAST({q.at(q.each(q.array(['code']), 'c', once), 0)} AS BIGINT) AS arranged FROM {relation} AS r)"


def separable(q: Dialect, relation: str, d: int) -> str:
    """The rows of relation (code, ..) whose function some weights realize, with orbit, bound, members: a join with the orbits
    of that size, which are all."""
    return f"(SELECT a.*, o.code AS orbit, o.bound, o.members FROM {arranged(q, relation, d)} AS a JOIN {orbits(q, d)} AS o ON a.arranged = o.code)"


def flips(q: Dialect, relation: str, d: int) -> str:
    """(code, state, to_orbit): the states whose value a threshold function can change and stay one, with the orbit it then
    is in. These are the walls of the function's cone of weights, so all functions are reached from any by such steps."""
    one = "shiftleft(CAST(1 AS BIGINT), CAST(state - 1 AS INT))" if q.name == "spark" else "(CAST(1 AS BIGINT) << (state - 1))"
    changed = f"(SELECT was, CAST(state AS INT) AS state, {q.xor('was', one)} AS code FROM (SELECT DISTINCT code AS was FROM {relation} AS r) AS f CROSS JOIN range(1, {1 << d}) AS states(state))"
    return f"(SELECT was AS code, state, orbit AS to_orbit FROM {separable(q, changed, d)} AS s)"
