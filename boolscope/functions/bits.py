"""Boolean functions as numbers: SQL text for truth tables, faces of the cube, restrictions and state maps.

A truth table is a BIGINT whose bit s is the value in state s; node i, counted from 1, is bit i - 1 of a state. All
masks are worked out here, so a plan holds only constants and bit operations on the columns.
"""

from __future__ import annotations

from itertools import combinations

#: Bounds of the weights for 1 to 5 nodes; beyond that the number of nodes is used.
WEIGHT_BOUNDS = (1, 1, 2, 3, 5)


def weight_bound(d: int) -> int:
    return WEIGHT_BOUNDS[d - 1] if d <= len(WEIGHT_BOUNDS) else d


def threshold_table(weights: list[str]) -> str:
    """The truth table of: the weighted sum of the state's nodes is above 0."""
    terms = []
    for s in range(1, 1 << len(weights)):
        total = " + ".join(w for i, w in enumerate(weights) if s >> i & 1)
        terms.append(f"CASE WHEN {total} > 0 THEN CAST({1 << s} AS BIGINT) ELSE CAST(0 AS BIGINT) END")
    return "(" + " + ".join(terms) + ")"


def bit(table: str, s: int) -> str:
    return f"CASE WHEN ({table} & {1 << s}) <> 0 THEN 1 ELSE 0 END"


def projection(d: int, node: int) -> int:
    """The truth table of the node itself."""
    return sum(1 << s for s in range(1 << d) if s >> (node - 1) & 1)


def successor(functions: list[str], s: int) -> str:
    """The state after state s."""
    return "(" + " + ".join(f"CASE WHEN ({f} & {1 << s}) <> 0 THEN {1 << j} ELSE 0 END" for j, f in enumerate(functions)) + ")"


class Face:
    """A sub-cube: nodes that are fixed, as a mask of states' bits, and their values."""

    def __init__(self, d: int, fixed: int, values: int):
        self.d, self.fixed, self.values = d, fixed, values
        self.free = [i for i in range(1, d + 1) if not fixed >> (i - 1) & 1]
        self.dim = len(self.free)
        self.states = [s for s in range(1 << d) if s & fixed == values]
        self.mask = sum(1 << s for s in self.states)
        self.name = f"face_{fixed}_{values}"

    def with_node(self, node: int, value: int) -> Face:
        one = 1 << (node - 1)
        return Face(self.d, self.fixed | one, self.values | (one if value else 0))

    def invariant(self, functions: list[str], node: int) -> str:
        """Whether the node keeps its value in every state of the face: then it is a control node there."""
        return f"({functions[node - 1]} & {self.mask}) = {projection(self.d, node) & self.mask}"

    def restricted(self, table: str) -> str:
        """The truth table on the face, its free nodes taken in order."""
        return "(" + " + ".join(f"CASE WHEN ({table} & {1 << s}) <> 0 THEN {1 << c} ELSE 0 END" for c, s in enumerate(self.states)) + ")"

    def closed(self, functions: list[str]) -> str:
        """Whether no transition leaves the face: every fixed node has its value after each of its states."""
        tests = [f"({functions[i]} & {self.mask}) = {self.mask if self.values >> i & 1 else 0}" for i in range(self.d) if self.fixed >> i & 1]
        return "(" + " AND ".join(tests) + ")" if tests else "TRUE"

    def realizable(self, functions: list[str], known: list[int]) -> str:
        """Whether every free node's function on the face is one of the known truth tables of that size."""
        if not self.dim:
            return "TRUE"
        among = ", ".join(map(str, known))
        return "(" + " AND ".join(f"{self.restricted(functions[i - 1])} IN ({among})" for i in self.free) + ")"


def faces(d: int) -> list[Face]:
    """All sub-cubes, those of fewer dimensions first."""
    out = []
    for k in range(d, -1, -1):
        for nodes in combinations(range(d), k):
            fixed = sum(1 << i for i in nodes)
            out += [Face(d, fixed, v) for v in range(1 << d) if v & ~fixed == 0]
    return out


def realized(k: int, bound: int) -> list[int]:
    """The truth tables of k nodes that weights up to the bound realize, the constant 0 too."""
    found = {(0,) * (1 << k)} if not k else set()
    if k:
        sums = {(0,)}
        for _ in range(k):
            sums = {x + tuple(y + w for y in x) for x in sums for w in range(-bound, bound + 1)}
        found = {tuple(int(y > 0) for y in x) for x in sums}
    return sorted(sum(b << s for s, b in enumerate(t)) for t in found)


# Vectors: <v_d, .., v_0> counts the leaves of each dimension. They are ordered by their sum, then v_0, v_1 and so on, and
# add up along a split, so one number in base 2^d + 1 stands for a vector: sums of codes are codes of sums.


def code_base(d: int) -> int:
    return (1 << d) + 1


def leaf_code(d: int, dim: int) -> int:
    b = code_base(d)
    return b ** (d + 1) + b ** (d - dim)


def digit(code: str, d: int, k: int, div) -> str:
    """v_k of a vector's code."""
    return f"({div(code, code_base(d) ** (d - k))} % {code_base(d)})"


def vector_text(code: str, d: int, div) -> str:
    return "'<' || " + " || ',' || ".join(f"CAST({digit(code, d, k, div)} AS STRING)" for k in range(d, -1, -1)) + " || '>'"


# Control trees: a leaf is *, a split by node n is n[off,on].


class Tree:
    """A labelled control tree over a face: its text, its splits (face, node) and its leaves."""

    def __init__(self, text: str, splits: list[tuple[Face, int]], leaves: list[Face]):
        self.text, self.splits, self.leaves = text, splits, leaves

    def masks(self, d: int) -> list[tuple[int, int]]:
        """Per node: the states in which it must keep its value, and its values there."""
        out = []
        for node in range(1, d + 1):
            states = 0
            for face, n in self.splits:
                states |= face.mask if n == node else 0
            out.append((states, projection(d, node) & states))
        return out

    def vector(self, d: int) -> list[int]:
        return [sum(x.dim == k for x in self.leaves) for k in range(d, -1, -1)]


def trees(face: Face) -> list[Tree]:
    """All control trees of a face; 2, 9 and 244 of them for 1, 2 and 3 nodes."""
    out = [Tree("*", [], [face])]
    for node in face.free:
        off, on = trees(face.with_node(node, 0)), trees(face.with_node(node, 1))
        out += [Tree(f"{node}[{a.text},{b.text}]", [(face, node), *a.splits, *b.splits], a.leaves + b.leaves) for a in off for b in on]
    return out


def shapes(dim: int) -> list[tuple[str, tuple[int, ...]]]:
    """All binary shapes over a cube of that dimension: text with leaves as their dimensions, and the vector from the
    largest dimension down."""

    def made(k: int) -> list[tuple[str, tuple[int, ...]]]:
        out = [(str(k), tuple(int(j == k) for j in range(dim, -1, -1)))]
        if k:
            below = made(k - 1)
            out += [(f"[{a},{b}]", tuple(x + y for x, y in zip(u, v))) for a, u in below for b, v in below]
        return out

    return made(dim)
