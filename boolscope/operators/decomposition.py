"""Control decompositions of networks, from their truth tables alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import bits
from ..functions.dialect import Dialect
from .dynamics import _columns


def _valid(face: bits.Face, known: dict[int, list[int]]) -> str:
    return face.realizable(_columns(face.d), known[face.dim]) if face.dim else "TRUE"


def _known(d: int) -> dict[int, list[int]]:
    return {k: bits.realized(k, bits.weight_bound(d)) for k in range(1, d + 1)}


def finest(networks: str, d: int, guarded: bool = False, alias: str = "code", value: str = "best") -> str:
    """networks with the code of the finest vector (value best) or the number of control trees (value count).

    A layer of columns per dimension of faces: a face is a leaf, or splits at any node that is invariant on it into
    two faces of the layer before. Guarded (the mode of realizable leaves), a face whose functions are not
    realizable is NULL, and so is whatever needs it.
    """
    known = _known(d) if guarded else {}
    out, names = networks, []
    for k in range(d + 1):
        made = []
        for face in (f for f in bits.faces(d) if f.dim == k):
            splits = [(face.invariant(_columns(d), n), face.with_node(n, 0).name, face.with_node(n, 1).name) for n in face.free]
            if value == "best":
                leaf = f"CAST({bits.leaf_code(d, k)} AS BIGINT)"
                options = [leaf, *(f"CASE WHEN {test} THEN {a} + {b} END" for test, a, b in splits)]
                body = f"greatest({', '.join(options)})" if len(options) > 1 else leaf
            else:
                body = " + ".join(["CAST(1 AS BIGINT)", *(f"CASE WHEN {test} THEN coalesce({a} * {b}, 0) ELSE 0 END" for test, a, b in splits)])
            if guarded and 0 < k < d:
                body = f"CASE WHEN {_valid(face, known)} THEN {body} END"
            made.append(f"{body} AS {face.name if k < d else alias}")
            names += [face.name] * (k < d)
        out = f"(SELECT *, {', '.join(made)} FROM {out} AS layer_{k})"
    return out


def finest_packed(networks: str, d: int) -> str:
    """networks with code, that of the finest vector, for sizes whose faces are too many for columns (243 for 5 nodes).

    Spark SQL only. The faces of a dimension are an array, made from the one before by a constant table: of each face
    its possible splits, with what they ask of a node's function and the places of both halves.
    """
    at = {}
    for k in range(d + 1):
        at |= {f.name: i + 1 for i, f in enumerate(f for f in bits.faces(d) if f.dim == k)}
    start = ", ".join([f"CAST({bits.leaf_code(d, 0)} AS BIGINT)"] * (1 << d))
    names = ", ".join(f"f_{i}" for i in range(1, d + 1))
    out = f"(SELECT *, array({start}) AS faces_0, array({names}) AS nodes FROM {networks} AS n)"
    for k in range(1, d + 1):
        table = []
        for face in (f for f in bits.faces(d) if f.dim == k):
            splits = [f"named_struct('node', {n}, 'mask', CAST({face.mask} AS BIGINT), 'want', CAST({bits.projection(d, n) & face.mask} AS BIGINT), 'low', {at[face.with_node(n, 0).name]}, 'high', {at[face.with_node(n, 1).name]})" for n in face.free]
            table.append(f"array({', '.join(splits)})")
        finer = f"CASE WHEN (element_at(nodes, x.node) & x.mask) = x.want THEN element_at(faces_{k - 1}, x.low) + element_at(faces_{k - 1}, x.high) END"
        best = f"aggregate(splits, CAST({bits.leaf_code(d, k)} AS BIGINT), (m, x) -> greatest(m, {finer}))"
        out = f"(SELECT * EXCEPT (faces_{k - 1}), transform(array({', '.join(table)}), splits -> {best}) AS faces_{k} FROM {out} AS layer_{k})"
    return f"(SELECT * EXCEPT (faces_{d}, nodes), element_at(faces_{d}, 1) AS code FROM {out} AS packed)"


def with_finest(networks: DataFrame, d: int) -> DataFrame:
    """networks with code, as finest_packed, by whole columns of a batch instead of row by row: each face of each layer is a
    column of numbers, and a split that a network lacks counts as 0."""
    layers = [[(f.name, bits.leaf_code(d, k), [(n, f.mask, bits.projection(d, n) & f.mask, f.with_node(n, 0).name, f.with_node(n, 1).name) for n in f.free]) for f in bits.faces(d) if f.dim == k] for k in range(d + 1)]
    schema = T.StructType([*networks.schema.fields, T.StructField("code", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [batch.column(f"f_{i}").to_numpy() for i in range(1, d + 1)]
            finer: dict[str, np.ndarray] = {}
            for layer in layers:
                below, finer = finer, {}
                for name, leaf, splits in layer:
                    best = np.full(batch.num_rows, leaf, np.int64)
                    for n, mask, want, low, high in splits:
                        np.maximum(best, (below[low] + below[high]) * ((nodes[n - 1] & mask) == want), out=best)
                    finer[name] = best
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best)], [*batch.schema.names, "code"])

    return networks.mapInArrow(coded, schema)


def with_valid_faces(networks: str, d: int) -> str:
    """networks with valid, the mask of the faces, by their number, that are realizable."""
    known = _known(d)
    terms = [f"CASE WHEN {_valid(f, known)} THEN CAST({1 << i} AS BIGINT) ELSE CAST(0 AS BIGINT) END" if 0 < f.dim < d else f"CAST({1 << i} AS BIGINT)" for i, f in enumerate(bits.faces(d))]
    return f"(SELECT *, {' + '.join(terms)} AS valid FROM {networks} AS unguarded)"


def tree_table(d: int, only: list[str] | None = None) -> str:
    """(tree, v_d .. v_0, leaf_sum, m_i, p_i per node, faces): the dictionary of control trees, each with what it asks.

    In the states m_i node i keeps its values p_i; faces is the mask of all faces in the tree.
    """
    number = {f.name: i for i, f in enumerate(bits.faces(d))}
    rows = []
    for t in bits.trees(bits.Face(d, 0, 0)):
        if only is None or t.text in only:
            v, masks = t.vector(d), t.masks(d)
            used = sum({1 << number[f.name] for f in [*t.leaves, *(f for f, _ in t.splits)]})
            rows.append(f"('{t.text}', {', '.join(map(str, v))}, {sum(v)}, {', '.join(f'CAST({m} AS BIGINT), CAST({p} AS BIGINT)' for m, p in masks)}, CAST({used} AS BIGINT))")
    names = ["tree", *(f"v_{k}" for k in range(d, -1, -1)), "leaf_sum", *(x for i in range(1, d + 1) for x in (f"m_{i}", f"p_{i}")), "faces"]
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS t({', '.join(names)}))"


def decomposed(networks: str, d: int, guarded: bool = False, only: list[str] | None = None) -> str:
    """A row per network and control tree that it admits: the network's columns and tree, v_d .. v_0, leaf_sum."""
    source = with_valid_faces(networks, d) if guarded else networks
    tests = " AND ".join(f"(net.f_{i} & tree.m_{i}) = tree.p_{i}" for i in range(1, d + 1)) + (" AND (net.valid & tree.faces) = tree.faces" if guarded else "")
    columns = ", ".join(["tree.tree", *(f"tree.v_{k}" for k in range(d, -1, -1)), "tree.leaf_sum"])
    return f"(SELECT net.*, {columns} FROM {source} AS net JOIN {tree_table(d, only)} AS tree ON {tests})"


def distinct_halves(d: int, node: int) -> str:
    """Whether the halves of a split at a node carry different sub-dynamics."""
    root = bits.Face(d, 0, 0)
    off, on = root.with_node(node, 0), root.with_node(node, 1)
    return "(" + " OR ".join(f"{off.restricted(f'f_{i}')} <> {on.restricted(f'f_{i}')}" for i in off.free) + ")"


def greedy_leaves(networks: str, d: int, alias: str = "greedy_leaves") -> str:
    """networks with the leaves of the tree that splits each face at its highest control node."""
    out = networks
    for k in range(d + 1):
        made = []
        for face in (f for f in bits.faces(d) if f.dim == k):
            cases = " ".join(f"WHEN {face.invariant(_columns(d), n)} THEN {face.with_node(n, 0).name} + {face.with_node(n, 1).name}" for n in sorted(face.free, reverse=True))
            made.append(f"{f'CASE {cases} ELSE 1 END' if cases else '1'} AS {face.name if k < d else alias}")
        out = f"(SELECT *, {', '.join(made)} FROM {out} AS greedy_{k})"
    return out


def weight_control(d: int, face: bits.Face, node: int, weights: list[str]) -> str:
    """The control test on a column of weights: the largest sum with the node off is at most 0, the smallest with it on above 0."""
    offset = [weights[i] for i in range(d) if face.values >> i & 1]
    free = [weights[i - 1] for i in face.free if i != node]
    base = " + ".join(offset) or "0"
    most = " + ".join([base, *(f"greatest({w}, 0)" for w in free)])
    least = " + ".join([base, *(f"least({w}, 0)" for w in free), weights[node - 1]])
    return f"(({most}) <= 0 AND ({least}) > 0)"


def guarded_decomposable_count(q: Dialect, sbf: str, d: int) -> str:
    """(decomposable): networks with a guarded split at the root, counted without listing them.

    A network splits at a node if its function there is the node itself and every other function is realizable on both
    halves. Which nodes it splits at is counted by inclusion and exclusion over sets of nodes: for one set the
    conditions fall on each function by itself, so their number is a product of counts over the function table.
    """
    known = _known(d)
    root = bits.Face(d, 0, 0)
    columns, names = [], {}
    for subset in range(1, 1 << d):
        nodes = [n for n in range(1, d + 1) if subset >> (n - 1) & 1]
        for node in range(1, d + 1):
            tests = [f"tt = {bits.projection(d, node)}"] if node in nodes else []
            for c in nodes:
                if c != node:
                    for value in (0, 1):
                        half = root.with_node(c, value)
                        if half.dim:
                            tests.append(f"{half.restricted('tt')} IN ({', '.join(map(str, known[half.dim]))})")
            names[subset, node] = f"n_{subset}_{node}"
            columns.append(f"CAST(sum(CASE WHEN {' AND '.join(tests) or 'TRUE'} THEN 1 ELSE 0 END) AS DECIMAL(38,0)) AS n_{subset}_{node}")
    terms = [("+" if subset.bit_count() % 2 else "-") + " * ".join(names[subset, n] for n in range(1, d + 1)) for subset in range(1, 1 << d)]
    return f"(SELECT CAST({' '.join(terms)} AS DECIMAL(38,0)) AS decomposable FROM (SELECT {', '.join(columns)} FROM {sbf} AS f) AS counts)"
