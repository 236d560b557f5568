"""Control trees as text: n[off,on] splits by node n, * is a leaf."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"\*|[0-9]+|[\[\],]")


def parse(text: str):
    """None for a leaf, (node, off, on) for a split."""
    tokens = TOKEN.findall(text)
    at = 0

    def tree():
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "*":
            return None
        node, at = int(token), at + 1
        off = tree()
        at += 1
        on = tree()
        at += 1
        return node, off, on

    return tree()


def serialize(tree) -> str:
    return "*" if tree is None else f"{tree[0]}[{serialize(tree[1])},{serialize(tree[2])}]"


def depths(tree, depth: int = 0) -> list[int]:
    """The depths of a tree's leaves."""
    return [depth] if tree is None else depths(tree[1], depth + 1) + depths(tree[2], depth + 1)


def one_label_a_depth(tree) -> bool:
    labels: dict[int, set[int]] = {}

    def visit(t, depth: int) -> None:
        if t is not None:
            labels.setdefault(depth, set()).add(t[0])
            visit(t[1], depth + 1)
            visit(t[2], depth + 1)

    visit(tree, 0)
    return all(len(x) == 1 for x in labels.values())


def arguments(text: str) -> list[str]:
    """Parts at commas outside parentheses."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def shapes(rows: DataFrame) -> DataFrame:
    """rows (tree, networks) with leaves, deepest and uniform; one text per kind of tree is parsed."""

    def run(batches):
        for pdf in batches:
            made = [parse(t) for t in pdf["tree"]]
            yield pd.DataFrame({"tree": pdf["tree"], "networks": pdf["networks"], "leaves": [len(depths(t)) for t in made], "deepest": [max(depths(t)) for t in made], "uniform": [one_label_a_depth(t) for t in made]})

    return rows.mapInPandas(run, "tree string, networks long, leaves long, deepest long, uniform boolean")
