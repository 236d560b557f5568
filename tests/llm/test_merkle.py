"""The Merkle manifest held against a recursion over lists."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boolscope.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, n string, digest string, below string, steps string, row string, id string, now string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """(root, per digest the digests left and right of its path)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        groups = [level[i : i + 8] for i in range(0, len(level), 8)]
        for p, i in zip(paths, at):
            g = groups[i // 8]
            p.append(("".join(g[: i % 8]), "".join(g[i % 8 + 1 :])))
        at, level = [i // 8 for i in at], [sha("".join(g)) for g in groups]
    return (level[0] if level else None), paths


def brute(rows):
    trees = {}
    for i, text, lang, source, n_chars in rows:
        new = text
        if i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0:
            new = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees.setdefault(lang, []).append((i is not None, i or 0, leaf(i, source, lang, n_chars, text), leaf(i, source, lang, n_chars, new), i))
    out, names = [], sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    subroots = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:4])
        subroots[name] = climb([x[2] for x in trees[name]])
    root, above = climb([subroots[n][0] for n in names])
    for name, up in zip(names, above):
        for (_, _, old, new, i), own in zip(trees[name], subroots[name][1]):
            folded = new
            for left, right in own + up:
                folded = sha(left + folded + right)
            out.append((i, old, subroots[name][0], root, sha("".join(a + b for a, b in own + up)), folded, folded == root))
    return Counter(out)


def made(spark, rows, partitions=3):
    docs = spark.createDataFrame([(*r, *("x",) * 9) for r in rows], SCHEMA).repartition(partitions)
    changed = F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, merkle.lower_ascii(docs["text"])).otherwise(docs["text"])
    out = merkle.prove(docs, changed)
    return Counter(tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")), "folded", F.col("folded") == F.col("root")).collect())


def rows_of(n, langs, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice([None, "", "Ä plain Text", f"Some {i} LINE\nß", "lower only"]), rnd.choice(langs), rnd.choice([None, "", "wéb"]), rnd.choice([None, 0, 77])) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (1, [None]), (8, ["en"]), (9, ["en"]), (65, [None, "", "é", "z", "a"]), (700, ["hot"] * 9 + [None, "b"]), (200, [f"l{i}" for i in range(150)])])
def test_equals_a_recursion(spark, n, langs):
    rows = rows_of(n, langs, n)
    assert made(spark, rows) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = rows_of(30, ["en", None], 1)
    rows += [(5, "Same", "en", "s", 1)] * 40 + [(5, "Other", "en", "s", 1), (None, "No Id", "en", "s", 1), (None, "No Id", None, None, None), (None, None, None, None, None)] * 2
    assert made(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert made(spark, []) == Counter()


def test_any_change_is_seen_and_a_very_long_text_is_covered_whole(spark):
    rows = [(i, "x" * 300_000 + str(i), "en", "s", 1) for i in range(10)]
    docs = spark.createDataFrame([(*r, *("x",) * 9) for r in rows], SCHEMA)
    last = F.when(docs["doc_id"] == 3, F.concat(F.expr("left(text, 299999)"), F.lit("y3"))).otherwise(docs["text"])
    got = {r["doc_id"]: r["folded"] == r["root"] for r in merkle.prove(docs, last).collect()}
    assert got == {i: i != 3 for i in range(10)}
    assert all(r["folded"] == r["root"] for r in merkle.prove(docs).collect())


def test_levels_are_sorted_runs_of_coordinates(spark):
    leaves = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("rest").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), "id")
    with merkle.scratch(spark):
        store = merkle.build(merkle.placed(leaves, ["id"]))
    assert store.height == 4
    for k, sizes in enumerate([(900, 100), (113, 13), (15, 2), (2, 1), (1,)]):
        level = store.level(k)
        assert sorted((r["count"] for r in level.groupBy("tree").count().collect()), reverse=True) == list(sizes)
        parts = level.select("tree", "pos", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
        by_file = {}
        for r in sorted(parts, key=lambda r: r["i"]):
            by_file.setdefault(r["f"], []).append((r["tree"], r["pos"]))
        runs = sorted(by_file.values())
        assert all(r == sorted(r) for r in runs) and all(a[-1] < b[0] for a, b in zip(runs, runs[1:]))
