"""Merkle manifest of a dataset: trees of digests in a store of nodes, level by level, and proofs that scans merge from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, save, scratch

#: Consecutive nodes that make one of the next level, and the columns that a row's digest covers.
FANOUT, COLUMNS = 8, ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left string, right string>>"


def row_digest(columns: list[Column]) -> Column:
    """Hexadecimal SHA-256 of the columns put together: each - if null, else its bytes in UTF-8, a colon and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joint_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, a row's place in its tree from 0, ascending by order (nulls first), and n, the rows of its tree.

    Rows are range-sorted into runs, and what each run holds of each tree is counted: as runs are sorted, that is a row a
    run and a row a tree. A row's place is its place in the run's part of the tree, after the parts of earlier runs. Nothing
    is gathered by tree but those counts, so a tree may hold all rows. The last column of order should tell equal rows apart,
    else they go to one run.
    """
    keys = [F.asc_nulls_first(c) for c in ("tree", *order)]
    runs = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    runs = save(runs.withColumn("_run", F.shiftright("_at", 33)), "runs")
    parts = runs.groupBy("tree", "_run").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    parts = parts.select("tree", "_run", (F.sum("_n").over(tree.orderBy("_run")) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("n"))
    found = runs.join(save(parts, "parts"), ["tree", "_run"])
    return found.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_run", "_shift")


@dataclass
class Store:
    """Trees as Parquet folders level=0, level=1 and so on, each sorted by coordinate (tree, pos) over its files.

    Every node has n, the nodes of its tree in its level, and digest; those above the leaves also have below, the digests of
    the level before that they are made of. A tree's last level is that with one node, its root.
    """

    spark: SparkSession
    path: str
    height: int

    def level(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level={k}")

    def roots(self) -> DataFrame:
        """(tree, digest): the root of each tree, whatever level it is in."""
        out = self.level(0).where("n = 1").select("tree", "digest")
        for k in range(1, self.height + 1):
            out = out.unionByName(self.level(k).where("n = 1").select("tree", "digest"))
        return out

    def groups(self, above: DataFrame | None = None) -> DataFrame:
        """(tree, parent, below, steps): per group of leaves its digests, and the steps from its parent to the root and, where
        above (tree, steps) is given, on through it. A lone leaf has a group without digests.

        Levels are read from the top down. A level's nodes meet their parents' steps by a merge on the coordinate, and hand on
        to each child the digests left and right of it. Leaves themselves are not touched.
        """

        def up(ends: DataFrame) -> DataFrame:
            return ends.withColumn("steps", F.array().cast(STEPS)) if above is None else ends.join(above, "tree")

        at = None
        for k in range(self.height, 0, -1):
            nodes = self.level(k)
            here = up(nodes.where("n = 1")).select("tree", F.col("pos").alias("parent"), "below", "steps")
            if at is not None:
                here = here.unionByName(nodes.select("tree", F.col("pos").alias("parent"), "below").hint("merge").join(at, ["tree", "parent"]))
            at = save(here, "steps") if k == 1 else save(here.select("tree", F.posexplode("below").alias("i", "digest"), "parent", "below", "steps").select("tree", (F.col("parent") * FANOUT + F.col("i")).alias("parent"), F.concat(F.array(beside(F.col("below"), F.col("i"))), "steps").alias("steps")), "steps")
        lone = up(self.level(0).where("n = 1")).select("tree", F.lit(0).cast("long").alias("parent"), F.array().cast("array<string>").alias("below"), "steps")
        return lone if at is None else at.unionByName(lone)


def beside(digests: Column, i: Column) -> Column:
    """(left, right): the digests before and after place i, each joined."""
    return F.struct(F.array_join(F.slice(digests, F.lit(1), i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.size(digests)), "").alias("right"))


def build(leaves: DataFrame) -> Store:
    """The store over leaves: tree, pos, n, digest, and other columns that stay in level 0.

    A level reads the one before in runs of its coordinates, which makes the groups of nodes whole and leaves the new level
    sorted: the range of the sort is the only exchange. No level is held in memory, and the driver learns no more than the largest n.
    """
    spark, path = leaves.sparkSession, new_path(leaves.sparkSession, "nodes")
    leaves.repartitionByRange("tree", "pos").sortWithinPartitions("tree", "pos").write.parquet(f"{path}/level=0")
    store = Store(spark, path, 0)
    most = store.level(0).agg(F.max("n")).first()[0] or 0
    while most > 1:
        last = store.level(store.height).where("n > 1").select("tree", F.floor(F.col("pos") / FANOUT).alias("parent"), "pos", "n", "digest")
        grouped = last.repartitionByRange("tree", "parent").groupBy("tree", "parent").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("members"))
        up = grouped.select("tree", F.col("parent").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"), F.col("members.digest").alias("below")).withColumn("digest", joint_digest(F.col("below")))
        store.height, most = store.height + 1, -(-most // FANOUT)
        up.sortWithinPartitions("tree", "pos").write.parquet(f"{path}/level={store.height}")
    return store


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the digests beside its path give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of the digests beside a leaf's path, level by level, left to right."""
    return joint_digest(F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


def prove(docs: DataFrame, changed: Column | None = None, columns: tuple[str, ...] = COLUMNS, tree_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, leaf, subroot, root, steps (the digests left and right of its path, from the leaf's level up
    through its subtree to the root), folded (the root that its leaf now gives with these steps).

    A leaf is the digest of the columns; leaves with the same tree_col make a tree, ascending by id; roots of these, null first
    and then by the bytes of their names, make the tree that gives the root. In both, every FANOUT nodes that follow each
    other make one of the next level, and a single last one does so too, until one is left. changed is the text as it is
    when checked (default: as it was), null where there is none.

    Leaves are range-sorted into runs and streamed into a store of nodes, a folder for each level; each level is made from the one before by one
    ordered scan; steps are found by merging levels on coordinates from the top down, over nodes, and meet the leaves last.
    The stores stay in the shared folder: they are the manifest.

    Null ids come first in their tree, then rows with equal ids by digest; equal rows take places in any order, which
    changes no digest. Null and empty names of a tree differ, as do null and empty values. Extra columns are ignored,
    an empty table gives an empty result. Trees may be any number and size; nothing but counts per run is gathered.
    """
    name = docs[tree_col].cast("string")
    values = {c: docs[c] for c in columns}
    leaf = row_digest(list(values.values()))
    now = row_digest([changed if c == text_col else v for c, v in values.items()]) if changed is not None else F.lit(None).cast("string")
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), name), F.lit("0")).alias("tree"), docs[id_col].cast("long").alias("id"), leaf.alias("digest"), now.alias("now"))
    with scratch(docs.sparkSession) as keep:
        # made once, before the ranges are sampled, with what tells equal rows apart
        rows = save(rows.withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "leaves")
        store = build(placed(rows, ["id", "digest", "now", "row"]).drop("row"))
        subroots = save(store.roots(), "subroots")
        top = build(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]))
        root = top.roots().select("tree", F.col("digest").alias("root"))
        above = with_groups(top.level(0), top.groups()).join(root, "tree").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "steps")
        above = keep(save(above, "above"))
        groups = keep(save(store.groups(above.select("tree", "steps")), "groups"))
    found = with_groups(store.level(0), groups).join(above.select("tree", "subroot", "root"), "tree")
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "steps", fold(F.coalesce("now", "digest"), F.col("steps")).alias("folded"))


def with_groups(leaves: DataFrame, groups: DataFrame) -> DataFrame:
    """leaves with steps: those of its group, after the digests beside the leaf in it."""
    met = leaves.withColumn("parent", F.floor(F.col("pos") / FANOUT)).join(groups, ["tree", "parent"])
    own = F.when(F.size("below") > 0, F.array(beside(F.col("below"), (F.col("pos") % FANOUT).cast("int")))).otherwise(F.array().cast(STEPS))
    return met.withColumn("steps", F.concat(own, "steps")).drop("parent", "below")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    out = prove(docs, tampered)
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _oracle(depth: int = 8) -> str:
    """SQL that lists each level of both trees: leaves by number in their tree, groups as lists, the path level by level."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    crc = "list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""rows_ AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {row("text")} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {row(lower)} ELSE {row("text")} END AS now FROM documents),
    a_0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_)"""]

    def climb(t: str) -> str:
        """CTEs of the levels above t_0 (tree, pos, n, h), and t_path (.., root, proof, folded)."""
        out = []
        for k in range(depth):
            out.append(f"{t}_g{k} AS (SELECT tree, pos // 8 AS g, max(n) AS n, list(h ORDER BY pos) AS hs FROM {t}_{k} GROUP BY ALL)")
            out.append(f"{t}_{k + 1} AS (SELECT tree, g AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {t}_g{k})")
        at = f"(SELECT *, '' AS proof, now AS folded, pos AS p FROM {t}_start)"
        for k in range(depth):
            hs = "[CASE WHEN i = x.p % 8 THEN x.folded ELSE y.hs[i + 1] END FOR i IN range(len(y.hs))]"
            siblings = "[y.hs[i + 1] FOR i IN range(len(y.hs)) IF i <> x.p % 8]"
            at = f"(SELECT x.* EXCLUDE (proof, folded, p), x.proof || array_to_string({siblings}, '') AS proof, CASE WHEN y.n = 1 THEN x.folded ELSE sha256(array_to_string({hs}, '')) END AS folded, x.p // 8 AS p FROM {at} AS x JOIN {t}_g{k} AS y ON x.tree = y.tree AND x.p // 8 = y.g)"
        out.append(f"{t}_path AS (SELECT * FROM {at} AS climbed)")
        return ", ".join(out)

    parts += [climb("a").replace("a_start", "a_0"), f"b_0 AS (SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM a_{depth})"]
    parts += ["b_start AS (SELECT d.doc_id, d.leaf, d.proof AS lower_proof, d.folded AS now, s.h AS subroot, s.pos, '' AS tree FROM a_path AS d JOIN b_0 AS s ON d.tree = s.name)", climb("b")]
    return f"""WITH {", ".join(parts)} SELECT doc_id, leaf, subroot, r.h AS root, sha256(lower_proof || proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified FROM b_path CROSS JOIN (SELECT h FROM b_{depth}) AS r"""


ORACLE = _oracle()
