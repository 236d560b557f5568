"""SimHash near-duplicates, found by deletion-variant signatures of few, long segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, scratch, text_of, trimmed
from .components import connected

SEED = 42
#: Index keys with three members or more that are sent to all tasks rather than shuffled.
BROADCAST_KEYS = 1_000_000


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes of a text's word shingles in order, repeats included; of all its words where there are fewer."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    whole, sizes = b" ".join(words), [len(w) for w in words]
    starts = [0, *accumulate(n + 1 for n in sizes)]
    ends = [s + n for s, n in zip(starts, sizes)]
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(whole, SEED)], dtype="<u8")
    return np.array([digest(whole[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """64 bits: bit i is set if it is set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits: bit i is set if it is set in over half of the hashes of the text's word shingles, repeats included."""
    return majority(shingles(text, width))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t.as_py(), width) for t in b["text"]), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b["id"], b["th"], pa.array(made.view(np.int64))], ["id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, th, fp) of every document; th is a hash of the text, fp the fingerprint as a signed long."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    return rows.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(trimmed(_fingerprints(width)), "id long, th long, fp long")


def _variants(fp: Column) -> Column:
    """The index keys of a fingerprint: for each 32-bit segment and bit of it, the segment with that bit deleted."""

    def key(i: Column) -> Column:
        segment, bit = F.shiftright(i, 5), (i % 32).cast("int")
        value = F.call_function("shiftrightunsigned", fp, (segment * 32).cast("int")).bitwiseAND(F.lit(0xFFFFFFFF))
        hole = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        return F.call_function("shiftleft", i.cast("long"), F.lit(32)).bitwiseOR(value.bitwiseAND(F.bitwise_not(hole)))

    return F.transform(F.sequence(F.lit(0), F.lit(63)), key)


def links(nodes: DataFrame, max_bits: int = 2, cap: int = 24) -> DataFrame:
    """(u, v): links among the distinct fingerprints fp, enough to connect all that differ in at most max_bits (2 or less).

    Two bits over two segments leave a segment with one at most,
    and that segment's variant without this bit is the same in both, so an equality join on 64 variants finds every
    pair; the other segment is then verified.

    Variants that over cap fingerprints share would make pairs with the square of their number. Their members take
    another exact way: each emits itself and the 64 fingerprints one bit away. Two fingerprints share such a point
    exactly if they differ in at most two bits, and at most 65 can share one, so a star over a point's members
    connects them without loss.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments with one deleted bit each reach 2 bits at most")
    many_tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.repartition(many_tasks, "fp")  # a small table, of which 64 times as many rows are made
    keyed = nodes.select(F.explode(_variants(F.col("fp"))).alias("k"), F.col("fp").alias("x"))
    groups = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n >= 2")
    groups = save(groups, "variants")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= max_bits
    two = groups.where("n = 2").where(near(F.col("lo"), F.col("hi"))).select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    large = groups.where("n > 2").select("k", "n")
    if large.count() <= BROADCAST_KEYS:  # 16 bytes each; else both sides are shuffled
        large = F.broadcast(large)
    members = save(keyed.join(large, "k"), "members")
    some = members.where(F.col("n") <= cap).groupBy("k").agg(F.collect_list("x").alias("xs"))
    some = some.select(F.explode("xs").alias("a"), "xs").select("a", F.explode(F.filter("xs", lambda b: (b > F.col("a")) & near(F.col("a"), b))).alias("b"))
    some = some.select(F.col("a").alias("u"), F.col("b").alias("v"))
    many = members.where(F.col("n") > cap).select("x").distinct()
    if max_bits == 2:
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.col("x").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        points = many.select("x", F.explode(F.concat(F.array("x"), flips)).alias("p"))
    else:  # at one bit: the ends of each one-bit edge share that edge
        holes = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.struct(b.alias("b"), F.col("x").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), b))).alias("p")))
        points = many.select("x", F.explode(holes).alias("p")).where(F.lit(max_bits == 1))
    stars = points.groupBy("p").agg(F.collect_list("x").alias("xs")).where(F.size("xs") > 1)
    stars = stars.select(F.array_min("xs").alias("u"), F.explode("xs").alias("v"))
    return two.unionByName(some).unionByName(stars).where("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, th, fp, root, component) of every document: th a hash of its text, root a fingerprint that names its group,
    component the smallest id in the group, reached by links of at most max_bits.

    Null and empty texts have fingerprint 0 and are linked like any other. A null id is returned as null; a group
    without an id has a null component. Rows that repeat an id are documents of their own. Extra columns are ignored;
    an empty table gives an empty result. Exact copies meet in one row per fingerprint before any search.
    """
    with scratch(docs.sparkSession) as keep:
        found = keep(save(fingerprints(docs, id_col, text_col, width), "fingerprints"))
        nodes = save(found.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
        roots = connected(links(nodes, max_bits))
        to = keep(save(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "roots"))
    least = to.groupBy("root").agg(F.min("least").alias("component"))
    out = found.join(to.join(least, "root").select("fp", "root", "component"), "fp")
    return out.select(F.col("id").alias(id_col), "th", "fp", "root", "component")


# --- near copies by similarity -------------------------------------------------------------------------------------

#: Words per shingle of the fingerprints that find candidates, fingerprints per text, and least hashes of shingles per text.
FINE, PRINTS, LEAST = 2, 3, 4
#: Texts that share a key of which all pairs are candidates; those that share one with more are searched exactly.
CAP = 4
#: Sets of a block where all sets of a group are compared.
BLOCK = 256
#: Pairs of a text beyond which it is one of the common ones, and how many of those there can be.
HOT, MOST_HOT = 500, 50_000


def _mixed(h: np.ndarray, round_: int) -> np.ndarray:
    """Other hashes of the same shingles, one set for each round."""
    h = h + np.uint64(round_ * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _least(h: np.ndarray) -> list[int]:
    """The least of the hashes of a text's runs of five words, made of those of its pairs of words h; of the pairs where
    there are fewer."""
    if len(h) > 3:
        h = _mixed(_mixed(h[:-3], 1) ^ _mixed(h[2:-1], 2) ^ _mixed(h[3:], 3), 4)
    return np.unique(h)[:LEAST].view(np.int64).tolist()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            b = batch.slice(at, 500)
            made, least = [], []
            for t in b["text"]:
                h = shingles(t.as_py(), FINE)
                made.append([majority(h if i == 0 else _mixed(h, i)) for i in range(PRINTS)])
                least.append(_least(h))
            columns = np.array(made, np.uint64).reshape(-1, PRINTS).view(np.int64).T
            yield pa.RecordBatch.from_arrays([b["id"], b["th"], *map(pa.array, columns), pa.array(least, pa.list_(pa.int64()))], ["id", "th", *(f"f{i}" for i in range(PRINTS)), "least"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                made = [np.unique(shingles(t.as_py(), width)).tobytes() for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["th"], pa.array(made, pa.binary())], ["th", "hashes"])

    return run


def _as_longs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            made = [np.frombuffer(h.as_buffer(), np.int64) for h in part["hashes"]]
            yield pa.RecordBatch.from_arrays([part["th"], pa.array(made, pa.list_(pa.int64()))], ["th", "hashes"])


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["a"], b["b"]):
                x, y = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                if min(len(x), len(y)) >= least * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= least * (len(x) + len(y) - both))
                else:
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([b["u"], b["v"]], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _keyed(texts: DataFrame) -> DataFrame:
    """(k, x): the keys of each text th: variants of the segments of its fingerprints f0, f1 and so on, and its least hashes."""
    variants = (F.transform(_variants(F.col(f"f{i}")), lambda k: k + F.lit(i << 38)) for i in range(PRINTS))  # noqa: B023
    least = F.transform("least", lambda h: h.bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62)))
    return texts.select(F.explode(F.concat(*variants, least)).alias("k"), F.col("th").alias("x"))


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v): pairs of texts th that share a key which at most CAP texts have; (th): the texts that share one with more.

    Texts are distinct and have th, f0, f1 and so on, and least. A null th isn't compared; an empty table gives two empty ones.
    """
    many_tasks = PRINTS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = save(texts, "texts")  # else the next line's tasks are merged, as for a small table
    keyed = _keyed(texts.repartition(many_tasks, "th"))
    groups = save(keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n >= 2"), "variants")
    two = groups.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    large = groups.where("n > 2").select("k", "n")
    if large.count() <= BROADCAST_KEYS:  # 16 bytes each; else both sides are shuffled
        large = F.broadcast(large)
    members = save(keyed.join(large, "k"), "members")
    some = members.where(F.col("n") <= CAP).groupBy("k").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    some = some.select(F.explode("xs").alias("u"), "xs").select("u", F.explode(F.filter("xs", lambda b: b > F.col("u"))).alias("v"))
    return two.unionByName(some).where("u <> v").distinct(), members.where(F.col("n") > CAP).select(F.col("x").alias("th")).distinct()


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(x, token, at, early): per set th the elements of which two sets of this similarity share one at least: the rarest ones, as many as a
    similar set may lack and one more; only those that several sets have.

    Elements are ranked by the number of sets that have them, so what many sets share comes last; at is the place in that order. early tells the
    elements before which so few others come that a set of the same size may lack them all: if sets share nothing before
    an element that is early in neither, they aren't similar, for the larger one would have to lack more.
    An empty set has the element 0.
    """
    tokens = sets.select("th", F.explode(F.when(F.size("hashes") > 0, F.col("hashes")).otherwise(F.array(F.lit(0).cast("long")))).alias("token"))
    tokens = save(tokens.withColumn("side", F.xxhash64("token")), "tokens")
    # one more key than was grouped by: the join then shuffles both sides, so that a hot element can be split
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("side", F.xxhash64("token"))
    ranked = tokens.join(often, ["token", "side"]).groupBy("th").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"))
    size = F.size("all")
    near = lambda share: F.floor(size * (1 - share) + 1e-9).cast("int") + 1
    kept = F.transform(F.slice("all", F.lit(1), near(F.lit(similarity))), lambda t, i: F.struct(t["token"].alias("token"), t["n"].alias("n"), i.alias("at"), (i < near(F.lit(2 * similarity / (1 + similarity)))).alias("early")))
    return ranked.select(F.col("th").alias("x"), F.inline(F.filter(kept, lambda t: t["n"] > 1))).drop("n")


def crowded(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From prefixes: (u, v), pairs that share an element which at most CAP sets have there; (x, token, at, early) of the others,
    where one of the sets has it early."""
    found = save(found, "prefixes")
    of = found.groupBy("token").agg(F.count("*").alias("n"), F.max("early").alias("any")).where("n > 1").withColumn("side", F.xxhash64("token"))
    both = save(found.withColumn("side", F.xxhash64("token")).join(of, ["token", "side"]).drop("side"), "shared")
    some = both.where(F.col("n") <= CAP).groupBy("token").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    some = some.select(F.explode("xs").alias("u"), "xs").select("u", F.explode(F.filter("xs", lambda b: b > F.col("u"))).alias("v"))
    return some.distinct(), both.where((F.col("n") > CAP) & F.col("any")).select("x", "token", "at", "early")


def stars(hot: DataFrame) -> DataFrame:
    """(u, v): of each element the set in whose order it comes first, with all others that have it. Of copies of a text, that is
    the one with the fewest changes."""
    centre = hot.where("early").groupBy("token").agg(F.min(F.struct("at", "x")).alias("c"))
    return hot.join(centre, "token").select("x", F.col("c.x").alias("c")).where("x <> c").select(F.least("x", "c").alias("u"), F.greatest("x", "c").alias("v")).distinct()


def _blocks(similarity: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sets = [np.frombuffer(h.as_buffer(), "<u8") for h in t["hashes"].chunk(0)] if t.num_rows else []
        few, root, x = (np.asarray(t[c]) for c in ("few", "root", "x"))
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array(list(map(len, sets)))
        ends = np.cumsum(sizes)
        out_u, out_v = [], []
        for i in np.flatnonzero(few):
            mark = np.zeros(len(names), np.int32)
            mark[flat[ends[i] - sizes[i] : ends[i]]] = 1
            sums = np.concatenate([[0], np.cumsum(mark[flat])])
            both = sums[ends] - sums[ends - sizes]
            hit = np.flatnonzero((both >= similarity * (sizes[i] + sizes - both)) & (root != root[i]) & ~few)
            out_u.append(np.minimum(x[i], x[hit]))
            out_v.append(np.maximum(x[i], x[hit]))
        return pa.table({"u": np.concatenate(out_u or [x[:0]]), "v": np.concatenate(out_v or [x[:0]])})

    return run


def apart(hot: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): the pairs of similar sets among those that share such elements and that roots (node, root) don't connect.

    Sets that elements connect make a group. Of each group those in the component that has most of them are only compared with the
    others, so where a star has connected a group there is nothing left. Both sides are dealt to blocks of BLOCK sets about, and
    a task compares a block with a block: sets are copied once for each block of the other side, pairs are never rows.
    """
    groups = save(connected(stars(hot)), "groups").select(F.col("node").alias("x"), F.col("root").alias("group"))
    at = save(groups.join(roots, F.col("x") == F.col("node"), "left").select("x", "group", F.coalesce("root", "x").alias("root")), "hot")
    by_root = at.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group")
    by_root = by_root.agg(F.max_by("root", "n").alias("major"), F.count("*").alias("roots"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")).where("roots > 1")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    at = at.join(by_root.select("group", "major", blocks("all").alias("right"), blocks("others").alias("left")), "group")
    deal = lambda n: F.pmod(F.xxhash64("x"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    few = at.where("root <> major").select("x", "root", "group", F.lit(True).alias("few"), deal("left").alias("l"), each("right").alias("r"))
    every = at.select("x", "root", "group", F.lit(False).alias("few"), each("left").alias("l"), deal("right").alias("r"))
    rows = few.unionByName(every).join(sets.withColumnRenamed("th", "x"), "x")
    return rows.groupBy("group", "l", "r").applyInArrow(_blocks(similarity), "u long, v long").distinct()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, a, b): pairs with the hashes of both texts. Texts in more than HOT pairs, of which MOST_HOT can be at most,
    have their pairs dealt to several tasks, each with a copy of the set."""
    common, out, right = max(HOT, pairs.count() // MOST_HOT), pairs, {}
    for key, name in (("u", "a"), ("v", "b")):
        hot = F.broadcast(pairs.groupBy(key).agg(F.ceil(F.count("*") / common).cast("int").alias("parts")).where("parts > 1"))
        parts = F.coalesce("parts", F.lit(1))
        out = out.join(hot, key, "left").withColumn(f"{key}p", F.pmod(F.xxhash64("u", "v"), parts.cast("long")).cast("int")).drop("parts")
        copies = sets.select(F.col("th").alias(key), F.col("hashes").alias(name)).join(hot, key, "left")
        right[key] = copies.withColumn(f"{key}p", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return out.join(right["u"], ["u", "up"]).join(right["v"], ["v", "vp"]).select("u", "v", "a", "b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, that with the smallest id (null last), then hash of the text.

    Two texts are near copies if their sets of shingles of width words (A-Z lower-cased; of all words where there are
    fewer) have a Jaccard similarity of similarity or more; groups are what such pairs connect. Candidates are texts
    that have, in one of PRINTS fingerprints over shingles of FINE words, a 32-bit segment that differs by one bit at
    most: deletion variants, as in links(); or one of the LEAST least hashes of runs of five words in common, as fingerprints of this
    few bits miss texts with a part added or cut off. Each candidate pair is then decided by the sets themselves, so
    texts that are less alike are never linked but through others. Of pairs of similarity 0.8 the least hashes alone miss
    one in 600.

    Texts of which more than CAP share a key, as under a common opening, are searched for all similar pairs without a miss: by the rarest
    elements of their sets (prefixes), so that what they all share finds nothing. Where many share even such an element, each is
    compared with the one that has the fewest rarer ones, and then all that isn't connected by that is compared, block by block.

    First each text is compared with one partner, then, of the other pairs, those that are not connected by then. Equal texts are
    one text before any search. Null and empty texts are equal. Rows that repeat an id are documents of their own. Extra
    columns stay; an empty table gives an empty result. Whole texts are read.
    """
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    longs = ", ".join(f"f{i} long" for i in range(PRINTS))
    with scratch(docs.sparkSession) as keep:
        found = save(rows.select("id", "th", "text").mapInArrow(trimmed(_prints), f"id long, th long, {longs}, least array<long>"), "fingerprints")
        pairs, many = candidates(found.dropDuplicates(["th"]))
        pairs, many = save(pairs, "pairs"), save(many, "many")
        asked = pairs.select("u").union(pairs.select("v")).union(many).distinct()
        texts = rows.join(asked, rows["th"] == asked["u"], "left_semi").select("th", "text")
        sets = save(texts.dropDuplicates(["th"]).mapInArrow(trimmed(_sets(width)), "th long, hashes binary"), "sets")

        def linked(some: DataFrame) -> DataFrame:
            return save(_with_sets(some, sets).mapInArrow(trimmed(_similar(similarity)), "u long, v long"), "links")

        hot = None
        if not many.isEmpty():
            these = sets.join(many, "th", "left_semi").mapInArrow(trimmed(_as_longs), "th long, hashes array<long>")
            more, hot = crowded(prefixes(these, similarity))
            hot = save(hot, "hot")
            pairs = save(pairs.unionByName(more).unionByName(stars(hot)).distinct(), "pairs")
        one = save(pairs.groupBy("v").agg(F.min("u").alias("u")), "one")
        links_ = linked(one)
        for last in (False, True):
            roots = save(connected(links_), "roots")
            if last and hot is None:
                break
            new = save(apart(hot, roots, sets, similarity), "links") if last else linked(_unconnected(pairs.join(one, ["u", "v"], "left_anti"), roots))
            links_ = links_.unionByName(new)
        if hot is not None:
            roots = save(connected(links_), "roots")
        group = F.coalesce("root", "th")
        first = found.join(roots, found["th"] == roots["node"], "left").groupBy(group.alias("group"))
        first = first.agg(F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), "th")).alias("x"))
        first = keep(save(first.select(F.col("x.id").alias("_id"), F.col("x.th").alias("_th")), "kept"))
    kept = rows.join(first, rows["id"].eqNullSafe(first["_id"]) & (rows["th"] == first["_th"]), "left_semi")
    return kept.dropDuplicates(["id", "th"]).select("row.*")


def _unconnected(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends have different roots."""
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}r"))
    out = pairs.join(at("u"), "u", "left").join(at("v"), "v", "left").where(F.coalesce("ur", "u") != F.coalesce("vr", "v"))
    return save(out.select("u", "v"), "rest")


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
