"""Clusters of a graph by rounds: suns with their systems, communities by modularity, and what many vertices reach, as bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared
from .layout import both_ways

# --- suns, planets and moons


def _nearest(marks: DataFrame, both: DataFrame, value: str) -> DataFrame:
    """(id, value): the least value of a vertex and its neighbours; nulls say nothing."""
    told = both.join(marks.select(F.col("id").alias("b"), value), "b").select(F.col("a").alias("id"), value)
    return marks.select("id", value).unionByName(told).groupBy("id").agg(F.min(value).alias(value))


def systems(vertices: DataFrame, edges: DataFrame, salt: int = 0, rounds: int = 60) -> DataFrame:
    """(id, sun, hops): every vertex with its sun, at most two hops away. Any two suns are at least three hops apart.

    Each round, a vertex without a system that has the least hash of those up to two hops away becomes a sun; those up to two hops away from
    the new suns are out of the running. A planet, next to a sun, belongs to it; it has only one. A moon, two hops away, takes the sun of the neighbouring
    planet with the least id. Two messages a round; rounds grow with the logarithm of the graph. edges: a, b.
    """
    both = shared(both_ways(edges.select("a", "b", F.lit(1.0).alias("weight"))).select("a", "b").distinct())
    rank = F.struct(F.xxhash64(F.lit(salt), "id").alias("h"), F.col("id").alias("v"))
    state = shared(vertices.select("id").distinct().select("id", F.lit(False).alias("sun"), rank.alias("rank")))  # rank: null once decided
    for _ in range(rounds):
        if not state.where("rank IS NOT NULL").limit(1).count():
            break
        least = _nearest(_nearest(state, both, "rank"), both, "rank").withColumnRenamed("rank", "least")
        state = shared(state.join(least, "id").select("id", (F.col("sun") | F.coalesce(F.col("rank") == F.col("least"), F.lit(False))).alias("sun"), "rank"))
        near = state.select("id", F.when(F.col("sun"), 0).alias("near"))
        near = _nearest(_nearest(near, both, "near"), both, "near")
        state = shared(state.join(near, "id").select("id", "sun", F.when(F.col("near").isNull(), F.col("rank")).alias("rank")))
    else:
        raise RuntimeError("suns were not settled")
    suns = state.where("sun").select("id", F.col("id").alias("sun"), F.lit(0).alias("hops"))
    planets = shared(both.join(suns.select(F.col("id").alias("b"), "sun"), "b").select(F.col("a").alias("id"), "sun", F.lit(1).alias("hops")))
    inner = suns.unionByName(planets)
    outer = state.select("id").join(inner, "id", "left_anti").join(both, F.col("id") == F.col("a")).select("id", "b")
    moons = outer.join(planets.select(F.col("id").alias("b"), "sun"), "b").groupBy("id").agg(F.min_by("sun", "b").alias("sun"))
    return inner.unionByName(moons.select("id", "sun", F.lit(2).alias("hops")))


def between_suns(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, weight, length): links of suns whose systems touch; weights add up, and length is the mean of the ways from sun to sun over
    the edges. edges: a, b, weight, length."""
    for end in ("a", "b"):
        edges = edges.join(found.select(F.col("id").alias(end), F.col("sun").alias(f"sun_{end}"), F.col("hops").alias(f"hops_{end}")), end)
    met = edges.where("sun_a <> sun_b").groupBy(F.least("sun_a", "sun_b").alias("a"), F.greatest("sun_a", "sun_b").alias("b"))
    return met.agg(F.sum("weight").alias("weight"), F.avg(F.col("length") + F.col("hops_a") + F.col("hops_b")).alias("length"))


# --- modularity


def modularity(edges: DataFrame, found: DataFrame) -> float:
    """Of communities (id, community): the share of weight inside them less what their degrees would give by chance; 0 without edges."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    met = both.join(found.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(found.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    per = met.groupBy("ca").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total, inside, square = per.agg(F.sum("k"), F.sum("inside"), F.sum(F.col("k") * F.col("k"))).first()
    return inside / total - square / total**2 if total else 0.0


def _moved(edges: DataFrame, rounds: int, salt: int, least: float) -> tuple[DataFrame, float]:
    """One level: (id, community) after rounds of local moves, and its modularity. edges: a, b, weight; a = b is what is inside a vertex."""
    both = shared(both_ways(edges))
    loops = edges.where("a = b").select(F.col("a").alias("id"), (2 * F.col("weight")).alias("weight"))
    load = shared(both.select(F.col("a").alias("id"), "weight").unionByName(loops).groupBy("id").agg(F.sum("weight").alias("k")))
    total = load.agg(F.sum("k")).first()[0] or 0.0
    at = best = shared(load.select("id", F.col("id").alias("community")))
    quality = modularity(edges, at)
    stalled = 0
    for r in range(rounds if total else 0):
        sized = shared(at.join(load, "id"))
        mass = sized.groupBy("community").agg(F.sum("k").alias("mass"))
        to = both.join(at.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("weight").alias("w"))
        own = sized.select("id", F.col("community").alias("own"), "k")
        mine = sized.select("id", "community", F.lit(0.0).alias("w"))  # a vertex may stay without a neighbour there
        to = to.unionByName(mine).groupBy("id", "community").agg(F.sum("w").alias("w")).join(own, "id").join(mass, "community")
        gain = F.col("w") - F.col("k") * (F.col("mass") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / total
        # neighbours that would swap for ever: a coin per vertex and round lets about half of them move
        choice = to.groupBy("id").agg(F.max(F.struct(F.round(gain, 9), (F.col("community") == F.col("own")).alias("stay"), (-F.col("community")).alias("c"))).alias("x"))
        turn = F.pmod(F.xxhash64(F.lit(salt), F.lit(r), "id"), F.lit(2)) == 0
        at = shared(at.join(choice, "id").select("id", F.when(turn, -F.col("x.c")).otherwise(F.col("community")).alias("community")))
        now = modularity(edges, at)
        stalled = 0 if now > quality + least else stalled + 1
        if now > quality:
            best, quality = at, now
        if stalled == 2:
            break
    return best, quality


def communities(edges: DataFrame, levels: int = 10, rounds: int = 12, salt: int = 0, least: float = 1e-3) -> tuple[DataFrame, float]:
    """((id, community), modularity) of the vertices that have edges: vertices move to the neighbouring community that gains most, then communities
    become vertices, until a level gains nothing. edges: a, b, weight, in any direction, weights above 0; repeated ones add up.

    Only sums per vertex and community are shuffled; a hub's edges meet in none but partial sums. The best of all rounds is kept, so
    modularity never falls.
    """
    level = shared(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("weight")))
    found, quality = None, float("-inf")
    for k in range(levels):
        moved, now = _moved(level, rounds, salt + k, least)
        if found is not None and now <= quality + 1e-9:
            break
        gained = now - quality
        found = shared(moved if found is None else found.join(moved.select(F.col("id").alias("community"), F.col("community").alias("next")), "community").select("id", F.col("next").alias("community")))
        quality = now
        if gained < least:
            break
        for end in ("a", "b"):
            level = level.join(moved.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}")), end)
        level = shared(level.groupBy(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b")).agg(F.sum("weight").alias("weight")))
    named = found.groupBy("community").agg(F.min("id").alias("name"))
    return found.join(named, "community").select("id", F.col("name").alias("community")), quality


# --- hops from every vertex


#: Sources of a row of bits: 4 numbers of 64.
WORDS = 4


def hops_from_all(vertices: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(id, hops, reached): for each vertex how many others are that many hops away, up to most.

    Sources are dealt to blocks of 256 places by a hash of theirs; a row holds the bits of a block's sources that reach a vertex. A
    round merges the rows of a vertex's neighbours by bit-or, so an edge carries 256 searches at once. Sources that share a place are
    told apart by a number, which makes a block of its own.
    """
    both = shared(both_ways(edges.select("a", "b", F.lit(1.0).alias("weight"))).select("a", "b").distinct())
    ids = vertices.select("id").distinct()
    size = 64 * WORDS
    blocks = max(1, -(-2 * ids.count() // size))  # half full on average, so that few places are shared
    place = F.pmod(F.xxhash64("id"), F.lit(blocks * size))
    crowd = ids.select("id", place.alias("place")).groupBy("place").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # a few at a place
    dealt = crowd.select("place", F.posexplode("ids").alias("more", "id"))
    block = dealt.select("id", (F.floor(F.col("place") / size) + F.col("more") * blocks).alias("block"), F.pmod("place", F.lit(size)).alias("at"))
    names = [f"w_{i}" for i in range(WORDS)]

    def bit(i: int) -> Column:
        return F.when(F.floor(F.col("at") / 64) == i, F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).otherwise(F.lit(0).cast("long")).alias(names[i])

    reach = shared(block.select("id", "block", *(bit(i) for i in range(WORDS))))
    ones = sum((F.bit_count(n) for n in names[1:]), F.bit_count(names[0]))
    seen = [shared(reach.groupBy("id").agg(F.sum(ones).alias("s_0")))]
    for k in range(1, most + 1):
        told = both.join(reach.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "block", *names)
        reach = shared(reach.unionByName(told).groupBy("id", "block").agg(*(F.bit_or(n).alias(n) for n in names)))
        seen.append(reach.groupBy("id").agg(F.sum(ones).alias(f"s_{k}")))
    table = seen[0]
    for more in seen[1:]:
        table = table.join(more, "id")
    gained = F.array(*(F.struct(F.lit(k).cast("long").alias("hops"), (F.col(f"s_{k}") - F.col(f"s_{k - 1}")).alias("reached")) for k in range(1, most + 1)))
    return table.select("id", F.inline(gained)).where("reached > 0")
