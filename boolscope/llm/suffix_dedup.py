"""Removal of byte strings that are found more than once in a corpus, by suffix arrays over shards of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch, text_of, trimmed

LENGTH = 400
#: Bytes of a document that are looked at in one go while anchors are picked.
CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]), dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Anchors:
    """Deals all windows of length bytes to anchors: each to the place of its half-window with the smallest hash.

    A window's choice depends on its bytes alone, so equal windows have anchors of the same hash in the same place of
    theirs: what is found twice is found among the windows of anchors with equal hashes.
    """

    def __init__(self, length: int):
        self.length, self.half = length, length // 2
        self.up, self.down = _powers(BASE, CHUNK + 4 * length), _powers(INVERSE, CHUNK + 4 * length)

    def _sums(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return sums

    def _least(self, data: np.ndarray) -> np.ndarray:
        """The anchor of every window of a chunk."""
        k, w = self.half, self.length - self.half + 1
        sums, n = self._sums(data), len(data) - k + 1
        h = _mix((sums[k:] - sums[:n]) * self.down[:n])
        packed = (h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64)
        blocks = -(-n // w)
        full = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        full[:n] = packed
        grid = full.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - w + 1
        return (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & np.uint64(0xFFFFF)).astype(np.int64)

    def deal(self, data: bytes) -> tuple[np.ndarray, ...]:
        """(first window, windows, anchor's place after it, hash of the half-window, hash of all the windows' bytes)."""
        a, n = np.frombuffer(data, np.uint8), len(data)
        if n < self.length:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        least = np.concatenate([at + self._least(a[at : at + CHUNK + self.length - 1]) for at in range(0, n - self.length + 1, CHUNK)])
        start = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
        anchor, many = least[start], np.diff(start, append=len(least))
        key, whole = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for first in range(0, n, CHUNK):  # hashes by prefix sums over chunks that hold whole segments
            mine = (start >= first) & (start < first + CHUNK)
            if mine.any():
                sums = self._sums(a[first : first + CHUNK + 4 * self.length])
                s, e, m = start[mine] - first, (start + many - 1)[mine] - first + self.length, anchor[mine] - first
                key[mine] = _mix((sums[m + self.half] - sums[m]) * self.down[m])
                whole[mine] = _mix(_mix((sums[e] - sums[s]) * self.down[s]) ^ ((m - s).astype(np.uint64) << np.uint64(32)) ^ (e - s).astype(np.uint64))
        return start, many, anchor - start, key, whole


def _anchors(length: int):
    names = ["id", "th", "start", "many", "place", "h", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                made = [anchors.deal(t.as_py()) for t in b["text"]]
                rows = pa.array(np.repeat(np.arange(b.num_rows), [len(x[0]) for x in made]))
                cols = [np.concatenate(c) for c in zip(*made)]
                cols = [*(c.astype(np.int32) for c in cols[:3]), *(c.view(np.int64) for c in cols[3:])]
                yield pa.RecordBatch.from_arrays([b["id"].take(rows), b["th"].take(rows), *map(pa.array, cols)], names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that a document is asked for."""
    for b in batches:
        for id_, th, text, asked in zip(b["id"].to_pylist(), b["th"].to_pylist(), b["text"], b["asked"].to_pylist()):
            data = text.as_buffer()
            rows = [(x["h"], id_, th, x["start"], x["many"], x["place"], x["copies"], data[x["start"] : x["start"] + x["many"] - 1 + LENGTH].to_pybytes()) for x in asked]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["key", "id", "th", "start", "many", "place", "copies", "bytes"])


# --- suffix arrays -----------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next (S); the last, of the sentinel, is."""
    n = len(t)
    differs = np.append(np.nonzero(t[1:] != t[:-1])[0], n - 1)
    following = differs[np.searchsorted(differs, np.arange(n))]
    return (following == n - 1) | (t[np.minimum(following + 1, n - 1)] > t[following])


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the leftmost S ones, by a scan of the buckets up for the others (L) and one
    down for S.

    Neighbouring buckets are scanned together as long as none of their entries puts another into one of them; a bucket
    that does so to itself is scanned alone, and what it puts into itself after that.
    """
    n, size = len(t), int(t.max()) + 1
    count = np.bincount(t, minlength=size)
    head = np.concatenate([[0], np.cumsum(count)[:-1]])
    tail = head + count
    many_l = np.bincount(t[~is_s], minlength=size)
    sa = np.full(n, -1, np.int32)
    first = t[lms]
    many = np.bincount(first, minlength=size)
    rank = np.arange(len(lms)) - (np.cumsum(many) - many)[first]
    sa[tail[first] - many[first] + rank] = lms

    def induced(block: np.ndarray, want_s: bool) -> np.ndarray:
        j = block - 1
        j = j[j >= 0]
        return j[is_s[j] == want_s]

    def put(j: np.ndarray, at: np.ndarray, step: int) -> None:
        if not len(j):
            return
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        new = np.nonzero(np.concatenate([[True], c[1:] != c[:-1]]))[0]
        found = np.diff(new, append=len(c))
        sa[at[c] + step * (np.arange(len(j)) - np.repeat(new, found))] = j
        at[c[new]] += step * found

    at, c, want = head.copy(), 0, 256
    while c < size:
        end = max(c + 1, int(np.searchsorted(tail, head[c] + want, "right")))
        j = induced(sa[head[c] : tail[end - 1]], False)
        least = int(t[j].min()) if len(j) else size
        if least >= end:
            put(j, at, 1)
            c, want = end, min(2 * want, 1 << 16)
        elif least > c:
            put(induced(sa[head[c] : head[least]], False), at, 1)
            c, want = least, max(64, want // 2)
        else:
            lo = head[c]
            while lo < at[c]:
                hi = at[c]
                put(induced(sa[lo:hi], False), at, 1)
                lo = hi
            put(induced(sa[tail[c] - many[c] : tail[c]], False), at, 1)
            c += 1
    at, c, want = tail - 1, size - 1, 256
    while c > 0:  # the bucket of the sentinel alone puts nothing
        end = min(c, max(1, int(np.searchsorted(head, tail[c] - want))))
        j = induced(sa[head[end] : tail[c]][::-1], True)
        most = int(t[j].max()) if len(j) else -1
        if most < end:
            put(j, at, -1)
            c, want = end - 1, min(2 * want, 1 << 16)
        elif most < c:
            put(induced(sa[tail[most] : tail[c]][::-1], True), at, -1)
            c, want = most, max(64, want // 2)
        else:
            hi = tail[c] - 1
            while hi > at[c]:
                lo = at[c]
                put(induced(sa[lo + 1 : hi + 1][::-1], True), at, -1)
                hi = lo
            put(induced(sa[head[c] : head[c] + many_l[c]][::-1], True), at, -1)
            c -= 1
    return sa


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of the suffixes of data (numbers from 1, with one 0 at the end).

    Induced sorting: suffixes are classified, the substrings between leftmost-smaller suffixes are sorted by one
    induction and named, the string of names, half as long or less, is sorted in turn the same way, and a second
    induction gives the order of all.
    """
    t = data.astype(np.int32)
    is_s = _types(t)
    lms = np.nonzero(is_s[1:] & ~is_s[:-1])[0] + 1
    if len(lms) > 1:
        sa = _induce(t, is_s, lms[np.argsort(t[lms], kind="stable")])
        leftmost = np.zeros(len(t), bool)
        leftmost[lms] = True
        order = sa[leftmost[sa]]
        end = np.empty(len(t), np.int64)
        end[lms] = np.append(lms[1:], lms[-1]) + 1
        size = end[order] - order
        sums = np.concatenate([[np.uint64(0)], np.cumsum((t.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(t)), dtype=np.uint64)])
        value = _mix((sums[end[order]] - sums[order]) * _powers(INVERSE, len(t))[order])
        names = np.empty(len(t), np.int32)
        names[order] = np.cumsum(np.concatenate([[0], (value[1:] != value[:-1]) | (size[1:] != size[:-1])]))
        string = names[lms]
        lms = order if string.max() + 1 == len(lms) else lms[suffix_array(string)]
    return _induce(t, is_s, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, borders: np.ndarray, most: int) -> np.ndarray:
    """Per place in the text: the common prefix of its suffix and the one before it in order (permuted order), up to
    most or more.

    Only places whose left neighbours differ, and borders, are compared; from one to the next the prefix loses one
    number a place.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.arange(n) - 1
    own = (before <= 0) | (t[np.maximum(left, 0)] != t[np.maximum(before - 1, 0)])
    own[0], own[borders] = True, True
    at = np.nonzero(own & (before >= 0))[0]
    padded = np.concatenate([t.astype(np.uint16), np.zeros(most + 8, np.uint16)])
    four = padded[:-3].astype(np.uint64)
    for i in (1, 2, 3):
        four |= padded[i : len(padded) - 3 + i].astype(np.uint64) << np.uint64(16 * i)
    same, a, b, reached = np.zeros(n, np.int64), at, before[at], 0
    while len(a) and reached < most:
        x = four[a + reached] ^ four[np.minimum(b + reached, len(four) - 1)]
        here = x == 0
        y = x[~here]
        zeros = (y & np.uint64(0xFFFF) == 0).astype(np.int64) + (y & np.uint64(0xFFFFFFFF) == 0) + (y & np.uint64(0xFFFFFFFFFFFF) == 0)
        same[a[~here]] = reached + zeros
        a, b = a[here], b[here]
        reached += 4
        inside = np.maximum(a, b) + reached < n
        same[a[~inside]] = reached
        a, b = a[inside], b[inside]
    same[a] = reached
    places = np.nonzero(own)[0]
    last = places[np.cumsum(own) - 1]
    return np.maximum(same[last] - (np.arange(n) - last), 0)


def repeated(segments: list[bytes], many: np.ndarray, copies: np.ndarray, length: int) -> list[np.ndarray]:
    """Per segment: which of its first many windows of length bytes are found twice or more in all, a segment that
    stands for several copies counting as two."""
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.zeros(int(starts[-1]) + 1, np.int16)
    t[:-1] = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int16) + 2
    t[starts[1:] - 1] = 1
    sa = suffix_array(t)
    same = common_prefixes(t, sa, starts[:-1], 2 * length + int(sizes.max()))
    valid = np.zeros(len(t), bool)
    owner = np.repeat(np.arange(len(segments)), many)
    places = starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    valid[places] = True
    run = np.cumsum(same[sa] < length)
    weight = np.zeros(len(t), np.int64)
    weight[places] = np.minimum(copies[owner], 2)
    found = np.zeros(len(t), bool)
    found[sa] = np.bincount(run, weight[sa])[run] >= 2
    return np.split(found[places], np.cumsum(many)[:-1])


def _shards(length: int):
    """Intervals of repeated windows, from segments in order of their keys; a shard ends where a key does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            many, copies = np.array([r[4] for r in held]), np.array([r[5] for r in held])
            rows = []
            for r, found in zip(held, repeated([r[6] for r in held], many, copies, length)):
                if r[5] == 1 and found.any():
                    edge = np.diff(np.concatenate([[0], found.view(np.int8), [0]]))
                    rows += [(r[1], r[2], r[3] + int(a), r[3] + int(b) - 1 + length) for a, b in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0])]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "th", "lo", "hi"])

        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("key", "id", "th", "start", "many", "copies", "bytes"))):
                if size >= SHARD and held and r[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield done()

    return run


SPANS = "id long, th long, lo int, hi int"
#: Bytes of a shard, at which it ends with its key; segments of a key beyond which the key is refined.
SHARD, MOST = 2 << 20, 2000
#: Copies of a segment beyond which it is one of the common ones, and how many of those there can be.
HOT, MOST_HOT = 1000, 50_000


def _ends(rows: DataFrame, length: int) -> DataFrame:
    return rows.select("id", "th", F.col("start").alias("lo"), (F.col("start") + F.col("many") - 1 + length).cast("int").alias("hi"))


def _refined(rows: DataFrame, length: int, low: int, high: int) -> DataFrame:
    """Segments of overfull keys, each as up to two parts with finer keys.

    rows: windows that reach low to high bytes left of their anchor. Those that reach beyond the middle share
    the bytes from there to the anchor's end, the others those to the right end that they all reach, so equal
    windows stay under one key.
    """
    k, mid, place = length // 2, (low + high) // 2, F.col("place")

    def part(side: int, lo, hi, key) -> DataFrame:
        a, b = F.greatest(lo, F.lit(0)), F.least(hi, F.col("many") - 1)
        out = rows.withColumns({"_a": a, "_b": b}).where("_a <= _b")
        cut = F.substring("bytes", F.col("_a") + 1, F.col("_b") - F.col("_a") + length)
        return out.select(F.xxhash64("key", F.lit(side), key).alias("key"), "id", "th", (F.col("start") + F.col("_a")).alias("start"), (F.col("_b") - F.col("_a") + 1).alias("many"), (place - F.col("_a")).alias("place"), "copies", cut.alias("bytes"))

    bytes_ = F.col("bytes")
    left = part(0, place - high, place - mid - 1, F.substring(bytes_, place - mid, F.lit(mid + 1 + k)))
    right = part(1, place - mid, place - low, F.substring(bytes_, place + 1, F.lit(k + (length - k) - mid)))
    return left.withColumns({"low": F.lit(mid + 1), "high": F.lit(high)}).unionByName(right.withColumns({"low": F.lit(low), "high": F.lit(mid)}))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, th, lo, hi): intervals of bytes, overlapping or not, that windows of length bytes found twice or more cover.

    docs: id, th (a hash of the text), text (binary). Windows are dealt to anchors. Of anchors with one hash, those
    with the same bytes in all their windows are repeated as they are, which counts alone tell. Where the bytes
    differ, one segment for each kind of bytes goes to a shard, in which a suffix array and its common prefixes
    tell the windows that are found in several. A key with more than MOST kinds is split by bytes further from the
    anchor, again and again, kinds that become equal being joined each time; that ends, as a key that fixes all
    of a window has one kind.
    """
    made = save(docs.mapInArrow(trimmed(_anchors(length)), "id long, th long, start int, many int, place int, h long, s long"), "anchors")
    kinds = made.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "start", "many", "place")).alias("x"))
    kinds = kinds.withColumn("copies", F.least("n", F.lit(2)).cast("long"))
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max("copies").alias("most")).where("kinds > 1 or most > 1")
    groups = save(kinds.join(groups, "h").select("h", "s", "n", "copies", "x", "kinds"), "kinds")
    # kinds so common that only MOST_HOT can be are sent to all tasks: no task then gets all rows of one
    common = max(HOT, made.count() // MOST_HOT)
    hot = F.broadcast(groups.where(F.col("n") > common).select("h", "s"))
    rest = groups.where((F.col("n") > 1) & (F.col("n") <= common)).select("h", "s")
    out = _ends(made.join(hot, ["h", "s"]), length).unionByName(_ends(made.join(hot, ["h", "s"], "left_anti").join(rest, ["h", "s"]), length))
    asked = groups.where("kinds > 1").select("x.id", "x.th", F.struct("h", "x.start", "x.many", "x.place", "copies").alias("a"))
    asked = asked.groupBy("id", "th").agg(F.collect_list("a").alias("asked"))
    key = [docs["id"].eqNullSafe(asked["id"]), docs["th"] == asked["th"]]
    fetched = docs.join(asked, key, "inner").select(docs["id"], docs["th"], "text", "asked")
    segments = fetched.mapInArrow(trimmed(_cut), "key long, id long, th long, start int, many int, place int, copies long, bytes binary")
    segments = save(segments.dropDuplicates(["key", "id", "th", "start"]), "segments")
    over = segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("key")
    todo, ready = segments.join(over, "key", "left_semi"), segments.join(over, "key", "left_anti")
    parts, levels = [ready], [(0, length - length // 2)]
    while levels and over.take(1):
        finer = [_refined(todo if len(levels) == 1 else todo.where((F.col("low") == lo) & (F.col("high") == hi)), length, lo, hi) for lo, hi in levels]
        rows = finer[0]
        for x in finer[1:]:
            rows = rows.unionByName(x)
        rows = save(rows.withColumn("kind", F.xxhash64("place", "many", "bytes")), "finer")
        met = rows.groupBy("key", "kind").agg(F.sum("copies").alias("sum"), F.min(F.struct("id", "th", "start")).alias("x"))
        met = save(met, "kinds")
        out = out.unionByName(_ends(rows.join(met.where("sum > 1").select("key", "kind"), ["key", "kind"]), length))
        one = rows.join(met, ["key", "kind"]).where(F.struct("id", "th", "start").eqNullSafe(F.col("x")))
        one = one.withColumn("copies", F.least("sum", F.lit(2)).cast("long")).drop("kind", "sum", "x")
        sizes = met.groupBy("key").agg(F.count("*").alias("n"))
        parts.append(one.join(sizes.where((F.col("n") > 1) & (F.col("n") <= MOST)).select("key"), "key", "left_semi").select(*segments.columns))
        over = sizes.where(F.col("n") > MOST).select("key")
        todo = save(one.join(over, "key", "left_semi"), "todo")
        levels = [(r["low"], r["high"]) for r in todo.select("low", "high").distinct().collect()]  # at most 2 ** level
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    found = rows.repartition("key").sortWithinPartitions("key", "id", "th", "start").mapInArrow(trimmed(_shards(length)), SPANS)
    return out.unionByName(found)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            b, out = batch.slice(first, 500), []
            for id_, text, lo, hi in zip(b["id"].to_pylist(), b["text"], b["lo"].to_pylist(), b["hi"].to_pylist()):
                data, kept, at, removed, n = text.as_py(), [], 0, 0, 0
                if lo:
                    lo, hi = np.array(lo), np.array(hi)
                    order = np.argsort(lo)
                    lo, hi = lo[order], np.maximum.accumulate(hi[order])
                    new = np.concatenate([[True], lo[1:] > hi[:-1]])
                    for a, z in zip(lo[new].tolist(), hi[np.append(np.nonzero(new)[0][1:] - 1, len(hi) - 1)].tolist()):
                        kept.append(data[at:a])
                        at, removed, n = z, removed + z - a, n + 1
                out.append((id_, len(data), removed, n, b"".join([*kept, data[at:]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every document; kept is what stays of its bytes.

    Every byte in a string of length bytes that starts anywhere else too, in any document, goes; all of its
    places lose it. Texts are UTF-8; a null text is empty, and shorter texts than length lose nothing. Rows with equal
    id and text are documents of their own that repeat each other. A null id is returned as null. Extra columns are
    ignored; an empty table gives an empty result. Long texts are read in chunks; only the bytes of segments that
    differ under one anchor are gathered outside their documents.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    with scratch(docs.sparkSession) as keep:
        found = spans(rows.select("id", "th", "text"), length).groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("x"))
        found = keep(save(found.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "x.lo", "x.hi"), "spans"))
    both = rows.join(found, rows["id"].eqNullSafe(found["_id"]) & (rows["th"] == found["_th"]), "left")
    out = both.select("id", "text", "lo", "hi").mapInArrow(trimmed(_finish), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
