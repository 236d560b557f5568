"""SimHash, components, suffix arrays and WARC archives against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boolscope.llm import components, simhash, suffix_dedup, warc
from boolscope.llm.common import new_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, most=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_groups(make_docs, corpus):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64, r["component"] or -1) for r in simhash.near_duplicates(make_docs(corpus)).collect())
    fps = [fingerprint(t) for _, t in corpus]
    group = roots(fps)
    least = {}
    for (i, _), g in zip(corpus, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((i is None, i or 0, f, least.get(g, -1) or -1) for (i, _), f, g in zip(corpus, fps, group))
    assert got == want


@pytest.mark.parametrize("cap", [1, 3, 24])
def test_links_of_dense_groups(spark, monkeypatch, cap):
    """All fingerprints near a few centres, with every size of bucket on every path."""
    rnd = random.Random(cap)
    fps = {0}
    for _ in range(3):
        c = rnd.getrandbits(64)
        fps |= {c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(60)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    found = components.connected(simhash.links(nodes, 2, cap)).collect()
    label = {r["node"] % 2**64: r["root"] for r in found}
    want = roots(fps)
    groups = lambda xs: Counter(frozenset(f for f, x in zip(fps, xs) if x == v) for v in set(xs))
    assert groups([label.get(f, f) for f in fps]) == groups(want)


def similar(a, b):
    """Whether the five-word shingles of two texts have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in (a, b):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)} - {()})
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def near_rows(rnd, groups, copies):
    """Texts and copies of them with a few words changed, some above and some below the similarity."""
    out = []
    for g in range(groups):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(80, 300))]
        for c in range(copies):
            own = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2, 12]) if c else 0):
                own[rnd.randrange(len(own))] = f"v{rnd.randrange(10**6)}"
            out.append((1000 * g + c, " ".join(own)))
    return out


def smallest_of_groups(rows):
    """The smallest id (null last) of each group of near copies, by comparing all pairs."""
    parent = {i: i for i in range(len(rows))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similar(rows[i][1], rows[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (doc is None, doc or 0))
    return {None if n else doc for n, doc in least.values()}


def family_rows(rnd, families, copies, opening, own):
    """Families of near copies that all have an opening of so many words and then as many of the family's."""
    first, out = [f"o{rnd.randrange(3000)}" for _ in range(opening)], []
    for f in range(families):
        words = [f"f{f}x{rnd.randrange(3000)}" for _ in range(own)]
        for c in range(copies):
            last = list(words)
            if c:
                last[rnd.randrange(own)] = f"c{f}x{c}"
            out.append((100 * f + c, " ".join(first + last)))
    return out


@pytest.mark.parametrize(("opening", "own", "cap"), [(200, 60, 24), (200, 60, 1), (300, 30, 5), (300, 12, 5), (0, 80, 3)])
def test_families_under_one_opening(make_docs, monkeypatch, opening, own, cap):
    """Each family keeps one text, however many texts share what they have in common."""
    monkeypatch.setattr(simhash, "CAP", cap)
    rows = family_rows(random.Random(opening + own), 12, 5, opening, own)
    kept = {r["doc_id"] for r in simhash.one_of_each(make_docs(rows)).collect()}
    assert kept == smallest_of_groups(rows)


def test_texts_with_a_part_added_or_cut_off(make_docs):
    rnd, rows = random.Random(8), []
    for g in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(40, 300))]
        n = len(words)
        cut = words[: n - int(n * rnd.uniform(0.05, 0.18))]
        more = words + [f"a{rnd.randrange(10**6)}" for _ in range(int(n * rnd.uniform(0.05, 0.22)))]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(cut)), (10 * g + 2, " ".join(more))]
    kept = {r["doc_id"] for r in simhash.one_of_each(make_docs(rows)).collect()}
    first = smallest_of_groups(rows)
    assert first <= kept and len(kept - first) <= 1


@pytest.mark.parametrize("cap", [1, 4, 100])
def test_rarest_elements_find_all_similar_sets(spark, monkeypatch, cap):
    monkeypatch.setattr(simhash, "CAP", cap)
    rnd, sets = random.Random(cap), {}
    for g in range(8):
        base = rnd.sample(range(10_000), rnd.choice([1, 3, 10, 40]))
        for c in range(9):
            own = set(base) - set(rnd.sample(base, rnd.randrange(1 + len(base) // 6))) | set(rnd.sample(range(60), rnd.randrange(1 + len(base) // 5)))
            sets[100 * g + c] = sorted(own)
    sets |= {1000 + i: sorted({*range(100, 140), *rnd.sample(range(60), 6)}) for i in range(12)} | {2000: [], 2001: []}
    df = spark.createDataFrame([(k, v) for k, v in sets.items()], "th long, hashes array<long>")
    some, hot = simhash.crowded(simhash.prefixes(df, 0.8))
    none = spark.createDataFrame([], "node long, root long")
    monkeypatch.setattr(simhash, "BLOCK", 5)
    binary = spark.createDataFrame([(k, np.array(v, "<u8").tobytes()) for k, v in sets.items()], "th long, hashes binary")
    found = [tuple(r) for r in simhash.apart(hot, none, binary, 0.8).collect()] if not hot.isEmpty() else []
    got = {tuple(r) for x in (some, simhash.stars(hot)) for r in x.select("u", "v").collect()} | set(found)
    alike = lambda a, b: len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b))
    assert {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])} <= got
    assert all(alike(sets[a], sets[b]) for a, b in found) and (found or cap == 100)
    assert len(got) < len(sets) ** 2 / 4


@pytest.mark.parametrize(("cap", "hot"), [(1, 500), (24, 3)])
def test_one_of_each(make_docs, corpus, monkeypatch, cap, hot):
    monkeypatch.setattr(simhash, "CAP", cap)
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = [*((None if i is None else i - 100, t) for i, t in corpus), *near_rows(random.Random(4), 25, 6), *((i + 500_000, t) for i, t in near_rows(random.Random(9), 1, 60))]
    rows = [(i, t) for i, t in rows if i is None or i not in (-99, -98)] + [(-99, corpus[1][1]), (-98, corpus[2][1]), (-98, corpus[2][1])]
    docs = make_docs(rows)
    out = simhash.one_of_each(docs)
    assert out.dtypes == docs.dtypes
    kept = {r["doc_id"] for r in out.collect()}
    first = smallest_of_groups(rows)
    assert first == kept
    texts = {}
    for doc, t in rows:
        texts.setdefault(t or "", []).append((doc is None, doc or 0))
    assert all(doc not in kept for same in texts.values() for n, doc in same if not n and (n, doc) != min(same))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_components_of_chains(spark):
    rnd = random.Random(3)
    chain = list(range(0, 300, 3))
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [(1, 4), (4, 1), (7, 7), (None, 3), (1000, 4)]
    rnd.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: 0 for x in chain} | {1: 1, 4: 1, 1000: 1}


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = Counter()
    for (i, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for at in range(len(d) - length + 1):
            if count[d[at : at + length]] > 1:
                gone[at : at + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out[i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def removed(docs):
    return Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())


@pytest.mark.parametrize(("most", "hot"), [(2, 3), (2000, 1000), (2000, 2)])
def test_suffix_dedup(make_docs, corpus, monkeypatch, most, hot):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(450)
    rows = [*corpus, *((100 + i, noise(rnd.randrange(500)) + passage[: rnd.randrange(380, 451)] + noise(rnd.randrange(500))) for i in range(25)), (200, "ab" * 600), (201, "=" * 3000), (202, noise(399)), (203, passage + passage)]
    assert removed(make_docs(rows)) == brute(rows, 400)


def test_suffix_dedup_empty(make_docs):
    assert removed(make_docs([])) == Counter()
    assert removed(make_docs([(1, None), (2, "short")])) == brute([(1, None), (2, "short")], 400)


def test_suffix_array_and_prefixes():
    rnd = random.Random(1)
    for trial in range(60):
        t = np.array([rnd.randrange(1, 1 + rnd.choice([2, 3, 5])) for _ in range(rnd.randrange(1, 60))] + [0])
        if trial % 3 == 0:
            t = np.array([*([1, 2, 2, 1, 3] * 12)[: rnd.randrange(1, 60)], 0])
        if trial % 3 == 1:
            t = np.array([*[rnd.randrange(1, 500) for _ in range(rnd.randrange(1, 60))] * 3, 0])
        sa = suffix_dedup.suffix_array(t)
        assert list(sa) == sorted(range(len(t)), key=lambda i: list(t[i:]))
        same = suffix_dedup.common_prefixes(t.astype(np.int16), sa, np.array([0]), 200)
        for a, b in zip(sa[1:], sa):
            x, y = list(t[a:]), list(t[b:])
            assert same[a] == next(k for k in range(len(t) + 1) if x[: k + 1] != y[: k + 1] or k == min(len(x), len(y)))


PAGES = [(1, "http://a/", "x" * 200), (2, "http://b/é", "x" * 200), (3, None, "short"), (4, "http://c/\r\n", "short"), (5, "u", None), (6, "u", ""), (None, "n", "x" * 200), (7, "v", "naïve 漢字 " * 30), (8, "w", "naïve 漢字 " * 30), (8, "w", "naïve 漢字 " * 30), (None, "n", "y" * 150), (None, "n", "y" * 150)]


def test_archives_round_trip(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, digest string"), path)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, path).collect())
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = min((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        again = len(data) >= 100 and first is not None and first != i
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    for name in spark.read.format("binaryFile").load(path).collect():
        assert bytes(name["content"][:4]) == b"\x5d\x2a\x4d\x18"


def test_archives_of_nothing(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_archive_frames_without_a_dictionary():
    data = b"".join(warc._packer(b"", 1 << 20)([__import__("pyarrow").RecordBatch.from_pydict({"id": [1], "url": ["u"], "payload": [b"p" * 300_000], "digest": [hashlib.sha256(b"p" * 300_000).hexdigest()], "first": [None]})]).__next__()["archive"].to_pylist())
    assert [warc.parse(x)["payload_bytes"] for x in warc.frames(data)] == [300_000]


def test_archives_of_a_hot_payload_are_bounded(spark):
    """Half of the pages have one payload; an archive ends at its size, and every one begins with the dictionary."""
    path, rnd = new_path(spark, "warc-test"), random.Random(3)
    pages = [(i, f"http://h/{i}", "same " * 60 if i % 2 else " ".join(str(rnd.random()) for _ in range(30))) for i in range(600)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), path, archive_bytes=20_000)
    files = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, 4).alias("magic")).collect()
    dictionary = max(r["length"] for r in files) - 20_000
    assert len(files) > 3 and dictionary < warc.DICT_BYTES + 2000 and {bytes(r["magic"]) for r in files} == {b"\x5d\x2a\x4d\x18"}
    got = warc.read_archives(spark, path)
    assert got.count() == 600
    assert {(r["record_type"], r["refers_to"]) for r in got.where("page_id % 2 = 1 and page_id > 1").collect()} == {("revisit", 1)}


def test_the_dictionary_sample_is_bounded(spark, monkeypatch):
    """Rows without id and url have equal hashes if their payloads are equal: they can't all enter the sample."""
    monkeypatch.setattr(warc, "SAMPLE_RECORDS", 20)
    taken = []
    monkeypatch.setattr(warc, "train", lambda samples: taken.append(len(samples)) or b"")
    warc.write_archives(spark.createDataFrame([(None, None, "z" * 150)] * 300, "page_id long, url string, html string"), new_path(spark, "warc-test"))
    assert taken[0] <= 20
