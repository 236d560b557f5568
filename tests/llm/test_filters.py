"""Line deduplication, quality rules and url rules against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from boolscope.llm import line_dedup, quality_rules, url_rules

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_line_dedup(make_docs, corpus):
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(make_docs(corpus)).drop("row").collect())
    rank = lambda i: 2**63 - 1 if i is None else i
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = defaultdict(set)
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(rank(i))
    want = Counter()
    for i, t in corpus:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == rank(i)]
        want[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    assert got == want


def test_line_dedup_of_a_long_text_and_of_rows_with_one_id(make_docs):
    """Places of lines belong to a text: rows that share an id lose their own lines. Ids that differ lose the rest."""
    line = "a line that many hold"
    rows = [(1, f"{line}\nx"), (2, f"first of two\n{line}"), (2, f"{line}\nsecond"), (2, f"{line}\nsecond"), (3, "\n".join(f"line number {i % 7000}" for i in range(20_000)) + f"\n{line}"), (4, "line number 12\n")]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"][:20]) for r in line_dedup.dedup_lines(make_docs(rows)).collect())
    assert got == Counter({(1, 2, 0, f"{line}\nx"[:20]): 1, (2, 2, 1, "first of two"): 1, (2, 2, 1, "second"): 2, (3, 20_001, 1, "line number 0\nline n"): 1, (4, 2, 1, ""): 1})


def test_line_keys_lower_only_ascii(make_docs):
    """É and é differ, A and a don't: of these only the last has the key of another."""
    rows = [(1, "ÉTÉ AU SOLEIL"), (2, "Été au soleil"), (3, "été au soleil"), (4, "ÉtÉ au Soleil ")]
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(make_docs(rows)).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_line_dedup_stage_keeps_columns(make_docs, corpus):
    docs = make_docs(corpus)
    out = line_dedup.without_repeats(docs)
    assert out.dtypes == docs.dtypes and out.count() == len(corpus)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert line_dedup.without_repeats(docs.limit(0)).count() == 0


def features(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    counts = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if counts[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if x.strip(SPACE)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(make_docs, corpus):
    rows = [*corpus, (90, "a b c d e f g h " * 9), (91, "## | $$ %&\n## | $$ %&\n\n"), (92, "x " * 25), (93, "one two three four five six seven eight nine " * 2 + "ten")]
    got = Counter((r["row"]["doc_id"], *list(r["q"])[:5]) for r in quality_rules.judge(make_docs(rows)).collect())
    assert got == Counter((i, *features(t)) for i, t in rows)


def test_quality_verdicts(make_docs):
    import random

    rnd = random.Random(1)
    clean = [(i, " ".join(rnd.choice(["the", "of", "a", "to", "word", "another", "sentence", "random", f"x{rnd.randrange(999)}"]) for _ in range(60))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"word{rnd.randrange(999)}$$$ | ###" for _ in range(40))) for i in range(30)]
    short = [(2000, "too short"), (2001, None), (2002, "")]
    kept = {r["row"]["doc_id"] for r in quality_rules.judge(make_docs(clean + junk + short)).where("kept").collect()}
    assert kept == {i for i, _ in clean}
    assert quality_rules.keep_good(make_docs([])).count() == 0


def test_quality_columns_stay(make_docs, corpus):
    docs = make_docs(corpus)
    assert quality_rules.keep_good(docs).dtypes == docs.dtypes


def test_estimate_finds_accuracies():
    good, bad = (1,) * 8, (-1, -1, 1, 1, 1, 1, 1, 1)
    share, right = quality_rules.estimate([(good, 900), (bad, 100)])
    assert 0.85 < share < 0.95
    assert quality_rules.posterior(share, right, good) > 0.99 and quality_rules.posterior(share, right, bad) < 0.01


URLS = [
    (1, "http://a.net/x"), (2, "https://www.Example.NET/en/1?q#f"), (3, "http://example.com/de/"), (4, "http://notexample.com/de/"), (5, "http://org/fr/"), (6, "http://b.org/fr"), (7, None), (8, "no scheme"),
    (9, "http://net"), (10, "http://net?x=://y/"), (11, "ftp://EXAMPLE.com#/de/"), (12, "http://x.example.net/en/"), (13, "http://x.example.net/EN/"), (14, "http://b.net\n/x"), (7, None), (2, "https://www.Example.NET/en/1?q#f"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def given(host, path):
    fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, "allow"))


def test_given_rules(spark):
    pages = spark.createDataFrame([(*x, "c") for x in URLS], "page_id long, url string, best string")
    none = spark.createDataFrame([], "url string, blocked boolean")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, none).collect())
    assert got == Counter((i, *parts(u), *given(*parts(u))) for i, u in URLS)
    assert url_rules.judge(pages.limit(0), none).count() == 0


def test_mined_rules(spark):
    rows = [(f"http://{'spam' if i % 4 == 0 else 'fine'}.shop.io/{'ads' if i % 8 == 0 else 'news'}/{i}", i % 4 == 0) for i in range(400)]
    labelled = spark.createDataFrame([*rows, (None, True), ("http://x.io", None)], "url string, blocked boolean")
    rules = url_rules.mine(labelled)
    assert {tuple(r["tokens"]) for r in rules.where("verdict = 'block' and confidence = 1").collect()} >= {("host:spam",)}
    pages = spark.createDataFrame([(1, "http://spam.shop.io/news/77777"), (2, "http://fine.shop.io/news/1"), (3, "http://other.io/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labelled).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def url_tokens(url):
    host, path = parts(url)
    query = url.split("#")[0].partition("?")[2]
    lists = (("host:", host.split(".")), ("path:", path.split("/")), ("query:", [x.split("=")[0] for x in query.split("&")]))
    return {kind + re.sub("[0-9]+", "0", x.lower()) for kind, xs in lists for x in xs if x}


def labelled_urls(rnd, n):
    """Urls whose labels depend on two tokens together, some of them very long."""
    out = []
    for i in range(n):
        section, kind = rnd.choice(["ads", "news", "help"]), rnd.choice(["shop", "blog"])
        keys = rnd.sample([f"k{chr(97 + j)}" for j in range(26)], 20) if i % 10 == 0 else []
        url = f"http://{kind}.site.io/{section}/{i}" + ("?" + "&".join(f"{k}={i}" for k in keys) if keys else "")
        out.append((url, (section == "ads" and kind == "shop") != (rnd.random() < 0.05)))
    return out


def test_mined_rules_hold_as_counted(spark):
    """Support and confidence of every rule are those of a plain count; all rules of one or two tokens are found."""
    rows = labelled_urls(random.Random(1), 1500)
    got = {(r["verdict"], tuple(r["tokens"])): (r["confidence"], r["support"]) for r in url_rules.mine(spark.createDataFrame(rows, "url string, blocked boolean"), 0.02, 0.7, 1.2).collect()}
    held = [(url_tokens(u), b) for u, b in rows]
    shares = {"block": sum(b for _, b in held) / len(held)}
    shares["allow"] = 1 - shares["block"]

    def counted(verdict, needs):
        hits = [b == (verdict == "block") for t, b in held if t >= set(needs)]
        return (sum(hits) / len(hits), sum(hits) / len(held)) if hits else (0, 0)

    for (verdict, needs), x in got.items():
        assert x == pytest.approx(counted(verdict, needs))
    every = sorted({t for x, _ in held for t in x})
    for needs in [*combinations(every, 1), *combinations(every, 2)]:
        for verdict, share in shares.items():
            confidence, support = counted(verdict, needs)
            assert ((verdict, needs) in got) == (support >= 0.02 and confidence >= 0.7 and confidence >= 1.2 * share)


def test_mined_rules_decide_on_held_out_urls(spark):
    rnd = random.Random(2)
    learn, held = spark.createDataFrame(labelled_urls(rnd, 1200), "url string, blocked boolean"), labelled_urls(rnd, 600)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)] + [(-1, "http://shop.site.io/ads/" + "x" * 200_000 + "?" + "&".join(f"a{'b' * i}" for i in range(3000)))], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, learn).collect()}
    assert got[-1] == "block"
    right = sum((got[i] == "block") == b for i, (_, b) in enumerate(held)) / len(held)
    assert right > 0.9 > max(sum(b for _, b in held), sum(not b for _, b in held)) / len(held)  # the better constant answer


def test_native_plans(make_docs, corpus):
    import contextlib
    import io

    labelled = make_docs(corpus).selectExpr("concat('http://a.io/', doc_id) AS url", "doc_id % 2 = 0 AS blocked")
    judged = url_rules.judge(labelled.selectExpr("1 AS page_id", "url"), labelled.limit(40))
    for df in (line_dedup.dedup_lines(make_docs(corpus)), quality_rules.features(make_docs(corpus)), judged):
        with contextlib.redirect_stdout(io.StringIO()) as said:
            df.explain()
        assert "Arrow" not in said.getvalue() and "Python" not in said.getvalue()


def test_line_hash(make_docs):
    out = line_dedup.dedup_lines(make_docs([(1, None)])).select(F.sha2(F.col("kept").cast("binary"), 256)).first()[0]
    assert out == hashlib.sha256(b"").hexdigest()
