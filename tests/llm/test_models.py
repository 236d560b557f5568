"""Toxicity, language identification, decontamination and packing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from boolscope.llm import decontaminate, language_crf, packing, toxicity

EN = "the of and to in is that it was for on with he be at by this had not are but from".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split()


def prose(rnd, stems, n):
    return " ".join(rnd.choice(stems) if rnd.random() < 0.5 else rnd.choice(stems) + rnd.choice(stems) for _ in range(n))


def test_fold():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("ｉｄｉｏｔ")
    assert toxicity.fold("$tup1d") == "stupid" and toxicity.fold("cash$ $") == "cash$ $"
    assert toxicity.fold("i​diot") == "idiot"


def test_toxicity_learns_words_and_exceptions(spark):
    rnd = random.Random(2)
    rows = [(prose(rnd, EN, 60) + (" you idiot " if i % 4 == 0 else " a bad apple ") + prose(rnd, EN, 20), int(i % 4 == 0)) for i in range(400)]
    rows += [(prose(rnd, EN, 60) + " idiot light " + prose(rnd, EN, 10), 0) for _ in range(12)]
    model = toxicity.learn(spark.createDataFrame([*rows, (None, 0), ("x", None)], "text string, toxic int"))
    docs = spark.createDataFrame([(1, prose(rnd, EN, 50) + " you 1d1ot " + prose(rnd, EN, 9)), (2, prose(rnd, EN, 50)), (3, None), (4, ""), (5, "you idiot " + prose(rnd, EN, 3000)), (6, prose(rnd, EN, 30) + " idiot light on"), (None, "you idiot")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == got[2] and got[6] < 0.5 and got[None] > 0.5
    assert all(0 <= x <= 1 for x in got.values())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    model = toxicity.learn(spark.createDataFrame([], "text string, toxic int"))
    got = toxicity.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model).first()
    assert 0 <= got["score"] <= 1


def chains(scores, moves):
    """Marginals of one chain by listing all its labellings."""
    n, k = scores.shape
    total = np.zeros((n, k))
    for code in range(k**n):
        labels = [code // k**i % k for i in range(n)]
        p = np.prod([scores[i, y] for i, y in enumerate(labels)]) * np.prod([moves[a, b] for a, b in zip(labels, labels[1:])])
        total[np.arange(n), labels] += p
    return total / total.sum(1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 3, 3, 1])
    scores, moves = rng.random((4, 5, 3)) + 0.1, rng.random((3, 3)) + 0.1
    got, pairs = language_crf.forward_backward(scores, moves, sizes)
    for i, n in enumerate(sizes):
        assert np.allclose(got[i, :n], chains(scores[i, :n], moves))
    assert np.isclose(pairs.sum(), (sizes - 1).sum())


def test_language_of_mixed_texts(spark):
    rnd = random.Random(4)
    model = language_crf.learn([(prose(rnd, EN, 80), "en") for _ in range(60)] + [(prose(rnd, DE, 80), "de") for _ in range(60)])
    texts = [(1, prose(rnd, EN, 40)), (2, prose(rnd, DE, 40)), (3, None), (4, "123 -- 456 ²Ⅷ"), (5, ""), (6, prose(rnd, EN, 60) + " " + prose(rnd, DE, 20)), (7, prose(rnd, DE, 20000)), (None, prose(rnd, DE, 5))]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_crf.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en", 7: "de", None: "de"}
    assert 0.6 < got[6][1] < 0.95
    empty = language_crf.identify(spark.createDataFrame(texts[:2], "doc_id long, text string"), language_crf.learn([]))
    assert {r["lang_pred"] for r in empty.collect()} == {"und"}


def test_long_texts_in_blocks(spark, monkeypatch):
    """Blocks of one text have the sums of its whole chain; predictions don't depend on how texts are put together."""
    rnd = random.Random(5)
    model = language_crf.learn([(prose(rnd, EN, 60), "en") for _ in range(40)] + [(prose(rnd, DE, 60), "de") for _ in range(40)])
    texts = [prose(rnd, EN, 300) + " 12 -- " + prose(rnd, DE, 200), prose(rnd, DE, 900), "", "1 2 " * 500, prose(rnd, EN, 3)]
    whole = language_crf.predict(texts, model, language_crf.Scores(model))
    cores = [w.strip(language_crf.STRIP) for w in language_crf.words(texts[0]) if language_crf.has_letter(w)]
    scores, moves = model.word_scores(cores)[None], np.exp(model.moves - model.moves.max())
    want = language_crf.forward_backward(scores, moves, np.array([len(cores)]))[0][0].sum(0)
    for cells in (2, 14, 2 * len(cores), 10_000):
        monkeypatch.setattr(language_crf, "CELLS", cells)
        assert np.allclose(language_crf.long_sums(cores, model), want)
    for cells, together in ((40, 100), (700, 1), (2_000, 10_000)):
        monkeypatch.setattr(language_crf, "CELLS", cells)
        monkeypatch.setattr(language_crf, "TOGETHER", together)
        got = language_crf.predict(texts, model, language_crf.Scores(model))
        assert [x[0] for x in got] == [x[0] for x in whole] and np.allclose([x[1] for x in got], [x[1] for x in whole], atol=1e-4)


def test_every_language_is_learned(spark):
    """More languages than the rows of a sample allow many texts of: each has one at least, also beside a very common one."""
    rows = [(i, f"common words {i} here", "zz") for i in range(3000)] + [(i, f"word{i} of{i % 300} lang{i % 300}", f"l{i % 300}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(x[1] for x in language_crf.labelled_sample(docs, rows=602))
    assert len(got) == 301 and sum(got.values()) <= 1.5 * 602
    assert set(Counter(x[1] for x in language_crf.labelled_sample(docs, rows=5)).values()) <= {1, 2, 3, 4, 5} and len(language_crf.labelled_sample(docs, rows=5)) >= 301
    model = language_crf.learn(language_crf.labelled_sample(docs, 3), rounds=4)
    assert len(model.languages) == 301
    assert language_crf.identify(docs.limit(5), model).count() == 5


def test_lcs():
    rnd = random.Random(1)
    for _ in range(50):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(1, 30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.lcs(decontaminate.masks(a), len(a), b) == table[-1, -1]


def test_answers():
    assert decontaminate.answer("What is it? Answer: forty two") == ["forty", "two"]
    assert decontaminate.answer("One two three. Four five six seven.") == ["four", "five", "six", "seven"]


def leaks(spark, rows, items, make_docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(make_docs(rows), bench).collect()}


def test_decontamination(spark, make_docs):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"{rnd.choice(EN)} q{rnd.randrange(3000)}" for _ in range(n // 2))
    items = [(i, text(rnd.randrange(16, 50)).capitalize() + ".") for i in range(30)]
    rows = [(i, text(rnd.randrange(5, 400))) for i in range(150)]
    planted = set()
    for n in range(40):
        item, t = items[n % 30]
        words = [w if rnd.random() > (0.1 if n % 2 else 0) else "other" for w in t.split()]
        rows.append((1000 + n, f"{text(rnd.randrange(0, 200))} {' '.join(words)} {text(rnd.randrange(0, 200))}"))
        planted.add((1000 + n, item))
    rows += [(2000, None), (2001, ""), (None, items[3][1]), (2002, text(20000) + " " + items[4][1])]
    found = leaks(spark, rows, [*items, (99, None), (98, "...")], make_docs)
    planted |= {(None, 3), (2002, 4)}
    assert not {x for x in found if x not in planted}
    assert len(planted & found) >= len(planted) - 2 and {x for x in planted if x[0] and x[0] % 2 == 0} <= found
    docs = make_docs(rows)
    kept = decontaminate.clean(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.dtypes == docs.dtypes and kept.count() == len(rows) - len({d for d, _ in found})


def test_decontamination_within_hot_copies(spark, make_docs):
    """An item in a third of the documents, exact and near copies, and items of common words only are still found."""
    rnd = random.Random(4)
    text = lambda n: " ".join(f"{rnd.choice(EN)} q{rnd.randrange(3000)}" for _ in range(n // 2))
    items = [(0, text(36)), (1, " ".join(rnd.choice(EN) for _ in range(24))), *((i, text(40)) for i in range(2, 12))]
    rows = [(i, text(rnd.randrange(20, 200))) for i in range(300)]
    hot = f"{text(60)} {items[0][1]} {text(60)}"
    rows += [(1000 + i, hot if i % 2 else f"{hot} {text(6)}") for i in range(150)]
    rows += [(2000 + i, f"{text(90)} {items[1][1]} {text(30)}") for i in range(3)]
    rows += [(3000 + i, f"{text(50)} {items[i][1]} {text(50)}") for i in range(2, 12)]
    want = {(1000 + i, 0) for i in range(150)} | {(2000 + i, 1) for i in range(3)} | {(3000 + i, i) for i in range(2, 12)}
    assert leaks(spark, rows, items, make_docs) == want


def test_decontamination_beyond_the_rank(spark, make_docs, monkeypatch):
    """A space with far fewer dimensions than the benchmark has items loses no copy."""
    monkeypatch.setattr(decontaminate, "RANK", 8)
    rnd = random.Random(5)
    text = lambda n: " ".join(f"{rnd.choice(EN)} q{rnd.randrange(3000)}" for _ in range(n // 2))
    items = [(i, text(rnd.randrange(16, 60))) for i in range(200)]
    rows = [(i, text(rnd.randrange(20, 200))) for i in range(100)]
    rows += [(1000 + i, f"{text(rnd.randrange(0, 90))} {t} {text(rnd.randrange(0, 90))}") for i, t in items]
    assert leaks(spark, rows, items, make_docs) == {(1000 + i, i) for i, _ in items}


def test_decontamination_of_nothing(spark, make_docs):
    assert leaks(spark, [(1, "x y z")], [(1, None)], make_docs) == set()
    assert leaks(spark, [], [(1, "some words of an item here")], make_docs) == set()


def test_hilbert_is_a_walk():
    """Along the curve, every cell of a grid comes once, each a step from the last."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing(make_docs, corpus):
    rows = [(i, t) for n, (i, t) in enumerate(corpus) if i is not None and n < 46] + [(300, "Don't <|endoftext|> stop… it's 42's ＡＢ é  x"), (301, "İstanbul ΣΑΣ ß ‘quote’... #tag")]
    pieces = packing.pack(make_docs(rows), bucket_tokens=3000).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        seq[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by) == {i for i, _ in rows}
    for i, t in rows:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for p in sorted(by[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + p["length"]].tobytes()))
            at += p["length"]
        assert at == len(ids)
    for s, got in seq.items():
        ends = [o + n for o, n in sorted(got)]
        assert [o for o, _ in sorted(got)] == [0, *ends[:-1]] and (ends[-1] == 4096 or s == max(seq))
    assert packing.pack(make_docs([])).count() == 0


def test_packing_rows_with_one_id(make_docs):
    got = Counter((r["doc_id"], r["length"]) for r in packing.pack(make_docs([(1, "a b"), (1, "a b"), (None, None)])).collect())
    assert got == Counter({(1, 3): 2, (None, 1): 1})


def test_packing_ids_of_all_white_space_and_control_characters():
    tokenizer, known = Tokenizer.from_file(packing.tokenizer_path()), packing.known_words(packing.tokenizer_path(), packing.DIMS)
    odd = [chr(c) for c in range(0x3001) if chr(c).isspace() or not chr(c).isprintable()]
    texts = [f"a{c}b{c} {c}Xy.{c}{c}z" for c in odd] + ["".join(odd), "a" + "b".join(odd), "it's\x1cgone\x1d 12 \x1e"]
    rows = [known.rows(w, len(w)) for w in map(packing.split, texts)]
    known.learn()
    assert [known.table.tokens(r).tolist() for r in rows] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("most", [7, 100_000])
def test_packing_buckets_are_even(make_docs, monkeypatch, most):
    """A third of the rows are copies, which share a place on the curve: they are dealt to many buckets all the same."""
    monkeypatch.setattr(packing, "MAX_BUCKETS", most)
    rows = [(i, "one text that is found many times" if i % 3 == 0 else f"text {i} of {i * 7919 % 1013} words {i * 31 % 97}") for i in range(900)]
    pieces = packing.pack(make_docs(rows), bucket_tokens=400)
    sizes = [len(x) for x in pieces.rdd.glom().collect()]
    assert len(sizes) == (7 if most == 7 else pieces.agg({"length": "sum"}).first()[0] // 400 + 1)
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    got = sorted((r["sequence_id"] * packing.LENGTH + r["offset"], r["length"]) for r in pieces.collect())
    assert [a for a, _ in got] == [sum(n for _, n in got[:i]) for i in range(len(got))]


def test_more_benchmark_words_than_two_bytes_hold(spark, make_docs):
    """Every word keeps a number of its own."""
    items = [(i, " ".join(f"q{i}x{j}" for j in range(700))) for i in range(100)]
    bench = decontaminate.Benchmark(items)
    assert len(set(bench.number.values())) == bench.size - 1 == 70_000
    words = decontaminate._numbers(bench.number)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "th": [1, 2], "text": [items[99][1], items[0][1] + " other"]})
    flat, starts = decontaminate._read(next(words(iter([batch])))["words"], bench.size)
    assert flat.tolist() == [*range(69_301, 70_001), *range(1, 701), 0] and starts.tolist() == [0, 700, 1401]


def test_learning_samples_are_bounded(spark, make_docs):
    """Copies of a text are one row, repeated ids are one document, and every language is learned from."""
    docs = spark.createDataFrame([(1, "copied text", "en")] * 50 + [(i, f"text {i}", "en") for i in range(30)] + [(7, "x" * 500, "de"), (8, "y" * 900, "de")], "doc_id long, text string, lang string")
    got = language_crf.labelled_sample(docs, 400, 100)
    assert Counter(x[1] for x in got) == {"en": len([x for x in got if x[1] == "en"]), "de": 1} and len(set(got)) == len(got)
    assert sum(len(t) for t, lang in got if lang == "en") <= 100 and ("x" * 500, "de") in got
    assert len(language_crf.labelled_sample(docs, 400)) == 33
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    repeated = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (3, "d"), (None, "e")], "doc_id long, text string")
    assert sorted(map(tuple, toxicity.labelled_sample(repeated, labels, "toxic").collect())) == [("a", 1), ("c", 0)]


def test_lexicon_matches_as_a_naive_scan_does():
    rnd = random.Random(5)
    letters = "abci "
    terms = {"".join(rnd.choice("abci") for _ in range(rnd.randrange(1, 5))) + rnd.choice(["", " "]): rnd.random() for _ in range(40)}
    lexicon = toxicity.Lexicon(terms, set())
    for _ in range(200):
        text = "".join(rnd.choice(letters) for _ in range(60))
        want = {}
        for m in re.finditer(r"[a-z]+", text):
            found = [w for t, w in terms.items() if (m[0] == t[:-1] if t.endswith(" ") else m[0].startswith(t))]
            if found:
                want[m.start()] = max(found)
        assert lexicon.matches(text) == want
