"""Piece encoding held against the sentencepiece library: ids, spans of bytes, decoded texts, other normalisers."""

import hashlib
import random
from itertools import pairwise

import numpy as np
import pytest
import sentencepiece

from boolscope.llm import piece_encoding
from boolscope.llm.piece_model import PieceModel, fields

ODD = ["", " ", "   ", "\n", "a", " a ", "a  b   c", "▁", "a▁b", "<s>", "</s> <unk>", "<0x0A>", "é́", "漢字仮名", "🎉👩‍👩‍👧", "\x00\x01\x1f", " x　y z", "ﬁ Å Ａ", "x" * 5000, "ab " * 4000, "1234567890" * 50]


@pytest.fixture(scope="module")
def model_file():
    with open(piece_encoding.model_path(), "rb") as f:
        return f.read()


def texts():
    rnd = random.Random(3)
    signs = "ab c  \n\té▁ñ<s></s>漢字🎉̀​\x00\x1f'’1234　 ﬁÅＡ"
    some = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(400)]
    return ODD + some + ["".join(chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(200)]


def own(model, text):
    normal, place = model.normalise(text)
    ids, sizes = [], []
    for word in model.words.findall(normal.decode()):
        i, s = model.encode(word)
        ids, sizes = ids + i, sizes + (model.sizes[i].tolist() if s is None else s)
    ends = np.cumsum([0, *sizes]).astype(int)
    return ids, [(int(place[b - s]), int(place[b])) for s, b in zip(sizes, ends[1:])]


def same_as_library(data, some):
    model, library = PieceModel(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in some:
        ids, spans = own(model, text.encode())
        pieces = library.encode(text, return_type="proto").pieces
        assert (ids, spans) == ([p.id for p in pieces], [(p.begin, p.end) for p in pieces]), repr(text[:50])


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def with_normaliser(data, **spec):
    """The model with another normaliser: map, prefix, squeeze, escape."""
    kept = b"".join(field(n, v) for n, v in fields(data) if n != 3)
    return kept + field(3, field(1, b"own") + field(2, spec.get("map", b"")) + field(3, spec.get("prefix", 1)) + field(4, spec.get("squeeze", 0)) + field(5, spec.get("escape", 1)))


def compiled(pairs):
    """A compiled character map: a double-array trie whose nodes find room first-fit, and the replacements."""
    tree, values, texts_ = {}, {}, b""
    for key, value in pairs.items():
        node = tree
        for b in key.encode():
            node = node.setdefault(b, {})
        values[id(node)] = len(texts_)
        texts_ += value.encode() + b"\0"
    size = 1 << 16
    used, units, bases = [False] * size, [0] * size, set()  # a label is checked, not a parent: bases must differ
    used[0] = True

    def place(node, at):
        leaf = id(node) in values
        labels = sorted(node) + [0] * leaf
        base = next(b for b in range(256 if at else 1, size, 1) if b not in bases and all(not used[b ^ x] for x in labels) and b ^ at < 1 << 21)
        bases.add(base)
        units[at] |= (base ^ at) << 10 | leaf << 8
        for x in labels:
            used[base ^ x] = True
        if leaf:
            units[base] = 1 << 31 | values[id(node)]
        for x in sorted(node):
            units[base ^ x] |= x
            place(node[x], base ^ x)

    place(tree, 0)
    trie = np.array(units, "<u4").tobytes()
    return len(trie).to_bytes(4, "little") + trie + texts_


def test_ids_and_spans_equal_the_library(model_file):
    same_as_library(model_file, texts())


@pytest.mark.parametrize("spec", [{"squeeze": 1}, {"prefix": 0}, {"squeeze": 1, "prefix": 0}])
def test_white_space_rules_equal_the_library(model_file, spec):
    same_as_library(with_normaliser(model_file, **spec), texts())


def test_a_compiled_map_replaces_longest_prefixes(model_file):
    pairs = {"ﬁ": "fi", "Å": "A", "Ａ": "a", "　": " ", "\t": " ", "\n": " ", "​": "", "ab": "x", "abc": "yy", "é": "é", "漢": "kan ", " ": "  "}
    blob = compiled(pairs)
    some = [*texts(), "ab abc abcd", "a ab", "abab", "xﬁabcé́é", "漢漢", "​​", "  　a​", "　ab"]
    for squeeze in (0, 1):
        same_as_library(with_normaliser(model_file, map=blob, squeeze=squeeze), some)


def test_bytes_that_are_no_utf8_count_as_replacement_signs(model_file):
    model, library = PieceModel(model_file), sentencepiece.SentencePieceProcessor(model_proto=model_file)
    for raw in (b"\xff", b"a\xc3", b"\xe6\xbc a", b"ok \xf0\x9f\x8e end", b"\xc3\xa9\xa9"):
        sign = "".join("�" if other else raw[s:e].decode() for s, e, other in piece_encoding_parts(raw))
        ids, spans = own(model, raw)
        assert ids == library.encode(sign)
        assert all(a[1] == b[0] for a, b in pairwise(spans)) and spans[-1][1] == len(raw)


def piece_encoding_parts(raw):
    from boolscope.llm.piece_model import whole

    return list(whole(raw))


def test_both_ways_to_merge_agree(model_file):
    model = PieceModel(model_file)
    for text in texts():
        for word in model.words.findall(model.normalise(text.encode())[0].decode()):
            assert model._merged_long(word) == model.merged(word)


def test_other_kinds_of_models_raise(model_file):
    with pytest.raises(ValueError, match="user-defined"):
        PieceModel(model_file + field(1, field(1, b"own") + field(3, 4)))
    with pytest.raises(ValueError, match="BPE"):
        PieceModel(model_file + field(2, field(3, 1)))


def test_operator_on_odd_rows(spark, make_docs, corpus, model_file):
    library = sentencepiece.SentencePieceProcessor(model_proto=model_file)
    rows = corpus + [(200 + i, t) for i, t in enumerate(ODD)] + [(300, "word " * 120_000), (301, "漢" * 50_000)]
    got = sorted(((r["doc_id"], r["ids"], r["begins"], r["ends"], r["decoded"]) for r in piece_encoding.encode(make_docs(rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        pieces = library.encode(t or "", return_type="proto").pieces
        ids = [p.id for p in pieces]
        want.append((i, ids, [p.begin for p in pieces], [p.end for p in pieces], library.decode(ids) if ids else ""))
    assert got == sorted(want, key=repr)
    assert piece_encoding.encode(make_docs([])).collect() == []


def test_words_are_forgotten_beyond_a_bound(model_file, monkeypatch):
    monkeypatch.setattr(piece_encoding, "KEPT_WORDS", 5)
    known = piece_encoding._Words(PieceModel(model_file))
    for words in (["▁a", "▁b", "▁a"], ["▁c", "▁dd", "▁e", "▁f"], ["▁a", "▁c"]):
        assert known.encoded(words)[0].tolist() == [i for w in words for i in known.model.encode(w)[0]]
        assert len(known.numbers) <= 5 + len(set(words))


def test_query_equals_the_library_on_a_table(spark, model_file):
    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_proto=model_file)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)), len((r["text"] or "").encode()))
    assert {r[0]: tuple(r)[1:] for r in piece_encoding.query(spark, sf).collect()} == want
