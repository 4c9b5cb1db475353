"""Alignment against the libraries and a plain count of overlaps."""

import hashlib
import random
import sys
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers
from ledgerfold.llm import alignment
from ledgerfold.llm.alignment import EMPTY, Fragment, Vocabularies, compose
from ledgerfold.llm.common import table
from ledgerfold.llm.queries import QUERIES
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
FILES = Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "  x", "a  b", "a \n b", "tab\tand\x00nul", "İstanbul ﬁ ½ ①", "U+2581 ▁ itself", "<s> x </s> <|endoftext|> <0x41>", "don't we'll 's", "你好 世界 " * 40, "x\x1c y \x85 z", "😀 é ", "the the the"]


@pytest.fixture(scope="module")
def coder():
    return alignment.Coder(FILES)


def plain(text):
    """Spans (start, end, id) of both tokenizers over the bytes of a blank and the text, by
    the libraries on the whole text; None without tokens."""
    coder = plain.coder
    if not text:
        return None
    raw, rows = (" " + text).encode(), []
    for ids, table_ in ((coder.a.encode(" " + text, add_special_tokens=False).ids, coder.a_bytes), (coder.b.encode(text), coder.b_bytes)):
        if b"".join(table_[i] for i in ids) != raw:
            return None
        at, spans = 0, []
        for i in ids:
            spans.append((at, at + len(table_[i]), i))
            at += len(table_[i])
        rows.append(spans)
    return rows


def groups_of(a, b):
    cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    rows, low = [], 0
    for cut in cuts:
        rows.append(([i for _, e, i in a if low < e <= cut], [i for _, e, i in b if low < e <= cut]))
        low = cut
    return rows


def expected(docs):
    """doc rows in order, by brute force over all pairs of overlapping spans."""
    seen, counts = [], Counter()
    for _, text in docs:
        both = plain(text)
        links = []
        if both:
            j = 0
            for s, e, i in both[0]:
                while both[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(both[1]) and both[1][k][0] < e:
                    links.append((i, both[1][k][2]))
                    k += 1
        counts.update(links)
        seen.append((both, links))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    rows = []
    for (doc_id, _), (both, links) in zip(docs, seen):
        if not both:
            rows.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups = linear_groups(*both)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((doc_id, len(both[0]), len(both[1]), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return rows


def linear_groups(a, b):
    rows, j, x, y = [], 0, [], []
    for _, e, i in a:
        x.append(i)
        while j < len(b) and b[j][1] <= e:
            y.append(b[j][2])
            j += 1
        if y and b[j - 1][1] == e:
            rows.append((x, y))
            x, y = [], []
    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(rows, want):
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=key) == sorted(want, key=key)


@pytest.fixture(autouse=True)
def libraries(coder):
    plain.coder = coder


def test_query(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    same(QUERIES["op12_cross_tokenizer_alignment"](spark, FOLDER).collect(), expected(docs))


def test_odd_rows(spark):
    noise = random.Random(5)
    long = [" ".join(noise.choice(["word", "Überraschung", "naïve", "x", "12345", "a,b;c", "foo\nbar"]) for _ in range(400)), "y" * 500, "no joint\n" * 60, "wide " + "语言" * 300 + " end of it"]
    docs = list(enumerate(ODD)) + [(None, "alone"), (None, None), (3, None), (50, "twice"), (50, "twice")] + list(enumerate(long, 100)) + [(100, long[0])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").select("*", *[F.lit(c).alias(c) for c in ("a", "b", "k", "block", "tokens", "uid", "n_a")])
    same(alignment.report(frame, FILES, chunk=40).collect(), expected(docs))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.report(none, FILES).collect() == []
    assert alignment.report(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), FILES).count() == 1


def test_groups_of_texts(spark):
    docs = spark.createDataFrame([(1, "the unbelievable thing"), (2, None)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r["groups"] for r in alignment.groups(alignment.encoded(docs, FILES), FILES).collect()}
    assert rows[2] == []
    assert [(list(g["a"]), list(g["b"])) for g in rows[1]] == groups_of(*plain("the unbelievable thing"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "\n", "é", "语", "it's", "  ", "x1", "▁", "\x1c", "😀", "<s>", "-", "Straße", "　"]), max_size=30).map("".join), st.integers(3, 20))
def test_ranges_compose_to_the_whole(text, chunk):
    coder = plain.coder
    whole = plain(text)
    parts = [coder.range_of(w, low, high) for _, low, high, w in alignment.ranges(text, chunk)]
    if whole is None:
        assert not text or None in parts
        return
    done = EMPTY
    for part in parts:
        done = compose(done, part, coder.width)
    assert coder.ids(done.a).tolist() == [i for _, _, i in whole[0]] and coder.ids(done.b).tolist() == [i for _, _, i in whole[1]]
    assert alignment._groups(FILES, done) == groups_of(*whole)


def test_ranges_cut_inside_tokens(coder):
    """The ranges' ends are not the tokenizers': prefixes and suffixes are really open."""
    text = " ".join(["interdisciplinary", "unbelievable"] * 200)
    parts = [coder.range_of(w, low, high) for _, low, high, w in alignment.ranges(text, 333)]
    opened = sum(len(p.a) // coder.width > sum(p.ga) or len(p.b) // coder.width > sum(p.gb) for p in parts[:-1])
    assert len(parts) > 10 and opened > 5


ids = st.lists(st.integers(0, 9), max_size=6)


@st.composite
def fragments(draw):
    a, b = draw(st.integers(0, 8)), draw(st.integers(0, 8))
    ga, gb = [], []
    while sum(ga) < a and sum(gb) < b and draw(st.booleans()):
        ga.append(draw(st.integers(0 if not ga else 1, a - sum(ga))))
        gb.append(draw(st.integers(0 if not gb else 1, b - sum(gb))))
    return Fragment(bytes(2 * a), bytes(2 * b), tuple(ga), tuple(gb))


@given(fragments(), fragments(), fragments())
def test_fragments_are_a_monoid(x, y, z):
    assert compose(compose(x, y, 2), z, 2) == compose(x, compose(y, z, 2), 2)
    assert compose(EMPTY, x, 2) == x == compose(x, EMPTY, 2)


def test_new_pieces_take_few_calls():
    """op12: the work of a piece outside the libraries is done over arrays, not piece by piece."""
    coder, calls = alignment.Coder(FILES), Counter()
    pieces = [f"w{i:x}or" for i in range(4000)]
    sys.setprofile(lambda frame, event, what: calls.update([event]))
    try:
        entries = coder.encode([" ".join(pieces)])[0]
    finally:
        sys.setprofile(None)
    assert len(entries) == 4000 and all(entries)
    assert sum(calls[e] for e in ("call", "c_call")) < 3 * 4000
