"""The registered queries against SQL, and against plain versions where SQL has no words."""

import html as html_lib
import re
from collections import Counter, defaultdict

import pytest

import brute
import compare
import corpus_pipeline
import public_tokenizers
from ledgerfold.llm import packing
from ledgerfold.llm.common import table
from ledgerfold.llm.oracle import SQL
from ledgerfold.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.database(FOLDER)


@pytest.fixture(scope="module")
def docs(spark):
    return [(r[0], r[1]) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, db, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), db, SQL[name]) is None


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op3_toxicity"](spark, folder).join(table(spark, folder, "labels"), "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    right = {t: sum(r["predicted"] == t for r in held if r["toxic"] == t) / sum(r["toxic"] == t for r in held) for t in (0, 1)}
    assert right[0] > 0.99 and right[1] > 0.9


def test_packing(spark, docs):
    rows = QUERIES["op5_best_fit_packing"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == {d for d, _ in docs}
    bins = defaultdict(list)
    for r in rows:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append((r["bin_offset"], r["bin_offset"] + r["n_tokens"], r["bin_size"]))
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a[1] == b[0] for a, b in zip(places, places[1:]))
        assert places[-1][2] == min(s for s in packing.SIZES if s >= places[-1][1])
    lengths = [r["n_tokens"] for r in rows if r["n_tokens"]]
    assert len(bins) == len(brute.best_fit(lengths, packing.SIZES, packing.OVERHEAD))


def test_html(spark):
    pages = {r[0]: r[1] for r in table(spark, FOLDER, "pages").select("page_id", "html").collect()}

    def article(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        texts = [" ".join(html_lib.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        return "\n".join(t for t in texts if t)

    rows = QUERIES["op7_html_extraction"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_near_duplicates(spark, docs):
    want, _ = brute.near_classes(docs)
    assert {r["doc_id"]: r["class_id"] for r in QUERIES["op8_near_duplicates"](spark, FOLDER).collect()} == want


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in QUERIES["op9_token_counts"](spark, FOLDER).collect()}
    assert len(rows) == len(docs)
    for doc, text in docs:
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (rows[doc]["n_bytes"], rows[doc]["n_tokens"], rows[doc]["over_limit"]) == (len(text.encode()), n, n > 2048)


def test_substring_dedup(spark):
    folder = "/root/testdata/sf0.01"
    docs = [(r[0], r[1]) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    found = defaultdict(set)
    for r in QUERIES["op10_substring_dedup"](spark, folder).collect():
        assert r["class_doc_id"] < r["doc_id"] or (r["class_doc_id"], r["class_word"]) == (r["doc_id"], r["first_word"])
        found[r["doc_id"]] |= set(range(r["first_word"], r["first_word"] + r["n_words"]))
    want = brute.repeated_words(docs)
    assert want.keys() <= found.keys()
    total, missed = sum(map(len, want.values())), sum(len(w - found[d]) for d, w in want.items())
    assert missed <= 0.01 * total
    # What is found beyond equal runs of fifty words is similar to an earlier text.
    assert len(found.keys() - want.keys()) <= 0.05 * len(want)


def test_pipeline(spark):
    folder, kept = FOLDER, table(spark, FOLDER, "documents")
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    items = [brute.words(r[0]) for r in table(spark, folder, "benchmark").select("text").collect()]
    windows = {tuple(w[i:i + min(10, len(w))]) for w in items for i in range(max(1, len(w) - 9)) if w}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert after.keys() <= before.keys()
        if name == "near duplicates":
            classes, _ = brute.near_classes(list(before.items()))
            assert after == {d: t for d, t in before.items() if classes[d] == d}
        if name == "substring dedup":
            assert not brute.repeated_words(list(after.items()))
        if name == "benchmark decontamination":
            hit = {d for d, t in before.items() if any(tuple(w[i:i + 10]) in windows for w in [brute.words(t)] for i in range(len(w)))}
            assert after == {d: t for d, t in before.items() if d not in hit}
        before = after
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == before.keys()
    assert Counter(n for n, _ in corpus_pipeline.STAGES).most_common(1)[0][1] == 1


