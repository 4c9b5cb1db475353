"""Nulls, empty and very long texts, ties and repeated rows, empty tables, odd columns."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
import public_tokenizers
from ledgerfold import session
from ledgerfold.llm import common, decontam, html, licenses, neardup, packing, substring, tokens, topk, toxicity, urls
from ledgerfold.llm.common import components
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD = [(None, "alone"), (None, None), (1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two"), (5, "One, two"), (6, LONG), (7, LONG + " end"), (8, "ß É x \U0001F600")]


def frame(spark, rows, shape=DOCS):
    return spark.createDataFrame(rows, shape)


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names operators use inside."""
    names = ["key", "maybe", "row", "id", "w", "h", "n", "items", "spans", "node", "score", "gone"]
    return frame(spark, ODD).select("*", *[F.lit(n).alias(n) for n in names])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def items(spark):
    return frame(spark, [(1, "one two"), (2, PASSAGE), (None, "alone"), (4, None), (5, ""), (6, "ONE two")], "item_id bigint, text string")


def test_top_k(spark):
    shape = "vec_id bigint, embedding array<float>, c string"
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (50, [0.5, -1.0]), (3, [2.0, 0.1]), (3, [2.0, 0.1]), (51, [1.0, 0.0])]
    bad = [(100, None), (4, []), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    vectors = frame(spark, [(i, v, "x") for i, v in good + bad], shape)
    found = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 3, 131072), (0, 2, 1, 65536), (50, 1, 3, 59136), (50, 2, 0, 32768)]
    few = topk.top_k(vectors.where("vec_id in (0, 3)"), F.col("vec_id") == 0, 5).collect()
    assert [tuple(r) for r in few] == [(0, 1, 3, 131072)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_of_many_copies(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i % 7), 1.0]) for i in range(50)]
    vectors = frame(spark, rows, "vec_id bigint, embedding array<float>")
    found = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    scaled = {i: [int(256 * x) for x in v] for i, v in rows}
    for q in [i for i in scaled if i % 50 == 0]:
        ranked = sorted((-sum(a * b for a, b in zip(scaled[q], v)), i) for i, v in scaled.items() if i != q)[:5]
        assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(ranked)]


def test_decontamination(spark, odd, none, items):
    rows = decontam.report(odd, items).collect()
    assert len(rows) == len(ODD)
    found = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["contaminated"]) for r in rows}
    assert found[(4, 2)] == (2, 2, True) and found[(5, 2)] == (2, 2, True) and found[(1, 0)] == (0, 0, False)
    assert found[(None, 1)] == (0, 0, False)
    kept = decontam.clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert decontam.report(none, items).count() == 0 and decontam.clean(odd, items.limit(0)).count() == len(ODD)
    inside = frame(spark, [(1, f"Before, {PASSAGE}! After.")])
    assert decontam.without_spans(inside, items).first()["text"].split() == ["Before,", "!", "After."]
    assert decontam.report(inside, items).first()["n_hit"] == 60


def test_decontamination_in_parts(spark, items, monkeypatch):
    docs = frame(spark, [(1, PASSAGE), (2, "one two three")])
    whole = sorted(decontam.report(docs, items).collect())
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 7)
    assert sorted(decontam.report(docs, items).collect()) == whole


def test_toxicity(spark, odd, none):
    labels = frame(spark, [(1, 1), (2, None), (None, 1), (4, 0), (4, 1), (99, 0)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.without_toxic(odd, labels).columns == odd.columns
    assert toxicity.toxicity(none, labels).count() == 0 and toxicity.toxicity(odd, labels.limit(0)).count() == len(ODD)


def test_toxicity_learns(spark):
    docs = [(i, f"plain text number{i} with words" + (f" you {w} go away" if i % 4 == 0 else " you friend go on")) for i in range(400) for w in [["stupid", "worthless", "pathetic"][i % 3]]]
    labels = frame(spark, [(i, int(i % 4 == 0)) for i, _ in docs], "doc_id bigint, toxic int")
    model = toxicity.learn(frame(spark, docs), labels)
    lexicon = model.lexicon
    assert lexicon.match("worthles")[0] == 1 and lexicon.match("w0rthlesss")[0] == 2 and lexicon.match("stuupid")[0] == 1
    assert lexicon.match("friend") is None and lexicon.match("stud") is None
    direct, misspelt, quoted, calm = model.scores(["you stupid thing", "you stuppid thing", 'they wrote the word "stupid" on it', "you nice thing"])
    assert direct > 0.5 and direct >= misspelt > calm and quoted < direct and calm < 0.5


def test_automaton_is_exact():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    import itertools

    terms = ("aba", "abcab", "bbbab", "cabacabab")
    lexicon = toxicity.Lexicon(terms, ())
    for n in range(1, 7):
        for word in map("".join, itertools.product("abc", repeat=n)):
            best = min(((d, t) for t in terms for d in [distance(word, t)] if d <= toxicity.edits(t)), default=None)
            assert lexicon.match(word) == best


def test_licenses(spark, odd, none):
    text = "Copyright me. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nALL RIGHTS reserved."
    docs = frame(spark, [(1, text), (2, "Released under the MIT license.\nLicensed under CC BY-NC 4.0."), (3, "Not licensed under CC BY-NC 4.0.")])
    found = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in licenses.scan(docs).collect()}
    assert found == {1: (3, "LicenseRef-all-rights-reserved,MIT"), 2: (2, "CC-BY-NC-4.0,MIT"), 3: (0, "")}
    assert licenses.matched(["bsd-grant", "bsd-source", "bsd-binary", "bsd-grant"]) == ["BSD-2-Clause"]
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_licenses(mark):
    import textwrap

    for licence, rule in licenses.RULES:
        for width in (70, 80):
            lines = [line for name in rule for line in textwrap.wrap(f"Copyright me. {licenses.SENTENCES[name][-1]}", width)]
            assert licenses.matched(licenses.sentence_ids("\r\n".join(mark + line for line in lines))) == [licence]
    assert licenses.sentence_ids('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.') == ["apache2-notice", "apache2-compliance"]
    assert licenses.sentence_ids("All rights\n\nreserved.") == []


def test_license_behind_a_rule():
    assert licenses.sentence_ids("*" * 80 + " All rights reserved.") == ["reserved"]


def test_packing(spark):
    rows = [(1, 100), (1, 100), (None, 3), (2, 0), (3, None), (4, 25), (5, 7)]
    packed = packing.pack(frame(spark, rows, "doc_id bigint, n_tokens bigint"), (16, 32), 4).collect()
    assert sum(r["n_tokens"] for r in packed) == 235
    assert {r["doc_id"] for r in packed if r["bin_id"] is None} == {2, 3}
    used = {}
    for r in packed:
        if r["bin_id"] is not None:
            used.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"], r["bin_size"]))
    for places in used.values():
        places.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:]))
        assert places[-1][2] == min(s for s in (16, 32) if s >= places[-1][0] + places[-1][1])
    assert packing.pack(frame(spark, [], "doc_id bigint, n_tokens bigint")).count() == 0


def test_packing_plan():
    import random
    from collections import Counter

    for seed in range(20):
        rng = random.Random(seed)
        lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 20), 7]) for _ in range(rng.randint(1, 300))]
        plan = packing.planned(Counter(lengths), (32, 64, 100), 5)
        assert int(plan.bins[:, 0].max()) < len(brute.best_fit(lengths, (32, 64, 100), 5))
        assert len(plan.places) <= 4 * 100


def test_packing_of_one_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RUN", 10)
    rows = packing.pack(frame(spark, [(i, 5) for i in range(333)], "doc_id bigint, n_tokens bigint"), (16,), 0).collect()
    assert len({(r["bin_id"], r["bin_offset"]) for r in rows}) == 333 and len({r["bin_id"] for r in rows}) == 111


def test_urls(spark):
    shape = "page_id bigint, url string, key string, host string"
    rows = [(1, None), (2, "no scheme"), (3, "http://A.NET"), (3, "http://A.NET/x"), (4, "ftp://x.example.net/en/1?q#f"), (5, "http://bad.org/p/#x"), (5, "http://bad.org/p/#x"), (None, "http://bad.org/p"), (6, "http://good.org/p"), (7, "http://")]
    pages = frame(spark, [(*r, "k", "h") for r in rows], shape)
    rules = (("block", "net/"), ("allow", "example.net/en/"))
    listed = frame(spark, [("https://BAD.org/p/",), (None,), ("https://bad.org/p",)], "url string")
    found = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules, listed).collect()]
    assert len(found) == len(rows)
    assert (1, "", "", None, "allow") in found and (3, "a.net", "", None, "allow") in found and (3, "a.net", "/x", "net/", "block") in found
    assert (4, "x.example.net", "/en/1", "example.net/en/", "allow") in found and found.count((5, "bad.org", "/p/", None, "block")) == 2
    assert (None, "bad.org", "/p", None, "block") in found and (6, "good.org", "/p", None, "allow") in found
    assert urls.judge(pages.limit(0), rules, listed).count() == 0 and urls.judge(pages, (), listed.limit(0)).where("verdict = 'block'").count() == 0


def test_html(spark):
    shape = "page_id bigint, url string, html string, wrapper string"
    page = "<html><body><div class=menu>Home</div><main><p>One &amp; <b>two</b>\n three<p>Four<table><tr><td>5<td>6</table></main><div id='comments-12'><p>me too</div>{}</body>"
    rows = [(1, "http://a/1", page.format("")), (1, "http://a/1", page.format("")), (2, "http://a/2", page.format("<footer>x</footer>")), (3, None, None), (4, "http://a/3", ""), (None, "x", "plain < text"), (5, "http://b/", "<p>" + "long " * 50_000)]
    found = html.extracted(frame(spark, [(*r, "w") for r in rows], shape)).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows) and texts[1] == texts[2] == "One & two three\nFour\n5\n6"
    assert texts[3] == texts[4] == "" and texts[None] == "plain < text" and len(texts[5]) == 249_999
    assert html.extracted(frame(spark, [], shape)).count() == 0


def wrapper_of(*pages):
    return html._merged(html.page_wrapper(html.blocks(p)) for p in pages)


def test_wrapper_groups():
    merged = wrapper_of("<ul><li>Home</ul><p>a<p>End", "<ul><li>Home</ul><h2>x</h2><p>b<p>c<p>End", "<ul><li>Home</ul><p>d<p>End")
    assert [html.path_of(f) for f in merged.fixed] == ["ul/li", "p"] and merged.pages == 3
    assert merged.groups == [[], [html.Slot("p", True, False), html.Slot("h2", False, True)], []]
    assert html._read(html._text(merged)) == merged
    copies = wrapper_of("<p>a<p>b", "<p>a<p>b", "<p>a<p>b")
    assert copies.pages == 1 and len(copies.fixed) == 2
    assert html.slots_of(html.blocks("<ul><li>Home</ul><p>new<p>End"), merged) == [("p", "new")]
    assert html.slots_of(html.blocks("<p>new<p>End"), merged) is None and html.slots_of(html.blocks("<ul><li>Home</ul><h5>q</h5><p>End"), merged) is None


@pytest.mark.parametrize("seed", range(5))
def test_common_run_is_longest(seed):
    rng = random.Random(seed)
    left, right = ([str(x) for x in rng.sample(range(30), 20)] for _ in range(2))
    longest = [[0] * 21 for _ in range(21)]
    for i in range(20):
        for j in range(20):
            longest[i + 1][j + 1] = longest[i][j] + 1 if left[i] == right[j] else max(longest[i][j + 1], longest[i + 1][j])
    run = html.common(left, right)
    assert len(run) == longest[20][20] and all(left[a] == right[b] for a, b in run)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(run, run[1:]))


def test_pages_without_marks(spark, monkeypatch):
    """Fixed texts are told by the wrapper alone; marked articles keep a sentence that all share."""
    shape = "page_id bigint, url string, html string"
    plain = [(n, f"http://plain/{n}", f"<p>Home</p><p>Story {n}</p>{'<p>More ' + str(n) + '</p>' if n % 2 else ''}<p>Copyright Foo</p>") for n in range(6)]
    divs = [(10 + n, f"http://divs/{n}", f"<div><div>Top</div><div>Text {n}<br>and on</div><div>Same</div><div>Tail {n}</div></div>") for n in range(4)]
    marked = [(20 + n, f"http://plain/m{n}", f"<p>Home</p><article><p>All share this.</p><p>Story {n}</p></article>") for n in range(4)]
    two = [(30 + n, f"http://two/{n}", f"<p>Once upon a time</p><p>Story {n}</p>") for n in range(2)]
    copies = [(40 + n, f"http://copies/{n}", "<p>Home</p><p>A story</p>") for n in range(5)]
    rows = frame(spark, plain + divs + marked + two + copies, shape).repartition(5)
    texts = {r["page_id"]: r["text"] for r in html.extracted(rows).collect()}
    assert [texts[n] for n in range(6)] == [f"Story {n}\nMore {n}" if n % 2 else f"Story {n}" for n in range(6)]
    assert [texts[10 + n] for n in range(4)] == [f"Text {n} and on\nTail {n}" for n in range(4)]
    assert [texts[20 + n] for n in range(4)] == [f"All share this.\nStory {n}" for n in range(4)]
    assert [texts[30 + n] for n in range(2)] == [f"Once upon a time\nStory {n}" for n in range(2)]
    assert {texts[40 + n] for n in range(5)} == {"Home\nA story"}
    with monkeypatch.context() as patch:  # joined by template, not sent
        patch.setattr(html, "BROADCAST_BYTES", -1)
        assert {r["page_id"]: r["text"] for r in html.extracted(rows).collect()} == texts
    monkeypatch.setattr(html, "wrappers", lambda pages: frame(spark, [], "host string, template string, wrapper string"))
    without = {r["page_id"]: r["text"] for r in html.extracted(rows).collect()}
    assert {n for n in texts if texts[n] != without[n]} == {*range(6), *range(10, 14)}


def test_wrapper_of_many_different_pages_stays_small():
    """Ten thousand pages of one host, each with names of its own: bounded and linear."""
    page = "<body><div><p>Home</p>{}<p>End</p></div></body>"
    merged, largest = None, 0
    for n in range(10_000):
        own = html.page_wrapper(html.blocks(page.format("".join(f"<div class=x{chr(97 + (n * 7 + k) % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)}><p>{n} {k}</div>" for k in range(20)))))
        merged = own if merged is None else html.aligned(merged, own)
        largest = max(largest, len(html._text(merged)))
    assert largest < 20_000 and merged.pages == 10_000
    assert [html.path_of(f) for f in merged.fixed] == ["body/div/p", "body/div/p"] and merged.groups == [[], None, []]


def test_near_duplicates(spark, odd, none):
    found = [(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(odd).collect()]
    assert len(found) == len(ODD)
    classes = dict(found)
    assert classes[5] == 4 and classes[7] == 6 and classes[None] is None
    assert all(classes[d] == d for d in (1, 2, 3, 4, 6, 8))
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8]
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies that are each similar to one text, and less so to each other."""
    import random

    rng = random.Random(1)
    first = [f"w{i}" for i in range(200)]
    docs = [(10, " ".join(first))]
    for i in range(300):
        copy = [*first]
        for at in rng.sample(range(200), 4):
            copy[at] = f"x{i}y{at}"
        docs.append((11 + i, " ".join(copy)))
    docs += [(1000 + i, " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(100))) for i in range(50)]
    want, _ = brute.near_classes(docs)
    assert len(set(want.values())) < 100
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, docs)).collect()}
    assert found == want


def test_near_duplicates_apart_from_the_hub(spark, monkeypatch):
    """Pairs that are similar to each other, in buckets with many that neither is similar to,
    which no finer bucket brings together."""
    import random

    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "DEPTHS", ())
    rng = random.Random(2)
    common, docs = [f"w{i}" for i in range(176)], []
    for i in range(100):
        own = [f"p{i}y{j}" for j in range(24)]
        for number in (2 * i, 2 * i + 1):
            text = common + own
            text[rng.randrange(180, 195)] = f"q{number}"
            text[rng.randrange(5, 170)] = f"r{number}"
            docs.append((number, " ".join(text)))
    want, _ = brute.near_classes(docs)
    assert sum(want[2 * i + 1] == 2 * i for i in range(100)) > 80
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(frame(spark, docs)).collect()}
    assert found == want


def test_remaining_pairs_of_a_large_bucket(spark):
    """Edits of one text that are near but not links of each other hardly meet, and the pairs
    that are links, some of them far from the hub, all do."""
    import itertools
    import random

    rng = random.Random(3)
    base = list(range(200))
    sets = {0: {*base}}
    for i in range(1, 301):
        gone = set(rng.sample(base, 24))
        sets[i] = {*base} - gone | {1000 * i + j for j in range(rng.randint(20, 28))}
    for i in range(1, 301, 10):  # neighbours at both sides of 0.8, and larger or smaller ones
        other = sorted(sets[i])
        rng.shuffle(other)
        sets[1000 + i] = {*other[: len(other) - rng.randint(0, 40)]} | {10**6 * i + j for j in range(rng.randint(0, 30))}
    similarity = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for hub in (0, 1, 1001):
        large = frame(spark, [(1, n, hub) for n in sets], "bucket bigint, node bigint, hub bigint")
        alone = frame(spark, [], "node bigint, root bigint")
        met = neardup.remaining(large, alone, frame(spark, [(n, sorted(s)) for n, s in sets.items()], "node bigint, s array<bigint>"))
        met = {tuple(sorted(r, reverse=True)) for r in met.collect()}
        linked = {n for n in sets if similarity(n, hub) >= 0.8}
        links = {(b, a) for a, b in itertools.combinations(sorted(sets), 2) if similarity(a, b) >= 0.8 and not {a, b} & {hub}}
        assert {(b, a) for b, a in links if not {a, b} <= linked} <= met
        assert len(met) < 0.02 * len(sets) ** 2 / 2


def test_substring_functions_run_once(spark, monkeypatch):
    """No written table evaluates a Python function twice for a row."""
    plans = []

    def stored(rows, label):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return session.stored(rows, label)

    monkeypatch.setattr(substring, "stored", stored)
    monkeypatch.setattr(substring, "SMALL", 2)
    words = [f"w{i}" for i in range(120)]
    docs = frame(spark, [(i, " ".join([f"a{i}", *words[i % 7:], f"b{i}"])) for i in range(40)])
    kept = substring.without_repeats(docs)
    assert kept.count() == 40
    plans.append(kept._jdf.queryExecution().executedPlan().toString())
    used = [[line.split("ArrowEvalPython")[1].split("]")[0].split("#")[0] for line in p.splitlines() if "ArrowEvalPython" in line] for p in plans]
    assert sum(map(len, used)) >= 5
    assert all(len(names) <= 1 for names in used)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20), *[(100, 100 + i) for i in range(1, 50)], *[(200 + i, 201 + i) for i in range(40)]]
    union = brute.Union()
    for a, b in links:
        union.join(a, b)
    found = {r[0]: r[1] for r in components(frame(spark, links, "a bigint, b bigint"), "test").collect()}
    assert found == {x: union.root(x) for link in links for x in link if x != 20}
    assert components(frame(spark, [], "a bigint, b bigint"), "test").count() == 0


def test_token_counts(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    own = tokens.Tokenizer(public_tokenizers.path("word_bpe_49k.json"), by_space=True)
    library = Tokenizer.from_file(own.path)
    odd_texts = [(20, "a <|endoftext|> b<|startoftext|>c"), (21, "it's 'll  tabs\tand\r\nlines"), (22, "ΑΣ. ΑΣ, Ω"), (23, "é ́x y z")]
    docs = odd.select("doc_id", "text", "id").union(frame(spark, odd_texts).withColumn("id", F.lit("")))
    cache = str(tmp_path / "cache")
    rows = tokens.cached_counts(docs, own, cache).collect()
    texts = [t or "" for _, t in ODD + odd_texts]
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == sorted((len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t for t in texts})
    assert len(tokens.cached_counts(docs, own, cache).collect()) == len(rows) and spark.read.parquet(cache).count() == stored
    assert tokens.cached_counts(none, own).count() == 0
    pieces = tokens.Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.path)
    assert tokens.count_texts(texts[:6], pieces) == [len(model.encode(t)) for t in texts[:6]]


def test_substring(spark, odd, none):
    found = substring.repeats(odd).collect()
    assert [tuple(r) for r in found] == [(7, 0, 60_000, 6, 0)]
    assert substring.repeats(none).count() == 0
    kept = {r["doc_id"]: r["text"] for r in substring.without_repeats(odd).collect()}
    assert kept[7] == "end" and kept[6] == LONG and len(kept) == 9
    assert substring.without_repeats(odd).columns == odd.columns


def test_substring_in_the_middle_of_lines(spark):
    edited = PASSAGE.split()
    edited[30] = "other"
    filler = lambda d, n: " ".join(f"{'f' if d > 0 else 'g'}{abs(d)}x{i}" for i in range(n))
    docs = [(d, f"{filler(d, 20 + d)} {p} {filler(-d, 30)}.") for d, p in [(1, PASSAGE), (2, PASSAGE.upper()), (3, " ".join(PASSAGE.split()[:49])), (4, " ".join(edited)), (5, " ".join(PASSAGE.split()[5:56]))]]
    found = {r["doc_id"]: (r["first_word"], r["n_words"], r["class_doc_id"]) for r in substring.repeats(frame(spark, docs)).collect()}
    assert found == {2: (22, 60, 1), 4: (24, 60, 1), 5: (25, 51, 1)}
    cut = {r["doc_id"]: r["text"] for r in substring.without_repeats(frame(spark, docs)).collect()}
    assert cut[2] == f"{filler(2, 22)} {filler(-2, 30)}." and cut[1] == docs[0][1]


def test_substring_that_the_earliest_text_holds_in_part(spark):
    """Text 0 has 49 words of a passage, one too few; of the others only the first keeps it."""
    words = PASSAGE.split()[:55]
    docs = [(100 * p + d, " ".join([f"a{p}y{d}x{i}" for i in range(20)] + [f"p{p}{w}" for w in (words[:49] if d == 0 else words)] + [f"b{p}y{d}x{i}" for i in range(20)])) for p in range(12) for d in range(30)]
    found = {r["doc_id"]: (r["first_word"], r["n_words"], r["class_doc_id"]) for r in substring.repeats(frame(spark, docs)).collect()}
    assert found == {100 * p + d: (20, 55, 100 * p + 1) for p in range(12) for d in range(2, 30)}


@pytest.mark.parametrize("n", [8, 60])
def test_substring_round_a_phrase_of_many_texts(spark, n):
    """A phrase that n texts hold alone, and two of them within a passage of 52 words."""
    own = lambda d, k: [f"{k}{d}x{i}" for i in range(60)]
    words = PASSAGE.split()[:52]
    for at in range(30):
        docs = [(d, " ".join(own(1000 * at + d, "a") + (words if d in (n // 2, n - 2) else words[3:48]) + own(1000 * at + d, "b"))) for d in range(n)]
        docs = [(1000 * at + d, t.replace("passage", f"p{at}y")) for d, t in docs]
        every = docs if at == 0 else every + docs
    found = {r["doc_id"]: (r["first_word"], r["n_words"], r["class_doc_id"]) for r in substring.repeats(frame(spark, every)).collect()}
    assert found == {1000 * at + n - 2: (60, 52, 1000 * at + n // 2) for at in range(30)}


def test_token_counts_of_any_text():
    """Against the library, over letters that change their kind in lower case, marks and
    white space of all sorts."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, noise = Tokenizer.from_file(path), tokens.Tokenizer(path, by_space=True), random.Random(7)
    parts = ["İ", "I", "ı", "Σ", "ß", "é", "e\u0301", "ǅ", "ﬁ", "K", "x", "the", "Word", "12", "½", "'s", "'", "-", ".", "@", "!!", "_", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "语", "😀", "<|endoftext|>"]
    texts = ["".join(noise.choice(parts) for _ in range(noise.randint(0, 8))) for _ in range(20_000)] + ["İ-", "İ. @l", "İİ!"]
    for start in range(0, len(texts), 256):
        some = texts[start:start + 256]
        assert tokens.count_texts(some, own) == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_a_passage_ahead_of_a_reworded_continuation():
    """A chain of edits is cut where it is too different, not given up."""
    rng = np.random.default_rng(1)
    new = lambda n: rng.integers(0, 1 << 30, n).astype(np.int32)
    passage = new(400)
    later = passage.copy()
    later[30] = 1
    later[60::8] = new(len(later[60::8]))  # one word of eight is another
    a, b = np.concatenate([new(30), passage, new(30)]), np.concatenate([new(50), later])
    for seeds in ([0], [0, 62, 200, 300]):
        at = np.array(seeds) + 10
        runs = substring.common_runs(a, b, at + 30, at + 50)
        assert runs == [(30, 90, 50, 110)]


@given(st.lists(st.tuples(st.integers(0, 280), st.integers(0, 2)), max_size=25), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_passages_of_a_chain(edits, seed):
    """Every passage meets the rule, none comes twice, and where no window of the chain's
    stretches is longer and similar, the longest is found."""
    a = np.random.default_rng(seed).integers(0, 1 << 30, 300).astype(np.int32)
    b = a.tolist()
    for place, kind in edits:
        place = min(place, len(b) - 1)
        b[place:place + 1] = {0: [-1 - place], 1: [], 2: [b[place], -1000 - place]}[kind]
    b = np.array(b, np.int32)
    if len(b) < 5 or (a[:5] != b[:5]).any():
        return
    runs = substring.common_runs(a, b, np.array([0]), np.array([0]))
    assert len(set(runs)) == len(runs)
    assert all(min(end - first, to - at) >= substring.LEAST and substring._similar(a[first:end], b[at:to]) for first, end, at, to in runs)
    chain = substring._chain(a, b, 0, 0).tolist()
    best = max((y[0] + y[2] - x[0] for i, x in enumerate(chain) for y in chain[i:]
                if min(y[0] + y[2] - x[0], y[1] + y[2] - x[1]) >= substring.LEAST
                and substring._similar(a[x[0]:y[0] + y[2]], b[x[1]:y[1] + y[2]])), default=0)
    found = max((end - first for first, end, _, _ in runs), default=0)
    assert found >= best - 8  # where the sum and the sets differ by a shingle
    assert bool(best) == bool(found)


def test_labelled_texts_are_all_learned_from(spark):
    """Texts that share a line and differ in their labels keep them."""
    line = "please read the rules of this board before you post anything"
    labels = frame(spark, [(i, i % 2) for i in range(200)], "doc_id bigint, toxic int")
    docs = [(i, f"{' '.join(f'w{i}x{k}' for k in range(8))} {'grobulous' if i % 2 else 'friendly'} {line}") for i in range(200)]
    model = toxicity.learn(frame(spark, docs), labels)
    clean, toxic = model.scores([docs[2][1], docs[1][1]])
    assert clean < 0.5 < toxic


def test_a_worker_keeps_one_operators_memory():
    common.kept("one")["memo"] = {"a": 1}
    assert common.kept("one") == {"memo": {"a": 1}}
    common.trimmed(lambda column: column)([1])  # a batch of this module
    assert common._KEPT.keys() == {__name__}
    assert common.kept("one") == {} and common._KEPT.keys() == {"one"}


def test_short_chains_are_not_searched(monkeypatch):
    """op10: common shingles whose chains are too short for a passage cost no search for one."""
    searched, longest = [], substring._longest
    monkeypatch.setattr(substring, "_longest", lambda part: searched.append(part) or longest(part))
    a = np.arange(400, dtype=np.int32)
    b = np.where(a % 40 < 10, a, a + 1000)  # ten equal words in forty
    at = np.arange(0, 400, 40) + 2
    assert substring.common_runs(a, b, at, at) == [] and not searched
    b[100:149] = a[100:149]
    assert substring.common_runs(a, b, at, at) == [] and not searched
    b[100:150] = a[100:150]
    assert substring.common_runs(a, b, at, at) == [(100, 150, 100, 150)] and searched


@given(st.lists(st.integers(0, 5), min_size=1, max_size=80), st.integers(1, 50))
def test_sliding_least(values, span):
    """op10: the first of the least of each window, as a search of each whole window gives it."""
    value = np.array(values, np.uint64)
    want = [i + int(value[i:i + span].argmin()) for i in range(len(values) - span + 1)]
    if want:
        assert substring._least(value, span).tolist() == want


def test_lowered_is_ascii_alone(spark):
    texts = ["ABC xYZ@[", "É ABC İSTANBUL ẞ", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(common.lowered(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["abc xyz@[", "É abc İstanbul ẞ", "", ""]
