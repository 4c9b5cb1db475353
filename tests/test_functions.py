import pytest
from pyspark.sql import functions as F

import model
from ledgerfold.functions import codecs, ids, text, validation
from ledgerfold.operators import journal
from ledgerfold.operators.specs import USER
from ledgerfold.schemas import ADDRESS
from ledgerfold.sources import topics


def column(spark, values, expression, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def _java(s):
    h = 0
    raw = s.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (31 * h + raw[i] * 256 + raw[i + 1]) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_java_hash(spark):
    words = ["", "a", "d1", "hello world", "Zürich", "日本語", "smile 😀 wide", "x" * 300]
    assert column(spark, words, ids.java_hash) == [_java(w) for w in words]
    assert _java("hello world") == 1794106052


def test_shard_tags(spark):
    # "polygenelubricants" hashes to the lowest 32-bit number, whose absolute value overflows.
    words = ["d1", "d2", "user-77", "polygenelubricants"]
    assert column(spark, words, lambda c: ids.shard_number(c))[-1] == -2
    assert column(spark, words, lambda c: ids.shard_tag(c, "UserEvent")) == [ids.tag_of(w, "UserEvent") for w in words]
    assert ids.tag_of("polygenelubricants", "UserEvent") == "UserEvent-2"
    plain, safe = column(spark, words, ids.shard_number), column(spark, words, lambda c: ids.shard_number(c, safe=True))
    assert safe == [abs(n) for n in plain]
    assert ids.tags_of_id("d1", "UserEvent") == [ids.tag_of("d1", "UserEvent")] and len(ids.tags_of_id(words[-1], "UserEvent")) == 2
    assert ids.stored_tags("UserEvent") == ["UserEvent-2", "UserEvent0", "UserEvent1", "UserEvent2"]
    assert [r[0] for r in journal.tags_of(spark, USER).collect()] == ["UserEvent0", "UserEvent1", "UserEvent2"]


@pytest.mark.parametrize("code, valid", [
    ("12345", True), ("12345-6789", True), ("12345 6789", True), ("1234", False), ("12345\n", False), ("123456789", False),
    ("12345-678", False), (" 12345", False), ("", False), ("12345--6789", False),
])
def test_zip(spark, code, valid):
    assert column(spark, [code], validation.zip_error) == [None if valid else f"Zip: {code} is not valid"]


def test_countries(spark):
    got = column(spark, ["US", "GB", "UK", "us", ""], validation.country_error)
    assert [g is None for g in got] == [True, True, False, False, False]
    assert got[2] == "Country: UK is not valid ISO country"
    assert 240 < len(validation.iso_countries()) < 260


def test_address_errors(spark):
    values = [None, model.address(), model.address("x", "US"), model.address("x", "UK")]
    got = column(spark, values, validation.address_errors, ADDRESS)
    assert got == [[], [], ["Zip: x is not valid"], ["Zip: x is not valid", "Country: UK is not valid ISO country"]]


def test_emails(spark):
    got = column(spark, ["a@b.com", "a.b+c@d-e.co.uk", "a@b", "a b@c.com", "@b.com", "", "a@b.com\n"], lambda c: validation.email_error("email", c))
    assert [g is None for g in got] == [True, True, False, False, False, False, False]


def test_sort_specs():
    assert codecs.parse_sort("username:asc") == ("username", True)
    assert codecs.parse_sort("email:DESC") == ("email", False)
    assert codecs.parse_sort("email:down") == ("email", True)
    assert codecs.parse_sort("address.city") == ("address.city", True)
    assert codecs.parse_sort("a:b:c") == ("a:b:c", True)
    assert codecs.sort_of("x", "DESC") == ("x", False) and codecs.sort_of("x", "ASC") == ("x", True)


def test_names_and_defaults():
    assert codecs.suggest_name("email") == "email_sugg"
    assert codecs.query_or_none("  ") is None and codecs.query_or_none("a") == "a"
    assert codecs.prefix_or_empty(None) == ""


def test_default_ids(spark):
    df = spark.createDataFrame([(None, "create", "n1"), ("i", "create", "n2"), ("j", "remove", None)], "entity_id string, kind string, username string")
    assert [r["entity_id"] for r in codecs.with_default_id(df).collect()] == ["n1", "i", "j"]
    assert [r["entity_id"] for r in codecs.with_default_id(df, always_username=True).collect()] == ["n1", "n2", "j"]


def test_redaction(spark):
    import hashlib
    got = column(spark, ["pw"], lambda c: codecs.redact_secret(c, F.lit("s")))
    assert got == [hashlib.sha256(b"spw").hexdigest()]


def test_timestamps_before_the_epoch(spark):
    df = spark.createDataFrame([(-1, 999_999_999), (5, 1_999)], "s bigint, n int")
    at = codecs.instant(F.col("s"), F.col("n"))
    assert [r[0] for r in df.select(F.unix_micros(at)).collect()] == [-1, 5_000_001]
    assert [tuple(r[0]) for r in df.select(codecs.instant_parts(at)).collect()] == [(-1, 999_999_000), (5, 1_000)]


def test_tokens(spark):
    assert column(spark, ["Hello, WORLD-42 Äpfel!", "", None], text.tokens) == [["hello", "world", "42", "äpfel"], [], []]
    assert text.words_of("Hello, WORLD-42 Äpfel!") == ["hello", "world", "42", "äpfel"]


def test_matching(spark):
    rows = ["red blue green", "bluered", "blue red", None]

    def run(f):
        return column(spark, rows, lambda c: f(text.tokens(c)))

    assert run(lambda w: text.has_any(w, ["red", "x"])) == [True, False, True, False]
    assert run(lambda w: text.has_all(w, ["red", "blue"])) == [True, False, True, False]
    assert run(lambda w: text.has_phrase(w, ["red", "blue"])) == [True, False, False, False]
    assert run(lambda w: text.has_prefix(w, ["bluer"])) == [False, True, False, False]
    assert run(lambda w: text.has_prefix(w, ["red", "bl"])) == [True, False, False, False]


def test_variants(spark):
    schema = "entity_id string, created struct<a:string>, changed struct<a:string>, removed struct<x:string>"
    df = spark.createDataFrame([("e", ("1",), None, None), ("f", None, ("2",), None), ("g", None, None, (None,)), ("h", None, None, None)], schema)
    got = codecs.flatten_variants(df, {"created": ["a"], "changed": ["a"], "removed": []}, ["entity_id"])
    assert sorted(map(tuple, got.collect())) == [("e", "created", "1"), ("f", "changed", "2"), ("g", "removed", None), ("h", "empty", None)]


def test_records_carry_only_their_kinds_fields(spark):
    rows = model.random_journal(2)
    schema = f"entity_id string, seq_nr bigint, ts timestamp_ntz, kind string, username string, email string, pass string, address {ADDRESS}, department struct<id:string>"
    for r in topics.records(spark.createDataFrame(rows, schema), USER, topics.USER_TOPIC).collect():
        assert r["topic"] == "c-user" and '"pass"' not in r["value"]
        if '"kind":"removed"' in r["value"]:
            assert '"email":null' in r["value"]
