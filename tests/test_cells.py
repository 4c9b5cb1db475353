import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerfold.functions.codecs import utc_micros
from ledgerfold.operators import cells
from ledgerfold.operators.cells import CELL

T0 = datetime(2024, 3, 31, 1, 30)
SCHEMA = "k string, ts timestamp_ntz, id bigint, v string"


def _log(seed, shape):
    draw = random.Random(seed)
    rows = []
    for i in range(400):
        key = "hot" if draw.random() < 0.6 else f"k{draw.randint(0, 40)}"
        at = {
            "spread": lambda: T0 + timedelta(microseconds=draw.randint(0, 10**9)),
            "burst": lambda: T0 + timedelta(microseconds=draw.randint(0, 50) if draw.random() < 0.7 else draw.randint(0, 10**10)),
            "one instant": lambda: T0,
        }[shape]()
        rows.append((key, at, i * 3 - 500, draw.choice([None, None, f"v{i}"])))
    draw.shuffle(rows)
    return rows


def _walk(rows):
    """id -> (last before, last so far, number, flagged so far)"""
    out, seen = {}, {}
    for key, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        last, number, flagged = seen.get(key, (None, 0, 0))
        now = v if v is not None else last
        number, flagged = number + 1, flagged + (v is not None)
        out[i] = (last, now, number, flagged)
        seen[key] = (now, number, flagged)
    return out


@pytest.mark.parametrize("shape", ["spread", "burst", "one instant"])
@pytest.mark.parametrize("rows_per_cell", [10, 10_000])
def test_scan_by_time(spark, shape, rows_per_cell):
    rows = _log(7, shape)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = cells.by_time(df, "k", "ts", "id", rows=rows_per_cell)
    assert bool(plan.hot) == (rows_per_cell == 10)
    placed = plan.apply(df)
    if plan.hot:
        assert "hot" in plan.hot
        largest = placed.groupBy("k", CELL).count().agg(F.max("count")).first()[0]
        assert largest <= 2 * rows_per_cell + 5
    out = cells.running_last(placed, plan, {"before": F.col("v")}, before=True)
    out = cells.running_last(out, plan, {"now": F.col("v")})
    out = cells.running_count(out, plan, "number")
    out = cells.running_count(out, plan, "flagged", F.col("v").isNotNull())
    found = {r["id"]: (r["before"], r["now"], r["number"], r["flagged"]) for r in out.collect()}
    assert found == _walk(rows)


def test_scan_by_sequence(spark):
    rows = [("hot", n, f"v{n}" if n % 7 == 0 else None) for n in range(1, 101)] + [("cold", n, f"c{n}") for n in range(1, 9)]
    df = spark.createDataFrame(rows, "entity_id string, seq_nr bigint, v string")
    plan = cells.by_sequence(df, rows=10)
    assert plan.hot == ("hot",)
    placed = plan.apply(df)
    assert placed.groupBy("entity_id", CELL).count().agg(F.max("count")).first()[0] <= 10
    out = cells.running_last(placed, plan, {"b": F.col("v")}, before=True).collect()
    for r in out:
        before = (r["seq_nr"] - 1) // 7 * 7 if r["entity_id"] == "hot" else r["seq_nr"] - 1
        prefix = "v" if r["entity_id"] == "hot" else "c"
        assert r["b"] == (f"{prefix}{before}" if before else None)


@pytest.mark.parametrize("listed", [10_000, 3])
def test_more_hot_keys_than_a_list_holds(spark, monkeypatch, listed):
    """Also with a null key; the bound of a cell does not grow with the data."""
    monkeypatch.setattr(cells, "MAX_HOT_KEYS", listed)
    rows = [(None if k == 5 else f"k{k}", T0 + timedelta(seconds=(i * 37 + k) % 1000), k * 1000 + i, f"v{i}" if i % 3 == 0 else None) for k in range(12) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = cells.by_time(df, "k", "ts", "id", rows=20)
    assert plan.every == (listed == 3) and plan.cuts and (plan.every or None in plan.hot)
    placed = plan.apply(df)
    assert placed.groupBy("k", CELL).count().agg(F.max("count")).first()[0] <= 45
    out = cells.running_count(cells.running_last(placed, plan, {"before": F.col("v")}, before=True), plan, "number")
    named = [("null" if r[0] is None else r[0], *r[1:]) for r in rows]
    assert {r["id"]: (r["before"], r["number"]) for r in out.collect()} == {i: (w[0], w[2]) for i, w in _walk(named).items()}


def test_more_than_ten_thousand_hot_keys(spark):
    df = spark.range(33_000).select(F.concat(F.lit("k"), (F.col("id") % 11_000)).alias("entity_id"), (F.floor(F.col("id") / 11_000) + 1).alias("seq_nr"))
    plan = cells.by_sequence(df, rows=2)
    assert plan.every and not plan.hot
    out = cells.running_count(plan.apply(df), plan, "n")
    assert out.filter("n <> seq_nr").count() == 0


def test_micros_ignores_session_zone(spark):
    df = spark.createDataFrame([(T0 + timedelta(minutes=m),) for m in range(0, 200, 7)], "ts timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r[0] for r in df.select(utc_micros("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    base = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 10**6
    assert got == [base + m * 60 * 10**6 for m in range(0, 200, 7)]


def test_join_unique_splits_hot_keys(spark):
    left = spark.createDataFrame([("hot", n) for n in range(1, 40)] + [("a", 1), ("b", 1), (None, 1)], "entity_id string, seq_nr bigint")
    right = spark.createDataFrame([("hot", 7), ("a", 8)], "entity_id string, x int")
    plan = cells.by_sequence(left, rows=5)
    assert plan.hot == ("hot",)
    got = cells.join_unique(left, right, plan)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(right, "entity_id", "left").collect()))


def test_global_rank(spark):
    values = list(range(500))
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v % 3, v) for v in values], "a int, b int").repartition(7)
    got = cells.global_rank(df, [F.col("a").desc(), F.col("b").asc()], "n").collect()
    wanted = sorted(((v % 3, v) for v in values), key=lambda r: (-r[0], r[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == wanted
    assert sorted(r["n"] for r in got) == list(range(500))
