import pytest
from pyspark.sql import functions as F

import model
from ledgerfold.operators import fold, state
from ledgerfold.operators.specs import DEPARTMENT, USER, EntitySpec, Field
from ledgerfold.schemas import ADDRESS

SCHEMA = (
    f"entity_id string, seq_nr bigint, ts timestamp_ntz, kind string, username string, email string, pass string, "
    f"address {ADDRESS}, department struct<id:string>"
)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _plain(row):
    return {f: (tuple(row[f]) if isinstance(row[f], tuple) else row[f]) for f in model.FIELDS}


def _by_id(df):
    return {r["id"]: _plain(r) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_view_fold(spark, seed):
    rows = model.random_journal(seed)
    assert _by_id(fold.view_fold(frame(spark, rows), USER, secrets=True)) == model.view(rows)


def test_view_fold_tolerates_replays_and_splits(spark):
    rows = model.random_journal(11)
    twice = frame(spark, rows + rows[::3])
    assert _by_id(fold.view_fold(twice, USER, secrets=True)) == model.view(rows)
    parts = [fold.summarise(frame(spark, rows[i::3] + rows[:5]), USER) for i in range(3)]
    merged = fold.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), USER)
    assert _by_id(fold.finish(merged, USER, secrets=True)) == model.view(rows)


def test_secrets_stay_out(spark):
    assert "pass" not in fold.view_fold(frame(spark, model.random_journal(1)), USER).columns


@pytest.mark.parametrize("seed", range(4))
def test_state_and_history(spark, cell_mode, seed):
    rows = model.random_journal(seed)
    journal = frame(spark, rows)
    assert _by_id(state.state_fold(journal, USER, secrets=True)) == model.state(rows)
    got = {}
    for r in state.history(journal, USER, secrets=True).collect():
        got[r["entity_id"], r["seq_nr"]] = _plain(r) if r["present"] else None
    assert got == model.history(rows)


def test_state_tolerates_replays(spark, cell_mode):
    rows = model.random_journal(12)
    assert _by_id(state.state_fold(frame(spark, rows + rows[::3]), USER, secrets=True)) == model.state(rows)


def test_the_two_folds_differ_on_irregular_logs(spark):
    rows = [("e", 1, model.START, "emailUpdated", None, "m", None, None, None)]
    assert fold.view_fold(frame(spark, rows), USER).count() == 1
    assert state.state_fold(frame(spark, rows), USER).count() == 0


def test_clear_and_recreate(spark):
    a, d = model.address(), ("d1",)
    rows = [
        ("e", 1, model.START, "created", "n", "m", "p", a, d),
        ("e", 2, model.START, "addressUpdated", None, None, None, None, None),
        ("e", 3, model.START, "departmentUpdated", None, None, None, None, None),
        ("f", 1, model.START, "created", "n", "m", "p", a, d),
        ("f", 2, model.START, "removed", None, None, None, None, None),
        ("f", 3, model.START, "emailUpdated", None, "late", None, None, None),
        ("f", 4, model.START, "created", "n2", "m2", "p2", None, d),
        ("f", 5, model.START, "created", "n3", "m3", "p3", a, None),
    ]
    got = _by_id(state.state_fold(frame(spark, rows), USER, secrets=True))
    assert got["e"]["address"] is None and got["e"]["department"] is None and got["e"]["username"] == "n"
    assert got["f"]["username"] == "n2"
    shown = {r["id"]: r["username"] for r in fold.view_fold(frame(spark, rows), USER).collect()}
    assert shown == {"e": "n", "f": "n3"}


def test_as_of(spark, cell_mode):
    rows = model.random_journal(5)
    journal = frame(spark, rows)
    cut = [r for r in rows if r[1] <= 9]
    assert _by_id(state.state_as_of(journal, USER, seq_nr=9, secrets=True)) == model.state(cut)
    when = "2024-01-01 01:30:00"
    early = [r for r in rows if str(r[2]) <= when]
    assert _by_id(state.state_as_of(journal, USER, ts=when, secrets=True)) == model.state(early)


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_and_recovery(spark, cell_mode, seed):
    rows = model.random_journal(seed)
    journal = frame(spark, rows)
    taken = state.snapshots(journal, USER, every=4, keep=2)
    after = model.history(rows)
    wanted = {}
    for entity in {r[0] for r in rows}:
        points = sorted(s for e, s in after if e == entity and s % 4 == 0)[-2:]
        wanted.update({(entity, s): after[entity, s] for s in points})
    got = {(r["entity_id"], r["seq_nr"]): (_plain(r) if r["present"] else None) for r in taken.collect()}
    assert got == wanted
    assert _by_id(state.recover(taken, journal, USER, secrets=True)) == model.state(rows)
    # A stale snapshot only means a longer tail.
    stale = taken.filter(F.col("seq_nr") <= 8)
    assert _by_id(state.recover(stale, journal, USER, secrets=True)) == model.state(rows)


def test_department_folds(spark):
    schema = "entity_id string, seq_nr bigint, ts timestamp_ntz, kind string, name string, description string"
    rows = [
        ("d1", 1, model.START, "created", "a", "x"), ("d1", 2, model.START, "updated", "b", "y"),
        ("d2", 1, model.START, "updated", "c", "z"),
        ("d3", 1, model.START, "created", "e", "w"), ("d3", 2, model.START, "removed", None, None),
    ]
    journal = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, fold.view_fold(journal, DEPARTMENT).collect())) == [("d1", "b", "y"), ("d2", "c", "z")]
    assert sorted(map(tuple, state.state_fold(journal, DEPARTMENT).collect())) == [("d1", 2, "b", "y")]


def test_merge_view(spark):
    view = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, x int")
    delta = spark.createDataFrame([("b", 9, False), ("c", None, True), ("z", 8, False)], "id string, x int, deleted boolean")
    assert sorted(map(tuple, fold.merge_view(view, delta).collect())) == [("a", 1), ("b", 9), ("z", 8)]


def test_an_entity_of_ones_own(spark):
    """Any entity is a declaration: fields and the kinds that set them."""
    spec = EntitySpec(
        "ticket", "TicketEvent",
        (Field("owner", "string", ("opened", "assigned"), "nobody"), Field("level", "string", ("opened", "raised"))),
        created="opened", removed="closed",
    )
    schema = "entity_id string, seq_nr bigint, ts timestamp_ntz, kind string, owner string, level string"
    rows = [
        ("t1", 1, model.START, "opened", "ann", "1"), ("t1", 2, model.START, "raised", None, "2"),
        ("t2", 1, model.START, "raised", None, "5"), ("t3", 1, model.START, "opened", "bob", "1"), ("t3", 2, model.START, "closed", None, None),
    ]
    journal = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, fold.view_fold(journal, spec).collect())) == [("t1", "ann", "2"), ("t2", "nobody", "5")]
    assert sorted(map(tuple, state.state_fold(journal, spec).collect())) == [("t1", 2, "ann", "2")]


def test_view_fold_as_streaming_aggregate(spark, tmp_path):
    rows = model.random_journal(21)
    for i in range(4):
        frame(spark, rows[i::4] + rows[:2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "j"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "j"))
    q = fold.view_fold(stream, USER, secrets=True).writeStream.outputMode("complete").format("memory").queryName("live_view").start()
    q.processAllAvailable()
    q.stop()
    assert _by_id(spark.table("live_view")) == model.view(rows)
