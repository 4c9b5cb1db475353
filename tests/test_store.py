import json

import pytest
from pyspark.sql import functions as F

import model
from ledgerfold.operators import fold, journal
from ledgerfold.operators.specs import USER
from ledgerfold.sources.store import MergedTable, ViewStore, read_journal, write_journal
from test_folds import _by_id, frame


@pytest.fixture
def tagged(spark):
    rows = model.random_journal(3, entities=30)
    return rows, journal.with_tags(frame(spark, rows), USER)


def test_journal_round_trip_and_pruning(spark, tagged, tmp_path):
    rows, df = tagged
    write_journal(df, str(tmp_path / "j"))
    stored = read_journal(spark, str(tmp_path / "j"))
    assert stored.count() == len(rows)
    assert _by_id(fold.view_fold(stored, USER, secrets=True)) == model.view(rows)
    one = journal.by_entity(stored, USER, "e0", from_seq=10)
    assert [r["seq_nr"] for r in one.collect()] == list(range(10, 61))
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tag" in plan and "EqualTo(entity_id,e0)" in plan and "GreaterThanOrEqual(seq_nr,10)" in plan
    late = journal.since(stored, "20240101T05:00")
    assert "timebucket" in late._jdf.queryExecution().toString().split("PartitionFilters")[1].split("]")[0]
    assert late.count() == sum(r[2].hour >= 5 for r in rows)


def test_union_of_tags_is_the_journal(spark, tagged):
    rows, df = tagged
    assert journal.union_of_tags(df, USER).count() == len(rows)


def test_offsets_resume_inclusively(spark, tagged, cell_mode):
    rows, df = tagged
    offsets = spark.createDataFrame([("e0", 58), ("e1", 1)], "entity_id string, offset bigint")
    got = journal.from_offsets(df, offsets)
    wanted = [r for r in rows if not (r[0] == "e0" and r[1] < 58)]
    assert sorted((r["entity_id"], r["seq_nr"]) for r in got.collect()) == sorted((r[0], r[1]) for r in wanted)


def test_tag_numbers(spark, tagged, cell_mode):
    rows, df = tagged
    got = journal.tag_view(df)
    assert got.filter(F.col("seq_nr") != F.col("tag_pid_sequence_nr")).count() == 0
    progress = {r["entity_id"]: r["tag_pid_sequence_nr"] for r in journal.tag_write_progress(got).collect()}
    assert progress["e0"] == 60


def test_view_store_batches_rerun_and_compact(spark, tmp_path):
    rows = model.random_journal(8)
    store = ViewStore(spark, str(tmp_path / "v"), USER)
    assert store.all().count() == 0
    for batch in range(4):
        store.apply(frame(spark, rows[batch::4]), batch)
    store.apply(frame(spark, rows[1::4]), 1)
    assert _by_id(store.all(secrets=True)) == model.view(rows)
    store.compact()
    store.compact()
    assert _by_id(store.all(secrets=True)) == model.view(rows)
    store.apply(frame(spark, [("e0", 1000, model.START, "removed", None, None, None, None, None)]), 4)
    assert "e0" not in _by_id(store.all(secrets=True))
    assert store.find("e0").count() == 0
    assert "EqualTo(entity_id,e0)" in store.find("e0")._jdf.queryExecution().executedPlan().toString()
    before = store.read(before=2)
    some = [r for b in (0, 1) for r in rows[b::4]]
    assert _by_id(fold.finish(before, USER, secrets=True)) == model.view(some)


def test_pruning_keeps_the_view(spark, tmp_path):
    rows = model.random_journal(9)
    store = ViewStore(spark, str(tmp_path / "v"), USER)
    for batch in range(6):
        store.apply(frame(spark, rows[batch::6]), batch)
        if batch in (1, 3, 4):
            store.compact()
    store.prune()
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "v" / "manifest").iterdir()) == ["upto=3", "upto=4"]
    named = {f for m in (tmp_path / "v" / "manifest").iterdir() for f in json.loads((m / "manifest.json").read_text())["folders"].values()}
    assert {str(p.relative_to(tmp_path / "v")) for p in (tmp_path / "v" / "base").glob("*/_bucket=*")} == named
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "v" / "delta").iterdir()) == ["batch=4", "batch=5"]
    assert _by_id(store.all(secrets=True)) == model.view(rows)
    before_last = [r for b in range(5) for r in rows[b::6]]
    assert _by_id(fold.finish(store.read(before=5), USER, secrets=True)) == model.view(before_last)


def _files(path):
    """Data files of a table's bases, by bucket."""
    return {p: p.stat().st_mtime_ns for p in path.glob("base/*/_bucket=*/*.parquet")}


def test_compaction_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    """1 % of the entities: about 1 % of the files are new, the others stay named."""
    entities = [f"e{i}" for i in range(400)]
    rows = [(e, 1, model.START, "created", e, f"{e}@x", "p", None, None) for e in entities]
    store = ViewStore(spark, str(tmp_path / "v"), USER, buckets=256)
    store.apply(frame(spark, rows), 0)
    store.compact()
    first = _files(tmp_path / "v")
    more = [(e, 2, model.START, "emailUpdated", None, "new", None, None, None) for e in entities[::100]]
    store.apply(frame(spark, more), 1)
    store.compact()
    new = set(_files(tmp_path / "v")) - set(first)
    assert len(first) > 150 and 0 < len(new) <= 4
    assert _by_id(store.all(secrets=True)) == model.view(rows + more)
    # The earlier manifest is still readable, and goes with the second next one.
    assert _by_id(fold.finish(store.read(before=1), USER, secrets=True)) == model.view(rows)
    store.apply(frame(spark, [(e, 3, model.START, "removed", None, None, None, None, None) for e in entities[::100]]), 2)
    store.compact()
    store.prune()
    left = _files(tmp_path / "v")
    assert len(set(left) & set(first)) == len(first) - len(new) and len(left) == len(first) + len(new)
    assert store.all().count() == 396
    reopened = ViewStore(spark, str(tmp_path / "v"), USER, buckets=8)
    reopened.apply(frame(spark, more), 3)
    reopened.compact()
    assert reopened.all().count() == 396 and len(set(_files(tmp_path / "v")) - set(left)) <= 4


def test_an_unfinished_compaction_is_not_read(spark, tmp_path):
    rows = model.random_journal(16)
    store = ViewStore(spark, str(tmp_path / "v"), USER)
    store.apply(frame(spark, rows[:50]), 0)
    store.compact()
    store.apply(frame(spark, rows[50:]), 1)
    store.compact()
    (next((tmp_path / "v" / "manifest").glob("upto=1-*")) / "_SUCCESS").unlink()
    assert _by_id(store.all(secrets=True)) == model.view(rows)
    store.compact()
    assert _by_id(store.all(secrets=True)) == model.view(rows)


def test_offsets_count_with_their_batch(spark, tmp_path):
    rows = sorted(model.random_journal(17), key=lambda r: (r[2], r[0], r[1]))
    store = ViewStore(spark, str(tmp_path / "v"), USER)
    whole = journal.with_tags(frame(spark, rows), USER)
    assert store.offsets().count() == 0 and store.next_batch() == 0

    def want(n):
        return sorted(map(tuple, journal.tag_offsets(journal.with_tags(frame(spark, rows[:n]), USER)).collect()))

    for batch, (i, j) in enumerate([(0, 30), (30, 60), (60, 90)]):
        store.apply(journal.with_tags(frame(spark, rows[i:j]), USER), batch, ledger=True)
        if batch == 1:
            store.compact()
        assert sorted(map(tuple, store.offsets().collect())) == want(j) and store.next_batch() == batch + 1
    (next((tmp_path / "v" / "delta").glob("batch=2-*")) / "_SUCCESS").unlink()
    assert sorted(map(tuple, store.offsets().collect())) == want(60)
    lag = {r["tag"]: r["lag"] for r in journal.lag(whole, store.offsets()).collect()}
    at = {r["tag"]: (r["ts"], r["entity_id"], r["seq_nr"]) for r in store.offsets().collect()}
    later = [r for r in whole.collect() if r["tag"] not in at or (r["ts"], r["entity_id"], r["seq_nr"]) > at[r["tag"]]]
    assert sum(lag.values()) == len(later) > 0
    beyond = journal.beyond(whole, store.offsets())
    assert beyond.count() == len(later) + len(at)


def test_upsert_and_delete(spark, tmp_path):
    store = ViewStore(spark, str(tmp_path / "v"), USER)
    schema = "id string, seq_nr bigint, username string, email string"
    store.upsert(spark.createDataFrame([("a", 1, "n", "e"), ("b", 1, "n", "e")], schema), 0)
    store.upsert(spark.createDataFrame([("a", 2, "n2", "e2")], schema), 1)
    store.delete(spark.createDataFrame([("b", 2)], "id string, seq_nr bigint"), 2)
    store.delete(spark.createDataFrame([("zz", 1)], "id string, seq_nr bigint"), 3)
    assert [(r["id"], r["username"]) for r in store.all().collect()] == [("a", "n2")]
    store.upsert(spark.createDataFrame([("b", 3, "back", "e")], schema), 4)
    assert sorted(r["id"] for r in store.all().collect()) == ["a", "b"]


def test_columns_are_only_ever_added(spark, tmp_path):
    path = str(tmp_path / "s")

    def merge(rows):
        return rows

    old = MergedTable(spark, path, "entity_id string, x int", merge)
    old.create_or_extend()
    old.append(spark.createDataFrame([("a", 1)], "entity_id string, x int"), 0)
    new = MergedTable(spark, path, "entity_id string, y string", merge)
    assert new.create_or_extend().fieldNames() == ["entity_id", "x", "y"]
    new.append(spark.createDataFrame([("b", "q")], "entity_id string, y string"), 1)
    assert sorted(map(tuple, new.read().collect())) == [("a", 1, None), ("b", None, "q")]
    assert sorted(map(tuple, old.read().collect())) == [("a", 1, None), ("b", None, "q")]


def test_snapshots_of_several_runs(spark, tmp_path):
    from ledgerfold.operators import state
    from ledgerfold.sources.store import read_snapshots, write_snapshots

    rows = model.random_journal(14)
    path = str(tmp_path / "snapshots")
    early = frame(spark, [r for r in rows if r[1] <= 20])
    assert read_snapshots(spark, path, USER).count() == 0
    write_snapshots(state.snapshots(early, USER, every=4), path, 1, USER)
    write_snapshots(state.snapshots(frame(spark, rows), USER, every=8), path, 2, USER)
    write_snapshots(state.snapshots(frame(spark, rows), USER, every=8), path, 2, USER)
    taken = read_snapshots(spark, path, USER)
    assert _by_id(state.recover(taken, frame(spark, rows), USER, secrets=True)) == model.state(rows)
    kept = {}
    for r in taken.collect():
        kept.setdefault(r["entity_id"], []).append(r["seq_nr"])
    assert max(len(n) for n in kept.values()) == 2 and sorted(kept["e0"]) == [48, 56]


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    rows = model.random_journal(15)
    store = ViewStore(spark, str(tmp_path / "v"), USER)
    store.apply(frame(spark, rows[:40]), 0)
    store.apply(frame(spark, rows[40:]), 1)
    (next((tmp_path / "v" / "delta").glob("batch=1-*")) / "_SUCCESS").unlink()
    assert _by_id(store.all(secrets=True)) == model.view(rows[:40])
    store.apply(frame(spark, rows[40:]), 1)
    assert _by_id(store.all(secrets=True)) == model.view(rows)
    store.apply(frame(spark, rows[40:]), 1)
    assert _by_id(store.all(secrets=True)) == model.view(rows)


def test_upsert_sets_only_what_it_is_given(spark, tmp_path):
    store = ViewStore(spark, str(tmp_path / "v"), USER)
    whole = "id string, seq_nr bigint, username string, email string, pass string"
    store.upsert(spark.createDataFrame([("a", 1, "n", "e", "p"), ("b", 1, "m", "f", "q")], whole), 0)
    store.upsert(spark.createDataFrame([("a", 2, "new")], "id string, seq_nr bigint, email string"), 1)
    store.upsert(spark.createDataFrame([("b", 2, None)], "id string, seq_nr bigint, email string"), 2)
    found = {r["id"]: (r["username"], r["email"], r["pass"]) for r in store.all(secrets=True).collect()}
    assert found == {"a": ("n", "new", "p"), "b": ("m", None, "q")}


@pytest.mark.parametrize("safe", [False, True])
def test_lookups_and_union_of_any_id(spark, tmp_path, safe):
    """Text ids with negative hashes, one beyond the basic plane, and the lowest hash."""
    ids = ["polygenelubricants", "\U0001F600", *[f"text id {i}" for i in range(12)]]
    rows = [(i, n, model.START, "created", "u", None, None, None, None) for i in ids for n in (1, 2)]
    df = journal.with_tags(frame(spark, rows), USER, safe=safe)
    write_journal(df, str(tmp_path / "j"), partitions=("tag",))
    stored = read_journal(spark, str(tmp_path / "j"))
    for i in ids:
        assert [r["seq_nr"] for r in journal.by_entity(stored, USER, i).collect()] == [1, 2]
    assert journal.union_of_tags(stored, USER).count() == len(rows)
