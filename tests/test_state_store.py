"""Streams whose state Spark keeps: the keyed gate, the stateful fold, single sending."""

import json

import pytest
from pyspark.sql import functions as F

import model
from ledgerfold.operators import gate, journal
from ledgerfold.operators.specs import DEPARTMENT, USER
from ledgerfold.functions import validation
from ledgerfold.schemas import DEPARTMENT_COMMANDS, USER_COMMANDS
from ledgerfold.session import STATE_PROVIDER
from ledgerfold.sources import topics
from ledgerfold.sources.store import ViewStore, committed, stream_journal
from ledgerfold.streaming import keyed, views
from test_folds import _by_id
from test_gate import LIFECYCLE, _random, _simulate
from test_streaming import _feed


def _files(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _commands(spark, path, schema=USER_COMMANDS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _decided(spark, out):
    return {r["cmd_id"]: (r["event_kind"], r["reply_kind"], r["seq_nr"]) for r in keyed.decisions(spark, out).collect()}


@pytest.mark.parametrize("seed", [41, 42])
def test_keyed_gate_over_batches_and_restarts(spark, tmp_path, seed):
    commands, marks = _random(seed, 200)
    ordered = sorted(commands, key=lambda c: (c[1], c[0]))
    path, out, checkpoint = (str(tmp_path / n) for n in ("commands", "out", "c"))
    departments = spark.createDataFrame(marks, LIFECYCLE)
    for i in range(4):
        # Within a file the commands are in no order.
        _files(spark, path, ordered[50 * i:50 * (i + 1)][::-1], USER_COMMANDS)
        if i != 1:  # the second run finds two files
            stream = keyed.user_commands(_commands(spark, path), departments)
            keyed.run(stream, gate.USER_GATE, out, checkpoint).awaitTermination()
    assert _decided(spark, out) == _simulate(commands, marks)
    # The state is that of the journal which the decisions make.
    rows = gate.carried_state(gate.events(keyed.decisions(spark, out), gate.USER_GATE), gate.USER_GATE)
    kept = keyed.carried_state(spark, checkpoint).filter("last_seq > 0")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))


def test_keyed_gate_goes_on_from_a_journal(spark, tmp_path):
    """A first run starts from what a batch gate has left, for another query to go on with."""
    commands, marks = _random(43, 160)
    ordered = sorted(commands, key=lambda c: (c[1], c[0]))
    departments = spark.createDataFrame(marks, LIFECYCLE)
    early = gate.user_gate(spark.createDataFrame(ordered[:80], USER_COMMANDS), departments)
    carried = gate.carried_state(gate.events(early, gate.USER_GATE), gate.USER_GATE)
    path, out = str(tmp_path / "commands"), str(tmp_path / "out")
    _files(spark, path, ordered[80:], USER_COMMANDS)
    stream = keyed.user_commands(_commands(spark, path), departments)
    keyed.run(stream, gate.USER_GATE, out, str(tmp_path / "c"), carried).awaitTermination()
    whole = _simulate(commands, marks)
    assert _decided(spark, out) == {c[0]: whole[c[0]] for c in ordered[80:]}


def test_keyed_gate_of_another_entity(spark, tmp_path):
    """Departments, a null id, unknown commands, and a batch that is empty."""
    ts = model.START
    rows = [(1, ts, "d1", "create", "a", "x", "s", None), (2, ts, "d1", "create", "b", "x", "s", None), (3, ts, None, "update", "b", "x", "s", None),
            (4, ts, None, "create", "b", "x", "s", None), (5, ts, "d1", "remove", None, None, "s", None), (6, ts, "d1", "fly", None, None, "s", None), (7, ts, "d1", "get", None, None, "s", None)]
    path, out = str(tmp_path / "commands"), str(tmp_path / "out")
    _files(spark, path, [], DEPARTMENT_COMMANDS)
    _files(spark, path, rows, DEPARTMENT_COMMANDS)
    stream = _commands(spark, path, DEPARTMENT_COMMANDS).withColumn("errors", validation.no_errors())
    keyed.run(stream, gate.DEPARTMENT_GATE, out, str(tmp_path / "c")).awaitTermination()
    batch = gate.department_gate(spark.createDataFrame(rows, DEPARTMENT_COMMANDS))
    assert _decided(spark, out) == {r["cmd_id"]: (r["event_kind"], r["reply_kind"], r["seq_nr"]) for r in batch.collect()}


def test_keyed_gate_runs_one_job_for_a_batch(spark, tmp_path):
    commands, marks = _random(44, 60)
    path, out = str(tmp_path / "commands"), str(tmp_path / "out")
    for i in range(3):
        _files(spark, path, commands[20 * i:20 * (i + 1)], USER_COMMANDS)
    stream = keyed.user_commands(_commands(spark, path), spark.createDataFrame(marks, LIFECYCLE))
    seen = spark.sparkContext.statusTracker()
    query = keyed.run(stream, gate.USER_GATE, out, str(tmp_path / "c"))
    query.awaitTermination()
    jobs = seen.getJobIdsForGroup(query.runId)
    batches = [p for p in query.recentProgress if p["numInputRows"] > 0]
    assert len(batches) == 3 and 0 < len(jobs) <= 6 * len(batches)


def test_keyed_gate_in_a_session_with_another_state_store(spark, tmp_path):
    """The gate brings the store that it needs, and leaves the session's setting alone."""
    commands, marks = _random(46, 60)
    path, out = str(tmp_path / "commands"), str(tmp_path / "out")
    _files(spark, path, commands, USER_COMMANDS)
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, other)
    try:
        stream = keyed.user_commands(_commands(spark, path), spark.createDataFrame(marks, LIFECYCLE))
        keyed.run(stream, gate.USER_GATE, out, str(tmp_path / "c")).awaitTermination()
        assert spark.conf.get(STATE_PROVIDER) == other
    finally:
        spark.conf.set(STATE_PROVIDER, before)
    assert _decided(spark, out) == _simulate(commands, marks)


@pytest.mark.parametrize("sent", [True, False])
def test_keyed_gate_of_many_department_events(spark, tmp_path, monkeypatch, sent):
    """Departments beyond the limits of what is broadcast, joined with and without that."""
    monkeypatch.setattr(gate, "SMALL_LIFECYCLE", 1)
    monkeypatch.setattr(gate, "SMALL_GRID", 1)
    monkeypatch.setattr(gate, "_PER_SLICE", 3)
    commands, marks = _random(47, 120)
    path, out = str(tmp_path / "commands"), str(tmp_path / "out")
    _files(spark, path, commands, USER_COMMANDS)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    if not sent:
        spark.conf.set(threshold, "-1")
    try:
        stream = keyed.user_commands(_commands(spark, path), spark.createDataFrame(marks, LIFECYCLE))
        keyed.run(stream, gate.USER_GATE, out, str(tmp_path / "c")).awaitTermination()
    finally:
        spark.conf.set(threshold, before)
    assert _decided(spark, out) == _simulate(commands, marks)


def test_too_many_department_events_are_refused(spark, tmp_path):
    commands, marks = _random(45, 20)
    _files(spark, str(tmp_path / "commands"), commands, USER_COMMANDS)
    spark.conf.set(gate.GRID_CONF, "1")
    try:
        with pytest.raises(ValueError, match="streaming.gate"):
            keyed.user_commands(_commands(spark, str(tmp_path / "commands")), spark.createDataFrame(marks, LIFECYCLE))
    finally:
        spark.conf.unset(gate.GRID_CONF)


def test_stateful_fold_of_late_and_repeated_files(spark, tmp_path):
    """A batch writes one row for each entity that it touches; reads equal the model."""
    rows = model.random_journal(51)
    parts = [rows[i::5] for i in range(5)]
    path, checkpoint = str(tmp_path / "j"), str(tmp_path / "c")
    store = ViewStore(spark, str(tmp_path / "v"), USER)

    def run():
        views.fold_view(stream_journal(spark, path, files_per_trigger=1), store, checkpoint).awaitTermination()

    order = [parts[4], parts[2], parts[2], parts[0]]
    _feed(spark, path, order)
    run()
    assert _by_id(store.all(secrets=True)) == model.view([r for i in (0, 2, 4) for r in parts[i]])
    deltas = committed(spark, f"{tmp_path}/v/delta")
    assert {n: spark.read.parquet(f).count() for n, f in deltas.items()} == {n: len({r[0] for r in part}) for n, part in enumerate(order)}
    _feed(spark, path, [parts[1], parts[3]])
    run()
    assert _by_id(store.all(secrets=True)) == model.view(rows)


def test_a_removed_entity_stays_removed(spark, tmp_path):
    """The tombstone is state: an older event that comes after the removal changes nothing."""
    rows = sorted(model.random_journal(52, entities=1), key=lambda r: r[1])
    path = str(tmp_path / "j")
    removed = next(i for i, r in enumerate(rows) if r[3] == "removed")
    store = ViewStore(spark, str(tmp_path / "v"), USER)
    _feed(spark, path, [rows[1:removed + 1]])
    views.fold_view(stream_journal(spark, path), store, str(tmp_path / "c")).awaitTermination()
    _feed(spark, path, [rows[:1]])
    views.fold_view(stream_journal(spark, path), store, str(tmp_path / "c")).awaitTermination()
    assert _by_id(store.all(secrets=True)) == {}


def _sent(spark, out):
    return sorted((r["key"], json.loads(r["value"])["seq_nr"]) for r in spark.read.parquet(out).collect())


@pytest.mark.parametrize("within", [None, "30 days"])
def test_each_event_is_sent_once(spark, tmp_path, within):
    rows = model.random_journal(53)
    path, out = str(tmp_path / "j"), str(tmp_path / "out")

    def run():
        views.republish(stream_journal(spark, path, files_per_trigger=1), USER, topics.USER_TOPIC, str(tmp_path / "c"), unique=True, within=within, path=out).awaitTermination()

    _feed(spark, path, [rows[:40], rows[20:60]])
    run()
    assert _sent(spark, out) == sorted((r[0], r[1]) for r in rows[:60])
    _feed(spark, path, [rows[:10], rows[50:]])
    run()
    assert _sent(spark, out) == sorted((r[0], r[1]) for r in rows)


def test_live_read_from_offsets(spark, tmp_path):
    rows = model.random_journal(54)
    offsets = {}
    for r in rows[: len(rows) // 2]:
        offsets[r[0]] = max(offsets.get(r[0], 0), r[1])
    known = spark.createDataFrame(list(offsets.items()), "entity_id string, offset bigint")
    _feed(spark, str(tmp_path / "j"), [rows[::2], rows[1::2]])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    live = journal.from_offsets(stream_journal(spark, str(tmp_path / "j")), known)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == jobs  # nothing is counted
    q = live.select("entity_id", "seq_nr").writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tail").collect())) == sorted((r[0], r[1]) for r in rows if r[1] >= offsets.get(r[0], 0))
