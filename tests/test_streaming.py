import json

import pytest
from pyspark.sql import functions as F

import model
from ledgerfold.operators import gate, journal
from ledgerfold.operators.specs import USER
from ledgerfold.schemas import USER_COMMANDS
from ledgerfold.sources import topics
from ledgerfold.sources.store import ViewStore, stream_journal
from ledgerfold.sources.tables import stream_files, write_in_time_order
from ledgerfold.streaming import gate as streaming_gate
from ledgerfold.streaming import views
from test_folds import _by_id, frame
from test_gate import LIFECYCLE, _random, _simulate


def _feed(spark, path, parts):
    for part in parts:
        journal.with_tags(frame(spark, part), USER).coalesce(1).write.mode("append").parquet(path)


def test_view_from_many_batches(spark, tmp_path):
    """Events out of order over files, one file twice, and a stop in between."""
    rows = model.random_journal(31)
    parts = [rows[i::5] for i in range(5)]
    path, checkpoint = str(tmp_path / "j"), str(tmp_path / "c")
    store = ViewStore(spark, str(tmp_path / "v"), USER)

    def run():
        stream = stream_journal(spark, path, files_per_trigger=1)
        views.build_view(stream, store, checkpoint, compact_every=2).awaitTermination()

    _feed(spark, path, parts[:3] + [parts[0]])
    run()
    assert _by_id(store.all(secrets=True)) == model.view([r for p in parts[:3] for r in p])
    _feed(spark, path, parts[3:])
    run()
    assert _by_id(store.all(secrets=True)) == model.view(rows)


def test_view_of_one_shard(spark, tmp_path):
    rows = model.random_journal(32, entities=12)
    path = str(tmp_path / "j")
    _feed(spark, path, [rows])
    stores = []
    for number in range(3):
        store = ViewStore(spark, str(tmp_path / f"v{number}"), USER)
        stream = journal.by_tag(stream_journal(spark, path), f"UserEvent{number}")
        views.build_view(stream, store, str(tmp_path / f"c{number}")).awaitTermination()
        stores.append(_by_id(store.all(secrets=True)))
    together = {k: v for s in stores for k, v in s.items()}
    assert together == model.view(rows) and sum(map(len, stores)) == len(together)


def test_a_failing_handler_fails_the_batch(spark, tmp_path):
    _feed(spark, str(tmp_path / "j"), [model.random_journal(1)])

    def handler(batch, batch_id):
        raise RuntimeError("no space")

    with pytest.raises(Exception, match="no space"):
        views.project(stream_journal(spark, str(tmp_path / "j")), "bad", str(tmp_path / "c"), handler).awaitTermination()


def test_republish_resumes(spark, tmp_path):
    rows = model.random_journal(33)
    path = str(tmp_path / "j")

    def run():
        stream = stream_journal(spark, path)
        views.republish(stream, USER, topics.USER_TOPIC, str(tmp_path / "c"), path=str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    _feed(spark, path, [rows[:40]])
    assert len(run()) == 40
    _feed(spark, path, [rows[40:]])
    records = run()
    assert sorted((r["key"], json.loads(r["value"])["seq_nr"]) for r in records) == sorted((r[0], r[1]) for r in rows)


def test_live_events_of_one_entity(spark, tmp_path):
    rows = model.random_journal(34)
    _feed(spark, str(tmp_path / "j"), [rows])
    live = journal.by_entity(stream_journal(spark, str(tmp_path / "j")), USER, "e0", from_seq=50)
    q = live.select("seq_nr").writeStream.format("memory").queryName("one_entity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r[0] for r in spark.table("one_entity").collect()) == list(range(50, 61))


def test_gate_over_batches(spark, tmp_path):
    commands, marks = _random(40, 200)
    ordered = sorted(commands, key=lambda c: (c[1], c[0]))
    path = str(tmp_path / "commands")
    departments = spark.createDataFrame(marks, LIFECYCLE)
    out = str(tmp_path / "out")

    def decide(batch, carried):
        return gate.user_gate(batch, departments, carried)

    def run():
        stream = spark.readStream.schema(USER_COMMANDS).option("maxFilesPerTrigger", 1).parquet(path)
        streaming_gate.run(stream, gate.USER_GATE, decide, out, str(tmp_path / "c"), compact_every=2).awaitTermination()

    for i in range(4):
        spark.createDataFrame(ordered[50 * i:50 * (i + 1)], USER_COMMANDS).coalesce(1).write.mode("append").parquet(path)
        if i != 1:
            run()
    decided = streaming_gate.decisions(spark, out)
    got = {r["cmd_id"]: (r["event_kind"], r["reply_kind"], r["seq_nr"]) for r in decided.collect()}
    assert got == _simulate(commands, marks)


def test_a_repeated_gate_batch_changes_nothing(spark, tmp_path):
    """The state a batch starts from excludes what the batch itself wrote."""
    out = str(tmp_path / "out")
    store = streaming_gate.state_store(spark, out)

    def state(*rows):
        return spark.createDataFrame(rows, "entity_id string, last_seq bigint, alive boolean").withColumn("bucket", streaming_gate.bucket_of())

    store.append(state(("a", 1, True)), 0)
    store.append(state(("a", 2, False)), 1)
    assert [tuple(r)[:3] for r in store.read(before=1).collect()] == [("a", 1, True)]
    assert [tuple(r)[:3] for r in store.read(before=2).collect()] == [("a", 2, False)]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    store = streaming_gate.state_store(spark, str(tmp_path / "out"))
    store.create_or_extend()
    many = spark.range(1000).select(F.col("id").cast("string").alias("entity_id"), F.lit(1).cast("bigint").alias("last_seq"), F.lit(True).alias("alive"))
    store.append(many.withColumn("bucket", streaming_gate.bucket_of()), 0)
    bucket = many.filter("entity_id = '7'").select(streaming_gate.bucket_of().alias("b")).first()[0]
    found = store.read(where=F.col("bucket").isin([bucket]))
    assert "7" in {r["entity_id"] for r in found.collect()} and found.count() < 50
    # The filter stands below the merge, at the scan.
    assert f"EqualTo(bucket,{bucket})" in found._jdf.queryExecution().executedPlan().toString()


def test_departments_that_come_while_the_gate_runs(spark, tmp_path):
    """Each batch asks for the departments as they are by then."""
    path, marks = str(tmp_path / "commands"), str(tmp_path / "departments")
    empty = spark.createDataFrame([], LIFECYCLE)
    empty.write.parquet(marks)

    def decide(batch, carried):
        return gate.user_gate(batch, spark.read.schema(LIFECYCLE).parquet(marks), carried)

    def run(cmd_id, entity):
        row = (cmd_id, model.START, entity, "create", entity, "e@x.com", "pass", None, ("d9",), entity, None)
        spark.createDataFrame([row], USER_COMMANDS).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(USER_COMMANDS).option("maxFilesPerTrigger", 1).parquet(path)
        streaming_gate.run(stream, gate.USER_GATE, decide, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()

    run(1, "first")
    spark.createDataFrame([("d9", 1, model.START, "created")], LIFECYCLE).write.mode("append").parquet(marks)
    run(2, "second")
    found = {r["entity_id"]: r["reply_kind"] for r in streaming_gate.decisions(spark, str(tmp_path / "out")).collect()}
    assert found == {"first": "CreatedFailed", "second": "Created"}


def test_slices_of_many_files_are_one_batch_each(spark, tmp_path):
    """Batches follow the slices of time, not the files that their size asks for."""
    path = str(tmp_path / "files")
    rows = spark.range(4000).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.col("id") % 97).alias("key"), "id")
    seen = []
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # every slice is as many files as there are shuffle partitions
    try:
        for part in (rows.filter("id < 2000"), rows.filter("id >= 2000")):
            files = write_in_time_order(part, path, "ts", "key", 4)
            assert files == 4
            stream = stream_files(spark, path, "ts timestamp_ntz, key bigint, id bigint", files)
            views.project(stream, "slices", str(tmp_path / "c"), lambda batch, _: seen.append(sorted(r["id"] for r in batch.collect()))).awaitTermination()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(seen) == 8 and sum(seen, []) == list(range(4000))


@pytest.mark.parametrize("name, least", [
    ("stream_user_view", 8), ("stream_resumed_view", 8), ("stream_department_view", 8), ("stream_republish", 8),
    ("stream_republish_departments", 8), ("stream_gate", 8), ("stream_keyed_gate", 8), ("stream_state_view", 8), ("stream_republish_once", 8),
    ("stream_from_offsets", 8), ("projection_ledger", 8), ("projection_ledger_view", 8), ("projection_lag", 4), ("stream_events_by_entity", 8), ("stream_events_by_tag", 8),
])
def test_registered_streams_run_many_batches(spark, monkeypatch, name, least):
    from pyspark.sql.streaming import StreamingQuery

    from ledgerfold.plans.catalog import QUERIES

    ended, wait = [], StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, *a: (wait(self, *a), ended.append(self))[0])
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()
    by_query = [[p["batchId"] for p in q.recentProgress if p["numInputRows"] > 0] for q in ended]
    batches = sum(by_query, [])
    assert len(batches) >= least
    apart = by_query if name.startswith("projection_ledger") else [batches]  # that one has two checkpoints
    assert all(len(numbers) == len(set(numbers)) for numbers in apart)
    stopped = ("stream_resumed_view", "stream_keyed_gate", "stream_state_view", "stream_republish_once", "projection_ledger", "projection_ledger_view")
    assert len(ended) == (2 if name in stopped else 1)
