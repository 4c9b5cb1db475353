"""The command gate over a stream of commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.operators.specs import GateSpec
from ledgerfold.sources.store import MergedTable, attempt, committed
from ledgerfold.streaming.views import COMPACT_EVERY, project

STATE = "entity_id string, last_seq bigint, alive boolean, bucket int"
#: State is stored by bucket of the entity id; a batch reads the buckets of its entities.
BUCKETS = 256

Decide = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(entity_id: str = "entity_id") -> Column:
    return F.pmod(F.xxhash64(entity_id), F.lit(BUCKETS)).cast("int")


def _merge(rows: DataFrame) -> DataFrame:
    merged = rows.groupBy("entity_id").agg(F.max("last_seq").alias("last_seq"), F.max_by("alive", "last_seq").alias("alive"))
    return merged.withColumn("bucket", bucket_of())


def state_store(spark, path: str) -> MergedTable:
    """Number and presence of every entity that ever had an event, sorted by bucket: row
    groups and files of other buckets are skipped by their statistics."""
    return MergedTable(spark, f"{path}/state", STATE, _merge, ("bucket", "entity_id"))


def run(stream: DataFrame, spec: GateSpec, decide: Decide, path: str, checkpoint: str, trigger: dict | None = None,
        compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Decide commands batch by batch.

    ``decide(commands, carried)`` is ``gate.department_gate``, or ``gate.user_gate`` with
    its departments, which it may read anew for every batch. Decisions go to
    ``path/decisions`` and the state change they cause to the state store; both are keyed
    by the batch, so a rerun repeats the same writes. Each batch sees the state of the
    batches before it, and of that only the buckets its entities are in. Commands of one
    entity must arrive in order across batches, as from a partitioned log. A batch is read
    from its source once.
    """
    spark = stream.sparkSession
    store = state_store(spark, path)
    store.create_or_extend()

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            ids = batch.select("entity_id").distinct()
            buckets = [r[0] for r in ids.select(bucket_of().alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
            carried = store.read(before=batch_id, where=F.col("bucket").isin(buckets)).drop("bucket").join(ids, "entity_id", "left_semi")
            decided = decide(batch, carried)
            folder = attempt(f"{path}/decisions", "batch", batch_id)
            decided.write.parquet(folder)
        finally:
            batch.unpersist()
        written = spark.read.schema(decided.schema).parquet(folder).filter(F.col("event_kind").isNotNull())
        lifecycle = F.when(F.col("event_kind").isin(spec.entity.created, spec.entity.removed), F.col("seq_nr"))
        # Only present entities and creations give events, so the entity is alive
        # unless its last lifecycle event in the batch removed it.
        alive = F.coalesce(F.max_by(F.col("event_kind") == spec.entity.created, lifecycle), F.lit(True))
        change = written.groupBy("entity_id").agg(F.max("seq_nr").alias("last_seq"), alive.alias("alive")).withColumn("bucket", bucket_of())
        store.append(change.sortWithinPartitions(*store.order), batch_id)
        if batch_id and batch_id % compact_every == 0:
            store.compact()
            store.prune()

    return project(stream, f"{spec.entity.name}Gate", checkpoint, handle, trigger)


def decisions(spark, path: str) -> DataFrame:
    """All decisions of completed batches; ``gate.events`` and ``replies`` take them."""
    return spark.read.parquet(*committed(spark, f"{path}/decisions").values())
