"""Continuous projections: read models and topics kept up with a journal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.operators import fold
from ledgerfold.operators.specs import EntitySpec
from ledgerfold.sources import topics
from ledgerfold.sources.store import ViewStore

# Batches between two compactions of a read model.
COMPACT_EVERY = 100


def project(stream: DataFrame, name: str, checkpoint: str, handler: Callable[[DataFrame, int], None],
            trigger: dict | None = None, mode: str = "append") -> StreamingQuery:
    """Run any batch handler over a journal stream, resuming from ``checkpoint``. A
    batch may come again after a failure, so the handler must be repeatable. An error in
    the handler fails the batch; nothing is skipped."""
    return (
        stream.writeStream.queryName(name).outputMode(mode).foreachBatch(handler).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def build_view(stream: DataFrame, store: ViewStore, checkpoint: str, trigger: dict | None = None,
               compact_every: int = COMPACT_EVERY, ledger: bool = False, first_batch: int = 0) -> StreamingQuery:
    """Keep a read model current.

    Each batch is folded by itself and appended; the fold is associative, so late,
    repeated and reordered events need no state between batches. With ``ledger`` the read
    model also keeps how far each tag got, committed with the batch: ``store.offsets`` tells
    it, ``journal.lag`` what is still to come, and ``journal.beyond`` lets a query without
    the old checkpoint go on. Such a query numbers its batches from 0 again and needs
    ``first_batch``.
    """
    store.create_or_extend()

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch_id += first_batch
        if ledger:
            batch.persist()  # folded, and asked for its offsets
        try:
            store.apply(batch, batch_id, ledger)
        finally:
            if ledger:
                batch.unpersist()
        if batch_id and batch_id % compact_every == 0:
            store.compact()
            store.prune()

    return project(stream, f"{store.spec.name}View", checkpoint, handle, trigger)


def fold_view(stream: DataFrame, store: ViewStore, checkpoint: str, trigger: dict | None = None,
              compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Keep a read model current, with the fold itself in the state store.

    The summaries of all entities, removed ones too, are the state of a streaming aggregate
    in update mode, so a batch writes one whole summary for each entity that it touches and
    a restart goes on from the checkpoint. Late, repeated and reordered events change a
    summary as they would have in order. The rows that ``store`` collects replace each other,
    and its reads and compactions are those of ``build_view``.
    """
    store.create_or_extend()

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, batch_id)
        if batch_id and batch_id % compact_every == 0:
            store.compact()
            store.prune()

    return project(fold.summarise(stream, store.spec), f"{store.spec.name}Fold", checkpoint, handle, trigger, "update")


def once(stream: DataFrame, within: str | None = None) -> DataFrame:
    """Each event of a journal stream the first time it comes, by entity and number.

    The numbers seen are state and survive a restart. Without ``within`` they are kept for
    good; with it (an interval such as "1 day", of event time) they are dropped once the
    stream is that far beyond them, and repeats must come within it.
    """
    keys = ["entity_id", "seq_nr"]
    if within is None:
        return stream.dropDuplicates(keys)
    timed = stream.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", within)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_at")


def republish(stream: DataFrame, spec: EntitySpec, topic: str, checkpoint: str, sink: str = "parquet",
              trigger: dict | None = None, unique: bool = False, within: str | None = None, **options: str) -> StreamingQuery:
    """Send every event on as a keyed record: stateless and, if the journal repeats an
    event, as often as it comes. ``unique`` sends each event ``once``; whether a batch that
    fails half way is sent again is up to the sink (files are not, topics are)."""
    rows = topics.records(once(stream, within) if unique else stream, spec, topic)
    return topics.write_stream(rows, checkpoint, sink, f"{spec.name}Topic", trigger, **options)
