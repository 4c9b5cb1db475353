"""Relations over a journal: reads, tags, buckets, progress, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.codecs import time_bucket
from ledgerfold.functions.ids import SHARDS, all_tags, shard_tag, stored_tags, tags_of_id
from ledgerfold.operators import cells
from ledgerfold.operators.cells import CellPlan
from ledgerfold.operators.specs import EntitySpec


def with_tags(journal: DataFrame, spec: EntitySpec, shards: int = SHARDS, safe: bool = False) -> DataFrame:
    """Adds the partition columns ``tag`` and ``timebucket``."""
    return journal.withColumn("tag", shard_tag(F.col("entity_id"), spec.base_tag, shards, safe)).withColumn(
        "timebucket", time_bucket(F.col("ts"))
    )


def by_entity(journal: DataFrame, spec: EntitySpec, entity_id: str, from_seq: int = 0, shards: int = SHARDS) -> DataFrame:
    """Events of one entity from a number on (included), in order. The tag predicate
    prunes partitions of a stored journal; the rest is pushed to the scan."""
    rows = journal.filter((F.col("entity_id") == entity_id) & (F.col("seq_nr") >= from_seq))
    if "tag" in journal.columns:
        rows = rows.filter(F.col("tag").isin(tags_of_id(entity_id, spec.base_tag, shards)))
    return rows if journal.isStreaming else rows.orderBy("seq_nr")


def by_tag(journal: DataFrame, tag: str) -> DataFrame:
    """Events of one shard, batch or stream."""
    return journal.filter(F.col("tag") == tag)


def from_offsets(journal: DataFrame, offsets: DataFrame, plan: CellPlan | None = None) -> DataFrame:
    """Events at or after each entity's stored offset; all events where none is stored.
    ``offsets`` (entity_id, offset) has one row per entity. The last handled event is
    read again, which the folds tolerate. A streamed journal is joined with the offsets as
    they are when the query starts, and is not counted first."""
    if journal.isStreaming:
        known = offsets.select(F.col("entity_id").alias("_entity"), F.col("offset").alias("_offset"))
        resumed = journal.join(known, F.col("entity_id").eqNullSafe(F.col("_entity")), "left")
        return resumed.filter(F.col("seq_nr") >= F.coalesce(F.col("_offset"), F.lit(0))).select(*journal.columns)
    plan = plan or cells.by_sequence(journal)
    wanted = [c for c in journal.columns if c != cells.CELL]
    resumed = cells.join_unique(journal, offsets.select("entity_id", F.col("offset").alias("_offset")), plan)
    return resumed.filter(F.col("seq_nr") >= F.coalesce(F.col("_offset"), F.lit(0))).select(*wanted)


def since(journal: DataFrame, bucket: str) -> DataFrame:
    """Events from a time bucket on; a partition filter on stored journals."""
    return journal.filter(F.col("timebucket") >= bucket)


def after(journal: DataFrame, ts: str) -> DataFrame:
    """Events later than an instant; the bucket predicate prunes a stored journal."""
    at = F.lit(ts).cast("timestamp_ntz")
    return since(journal.filter(F.col("ts") > at), f"{ts[:4]}{ts[5:7]}{ts[8:10]}T{ts[11:13]}:00")


def envelopes(journal: DataFrame) -> DataFrame:
    """Offset and creation time of every event."""
    return journal.select("entity_id", F.col("seq_nr").alias("offset"), F.col("ts").alias("created_at"))


def number_events(log: DataFrame, key: str = "entity_id", ts: str = "ts", tie: str = "event_id",
                  name: str = "seq_nr") -> tuple[DataFrame, CellPlan]:
    """Number the rows of each key 1, 2, 3, ... by time. Further scans that use the plan
    run in the same order, so they reuse its cells, the shuffle and the sort."""
    plan = cells.by_time(log.select(key, ts, tie), key, ts, tie)
    return cells.running_count(plan.apply(log), plan, name), plan


def tag_view(journal: DataFrame, plan: CellPlan | None = None) -> DataFrame:
    """The journal by (tag, time bucket) with a running number per (tag, entity). An
    entity has one tag, so numbering per entity numbers per (tag, entity)."""
    plan = plan or cells.by_sequence(journal)
    return cells.uncut(cells.running_count(plan.apply(journal), plan, "tag_pid_sequence_nr"))


def tag_write_progress(tagged: DataFrame) -> DataFrame:
    """How far each entity got within its tag."""
    return tagged.groupBy("entity_id", "tag").agg(
        F.max("seq_nr").alias("seq_nr"),
        F.max("tag_pid_sequence_nr").alias("tag_pid_sequence_nr"),
        F.max("ts").alias("offset"),
    )


def entity_ids(journal: DataFrame) -> DataFrame:
    return journal.select("entity_id").distinct()


#: The last event of a tag, as a projection keeps it.
OFFSETS = "tag string, ts timestamp_ntz, entity_id string, seq_nr bigint"


def tag_offsets(journal: DataFrame) -> DataFrame:
    """Last event per tag, by time, entity and number."""
    return journal.groupBy("tag").agg(F.max(F.struct("ts", "entity_id", "seq_nr")).alias("at")).select("tag", "at.*")


def merge_offsets(offsets: DataFrame) -> DataFrame:
    """Offsets of several batches as one: they merge like the events that they stand for."""
    return tag_offsets(offsets)


def projection_offsets(journal: DataFrame, spec: EntitySpec) -> DataFrame:
    """Last event per (projection, tag), by time, entity and number."""
    names = F.array(*[F.lit(p) for p in spec.projections])
    return tag_offsets(journal).select(F.explode(names).alias("projection"), "*")


def beyond(journal: DataFrame, offsets: DataFrame) -> DataFrame:
    """Events at or after the offset of their tag, and all of a tag without one; batch or
    stream. What a projection that has lost its checkpoint must read: the last event comes
    again, which the folds tolerate. Offsets are one row per tag and go by broadcast."""
    known = offsets.select(F.col("tag").alias("_tag"), F.struct("ts", "entity_id", "seq_nr").alias("_at"))
    joined = journal.join(F.broadcast(known), F.col("tag").eqNullSafe(F.col("_tag")), "left")
    reached = F.col("_at").isNull() | (F.struct("ts", "entity_id", "seq_nr") >= F.col("_at"))
    return joined.filter(reached).select(*journal.columns)


def lag(journal: DataFrame, offsets: DataFrame) -> DataFrame:
    """tag, lag: the events of each tag that a projection with these offsets still lacks."""
    known = offsets.select(F.col("tag").alias("_tag"), F.struct("ts", "entity_id", "seq_nr").alias("_at"))
    joined = journal.join(F.broadcast(known), F.col("tag").eqNullSafe(F.col("_tag")), "left")
    lacks = F.col("_at").isNull() | (F.struct("ts", "entity_id", "seq_nr") > F.col("_at"))
    return joined.groupBy("tag").agg(F.count_if(lacks).alias("lag"))


def time_buckets(journal: DataFrame) -> DataFrame:
    return journal.groupBy("tag", "timebucket").agg(F.count("*").alias("events"))


def tags_of(spark, spec: EntitySpec, shards: int = SHARDS) -> DataFrame:
    return spark.range(1).select(F.explode(all_tags(spec.base_tag, shards)).alias("tag"))


def union_of_tags(journal: DataFrame, spec: EntitySpec, shards: int = SHARDS) -> DataFrame:
    """The whole log as the union of its shards, in one scan."""
    return journal.filter(F.col("tag").isin(stored_tags(spec.base_tag, shards)))
