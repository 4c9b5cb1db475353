"""Events as keyed records for a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.operators.specs import EntitySpec

# Topic names.
USER_TOPIC = "c-user"
DEPARTMENT_TOPIC = "c-department"


def records(journal: DataFrame, spec: EntitySpec, topic: str) -> DataFrame:
    """topic, key = entity id, value = the event as JSON with only its kind's fields."""
    payload = [F.when(F.col("kind").isin(list(f.kinds)), F.col(f.name)).alias(f.name) for f in spec.shown]
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")
    value = F.to_json(F.struct("entity_id", "seq_nr", at, "kind", *payload), {"ignoreNullFields": "false"})
    return journal.select(F.lit(topic).alias("topic"), F.col("entity_id").alias("key"), value.alias("value"))


def write_stream(rows: DataFrame, checkpoint: str, sink: str = "parquet", name: str | None = None, trigger: dict | None = None,
                 **options: str) -> StreamingQuery:
    writer = rows.writeStream.format(sink).outputMode("append").options(**options).option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return writer.trigger(**(trigger or {"availableNow": True})).start()
