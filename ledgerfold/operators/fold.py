"""The view fold: upsert semantics, one associative aggregate.

An update on a missing row inserts it with default values, a removal deletes it, and a
later event of any kind brings it back. Per entity it is enough to know the last event,
the last removal and, per field, the last event that set it. These merge in any order
and grouping, so map-side partial aggregation bounds what a hot entity ships, partial
results can be stored and merged later, and replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators.specs import EntitySpec, Field


def _seq(f: Field) -> str:
    return f"{f.name}_seq"


def summarise(journal: DataFrame, spec: EntitySpec) -> DataFrame:
    """Mergeable summary per entity. Works on batch and streaming frames."""
    seq, kind = F.col("seq_nr"), F.col("kind")
    sets = {f.name: F.when(kind.isin(list(f.kinds)), seq) for f in spec.fields}
    return journal.groupBy("entity_id").agg(
        F.max(seq).alias("last_seq"),
        F.coalesce(F.max(F.when(kind == spec.removed, seq)), F.lit(0)).alias("removed_seq"),
        *[F.max(sets[f.name]).alias(_seq(f)) for f in spec.fields],
        # max_by keeps a null value, so a cleared field wins over an older value.
        *[F.max_by(f.name, sets[f.name]).alias(f.name) for f in spec.fields],
    )


def merge(summaries: DataFrame, spec: EntitySpec) -> DataFrame:
    """Summaries of the same entity become one."""
    return summaries.groupBy("entity_id").agg(
        F.max("last_seq").alias("last_seq"),
        F.max("removed_seq").alias("removed_seq"),
        *[F.max(_seq(f)).alias(_seq(f)) for f in spec.fields],
        *[F.max_by(f.name, _seq(f)).alias(f.name) for f in spec.fields],
    )


def finish(summaries: DataFrame, spec: EntitySpec, secrets: bool = False) -> DataFrame:
    """Live rows of a view. Secret fields stay out unless asked for."""
    fields = spec.fields if secrets else spec.shown
    values = [
        F.when(F.col(_seq(f)) > F.col("removed_seq"), F.col(f.name)).otherwise(F.lit(f.default).cast(f.dtype)).alias(f.name)
        for f in fields
    ]
    return summaries.filter(F.col("last_seq") > F.col("removed_seq")).select(F.col("entity_id").alias("id"), *values)


def summary_schema(spec: EntitySpec) -> str:
    """Columns of a summary, as DDL."""
    numbers = ["entity_id string", "last_seq bigint", "removed_seq bigint"] + [f"{_seq(f)} bigint" for f in spec.fields]
    return ", ".join(numbers + [f"{f.name} {f.dtype}" for f in spec.fields])


def view_fold(journal: DataFrame, spec: EntitySpec, secrets: bool = False) -> DataFrame:
    """Current view rows of a journal."""
    return finish(summarise(journal, spec), spec, secrets)


def merge_view(view: DataFrame, delta: DataFrame) -> DataFrame:
    """Replace view rows by a batch of changed rows (``deleted`` marks removals)."""
    kept = view.join(delta.select("id"), "id", "left_anti")
    return kept.unionByName(delta.filter(~F.col("deleted")).drop("deleted"))
