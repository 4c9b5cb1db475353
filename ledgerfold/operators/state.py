"""The guarded fold: what an entity itself believes after its events.

Only a creation counts while the entity is absent, a creation is ignored while it is
present, a removal makes it absent and it may be created again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.operators import cells
from ledgerfold.operators.cells import CellPlan
from ledgerfold.operators.specs import EntitySpec


def _lifecycle(spec: EntitySpec) -> Column:
    return F.when(F.col("kind").isin(spec.created, spec.removed), F.col("kind"))


def state_before(journal: DataFrame, spec: EntitySpec, plan: CellPlan | None = None) -> tuple[DataFrame, CellPlan]:
    """Adds ``present`` (was the entity there before this event?) and ``effective``
    (did the event change anything?). The state before an event is the last lifecycle
    event ahead of it, whether or not that one was itself effective."""
    plan = plan or cells.by_sequence(journal)
    scanned = cells.running_last(plan.apply(journal), plan, {"_lifecycle": _lifecycle(spec)}, before=True)
    present = F.coalesce(F.col("_lifecycle") == spec.created, F.lit(False))
    creating = F.col("kind") == spec.created
    return scanned.withColumn("present", present).withColumn("effective", creating != present).drop("_lifecycle"), plan


def _folded(journal: DataFrame, spec: EntitySpec, plan: CellPlan | None) -> DataFrame:
    """Per entity: last number, whether present, and the fields by effective events."""
    marked, _ = state_before(journal, spec, plan)
    seq, kind, works = F.col("seq_nr"), F.col("kind"), F.col("effective")
    return marked.groupBy("entity_id").agg(
        F.max(seq).alias("last_seq"),
        F.coalesce(F.max_by(kind == spec.created, F.when(_lifecycle(spec).isNotNull(), seq)), F.lit(False)).alias("present"),
        *[F.max_by(f.name, F.when(works & kind.isin(list(f.kinds)), seq)).alias(f.name) for f in spec.fields],
    )


def state_fold(journal: DataFrame, spec: EntitySpec, secrets: bool = False, plan: CellPlan | None = None) -> DataFrame:
    """Entities present at the end, with their fields."""
    fields = [f.name for f in (spec.fields if secrets else spec.shown)]
    return _folded(journal, spec, plan).filter("present").select(F.col("entity_id").alias("id"), "last_seq", *fields)


def state_as_of(journal: DataFrame, spec: EntitySpec, seq_nr: int | None = None, ts: str | None = None,
                secrets: bool = False, plan: CellPlan | None = None) -> DataFrame:
    """State after the events up to a sequence number and/or an instant, both included."""
    if seq_nr is not None:
        journal = journal.filter(F.col("seq_nr") <= seq_nr)
    if ts is not None:
        journal = journal.filter(F.col("ts") <= F.lit(ts).cast("timestamp_ntz"))
    return state_fold(journal, spec, secrets, plan)


def read_state(journal: DataFrame, spec: EntitySpec, entity_id: str) -> DataFrame:
    """Write-side state of one entity. The filter goes to the scan."""
    return state_fold(journal.filter(F.col("entity_id") == entity_id), spec)


def history(journal: DataFrame, spec: EntitySpec, secrets: bool = False, plan: CellPlan | None = None) -> DataFrame:
    """State after every event. Fields are null where the entity is absent."""
    fields = spec.fields if secrets else spec.shown
    marked, plan = state_before(journal, spec, plan)
    kind = F.col("kind")
    # The struct makes a cleared (null) value count as a value.
    setters = {
        f"_after_{f.name}": F.when(F.col("effective") & kind.isin(list(f.kinds)), F.struct(F.col(f.name).alias("v")))
        for f in fields
    }
    scanned = cells.running_last(marked, plan, setters)
    alive = F.when(kind == spec.created, F.lit(True)).when(kind == spec.removed, F.lit(False)).otherwise(F.col("present"))
    return scanned.select(
        "entity_id", "seq_nr", "ts", "kind", alive.alias("present"),
        *[F.when(alive, F.col(f"_after_{f.name}.v")).alias(f.name) for f in fields],
    )


def snapshots(journal: DataFrame, spec: EntitySpec, every: int = 100, keep: int = 2,
              plan: CellPlan | None = None) -> DataFrame:
    """State at every ``every``-th event, the latest ``keep`` per entity.

    Numbers are dense, so the latest ``keep`` points differ in (point modulo keep): one
    maximum per residue keeps exactly these, by a partial aggregate and no window.
    """
    points = history(journal, spec, secrets=True, plan=plan).filter(F.col("seq_nr") % every == 0)
    columns = ["seq_nr", "ts", "present", *[f.name for f in spec.fields]]
    slot = F.floor(F.col("seq_nr") / every) % keep
    latest = points.groupBy("entity_id", slot.alias("_slot")).agg(F.max_by(F.struct(*columns), "seq_nr").alias("s"))
    return latest.select("entity_id", "s.*")


def checkpoint(journal: DataFrame, spec: EntitySpec, ts: str, plan: CellPlan | None = None) -> DataFrame:
    """Every entity as it is at an instant, absent ones included: a snapshot from which a
    recovery needs no event of that instant or before."""
    upto = journal.filter(F.col("ts") <= F.lit(ts).cast("timestamp_ntz"))
    return _folded(upto, spec, plan).select(
        "entity_id", F.col("last_seq").alias("seq_nr"), F.lit(ts).cast("timestamp_ntz").alias("ts"), "present", *[f.name for f in spec.fields]
    )


def resume(taken: DataFrame, tail: DataFrame, spec: EntitySpec, secrets: bool = False) -> DataFrame:
    """State from a checkpoint and the events after it. Of a stored journal only the
    buckets of the tail are read."""
    names = [f.name for f in spec.fields]
    kind = F.when(F.col("present"), F.lit(spec.created)).otherwise(F.lit(spec.removed))
    leading = taken.select("entity_id", "seq_nr", "ts", kind.alias("kind"), *names)
    return state_fold(leading.unionByName(tail.select("entity_id", "seq_nr", "ts", "kind", *names)), spec, secrets)


def recover(taken: DataFrame, journal: DataFrame, spec: EntitySpec, secrets: bool = False,
            plan: CellPlan | None = None) -> DataFrame:
    """State from the latest snapshot of each entity and the events after it.

    A snapshot enters the fold as the event that would have produced it: a creation
    with all fields, or a removal.
    """
    names = [f.name for f in spec.fields]
    newest = taken.groupBy("entity_id").agg(F.max_by(F.struct("seq_nr", "ts", "present", *names), "seq_nr").alias("s"))
    kind = F.when(F.col("s.present"), F.lit(spec.created)).otherwise(F.lit(spec.removed))
    leading = newest.select("entity_id", "s.seq_nr", "s.ts", kind.alias("kind"), *[f"s.{n}" for n in names])
    plan = plan or cells.by_sequence(journal)
    known = newest.select("entity_id", F.col("s.seq_nr").alias("_from"))
    tail = cells.join_unique(journal.select("entity_id", "seq_nr", "ts", "kind", *names), known, plan)
    tail = tail.filter(F.col("seq_nr") > F.coalesce(F.col("_from"), F.lit(0))).drop("_from")
    return state_fold(leading.unionByName(tail), spec, secrets, plan=plan.by_number())
