"""Command gates: a command log plus entity state gives events and replies.

The state before a command is decided by the last valid creation or removal ahead of it:
a creation of a present entity and a removal of an absent one do not change that, so one
running scan per entity replaces command-by-command processing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import validation
from ledgerfold.functions.codecs import utc_micros
from ledgerfold.operators import cells
from ledgerfold.operators.cells import CellPlan
from ledgerfold.operators.specs import DEPARTMENT_GATE, USER_GATE, GateSpec, Rule, Validator
from ledgerfold.session import stored

ORDER = ("cmd_ts", "cmd_id")
# Carried state sorts ahead of any command.
_BEGINNING = "0001-01-01 00:00:00"
# Lifecycle rows take ties below any command id, so they precede commands of the same time.
_LIFECYCLE_TIE = -(1 << 62)


def with_errors(commands: DataFrame, validators: Sequence[Validator]) -> DataFrame:
    """Adds ``errors``: messages of all validators that apply, in validator order, after
    those found before."""
    parts = [F.when(F.col("kind").isin(list(v.kinds)), v.errors()) for v in validators]
    found = [F.col("errors")] if "errors" in commands.columns else []
    return commands.withColumn("errors", validation.combined(found + parts))


def _pick(rules: Sequence[Rule], otherwise: str) -> tuple[Column, Column]:
    """(event kind, reply kind) of a command in one state."""
    event, reply = F.lit(None).cast("string"), F.lit(otherwise)
    invalid = F.size("errors") > 0
    for rule in rules:
        this = F.col("kind") == rule.command
        fails = F.lit(False) if rule.failure is None else invalid
        event = F.when(this, F.when(~fails, F.lit(rule.event))).otherwise(event)
        good = F.lit(rule.reply)
        reply = F.when(this, F.when(fails, F.lit(rule.failure)).otherwise(good) if rule.failure else good).otherwise(reply)
    return event, reply


def _lifecycle(spec: GateSpec) -> Column:
    """``created`` / ``removed`` for the commands that can change presence."""
    invalid = F.size("errors") > 0
    column = F.lit(None).cast("string")
    for rule in (*spec.absent, *spec.present):
        if rule.event in (spec.entity.created, spec.entity.removed):
            works = ~invalid if rule.failure else F.lit(True)
            column = F.when((F.col("kind") == rule.command) & works, F.lit(rule.event)).otherwise(column)
    return column


def plan_commands(commands: DataFrame, rows: int | None = None) -> CellPlan:
    return cells.by_time(commands.select("entity_id", *ORDER), "entity_id", *ORDER, rows=rows)


def decide(commands: DataFrame, spec: GateSpec, carried: DataFrame | None = None, plan: CellPlan | None = None) -> DataFrame:
    """Every command with ``present``, ``event_kind``, ``reply_kind`` and, for commands
    that give an event, its ``seq_nr``.

    ``commands`` has an ``errors`` column. ``carried`` (entity_id, last_seq, alive) is
    the state the log starts from: it enters as rows ahead of the commands, which need
    no join and stay balanced.
    """
    plan = plan or plan_commands(commands)
    rows = commands
    if carried is not None:
        leading = carried.select(
            "entity_id", F.lit(_BEGINNING).cast("timestamp_ntz").alias("cmd_ts"), F.lit(-1).cast("bigint").alias("cmd_id"),
            F.struct("last_seq", "alive").alias("_carried"),
        )
        rows = commands.unionByName(leading, allowMissingColumns=True)
        rows = rows.withColumn("errors", F.coalesce("errors", validation.no_errors()))
    else:
        rows = rows.withColumn("_carried", F.lit(None).cast("struct<last_seq:bigint,alive:boolean>"))
    was = F.when(F.col("_carried.alive"), F.lit(spec.entity.created)).when(~F.col("_carried.alive"), F.lit(spec.entity.removed))
    moves = F.when(F.col("_carried").isNotNull(), was).otherwise(_lifecycle(spec))
    scanned = cells.running_last(plan.apply(rows), plan, {"_before": moves}, before=True)
    present = F.coalesce(F.col("_before") == spec.entity.created, F.lit(False))
    absent_event, absent_reply = _pick(spec.absent, spec.absent_reply)
    present_event, present_reply = _pick(spec.present, spec.present_reply)
    command = F.col("_carried").isNull()
    decided = (
        scanned.withColumn("present", present)
        .withColumn("event_kind", F.when(command, F.when(F.col("present"), present_event).otherwise(absent_event)))
        .withColumn("reply_kind", F.when(F.col("present"), present_reply).otherwise(absent_reply))
    )
    emits = F.col("event_kind").isNotNull()
    numbered = cells.running_count(decided, plan, "_emitted", emits)
    start = F.lit(0)
    if carried is not None:
        numbered = cells.running_last(numbered, plan, {"_stored": F.col("_carried.last_seq")})
        numbered = numbered.filter(F.col("_carried").isNull())
        start = F.coalesce(F.col("_stored"), F.lit(0))
    numbered = numbered.withColumn("seq_nr", F.when(emits, F.col("_emitted") + start))
    return cells.uncut(numbered).drop("_carried", "_before", "_emitted", "_stored")


def events(decisions: DataFrame, spec: GateSpec) -> DataFrame:
    """Journal rows of the commands that gave an event, at the command's own time."""
    fields = [
        F.when(F.col("event_kind").isin(list(f.kinds)), F.col(f.name)).alias(f.name) for f in spec.entity.fields
    ]
    return decisions.filter(F.col("event_kind").isNotNull()).select(
        "entity_id", "seq_nr", F.col("cmd_ts").alias("ts"), F.col("event_kind").alias("kind"), *fields
    )


def with_state(decisions: DataFrame, spec: GateSpec, plan: CellPlan | None = None, secrets: bool = False) -> DataFrame:
    """Adds ``state``: the entity as it is after each command, null where it is absent.
    This is what a ``get`` command is answered with. For a log from the beginning."""
    plan = plan or plan_commands(decisions)
    fields = spec.entity.fields if secrets else spec.entity.shown
    event = F.col("event_kind")
    setters = {
        f"_after_{f.name}": F.when(event.isin(list(f.kinds)), F.struct(F.col(f.name).alias("v"))) for f in fields
    }
    scanned = cells.running_last(plan.apply(decisions), plan, setters)
    alive = F.coalesce(
        F.when(event == spec.entity.created, F.lit(True)).when(event == spec.entity.removed, F.lit(False)), F.col("present")
    )
    state = F.struct(*[F.col(f"_after_{f.name}.v").alias(f.name) for f in fields])
    return scanned.select(*decisions.columns, F.when(alive, state).alias("state"))


def department_gate(commands: DataFrame, carried: DataFrame | None = None, plan: CellPlan | None = None) -> DataFrame:
    """Decisions on department commands. There is nothing to validate."""
    return decide(commands.withColumn("errors", validation.no_errors()), DEPARTMENT_GATE, carried, plan)


def lifecycle_events(journal: DataFrame) -> DataFrame:
    """Creations and removals of a journal, for as-of lookups."""
    return journal.filter(F.col("kind").isin("created", "removed")).select("entity_id", "seq_nr", "ts", "kind")


# Lifecycle rows, and rows of the grid below, up to which departments are broadcast: about
# 30 bytes a row.
SMALL_LIFECYCLE, SMALL_GRID, GRID_CONF = 200_000, 400_000, "ledgerfold.lifecycle.rows"
# Lifecycle rows of all departments in one slice of time, about.
_PER_SLICE = 256


def department_grid(departments: DataFrame, whole: bool = False) -> tuple[DataFrame, tuple[float, ...]] | None:
    """Small enough lifecycles as one row per (department, slice of time): the state the
    slice begins with and the changes within it. None if they are too many; ``whole`` takes
    any number, for a join that need not broadcast them."""
    limit = int(departments.sparkSession.conf.get(GRID_CONF, str(SMALL_LIFECYCLE)))
    marks = departments.select(
        F.col("entity_id").alias("_dept"), "ts", utc_micros("ts").cast("double").alias("t"), "seq_nr", (F.col("kind") == "created").alias("here")
    )
    total, named = marks.agg(F.count("*"), F.count_distinct("_dept")).first()
    slices = max(1, total // _PER_SLICE)
    if whole:
        # No more rows than there are events, however many departments share the slices.
        slices = max(1, min(slices, max(total, SMALL_GRID) // max(1, named)))
    elif total > limit or named * slices > SMALL_GRID:
        return None
    at = [n / slices for n in range(1, slices)]
    splits = tuple(sorted(set(marks.stat.approxQuantile("t", at, 1 / (4 * slices))))) if at and total else ()
    placed = cells.with_bucket(marks, F.col("t"), splits, "_slice")
    change = F.struct("ts", "seq_nr", "here")
    inside = placed.groupBy("_dept", "_slice").agg(F.array_sort(F.collect_list(change)).alias("_changes"))
    every = placed.select("_dept").distinct().select("_dept", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(splits)).cast("bigint"))).alias("_slice"))
    ahead = Window.partitionBy("_dept").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    grid = every.join(inside, ["_dept", "_slice"], "left")
    last = F.last(F.element_at("_changes", -1)["here"], ignorenulls=True).over(ahead)
    return grid.select("_dept", "_slice", "_changes", F.coalesce(last, F.lit(False)).alias("_began")), splits


def with_department_exists(commands: DataFrame, departments: DataFrame, kinds: Sequence[str] = ("create", "changeDepartment"),
                           rows: int | None = None) -> DataFrame:
    """Adds ``department_exists``: was the referenced department there at command time?

    ``departments`` is the output of ``lifecycle_events``. Where they are few, checked by a
    count, they are sent to the commands: each command finds its slice of time by binary
    search and looks at the changes in it, and nothing is shuffled. Beyond that the lookup
    is one union and a running scan per department: lifecycle rows and commands meet in
    time order, and departments that take many commands are cut into cells like any hot
    key. Commands that need no lookup pass by either.

    A stream of commands meets the slices of any number of departments' events, which are
    written out once; Spark sends them or, where they are many, shuffles them by department
    and slice.
    """
    reference = F.col("department.id")
    asks = F.coalesce(F.col("kind").isin(list(kinds)) & reference.isNotNull(), F.lit(False))
    live = commands.isStreaming
    grid = department_grid(departments, live) if rows is None else None
    if grid is not None:
        known, splits = grid
        known = stored(known, "department-slices") if live else F.broadcast(known)
        sliced = cells.with_bucket(commands.withColumn("_dept", F.when(asks, reference)), utc_micros("cmd_ts"), splits, "_slice")
        found = sliced.join(known, ["_dept", "_slice"], "left")
        # At the same instant the lifecycle goes first.
        before = F.filter("_changes", lambda c: c["ts"] <= F.col("cmd_ts"))
        seen = F.try_element_at(before, F.lit(-1))["here"]
        exists = F.when(F.col("_dept").isNotNull(), F.coalesce(seen, F.col("_began"), F.lit(False)))
        return found.select(*commands.columns, exists.alias("department_exists"))
    asking = commands.filter(asks).withColumn("_dept", reference)
    tie = (F.col("seq_nr") + _LIFECYCLE_TIE).alias("cmd_id")
    marks = departments.select(F.col("entity_id").alias("_dept"), F.col("ts").alias("cmd_ts"), tie, F.col("kind").alias("_mark"))
    narrow = asking.select("_dept", *ORDER).unionByName(marks.select("_dept", *ORDER))
    plan = cells.by_time(narrow, "_dept", *ORDER, rows=rows)
    together = asking.withColumn("_mark", F.lit(None).cast("string")).unionByName(marks, allowMissingColumns=True)
    scanned = cells.running_last(plan.apply(together), plan, {"_last": F.col("_mark")})
    answered = scanned.filter(F.col("_mark").isNull()).select(
        *commands.columns, F.coalesce(F.col("_last") == "created", F.lit(False)).alias("department_exists")
    )
    if plan.cuts:
        # The gate that follows reads this more than once.
        answered = stored(answered, "answered")
    return answered.unionByName(commands.filter(~asks).withColumn("department_exists", F.lit(None).cast("boolean")))


# The address is checked ahead of any shuffle, so replies do not move addresses.
ADDRESS_VALIDATOR = Validator(("create", "changeAddress"), lambda: validation.address_errors(F.col("address")))
DEPARTMENT_VALIDATOR = Validator(
    ("create", "changeDepartment"), lambda: validation.department_errors(F.col("department"), F.col("department_exists"))
)


def user_gate(commands: DataFrame, departments: DataFrame, carried: DataFrame | None = None,
              plan: CellPlan | None = None) -> DataFrame:
    """Decisions on user commands. ``departments`` are lifecycle events of departments."""
    plan = plan or plan_commands(commands)
    checked = with_department_exists(with_errors(commands, [ADDRESS_VALIDATOR]), departments)
    return decide(with_errors(checked, [DEPARTMENT_VALIDATOR]), USER_GATE, carried, plan)


def carried_state(journal: DataFrame, spec: GateSpec) -> DataFrame:
    """What later commands need to know of a journal: last number and presence."""
    kind = F.col("kind")
    lifecycle = F.when(kind.isin(spec.entity.created, spec.entity.removed), F.col("seq_nr"))
    return journal.groupBy("entity_id").agg(
        F.max("seq_nr").alias("last_seq"),
        F.coalesce(F.max_by(kind == spec.entity.created, lifecycle), F.lit(False)).alias("alive"),
    )
