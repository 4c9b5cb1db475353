"""The command gate with its state kept per entity in Spark's state store.

Unlike ``streaming.gate``, whose state is a table that batches read and merge, the state of
an entity is looked up by its key, changed in place and checkpointed with the offsets: a
micro-batch is one shuffle of its commands by entity and one append of its decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.operators import gate
from ledgerfold.operators.specs import GateSpec
from ledgerfold.session import rocksdb_state

CARRIED = "last_seq bigint, alive boolean"
_DECIDED = [
    T.StructField("present", T.BooleanType()), T.StructField("event_kind", T.StringType()),
    T.StructField("reply_kind", T.StringType()), T.StructField("seq_nr", T.LongType()),
]


def _decider(spec: GateSpec, names: list[str]):
    """The stateful processor of a gate, which returns rows of ``names``. It is made here, so that it reaches the workers by
    value and they need not have this package."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    rules = {
        alive: {r.command: (r.event, r.reply, r.failure) for r in chosen}
        for alive, chosen in ((False, spec.absent), (True, spec.present))
    }
    default = {False: (None, spec.absent_reply, None), True: (None, spec.present_reply, None)}
    created, removed, shape = spec.entity.created, spec.entity.removed, CARRIED
    decided = Row(*names)

    class Decider(StatefulProcessor):
        def init(self, handle) -> None:
            self.carried = handle.getValueState("carried", shape)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.carried.update((initialState["last_seq"], initialState["alive"]))

        def handleInputRows(self, key, rows, timerValues):
            last, alive = tuple(self.carried.get()) if self.carried.exists() else (0, False)
            # The commands of one entity in one micro-batch, in their order.
            for row in sorted(rows, key=lambda r: (r["cmd_ts"], r["cmd_id"])):
                event, reply, failure = rules[alive].get(row["kind"], default[alive])
                if failure is not None and row["_failed"]:
                    event, reply = None, failure
                present, number = alive, None
                if event is not None:
                    last += 1
                    number, alive = last, event == created or (alive and event != removed)
                yield decided(*row[:-1], present, event, reply, number)
            self.carried.update((last, alive))

        def close(self) -> None:
            pass

    return Decider()


def decide(commands: DataFrame, spec: GateSpec, carried: DataFrame | None = None) -> DataFrame:
    """``gate.decide`` over a stream: every command with ``present``, ``event_kind``,
    ``reply_kind`` and ``seq_nr``, as they come.

    ``commands`` is a stream with an ``errors`` column. Commands of one entity must arrive
    in order across micro-batches, as from a partitioned log; within one they are sorted by
    (time, id), so a micro-batch's commands of one entity must fit a task: bound it by the
    source's files or offsets per trigger. ``carried`` (entity_id, last_seq, alive) is the
    state that a first run starts from, as ``gate.carried_state`` gives it. A null entity
    id is an entity.
    """
    kept = [c for c in commands.columns if c != "errors"]
    rows = commands.select(*kept, (F.size("errors") > 0).alias("_failed"))
    shape = T.StructType([*commands.select(*kept).schema.fields, *_DECIDED])
    start = carried.select("entity_id", "last_seq", "alive").groupBy("entity_id") if carried is not None else None
    return rows.groupBy("entity_id").transformWithState(_decider(spec, shape.names), shape, "Append", "None", start)


def user_commands(commands: DataFrame, departments: DataFrame) -> DataFrame:
    """Streamed user commands with their ``errors``. ``departments`` are lifecycle events
    as they are when the query starts; where they change while it runs, use
    ``streaming.gate``, which reads them for every batch. They may be any number, unless the
    session sets a limit to them."""
    checked = gate.with_errors(commands, [gate.ADDRESS_VALIDATOR])
    if commands.sparkSession.conf.get(gate.GRID_CONF, None) and gate.department_grid(departments) is None:
        raise ValueError("too many department events to send to a stream of commands: use streaming.gate")
    return gate.with_errors(gate.with_department_exists(checked, departments), [gate.DEPARTMENT_VALIDATOR])


def run(commands: DataFrame, spec: GateSpec, path: str, checkpoint: str, carried: DataFrame | None = None,
        trigger: dict | None = None) -> StreamingQuery:
    """Decide a stream of commands (with ``errors``) and append the decisions to
    ``path/decisions``. The sink's log names the files of completed batches, so a batch that
    is run again after a failure appears once. The state is in RocksDB, the only store that
    keeps state by key and name."""
    writer = decide(commands, spec, carried).writeStream.queryName(f"{spec.entity.name}KeyedGate").format("parquet")
    writer = writer.option("path", f"{path}/decisions").option("checkpointLocation", checkpoint)
    with rocksdb_state(commands.sparkSession):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """The decisions of completed batches; ``gate.events`` and ``replies`` take them."""
    return spark.read.parquet(f"{path}/decisions")


def carried_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """entity_id, last_seq and alive of every entity, as the state store holds them: what
    another run, or a batch of commands, can start from."""
    state = spark.read.format("statestore").option("stateVarName", "carried").load(checkpoint)
    return state.select("key.entity_id", "value.last_seq", "value.alive")
