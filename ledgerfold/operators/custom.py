"""Folds in user code, for what an ``EntitySpec`` cannot say: a journal's events are handed
over in order as Arrow batches, and summaries of consecutive runs are merged as a tree, so
that neither a task nor a call ever holds all events of a hot entity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerfold.operators import cells
from ledgerfold.operators.cells import CELL, CellPlan
from ledgerfold.session import stored

#: Summaries of one entity that a step of the tree merges in one task, and rows handed on.
WIDTH, HANDED = 64, 1_000

Summary = dict


@dataclass(frozen=True)
class Fold:
    """``summarise`` takes consecutive events of one entity (an Arrow batch of ``columns``),
    ``merge`` an earlier and a later summary; it must be associative, as runs are cut anywhere.
    ``finish`` gives the result of an entity. Summaries and results are dicts of the given
    struct types. The functions run in tasks: define them inside another function, or ship
    their module."""

    columns: tuple[str, ...]
    summary: str
    result: str
    summarise: Callable[[pa.RecordBatch], Summary]
    merge: Callable[[Summary, Summary], Summary]
    finish: Callable[[Summary], dict]


def _merging(take, merge, schema: pa.Schema, once: bool):
    """Rows (entity, group, number, ...) sorted by the first three to one row (entity, group,
    summary) per group. ``take`` gives the summary of consecutive rows; with ``once``, a
    number that comes again is skipped. Made here, so that it reaches the workers by value."""
    handed = HANDED

    def task(batches):
        now, merged, last, done = None, None, None, []

        def given():
            rows = [{schema.names[0]: k[0], schema.names[1]: k[1], schema.names[2]: s} for k, s in done]
            done.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            entities = batch.column(0)
            codes = entities.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            groups, numbers = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            changes = np.flatnonzero((codes[1:] != codes[:-1]) | (groups[1:] != groups[:-1])) + 1
            events = batch.select(batch.schema.names[3:])
            for first, end in zip([0, *changes.tolist()], [*changes.tolist(), size]):
                key = (entities[first].as_py(), int(groups[first]))
                if now is not None and key != now:
                    done.append((now, merged))
                    merged = last = None
                now = key
                part, own = events.slice(first, end - first), numbers[first:end]
                if once:
                    new = np.ones(end - first, bool)
                    new[1:] = own[1:] != own[:-1]
                    new[0] = last is None or own[0] != last
                    part = part if new.all() else part.filter(pa.array(new))
                last = own[-1]
                if part.num_rows:
                    summary = take(part)
                    merged = summary if merged is None else merge(merged, summary)
            if len(done) >= handed:
                yield given()
        if now is not None:
            done.append((now, merged))
        yield given()

    return task


def _stepped(merge):
    def take(rows: pa.RecordBatch):
        merged = None
        for summary in rows.column(0).to_pylist():
            merged = summary if merged is None else merge(merged, summary)
        return merged

    return take


def _finished(finish, schema: pa.Schema):
    def task(batches):
        for batch in batches:
            rows = [{schema.names[0]: k, **finish(s)} for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return task


def fold(journal: DataFrame, by: Fold, key: str = "entity_id", seq: str = "seq_nr", plan: CellPlan | None = None) -> DataFrame:
    """One row per entity: ``key`` and the columns of the result.

    Rows are numbered 1, 2, 3, ... per entity; a repeated number counts once. Uncut entities
    take one shuffle. Hot ones are cut into cells, each summarised by itself, and the
    summaries merged ``WIDTH`` at a time: no task gets more than a cell of events or that many
    summaries of one entity. A null entity is one like any other; nulls in events reach
    ``summarise`` as they are. An empty journal gives no rows.
    """
    plan = plan or cells.by_sequence(journal, key, seq)
    cut = plan.apply(journal.select(key, *dict.fromkeys([seq, *[c for c in by.columns if c != key]])))
    cut = cut if plan.cuts else cut.withColumn(CELL, F.lit(0).cast("bigint"))
    entity = T.StructField(key, journal.schema[key].dataType)
    shape = T.StructType([entity, T.StructField(CELL, T.LongType()), T.StructField("_summary", T.StructType.fromDDL(by.summary))])
    arrow = to_arrow_schema(shape)

    numbered = cut.select(key, CELL, F.col(seq).cast("bigint").alias("_number"), *by.columns)
    ordered = numbered.repartition(key, CELL).sortWithinPartitions(key, CELL, "_number")
    found = ordered.mapInArrow(_merging(by.summarise, by.merge, arrow, True), shape)
    if plan.cuts:
        found = stored(found, "summaries")
        most = found.agg(F.max(CELL)).first()[0] or 0
        while most > 0:
            upper = found.select(key, F.floor(F.col(CELL) / WIDTH).cast("bigint").alias("_group"), F.col(CELL).alias("_number"), "_summary")
            placed = upper.repartition(key, "_group").sortWithinPartitions(key, "_group", "_number")
            found = placed.mapInArrow(_merging(_stepped(by.merge), by.merge, arrow, False), shape)
            most //= WIDTH
    result = T.StructType([entity, *T.StructType.fromDDL(by.result).fields])
    return found.select(key, "_summary").mapInArrow(_finished(by.finish, to_arrow_schema(result)), result)


def longest_run(column: str = "kind", seq: str = "seq_nr") -> Fold:
    """Per entity the longest run of consecutive events with one value of ``column``: the
    value, the number of events and the first one's number; of equal runs the earliest."""
    run = f"struct<{column}: string, n: bigint, first_seq: bigint>"

    def better(runs):
        return max(runs, key=lambda r: (r["n"], -r["first_seq"]))

    def summarise(events):
        values, numbers = events[column].to_pylist(), events[seq].to_pylist()
        runs, at = [], 0
        for value, held in groupby(values):
            size = sum(1 for _ in held)
            runs.append({column: value, "n": size, "first_seq": numbers[at]})
            at += size
        return {"first": runs[0], "last": runs[-1], "best": better(runs), "whole": len(runs) == 1}

    def merge(a, b):
        if a["last"][column] != b["first"][column]:
            return {"first": a["first"], "last": b["last"], "best": better([a["best"], b["best"]]), "whole": False}
        joined = {**a["last"], "n": a["last"]["n"] + b["first"]["n"]}
        return {
            "first": joined if a["whole"] else a["first"], "last": joined if b["whole"] else b["last"],
            "best": better([a["best"], joined, b["best"]]), "whole": a["whole"] and b["whole"],
        }

    def finish(summary):
        return summary["best"]

    return Fold((column, seq), f"first {run}, last {run}, best {run}, whole boolean", f"{column} string, n bigint, first_seq bigint", summarise, merge, finish)
