"""Ordered scans per key that stay balanced when one key holds most of the rows.

A window over ``partitionBy(key).orderBy(...)`` sorts a whole key in one task. Here a
key with many rows is cut into *cells*, consecutive runs along the order with a bounded
number of rows. The window then runs per (key, cell), and what earlier cells hand on
(the last value seen, the number of rows) comes from a small aggregate: one row per cell.

Keys below the bound are not cut, and on data where no key exceeds it the plan is the
plain window. The check reads the row count (Parquet footers) and, only if the whole
input exceeds the bound, one narrow column with map-side counts.

What cells hand on is written out before the scan that uses it: its size is then known
to the planner, and scans that follow each other do not recompute one another.

A cell never holds more than the bound, whatever the total: if the keys above it are too
many to list on the driver, every key is cut the same way. A null key is a key like any
other.

Cutting decides where rows are processed, never what the result is.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerfold.functions.codecs import utc_micros
from ledgerfold.session import stored

CELL = "_cell"
CELL_ROWS = 5_000_000
MAX_HOT_KEYS = 10_000
CELL_ROWS_CONF = "ledgerfold.cell.rows"


def _cell_rows(df: DataFrame, rows: int | None) -> int:
    return rows or int(df.sparkSession.conf.get(CELL_ROWS_CONF, str(CELL_ROWS)))


def _heavy_keys(df: DataFrame, key: str, rows: int) -> tuple[tuple, bool, int]:
    """(keys with more than ``rows`` rows, whether they are all keys, rows to cut). Above
    MAX_HOT_KEYS the list is not made, and all keys count as such."""
    counts = df.groupBy(key).count().filter(F.col("count") > rows)
    found = counts.limit(MAX_HOT_KEYS + 1).collect()
    if len(found) > MAX_HOT_KEYS:
        return (), True, df.count()
    return tuple(r[0] for r in found), False, sum(r[1] for r in found)


def with_bucket(df: DataFrame, value: Column, splits: tuple[float, ...], out: str) -> DataFrame:
    """Order-preserving slice number of ``value`` by binary search in ``splits``."""
    if not splits:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    bounds = [float("-inf"), *splits, float("inf")]
    prepared = df.withColumn("_slice_in", F.coalesce(value.cast("double"), F.lit(float("-inf"))))
    sliced = Bucketizer(splits=bounds, inputCol="_slice_in", outputCol="_slice_out").transform(prepared)
    return sliced.withColumn(out, F.col("_slice_out").cast("bigint")).drop("_slice_in", "_slice_out")


@dataclass(frozen=True)
class CellPlan:
    """How the rows of a key are ordered and, for ``hot`` keys, cut."""

    key: str
    order: tuple[str, ...]
    hot: tuple = ()
    rows: int = 0
    splits: tuple[float, ...] = ()
    tied: tuple[float, ...] = ()
    tie_splits: tuple[float, ...] = ()
    by_sequence: bool = False
    every: bool = False

    @property
    def cuts(self) -> bool:
        return self.every or bool(self.hot)

    @property
    def columns(self) -> list[str]:
        return [self.key, CELL] if self.cuts else [self.key]

    def is_hot(self) -> Column:
        if self.every:
            return F.lit(True)
        listed = F.coalesce(F.col(self.key).isin([k for k in self.hot if k is not None]), F.lit(False))
        return listed | F.col(self.key).isNull() if None in self.hot else listed

    def apply(self, df: DataFrame) -> DataFrame:
        """Add the cell number. Unchanged when no key needs cutting or rows have one."""
        if not self.cuts or CELL in df.columns:
            return df
        if self.by_sequence:
            cell = F.floor((F.col(self.order[0]) - 1) / self.rows).cast("bigint")
            return df.withColumn(CELL, F.when(self.is_hot(), cell).otherwise(F.lit(0)))
        ts, tie = self.order
        df = with_bucket(df, utc_micros(ts), self.splits, "_ts_slice")
        df = with_bucket(df, F.col(tie), self.tie_splits, "_tie_slice")
        inner = F.when(utc_micros(ts).cast("double").isin(list(self.tied)), F.col("_tie_slice")) if self.tied else F.lit(None)
        cell = F.col("_ts_slice") * (len(self.tie_splits) + 1) + F.coalesce(inner.cast("bigint"), F.lit(0))
        return df.withColumn(CELL, F.when(self.is_hot(), cell).otherwise(F.lit(0))).drop("_ts_slice", "_tie_slice")

    def by_number(self, seq: str = "seq_nr") -> CellPlan:
        """Cells of the same keys by ranges of their dense numbers, for rows that carry
        no cell column."""
        return replace(self, order=(seq,), by_sequence=True)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.columns).orderBy(*self.order)


def by_sequence(df: DataFrame, key: str = "entity_id", seq: str = "seq_nr", rows: int | None = None) -> CellPlan:
    """Cells for rows numbered 1, 2, 3, ... per key: a cell is a range of numbers."""
    size = _cell_rows(df, rows)
    if df.count() <= size:
        return CellPlan(key, (seq,))
    # The filter reaches the scan: row groups of short keys are skipped by statistics.
    hot, every, _ = _heavy_keys(df.filter(F.col(seq) > size), key, 0)
    return CellPlan(key, (seq,), hot, size, by_sequence=True, every=every)


def by_time(df: DataFrame, key: str, ts: str, tie: str, rows: int | None = None) -> CellPlan:
    """Cells for rows ordered by a TIMESTAMP_NTZ and a unique BIGINT.

    The cuts are quantiles of time over the hot keys, so bursts get more of them. A
    single instant that holds more than a cell's worth of rows is cut along ``tie``.
    """
    size = _cell_rows(df, rows)
    if df.count() <= size:
        return CellPlan(key, (ts, tie))
    hot, every, held = _heavy_keys(df, key, size)
    if not hot and not every:
        return CellPlan(key, (ts, tie))
    listed = CellPlan(key, (ts, tie), hot, every=every)
    heavy = df.filter(listed.is_hot()).select(utc_micros(ts).cast("double").alias("t"), F.col(tie).cast("double").alias("i"))
    # Two cuts per cell's worth of rows leave room for the error of the sketch.
    cuts = 2 * -(-held // size)
    at = [n / cuts for n in range(1, cuts)]
    found = heavy.stat.approxQuantile("t", at, 1 / (4 * cuts))
    tied = tuple(sorted({a for a, b in zip(found, found[1:]) if a == b}))
    splits = tuple(sorted(set(found) | {t + 1 for t in tied}))
    tie_splits: tuple[float, ...] = ()
    if tied:
        tie_splits = tuple(sorted(set(heavy.filter(F.col("t").isin(list(tied))).stat.approxQuantile("i", at, 1 / (4 * cuts)))))
    return CellPlan(key, (ts, tie), hot, size, splits, tied, tie_splits, every=every)


def _carried(scanned: DataFrame, handed: DataFrame, plan: CellPlan) -> DataFrame:
    """What the earlier cells hand on, beside the rows of a cell; a null key meets itself."""
    small = stored(handed, "carry").withColumnsRenamed({plan.key: "_carry_key", CELL: "_carry_cell"})
    match = F.col(plan.key).eqNullSafe(F.col("_carry_key")) & (F.col(CELL) == F.col("_carry_cell"))
    return scanned.join(small, match, "left").drop("_carry_key", "_carry_cell")


def running_last(df: DataFrame, plan: CellPlan, columns: Mapping[str, Column], before: bool = False) -> DataFrame:
    """Per row the last non-null value of each column so far, in the plan's order.

    ``before`` leaves the row itself out. ``df`` went through ``plan.apply``. Wrap a
    value whose null counts in a struct.
    """
    frame = plan.window().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    scanned = df.select("*", *[F.last(c, ignorenulls=True).over(frame).alias(n) for n, c in columns.items()])
    if not plan.cuts:
        return scanned
    position = F.struct(*plan.order)
    # Every cell gets a row, also one without a value: it hands on what came before.
    ends = df.filter(plan.is_hot()).groupBy(*plan.columns).agg(
        *[F.max_by(c, F.when(c.isNotNull(), position)).alias(f"_in_{n}") for n, c in columns.items()]
    )
    earlier = Window.partitionBy(plan.key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(
        *plan.columns, *[F.last(f"_in_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in columns]
    )
    merged = _carried(scanned, handed, plan)
    kept = [c for c in scanned.columns if c not in columns]
    return merged.select(*kept, *[F.coalesce(F.col(n), F.col(f"_in_{n}")).alias(n) for n in columns])


def running_count(df: DataFrame, plan: CellPlan, name: str, flag: Column | None = None) -> DataFrame:
    """Per row the number of rows (with ``flag`` true) so far, itself included."""
    counted = F.when(flag, 1) if flag is not None else F.lit(1)
    if flag is None:
        within = F.row_number().over(plan.window()).cast("bigint")
    else:
        within = F.count(counted).over(plan.window().rowsBetween(Window.unboundedPreceding, 0))
    scanned = df.select("*", within.alias(name))
    if not plan.cuts:
        return scanned
    sizes = df.filter(plan.is_hot()).groupBy(*plan.columns).agg(F.count(counted).alias("_size"))
    earlier = Window.partitionBy(plan.key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    handed = sizes.select(*plan.columns, F.sum("_size").over(earlier).alias("_ahead"))
    merged = _carried(scanned, handed, plan)
    kept = [c for c in scanned.columns if c != name]
    return merged.select(*kept, (F.col(name) + F.coalesce(F.col("_ahead"), F.lit(0))).alias(name))


def uncut(df: DataFrame) -> DataFrame:
    return df.drop(CELL)


def join_unique(left: DataFrame, right: DataFrame, plan: CellPlan) -> DataFrame:
    """Left join where ``right`` has one row per key. The hot keys' few right rows (at
    most one for each) are broadcast, so no task receives a whole hot key."""
    if plan.every or not plan.hot:
        return left.join(right, plan.key, "left")
    hot = plan.is_hot()
    cold_side = left.filter(~hot).join(right, plan.key, "left")
    hot_side = left.filter(hot).join(F.broadcast(right.filter(hot)), plan.key, "left")
    return cold_side.unionByName(hot_side)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Position 0, 1, 2, ... of every row in one total order, without a single-task
    window: a range-partitioned sort, written out, plus one offset per partition. Writing
    it fixes the partition numbers that both sides of the join below rely on."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    stable = stored(placed, "ranked")
    part = F.shiftright("_place", 33)
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = stable.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # One row per shuffle partition: bounded by configuration, not by the data.
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
    )
    return (
        stable.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .select(*df.columns, (F.col("_start") + local).alias(name))
    )
