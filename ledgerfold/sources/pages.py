"""Pages by continuation: the hits of a query arranged once in one order, and every next page
read from where the last one ended, without sorting or counting again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import cells
from ledgerfold.operators.search import STREAM_PAGE

#: Rows of a block. A page reads the blocks that it lies in.
BLOCK = 10_000


class SortedHits:
    """Hits as they were when ``write`` arranged them, in the order that ``search.page_of``
    gives: whole values without case, nulls last, ties by id, which is never null.

    Rows lie by range of their position, so a page reads the row groups of its blocks. The
    first key of every block is kept beside them, one row per ``block`` rows. A continuation
    is the key of the last row seen; a row with that key need not exist.
    """

    def __init__(self, spark: SparkSession, path: str, sorts: Iterable[tuple[str, bool]] = (), tie: str = "id", block: int = BLOCK):
        self.spark, self.path, self.sorts, self.tie, self.block = spark, path.rstrip("/"), tuple(sorts), tie, block
        self.keys = [f"_key{i}" for i in range(len(self.sorts))]

    def write(self, hits: DataFrame) -> SortedHits:
        """One range-partitioned sort; no task holds more than its range."""
        order = [F.col(k).asc_nulls_last() if asc else F.col(k).desc_nulls_last() for k, (_, asc) in zip(self.keys, self.sorts)]
        keyed = hits.select("*", *[F.lower(F.col(f)).alias(k) for k, (f, _) in zip(self.keys, self.sorts)])
        ranked = cells.global_rank(keyed, [*order, F.col(self.tie).asc()], "_position")
        placed = ranked.withColumn("_block", F.floor(F.col("_position") / self.block).cast("bigint"))
        placed.repartitionByRange("_position").sortWithinPartitions("_position").write.parquet(f"{self.path}/rows")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        rows.filter(F.col("_position") % self.block == 0).select("_block", *self.keys, self.tie).write.parquet(f"{self.path}/fences")
        return self

    def _after(self, key: Sequence) -> Column:
        """Rows behind ``key`` in the order, column by column; null is the last value."""
        found, same = [], F.lit(True)
        for name, asc, value in zip([*self.keys, self.tie], [*[a for _, a in self.sorts], True], key, strict=True):
            column = F.col(name)
            if value is not None:
                behind = column > F.lit(value) if asc else column < F.lit(value)
                found.append(same & (behind | column.isNull()))
            same = same & column.eqNullSafe(F.lit(value))
        return reduce(lambda a, b: a | b, found, F.lit(False))

    def page(self, after: Sequence | None = None, size: int = STREAM_PAGE) -> DataFrame:
        """The ``size`` rows behind the key ``after`` (the first ones without it), in order,
        with their keys."""
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if size <= 0:
            return rows.limit(0).drop("_block", "_position")
        first = 0
        if after is not None:
            fences = self.spark.read.parquet(f"{self.path}/fences")
            first = fences.filter(~self._after(after)).agg(F.max("_block")).first()[0] or 0
            rows = rows.filter(self._after(after))
        # Of the first block nothing may be left, so the page ends in one of the next.
        wanted = rows.filter(F.col("_block").between(first, first + -(-size // self.block)))
        return wanted.orderBy("_position").limit(size).drop("_block", "_position")

    def key_of(self, row: Row) -> tuple:
        return tuple(row[k] for k in [*self.keys, self.tie])

    def following(self, size: int = STREAM_PAGE) -> Iterator[list[Row]]:
        """Page after page, until none is left; the caller holds one at a time."""
        key = None
        while rows := self.page(key, size).collect():
            yield rows
            key = self.key_of(rows[-1])
