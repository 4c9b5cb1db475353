"""Best-fit packing into sequences of several permitted lengths.

Texts of equal length are interchangeable, so the packing is planned on the histogram of
lengths, whose size is bounded by the largest permitted length and not by the data. The
plan is that of best-fit decreasing over all pieces; Spark numbers the pieces of a length
and each looks up its place.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerfold.llm.common import ship
from ledgerfold.session import stored

#: Permitted sequence lengths, and what a sequence costs beside its own length.
SIZES, OVERHEAD = (512, 1024, 2048, 4096, 8192), 64
#: Pieces of one length that one task numbers at a time, on average.
RUN = 500


@dataclass
class Plan:
    """``places``: per run of equal pieces (length, first rank, first bin, pieces in a bin,
    offset in the bin); ``bins``: per run of equal bins (first bin, size)."""

    places: np.ndarray
    bins: np.ndarray


def opened(length: int, count: int, smaller: int, sizes: Sequence[int], overhead: int) -> int:
    """The size whose cost for each token that it can be filled with is least: as many
    pieces of this length as fit, then what shorter pieces there are."""
    best, least = sizes[-1], float("inf")
    for size in sizes:
        if size >= length:
            own = min(count, size // length) * length
            cost = (size + overhead) / (own + min(size - own, smaller))
            if cost < least:
                best, least = size, cost
    return best


def planned(histogram: dict[int, int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> Plan:
    """Best-fit decreasing on whole runs of bins alike. Each piece goes to the open bin with
    the least room that holds it; only then is a bin opened. At the end every bin becomes
    the smallest permitted size that holds its contents."""
    sizes = sorted(sizes)
    runs: list[tuple[int, int, int, int]] = []  # (room, first bin, one after the last, size), sorted
    places, bins = [], 0
    smaller = sum(n * c for n, c in histogram.items())
    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        smaller -= length * count
        while rank < count:
            at = bisect_left(runs, (length,))
            if at < len(runs):
                room, first, end, size = runs.pop(at)
            else:
                size = room = opened(length, count - rank, smaller, sizes, overhead)
                first, bins = bins, bins + -(-(count - rank) // (size // length))
                end = bins
            each = room // length
            full = min(end - first, (count - rank) // each)
            if full:
                places.append((length, rank, first, each, size - room))
                insort(runs, (room - each * length, first, first + full, size))
                rank += full * each
            if first + full < end:
                rest = count - rank  # fewer than a bin takes
                if rest:
                    places.append((length, rank, first + full, each, size - room))
                    insort(runs, (room - rest * length, first + full, first + full + 1, size))
                    rank = count
                if first + full + bool(rest) < end:
                    insort(runs, (room, first + full + bool(rest), end, size))
    final = sorted((first, next(s for s in sizes if s >= size - room)) for room, first, _, size in runs)
    return Plan(np.array(places, np.int64).reshape(-1, 5), np.array(final, np.int64).reshape(-1, 2))


def _placer(plan: Plan):
    places, bins = plan.places, plan.bins
    starts = (places[:, 0] << 40) + places[:, 1]
    order = np.argsort(starts)
    starts, places = starts[order], places[order]
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("bin", "at", "size")])

    @arrow_udf(kind)
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, number = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        run = places[np.searchsorted(starts, (size << 40) + number, side="right") - 1]
        over, slot = np.divmod(number - run[:, 1], run[:, 3])
        own = run[:, 2] + over
        holds = bins[np.searchsorted(bins[:, 0], own, side="right") - 1, 1]
        return pa.StructArray.from_arrays([pa.array(x) for x in (own, run[:, 4] + slot * size, holds)], names=["bin", "at", "size"])

    return place


def pack(docs: DataFrame, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> DataFrame:
    """The pieces of ``docs`` (doc_id, n_tokens) and their places: doc_id, piece (from 0),
    first (token of the text), n_tokens, bin_id, bin_size and bin_offset.

    A text longer than the largest size is cut into pieces of that size and a rest. Nothing
    is dropped or padded. Texts without tokens, null lengths included, have one row with no
    bin. Repeated rows and null ids are packed like others. An empty table gives no rows.
    The driver sees one count for each length up to the largest size. The pieces of a
    length are numbered in runs, so a length that a third of all texts have is no hot group.
    """
    spark, most = docs.sparkSession, max(sizes)
    ship(spark)
    rows = docs.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    cut = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / most), F.lit(1)).cast("int") - 1)).alias("piece"))
    cut = cut.select("doc_id", "piece", (F.col("piece") * F.lit(most).cast("long")).alias("first"), F.least(F.col("n") - F.col("piece") * F.lit(most).cast("long"), F.lit(most)).alias("n_tokens"))
    # Written once, so that the numbers of a piece stay its own if a task is run again.
    pieces = stored(cut.withColumn("key", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())), "pieces")
    counts = {r[0]: r[1] for r in pieces.where("n_tokens > 0").groupBy("n_tokens").count().collect()}
    plan = planned(counts, sizes, overhead)
    runs = max(1, -(-max(counts.values(), default=0) // RUN))
    parts = pieces.where("n_tokens > 0").withColumn("run", F.pmod("key", F.lit(runs)))
    before = parts.groupBy("n_tokens", "run").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("n_tokens").orderBy("run")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("n_tokens", "run").orderBy("key", "doc_id", "piece")) - 1
    ranked = parts.withColumn("own", own).join(before, ["n_tokens", "run"])
    placed = ranked.withColumn("p", _placer(plan)("n_tokens", F.col("own") + F.col("before"))) if counts else None
    columns = ["doc_id", "piece", "first", "n_tokens"]
    empty = pieces.where("n_tokens = 0").select(*columns, *[F.lit(None).cast("long").alias(n) for n in ("bin_id", "bin_size", "bin_offset")])
    if placed is None:
        return empty
    return placed.select(*columns, F.col("p.bin").alias("bin_id"), F.col("p.size").alias("bin_size"), F.col("p.at").alias("bin_offset")).union(empty)
