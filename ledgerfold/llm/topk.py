"""Exact top-k search over integer vectors with a uniform threshold in three phases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.llm.common import ship
from ledgerfold.session import stored

#: Score lists: a vector is cut into so many runs of components.
LISTS = 2
#: Distinct vectors in a block, on average, of candidates and of queries.
CANDIDATES, QUERIES = 2048, 256


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of every component; null for vectors that take no part: null or empty,
    or with a component that is null, not finite, or beyond 64 bits."""
    x = F.transform(embedding, lambda v: F.lit(256.0) * v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0**62))
    return F.when((F.size(embedding) > 0) & fine, F.transform(x, lambda v: F.floor(v).cast("long")))


def _blocks(rows: DataFrame, size: int, prefix: str, *more: str) -> DataFrame:
    """Vectors packed by a hash of their class into blocks of about ``size``: the keys are
    distinct, so no block outgrows it by much."""
    parts = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("parts"))
    placed = rows.join(F.broadcast(parts), "dim").withColumn("block", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    packed = placed.groupBy("dim", "block", "parts").agg(F.collect_list(F.struct("c", "q", *more)).alias("items"))
    return packed.select(
        "dim", F.col("block").alias(f"{prefix}_block"), F.col("parts").alias(f"{prefix}_parts"),
        *[F.col(f"items.{n}").alias(f"{prefix}_{n}") for n in ("c", *more)],
        F.flatten("items.q").alias(f"{prefix}_q"),
    )


def _pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every block of queries beside every block of candidates."""
    parts = candidates.select("dim", F.col("c_parts").alias("p")).distinct()
    spread = queries.join(F.broadcast(parts), "dim").withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return spread.join(candidates, ["dim", "c_block"])


def _score_lists(row: dict) -> list[np.ndarray]:
    """The partial scores of all query and candidate pairs of two blocks, list by list. In
    doubles while every sum is below 2**53, in 64-bit integers otherwise."""
    q, c = (np.asarray(row[n], np.int64).reshape(-1, row["dim"]) for n in ("q_q", "c_q"))
    if float(np.abs(q).max()) * float(np.abs(c).max()) * row["dim"] < 2.0**53:
        q, c = q.astype(float), c.astype(float)
    return [(q[:, part] @ c[:, part].T).astype(np.int64) for part in np.array_split(np.arange(row["dim"]), LISTS)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: (v.values.to_numpy(zero_copy_only=False) if isinstance(v, pa.ListScalar) else v.as_py()) for name, v in zip(batch.schema.names, (col[i] for col in batch.columns))}


def _table(q, c, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, c, score)], names=["qc", "c", "score"])


def _phase_one(k: int):
    def heads(batches):
        """Of every list the k best per query, with their whole scores."""
        for row in _rows(batches):
            lists = _score_lists(row)
            total, n = sum(lists), lists[0].shape[1]
            for part in lists:
                best = np.argpartition(-part, min(k, n) - 1, axis=1)[:, :min(k, n)]
                at = np.repeat(np.arange(len(part)), best.shape[1])
                yield _table(row["q_c"][at], row["c_c"][best.ravel()], total[at, best.ravel()])

    return heads


def _phase_two(batches):
    """All entries at or above a query's threshold in some list, resolved to whole scores;
    those below the cutoff go."""
    for row in _rows(batches):
        lists = _score_lists(row)
        cut = np.asarray(row["q_cut"], np.int64)[:, None]
        # m parts that are all below cut / m have a sum below cut.
        share = -(-cut // len(lists))
        at, of = np.nonzero(np.any([part >= share for part in lists], axis=0))
        score = sum(part[at, of] for part in lists)
        keep = score >= cut[at, 0]
        yield _table(row["q_c"][at[keep]], row["c_c"][of[keep]], score[keep])


def _best(rows: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """For each row that ``is_query`` picks, the ``k`` other rows with the highest integer
    inner product: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.

    Equal vectors are scored once, as a class of which the k + 1 smallest ids can matter.
    Blocks of queries meet blocks of classes; each vector is cut into ``LISTS`` runs of
    components, which give the score lists.
    1. Every list of every block yields its best entries; the (k + 1)-th best whole score
       among these is a cutoff that the final results cannot fall below.
    2. The cutoff goes back to all blocks, and each list yields the entries of at least the
       cutoff divided by the number of lists: an entry below that in all lists cannot win.
    3. These entries are resolved to whole scores and ranked.

    An id must not stand for two vectors. Rows without an id, and vectors that are null, empty, or hold null or non-finite
    components, take no part. Repeated rows count once. Only vectors of the query's length
    are candidates. With fewer than k candidates all are returned.
    """
    ship(vectors.sparkSession)
    rows = vectors.select("vec_id", quantised(F.col("embedding")).alias("q"), is_query.alias("asked")).where("vec_id IS NOT NULL AND q IS NOT NULL")
    rows = stored(rows.distinct(), "vectors")
    classes = stored(rows.groupBy("q").agg(F.min("vec_id").alias("c"), F.max("asked").alias("asked")).withColumn("dim", F.size("q")), "classes")
    named = stored(rows.join(classes.select("q", "c"), "q").select("vec_id", "asked", "c"), "named")
    candidates = stored(_blocks(classes.select("c", "q", "dim"), CANDIDATES, "c"), "blocks")
    queries = classes.where("asked").select("c", "q", "dim")
    shape = "qc bigint, c bigint, score bigint"
    heads = _pairs(_blocks(queries, QUERIES, "q"), candidates).mapInArrow(_phase_one(k + 1), shape).distinct()
    ranked = _best(heads, k + 1, ["qc"], F.desc("score"), F.col("c"))
    cuts = ranked.groupBy("qc").agg(F.when(F.count("*") > k, F.min("score")).otherwise(-(2**62)).alias("cut"))
    cuts = stored(cuts, "cutoffs")
    asked = queries.join(cuts, F.col("c") == F.col("qc")).drop("qc")
    found = _pairs(_blocks(asked, QUERIES, "q", "cut"), candidates).mapInArrow(_phase_two, shape)
    members = _best(named.select("c", "vec_id"), k + 1, ["c"], F.col("vec_id")).drop("rank")
    near = _best(found, k + 1, ["qc"], F.desc("score"), F.col("c")).drop("rank").join(members, "c")
    each = named.where("asked").select(F.col("vec_id").alias("query_id"), F.col("c").alias("qc")).join(near, "qc").where("query_id <> vec_id")
    best = _best(each, k, ["query_id"], F.desc("score"), F.col("vec_id"))
    return best.select("query_id", "rank", "vec_id", "score")
