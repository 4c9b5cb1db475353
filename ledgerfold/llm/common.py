"""What the operators of this folder share: tables, words, digests and link components."""

from __future__ import annotations

import ctypes
import functools
import os
import string
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerfold.session import stored

#: Fixed: words are runs of letters a-z, digits and everything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The C library's call that returns free memory, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

_SHIPPED: set[str] = set()

#: Rows of long texts that are handed to a Python worker at a time, where the session has
#: Spark's default, which is meant for short rows.
BATCH_ROWS, BATCH_CONF = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once per application, and bounds their
    batches. Spark's own file server sends the archive, so only the driver needs the folder
    that it lies in."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="ledgerfold-"), "ledgerfold.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def give_back() -> None:
    """Hands a Python worker's free memory back to the system. Several workers share an
    executor's memory with its JVM, and idle ones keep what they have."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What ``owner`` keeps between the batches of a Python worker. Later stages reuse the
    worker, so the first batch of another owner drops what the one before has kept."""
    if owner not in _KEPT:
        _KEPT.clear()
        give_back()
    return _KEPT.setdefault(owner, {})


def trimmed(function):
    """For the body of an Arrow UDF: gives back what each batch took, and what the
    operators of earlier stages keep."""
    owner = function.__module__

    @functools.wraps(function)
    def run(*columns):
        kept(owner)
        result = function(*columns)
        give_back()
        return result

    return run


def once(function):
    """A UDF whose result rows are chosen by, as a generator or a filter does. Spark moves such
    a choice ahead of the column it is made by, and then runs a deterministic UDF for it once
    more, with a second worker for each task."""
    return function.asNondeterministic()


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; null counts as empty. For ASCII alone
    that is ``lower``, which does not look every character up."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def hashed(items: Column) -> Column:
    """64-bit hashes of an array's strings, in order."""
    return F.transform(items, lambda w: F.xxhash64(w))


def same(left: str, right: str) -> Column:
    """Equality under which null equals null."""
    return F.col(left).eqNullSafe(F.col(right))


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of ``links`` (columns ``a`` and ``b``, any comparable type):
    one row per linked node with the smallest node of its component as ``root``.

    Alternating large-star and small-star rounds. Every round is a few shuffles over the
    links, its result is stored in the shared folder, and the number of rounds grows with
    the logarithm of the component size. Nothing is gathered: per node only a minimum is
    taken, and the join that hands it out is split by adaptive execution if a node is hot.
    """
    def written(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """The links, stored, and a mark of them as a set, taken while they are written."""
        seen = Observation()
        marked = rows.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.xxhash64("v", "u")).alias("y"))
        return stored(marked, label), tuple(seen.get.values())

    edges, mark = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.select("v", "m").where("v <> m").union(joined.select("u", "m")).toDF("u", "v").distinct()
        before, (edges, mark) = mark, written(small)
        if mark == before:  # a round that changes nothing has reached the stars
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.union(stars.select("root", "root").distinct())


#: A block is eight words of 64 bits; a key sets one bit in each.
WORDS = 8
BITS_PER_KEY = 16
#: At most 2.4 MB of filter are sent to the executors. A longer list only fills the blocks
#: further: more possible hits, the same result.
MOST_BLOCKS = 1 << 15


def _marks(key: Column) -> list[Column]:
    seen = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(seen, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def maybe_in(rows: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only where ``column`` is null or
    surely not in the one column of ``keys``, by a blocked Bloom filter.

    The filter is made by an aggregate with one row per block and sent to the executors;
    its size has a fixed bound, whatever the number of keys.
    """
    keys = keys.toDF("_key")
    blocks = max(1, min(MOST_BLOCKS, -(-keys.count() * BITS_PER_KEY // (64 * WORDS))))
    bits = [f"_w{i}" for i in range(WORDS)]
    at = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks))
    marked = keys.where("_key IS NOT NULL").select(at("_key").alias("_block"), *[m.alias(w) for w, m in zip(bits, _marks(F.col("_key")))])
    bloom = marked.groupBy("_block").agg(*[F.bit_or(w).alias(w) for w in bits])
    found = rows.join(F.broadcast(bloom), F.when(F.col(column).isNotNull(), at(column)) == F.col("_block"), "left")
    maybe = F.col("_block").isNotNull()
    for w, mark in zip(bits, _marks(F.col(column))):
        maybe = maybe & (F.col(w).bitwiseAND(mark) == mark)
    return found.withColumn(name, F.coalesce(maybe, F.lit(False))).drop("_block", *bits)


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in the one column of ``gone``, all columns
    kept; rows whose key is null stay. Only rows that pass the filter go into the join."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    marked = maybe_in(rows, "key", gone, "maybe")
    kept = marked.where("maybe").join(gone.toDF("gone"), F.col("key") == F.col("gone"), "left_anti")
    return marked.where("NOT maybe").select("row").union(kept.select("row")).select("row.*")
