"""The generated tables, read with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions.codecs import utc_micros
from ledgerfold.operators.cells import with_bucket
from ledgerfold.sources.store import names_in

SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def write_in_time_order(rows: DataFrame, path: str, ts: str, key: str, slices: int = 8) -> int:
    """``rows`` as files for a stream to find one after the other: slices of time, each
    written after the one before, and in a slice all rows of a key in one file. Large slices
    are several files: returns how many, on average, for ``stream_files`` to take at a time.
    A stream then has about as many batches as there are slices, however many rows."""
    def files() -> int:
        return sum(name.endswith(".parquet") for name in names_in(rows.sparkSession, path))

    before = files()
    at = utc_micros(ts).cast("double")
    cuts = rows.select(at.alias("t")).stat.approxQuantile("t", [n / slices for n in range(1, slices)], 0.001)
    splits = tuple(sorted(set(cuts)))
    placed = with_bucket(rows, at, splits, "_slice")
    for number in range(len(splits) + 1):
        placed.filter(F.col("_slice") == number).drop("_slice").repartition(key).write.mode("append").parquet(path)
    return max(1, (files() - before) // (len(splits) + 1))


def stream_files(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
