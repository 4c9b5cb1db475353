"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    STATE_PROVIDER: ROCKSDB,
    "spark.ui.enabled": "false",
    # No call-site capture for every column expression: plans are built faster.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings this library is written for.

    On a cluster leave ``master`` unset and give ``shuffle_partitions`` as a few
    times the core count: adaptive execution merges the small ones.
    """
    builder = SparkSession.builder.appName("ledgerfold")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, whatever the session is set to; a
    stream takes the settings as they are when it starts. The session gets its own back."""
    earlier = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if earlier is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, earlier)


_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` where the cluster names
    one. Only if all runs in one process (``local`` or ``local[...]``) and it is unset, a
    new folder is made and kept in the session for the next call."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("ledgerfold.work.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="ledgerfold-")
        spark.conf.set("ledgerfold.work.dir", folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, until ``release``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes what this application has put below the shared folder, once no frame that
    reads it is needed any more. The number of folders deleted."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    deleted = 0
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        deleted += place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return deleted


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read back: computed once, cheap to read
    from several places, and not lost with an executor."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
