"""Stored journals and read models, as plain Parquet.

A journal is partitioned by time bucket and tag. A read model is a log of mergeable
partial results: each batch appends what changed, a read merges per entity. Every write
goes to a folder of its own attempt and counts once Spark has marked it complete, so a
rerun of a batch replaces the earlier attempt at one instant, a failed one is never seen,
and no write touches what a reader may be reading. ``compact`` merges what has piled up,
but rewrites only the buckets of entities that it touches: a manifest names the valid folder
of every bucket, and the offsets a projection has come to. ``prune`` deletes what no
manifest names any more.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerfold import schemas
from ledgerfold.operators import fold, journal, search
from ledgerfold.operators.specs import EntitySpec


def _place(spark: SparkSession, path: str):
    """(file system, path) on whatever file system holds the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; empty if it is missing."""
    system, place = _place(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def attempt(path: str, kind: str, number: int) -> str:
    """A new folder for one try at writing batch or base ``number``."""
    return f"{path.rstrip('/')}/{kind}={number}-{time.time_ns()}"


def committed(spark: SparkSession, path: str) -> dict[int, str]:
    """Number -> folder of its latest attempt that was written completely."""
    found: dict[int, tuple[int, str]] = {}
    for name in names_in(spark, path):
        number, _, tried = name.partition("=")[2].partition("-")
        if number.isdigit() and "_SUCCESS" in names_in(spark, f"{path}/{name}"):
            found[int(number)] = max(found.get(int(number), (-1, "")), (int(tried or 0), f"{path}/{name}"))
    return {number: folder for number, (_, folder) in sorted(found.items())}


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    system, place = _place(spark, path)
    out = system.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    system, place = _place(spark, path)
    source = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_journal(rows: DataFrame, path: str, mode: str = "append", partitions: tuple[str, ...] = ("timebucket", "tag")) -> None:
    """Write a tagged journal. Ranges over (partitions, entity, number) spread a busy
    hour or entity over many tasks and leave each file sorted for lookups. Small
    journals do better with the tag alone."""
    order = [*partitions, "entity_id", "seq_nr"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode(mode).partitionBy(*partitions).parquet(path)


def read_journal(spark: SparkSession, path: str, schema: str = schemas.USER_JOURNAL) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_journal(spark: SparkSession, path: str, schema: str = schemas.USER_JOURNAL, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_snapshots(taken: DataFrame, path: str, run: int, spec: EntitySpec, keep: int = 2) -> None:
    """Write the snapshots of run ``run``, together with those of earlier runs that are
    still among the latest ``keep`` of their entity. A rerun replaces its run."""
    spark = taken.sparkSession
    earlier = [f for n, f in committed(spark, path).items() if n < run]
    rows = taken.unionByName(spark.read.schema(_snapshot_schema(spec)).parquet(earlier[-1])) if earlier else taken
    rows = rows.dropDuplicates(["entity_id", "seq_nr"])
    columns = [c for c in rows.columns if c != "entity_id"]
    # The latest by a bounded aggregate: `keep` times the maximum below the one before.
    best = None
    for _ in range(keep):
        left = rows if best is None else rows.join(best.select("entity_id", "seq_nr"), ["entity_id", "seq_nr"], "left_anti")
        top = left.groupBy("entity_id").agg(F.max_by(F.struct(*columns), "seq_nr").alias("s")).select("entity_id", "s.*")
        best = top if best is None else best.unionByName(top)
    best.write.parquet(attempt(path, "run", run))


def _snapshot_schema(spec: EntitySpec) -> str:
    fields = ", ".join(f"{f.name} {f.dtype}" for f in spec.fields)
    return f"entity_id string, seq_nr bigint, ts timestamp_ntz, present boolean, {fields}"


def read_snapshots(spark: SparkSession, path: str, spec: EntitySpec) -> DataFrame:
    """The snapshots as the last complete run left them; ``recover`` uses the latest of
    each entity."""
    runs = committed(spark, path)
    schema = _snapshot_schema(spec)
    return spark.read.schema(schema).parquet(runs[max(runs)]) if runs else spark.createDataFrame([], schema)


#: Column and folder name of a bucket of entities in a read model's bases.
_BUCKET = "_bucket"


class MergedTable:
    """Append-only partial results with a merge function.

    ``buckets`` is the unit of compaction: about as many entities of a batch as there are
    buckets make it rewrite everything, so choose more of them than a batch has entities, but
    not so many that a bucket falls below a file of useful size. A table keeps the number
    that it was first compacted with.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame],
                 order: tuple[str, ...] = ("entity_id",), buckets: int = 64):
        self.spark, self.path, self._merge, self.order, self.buckets = spark, path.rstrip("/"), merge, order, buckets
        self._declared = schema

    def create_or_extend(self) -> T.StructType:
        """Record the declared columns next to those already known. Nothing is dropped:
        new columns are null in older rows, columns no longer declared stay readable."""
        declared = self.spark.createDataFrame([], self._declared)
        known = self.schema() if names_in(self.spark, f"{self.path}/columns") else T.StructType()
        added = [f for f in declared.schema if f.name not in known.fieldNames()]
        full = T.StructType([*known, *added])
        if added:
            self.spark.createDataFrame([], full).coalesce(1).write.mode("append").parquet(f"{self.path}/columns")
        return full

    def schema(self) -> T.StructType:
        """The columns known so far; the declared ones ahead of the first write."""
        if not names_in(self.spark, f"{self.path}/columns"):
            return self.spark.createDataFrame([], self._declared).schema
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/columns").schema

    def append(self, rows: DataFrame, batch: int, offsets: DataFrame | None = None) -> None:
        """Append a batch, with the ``journal.tag_offsets`` that it comes to. The offsets
        are written ahead, under the name of the batch's attempt, and count from the
        instant that the batch itself counts."""
        target = attempt(f"{self.path}/delta", "batch", batch)
        if offsets is not None:
            offsets.coalesce(1).write.parquet(f"{self.path}/offsets/{target.rpartition('/')[2]}")
        rows.write.parquet(target)

    def _manifest(self, before: int | None = None) -> tuple[int | None, dict]:
        """The latest manifest, of the batches ahead of ``before`` or of all, and the last
        batch that it covers."""
        found = committed(self.spark, f"{self.path}/manifest")
        upto = max((n for n in found if before is None or n < before), default=None)
        if upto is None:
            return None, {"buckets": self.buckets, "folders": {}, "offsets": None}
        return upto, json.loads(_read_text(self.spark, f"{found[upto]}/manifest.json"))

    def _batches(self, after: int | None, before: int | None = None) -> list[str]:
        batches = committed(self.spark, f"{self.path}/delta")
        return [f for b, f in batches.items() if (after is None or b > after) and (before is None or b < before)]

    def read(self, before: int | None = None, where: Column | None = None) -> DataFrame:
        """One merged row per entity, of the batches ahead of ``before`` or of all.
        ``where`` keeps whole entities; it reaches the scans below the merge."""
        schema = self.schema()
        upto, manifest = self._manifest(before)
        folders = [f"{self.path}/{f}" for f in manifest["folders"].values()] + self._batches(upto, before)
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*folders)
        return self._merge(rows if where is None else rows.filter(where))

    def next_batch(self) -> int:
        """The number behind all batches that count."""
        upto, _ = self._manifest()
        return max([-1 if upto is None else upto, *committed(self.spark, f"{self.path}/delta")]) + 1

    def offsets(self) -> DataFrame:
        """tag, ts, entity_id, seq_nr: the last event of each tag in the batches that count."""
        upto, manifest = self._manifest()
        named = {name: f"{self.path}/offsets/{name}" for name in names_in(self.spark, f"{self.path}/offsets")}
        folders = [named[n] for n in (f.rpartition("/")[2] for f in self._batches(upto)) if n in named]
        folders += [f"{self.path}/{manifest['offsets']}"] if manifest["offsets"] else []
        if not folders:
            return self.spark.createDataFrame([], journal.OFFSETS)
        return journal.merge_offsets(self.spark.read.schema(journal.OFFSETS).parquet(*folders))

    def compact(self) -> None:
        """Merge everything appended since the last time into the buckets of its entities;
        the others stay as they are. Readers go on with the earlier manifest until the new
        one is marked complete."""
        upto, manifest = self._manifest()
        batches = committed(self.spark, f"{self.path}/delta")
        fresh = self._batches(upto)
        if not fresh:
            return
        schema, bucket = self.schema(), F.pmod(F.xxhash64("entity_id"), F.lit(manifest["buckets"])).cast("int").alias(_BUCKET)
        changed = self.spark.read.schema(schema).parquet(*fresh)
        touched = sorted(r[0] for r in changed.select(bucket).distinct().collect())  # at most as many as buckets
        name = f"upto={max(batches)}-{time.time_ns()}"
        folders = dict(manifest["folders"])
        if touched:
            earlier = [f"{self.path}/{folders[str(b)]}" for b in touched if str(b) in folders]
            rows = changed.unionByName(self.spark.read.schema(schema).parquet(*earlier)) if earlier else changed
            merged = self._merge(rows).select("*", bucket).repartitionByRange(_BUCKET, *self.order)
            merged.sortWithinPartitions(_BUCKET, *self.order).write.partitionBy(_BUCKET).parquet(f"{self.path}/base/{name}")
            folders |= {str(b): f"base/{name}/{_BUCKET}={b}" for b in touched}
        offsets, known = manifest["offsets"], self.offsets()
        if names_in(self.spark, f"{self.path}/offsets"):
            offsets = f"offsets/{name}"
            known.coalesce(1).write.parquet(f"{self.path}/{offsets}")
        whole = json.dumps({"buckets": manifest["buckets"], "folders": folders, "offsets": offsets})
        _write_text(self.spark, f"{self.path}/manifest/{name}/manifest.json", whole)
        _write_text(self.spark, f"{self.path}/manifest/{name}/_SUCCESS", "")

    def prune(self) -> None:
        """Delete what only manifests ahead of the last two name. Readers of the newest and a
        rerun of the last batch need none of it."""
        manifests = committed(self.spark, f"{self.path}/manifest")
        if len(manifests) < 2:
            return
        before_last, last = sorted(manifests)[-2:]
        texts = [json.loads(_read_text(self.spark, f"{manifests[n]}/manifest.json")) for n in (before_last, last)]
        needed = {f for t in texts for f in (*t["folders"].values(), t["offsets"]) if f}

        def delete(name: str) -> None:
            system, place = _place(self.spark, f"{self.path}/{name}")
            system.delete(place, True)

        def number(name: str) -> int:
            return int(name.partition("=")[2].partition("-")[0])

        for kind in ("delta", "manifest", "offsets"):
            limit = before_last - 1 if kind == "manifest" else before_last
            for name in names_in(self.spark, f"{self.path}/{kind}"):
                if number(name) <= limit and f"{kind}/{name}" not in needed:
                    delete(f"{kind}/{name}")
        for name in names_in(self.spark, f"{self.path}/base"):
            own = [f"base/{name}/{b}" for b in names_in(self.spark, f"{self.path}/base/{name}") if b.startswith(_BUCKET)]
            if number(name) <= last and not needed.intersection(own):
                delete(f"base/{name}")
            elif number(name) <= last:
                for folder in set(own) - needed:
                    delete(folder)


class ViewStore(MergedTable):
    """A read model of one entity type."""

    def __init__(self, spark: SparkSession, path: str, spec: EntitySpec, buckets: int = 64):
        super().__init__(spark, path, fold.summary_schema(spec), lambda rows: fold.merge(rows, spec), buckets=buckets)
        self.spec = spec

    def apply(self, events: DataFrame, batch: int, ledger: bool = False) -> None:
        """Fold a batch of events into the view; ``ledger`` keeps how far each tag got, of
        events that have a ``tag`` and a ``ts``."""
        self.append(fold.summarise(events, self.spec), batch, journal.tag_offsets(events) if ledger else None)

    def upsert(self, rows: DataFrame, batch: int, seq: str = "seq_nr") -> None:
        """Insert rows or set fields of existing ones (id, ``seq``, fields). Only the fields
        that ``rows`` has are set; a field it lacks keeps its value, a null clears it."""
        numbers = [(F.col(seq) if f.name in rows.columns else F.lit(None)).cast("bigint").alias(f"{f.name}_seq") for f in self.spec.fields]
        values = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dtype).alias(f.name) for f in self.spec.fields
        ]
        zero = F.lit(0).cast("bigint").alias("removed_seq")
        self.append(rows.select(F.col("id").alias("entity_id"), F.col(seq).alias("last_seq"), zero, *numbers, *values), batch)

    def delete(self, rows: DataFrame, batch: int, seq: str = "seq_nr") -> None:
        """Remove rows (id, ``seq``)."""
        nothing = [F.lit(None).cast("bigint").alias(f"{f.name}_seq") for f in self.spec.fields]
        nothing += [F.lit(None).cast(f.dtype).alias(f.name) for f in self.spec.fields]
        self.append(
            rows.select(F.col("id").alias("entity_id"), F.col(seq).alias("last_seq"), F.col(seq).alias("removed_seq"), *nothing), batch
        )

    def all(self, secrets: bool = False) -> DataFrame:
        return fold.finish(self.read(), self.spec, secrets)

    def find(self, entity_id: str) -> DataFrame:
        """One row; the filter reaches the scans below the merge."""
        return search.find(self.all(), entity_id)


class ViewSearch:
    """Search and suggestions over the rows of a view."""

    def __init__(self, view: DataFrame, fields=search.USER_FIELDS, suggested=search.SUGGESTED):
        self.view, self.fields, self.suggested = view, fields, suggested

    def search(self, query=None, page=0, page_size=10, sorts=(), mode="any"):
        return search.search(self.view, query, page, page_size, sorts, self.fields, mode)

    def pages(self, query=None, sorts=(), mode="any"):
        return search.all_pages(search.matching(self.view, query, self.fields, mode), sorts)

    def suggest(self, prefix):
        return search.suggestions(self.view, prefix, self.suggested)
