"""Tables beside a view that answer searches and suggestions without reading the view:
plain Parquet, sorted by what is looked for, so that a predicate on it prunes files and row
groups. Each batch adds the entries of the rows that it touches; an entry counts if no later
batch has touched its row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import text
from ledgerfold.functions.codecs import query_or_none
from ledgerfold.operators import search
from ledgerfold.sources.store import attempt, committed


def begins(column: str, prefix: str) -> Column:
    """Values that begin with ``prefix``, as a range that reaches the scan: strings are
    ordered by code point, and the range ends at the next string of that length or less."""
    least = F.col(column) >= prefix
    for end in range(len(prefix), 0, -1):
        code = ord(prefix[end - 1]) + 1
        if code <= 0x10FFFF:
            return least & (F.col(column) < prefix[:end - 1] + chr(0xE000 if code == 0xD800 else code))
    return least


class SortedTable:
    """Entries of rows by ``key``, sorted by ``order``. A range over the order spreads a
    value that a third of the entries hold over many tasks and files."""

    schema: str
    order: tuple[str, ...]

    def __init__(self, spark: SparkSession, path: str, key: str = "id", key_type: str = "string"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._touched = f"id {key_type}, batch bigint"
        self._entries = f"{self._touched}, {self.schema}"

    def entries(self, rows: DataFrame) -> DataFrame:
        """The entries of rows: ``id`` and the columns of ``schema``."""
        raise NotImplementedError

    def apply(self, rows: DataFrame, batch: int, removed: DataFrame | None = None) -> None:
        """Replace the entries of ``rows`` by theirs, and drop those of the ids that are
        ``removed``. A rerun replaces its batch."""
        target = attempt(f"{self.path}/delta", "batch", batch)
        ids = rows.select(F.col(self.key).alias("id"))
        ids = ids if removed is None else ids.union(removed.select(self.key))
        ids.select("id", F.lit(batch).cast("bigint").alias("batch")).write.parquet(f"{self.path}/touched/{target.rpartition('/')[2]}")
        self._write(self.entries(rows), batch, target)

    def _write(self, entries: DataFrame, batch: int, target: str) -> None:
        names = [f.partition(" ")[0] for f in self._entries.split(", ")]
        rows = entries.withColumn("batch", F.lit(batch).cast("bigint")).select(*names)
        rows.repartitionByRange(*self.order).sortWithinPartitions(*self.order).write.parquet(target)

    def read(self, where: Column | None = None) -> DataFrame:
        """The entries that count; ``where`` reaches the scan. What later batches have
        touched is known from ids and numbers since the last ``compact`` alone."""
        bases, batches = committed(self.spark, f"{self.path}/base"), committed(self.spark, f"{self.path}/delta")
        upto = max(bases, default=None)
        fresh = [f for n, f in batches.items() if upto is None or n > upto]
        folders = fresh + ([bases[upto]] if bases else [])
        if not folders:
            return self.spark.createDataFrame([], self._entries)
        rows = self.spark.read.schema(self._entries).parquet(*folders)
        rows = rows if where is None else rows.filter(where)
        if not fresh:
            return rows
        touched = self.spark.read.schema(self._touched).parquet(*[f"{self.path}/touched/{f.rpartition('/')[2]}" for f in fresh])
        newest = touched.groupBy(F.col("id").alias("_id")).agg(F.max("batch").alias("_newest"))
        joined = rows.join(newest, F.col("id") == F.col("_id"), "left")
        return joined.filter(F.col("_newest").isNull() | (F.col("batch") >= F.col("_newest"))).select(*rows.columns)

    def compact(self) -> None:
        """All entries that count in one sorted base, under the number of the last batch."""
        batches = committed(self.spark, f"{self.path}/delta")
        if batches and max(batches) > max(committed(self.spark, f"{self.path}/base"), default=-1):
            self._write(self.read(), max(batches), attempt(f"{self.path}/base", "upto", max(batches)))


class Completions(SortedTable):
    """Lower-cased values of the suggested properties: a prefix is a range."""

    schema = "property string, value string, text string"
    order = ("property", "value", "id")

    def __init__(self, spark, path, properties: Sequence[str] = search.SUGGESTED, key="id", key_type="string"):
        self.properties = properties
        super().__init__(spark, path, key, key_type)

    def entries(self, rows: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).alias("text")) for p in self.properties])
        found = rows.select(F.col(self.key).alias("id"), F.inline(pairs)).filter("text IS NOT NULL")
        return found.withColumn("value", F.lower("text"))

    def suggest(self, prefix: str, size: int = search.SUGGESTIONS) -> DataFrame:
        """The rows of ``search.suggest`` on the view."""
        hit = begins("value", prefix.lower()) if prefix else F.lit(False)
        return search.completions([(p, self.read((F.col("property") == p) & hit)) for p in self.properties], size)


class Postings(SortedTable):
    """One entry for every word of the searched fields, with its field and place."""

    schema = "term string, field int, at int"
    order = ("term", "id", "field", "at")

    def __init__(self, spark, path, fields: Sequence[str] = search.USER_FIELDS, key="id", key_type="string"):
        self.fields = fields
        super().__init__(spark, path, key, key_type)

    def entries(self, rows: DataFrame) -> DataFrame:
        cut = F.array(*[text.tokens(F.col(f)) for f in self.fields])
        words = rows.select(F.col(self.key).alias("id"), F.posexplode(cut).alias("field", "words"))
        return words.select("id", "field", F.posexplode("words").alias("at", "term"))

    def ids(self, terms: Sequence[str], mode: str = "any") -> DataFrame:
        """``id`` of the rows that match, once each."""
        begun = begins("term", terms[-1]) if mode == "prefix" else F.lit(False)
        exact = list(terms[:-1] if mode == "prefix" else terms)
        hits = self.read(F.col("term").isin(exact) | begun if exact else begun)
        if mode == "any":
            return hits.select("id").distinct()
        if mode == "all":
            return hits.select("id", "term").distinct().groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(set(terms))).select("id")
        # The word that has the number k in the phrase stands k places behind its start.
        last = len(terms) - 1
        numbers = [F.when(begun if mode == "prefix" and k == last else F.col("term") == t, F.lit(k)) for k, t in enumerate(terms)]
        placed = hits.select("id", "field", "at", F.explode(F.array_compact(F.array(*numbers))).alias("k"))
        starts = placed.groupBy("id", "field", (F.col("at") - F.col("k")).alias("start")).agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("seen"))
        return starts.filter(F.col("seen") == (1 << len(terms)) - 1).select("id").distinct()

    def matching(self, view: DataFrame, query: str | None, mode: str = "any") -> DataFrame:
        """The rows of ``view`` that ``search.matching`` finds in the fields."""
        wanted = query_or_none(query)
        terms = text.words_of(wanted) if wanted is not None else []
        if wanted is None or (not terms and mode == "all"):
            return view
        if not terms:
            return view.filter(F.lit(False))
        # A long phrase is cut into parts of 60 words that overlap by one; these may stand
        # apart, so the few rows that hold all of them are looked at again.
        parts = [terms[i:i + 60] for i in range(0, len(terms), 59)] if mode in ("phrase", "prefix") else [terms]
        modes = ["phrase"] * (len(parts) - 1) + [mode]
        ids = reduce(lambda x, y: x.join(y, "id", "left_semi"), [self.ids(p, m) for p, m in zip(parts, modes)])
        hits = view.join(ids.withColumnRenamed("id", "_id"), F.col(self.key) == F.col("_id"), "left_semi")
        return hits if len(parts) == 1 else search.matching(hits, query, self.fields, mode)
