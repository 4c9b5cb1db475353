"""Benchmark decontamination: the word windows of the benchmark items as a hashed set,
scanned against every word position of the training texts, verified, and turned into
per-document findings, cut spans or dropped documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import hashed, without, words
from ledgerfold.session import stored

WINDOW = 10
#: What stands between words, and words, in a text before A-Z are lowered.
GAP_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows sent to all executors at a time, about 200 bytes each. A benchmark with more
#: is cut by hash into parts of this size and the corpus is scanned once per part.
BROADCAST_WINDOWS = 200_000


def _windows(items: Column, size: Column | int) -> Column:
    """All runs of ``size`` entries, or null where there are fewer."""
    return F.when(F.size(items) >= size, F.transform(F.sequence(F.lit(1), F.size(items) - size + 1), lambda i: F.slice(items, i, size)))


def benchmark_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``gram`` (hash), ``size``, ``window`` (words) and the
    ``items`` that hold it. An item with fewer words is one window; one without words or
    without an id has none."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    rows = rows.withColumn("size", F.least(F.size("w"), F.lit(size)))
    rows = rows.select("item", "size", F.explode(_windows(F.col("w"), F.col("size"))).alias("window"))
    rows = rows.groupBy("size", "window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.select(F.xxhash64(hashed(F.col("window"))).alias("gram"), "size", "window", "items")


def findings(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per distinct (doc_id, text): ``n_words``, ``items`` with occurring windows (sorted
    as strings), ``copies`` (rows that agree) and ``spans``, the merged hit word ranges as (first, end) pairs.

    Null and empty texts have no words and no hits. A text of any length is scanned whole. An empty benchmark hits nothing.
    """
    grams = stored(benchmark_windows(items, size), "windows")
    sizes = [(r[0], r[1]) for r in grams.groupBy("size").count().orderBy("size").collect()]  # at most ``size`` rows
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    rows = rows.select("id", F.xxhash64(F.coalesce("t", F.lit(""))).alias("h1"), F.hash(F.coalesce("t", F.lit(""))).alias("h2"), words(F.col("t")).alias("w"))
    rows = rows.select("*", F.size("w").cast("long").alias("n_words"), hashed(F.col("w")).alias("h"))
    key = ["id", "h1", "h2", "n_words"]
    scans = [(n, part, parts) for n, count in sizes for parts in [-(-count // BROADCAST_WINDOWS)] for part in range(parts)]
    hits = None
    for n, part, parts in scans or [(size, 0, 1)]:
        # Every position goes past the set; the words decide, not the hash. In the first
        # scan a null ahead of the positions keeps one row for each document.
        marks = F.coalesce(F.transform(_windows(F.col("h"), n), lambda g: F.xxhash64(g)), F.array().cast("array<bigint>"))
        whole = F.array(F.lit(None).cast("bigint")) if hits is None else F.array().cast("array<bigint>")
        at = rows.select(*key, "w", F.concat(whole, marks).alias("marks")).select(*key, "w", F.posexplode_outer("marks").alias("at", "mark"))
        at = at.withColumn("first", F.col("at") - 1 if hits is None else F.col("at"))
        part_of = grams.where((F.col("size") == n) & (F.pmod("gram", F.lit(parts)) == part)).drop("size")
        verified = F.slice("w", F.greatest(F.col("first") + 1, F.lit(1)), F.lit(n)) == F.col("window")
        found = at.join(F.broadcast(part_of), F.col("mark") == F.col("gram"), "left").where((F.col("first") < 0) | verified)
        found = found.select(*key, "first", F.lit(n).alias("size"), "items")
        hits = found if hits is None else hits.union(found)
    merged = hits.groupBy(*key).agg(
        F.sum(F.when(F.col("first") < 0, 1).otherwise(0)).alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("first") >= 0, F.struct("first", (F.col("first") + F.col("size")).alias("end"))))).alias("found"),
    )
    start = F.expr("cast(array() as array<struct<first:int,end:int>>)")
    spans = F.aggregate("found", start, lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["first"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(F.struct(s["first"].alias("first"), s["end"].alias("end"))))))
    return merged.select(*key, "copies", "items", spans.alias("spans"))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated. Repeated rows are reported as often as they occur."""
    found = findings(docs, items, size)
    one = found.select(F.col("id").alias("doc_id"), "n_words", n_hit(F.col("spans")).alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), "copies")))
    return one.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns kept."""
    key = lambda doc_id, *hashes: F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), *hashes)
    gone = findings(docs, items, size).where(F.size("spans") > 0).select(key("id", "h1", "h2"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return without(docs, key("doc_id", F.xxhash64(text), F.hash(text)), stored(gone, "hits"))


def without_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text) with the hit words cut out of the texts; what stands between
    the words stays."""
    rows = docs.select("doc_id", "text")
    found = findings(docs, items, size).where(F.size("spans") > 0).select(F.col("id").alias("i"), "h1", "h2", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    match = F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64(text) == F.col("h1")) & (F.hash(text) == F.col("h2"))
    # A gap stands before every word and one after the last.
    pairs = F.zip_with(F.split("text", WORD_RUN), F.array_remove(F.split("text", GAP_RUN), ""), lambda g, w: F.struct(g.alias("g"), F.coalesce(w, F.lit("")).alias("w")))
    hit = lambda i: F.exists("spans", lambda s: (i >= s["first"]) & (i < s["end"]))
    cut = F.array_join(F.transform(pairs, lambda p, i: F.concat(p["g"], F.when(hit(i), "").otherwise(p["w"]))), "")
    return rows.join(found, match, "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut).alias("text"))
