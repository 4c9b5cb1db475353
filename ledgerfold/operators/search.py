"""Queries on views: lookup, search, ranking, sorting, paging, suggestions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerfold.functions import text
from ledgerfold.functions.codecs import query_or_none
from ledgerfold.operators import cells
from ledgerfold.session import stored

# The searched fields of the two views and the suggested properties.
USER_FIELDS = (
    "id", "username", "email", "address.street", "address.number", "address.city", "address.state", "address.zip",
    "address.country", "department.id",
)
DEPARTMENT_FIELDS = ("id", "name", "description")
SUGGESTED = ("username", "email")

STREAM_PAGE = 20
# Rows ahead of a page up to which every task keeps them all, and rows of a page that are
# broadcast to fetch the rest of their columns.
DEEP, BROADCAST_PAGE = 10_000, 10_000
SUGGESTIONS = 5
K1, B = 1.2, 0.75


def find(view: DataFrame, entity_id: str) -> DataFrame:
    return view.filter(F.col("id") == entity_id)


def find_all(view: DataFrame, limit: int | None = None) -> DataFrame:
    """Every row; a limit only if asked for."""
    return view if limit is None else view.limit(limit)


def matching(view: DataFrame, query: str | None, fields: Sequence[str] = USER_FIELDS, mode: str = "any") -> DataFrame:
    """Rows whose fields match. ``mode``: ``any`` term in any field, ``all`` terms over
    the fields together, ``phrase`` within one field, ``prefix`` the same with the last
    word begun. A blank query matches all rows."""
    wanted = query_or_none(query)
    if wanted is None:
        return view
    terms = text.words_of(wanted)
    if mode in ("phrase", "prefix"):
        test = text.has_phrase if mode == "phrase" else text.has_prefix
        return view.filter(reduce(lambda a, b: a | b, [test(text.tokens(F.col(f)), terms) for f in fields]))
    # A word never crosses two fields, so they are cut into words together.
    words = text.tokens(F.concat_ws(" ", *fields))
    return view.filter({"any": text.has_any, "all": text.has_all}[mode](words, terms))


def _order(sorts: Iterable[tuple[str, bool]], tie: str = "id") -> list[Column]:
    """Whole values without case; the id makes the order total, so pages never overlap."""
    keys = [F.lower(F.col(f)).asc_nulls_last() if asc else F.lower(F.col(f)).desc_nulls_last() for f, asc in sorts]
    return [*keys, F.col(tie).asc()]


def _page(hits: DataFrame, order: list[Column], page: int, page_size: int, deep: int) -> DataFrame:
    if page_size <= 0:
        return hits.limit(0)
    first = page * page_size
    if first + page_size <= deep:
        return hits.orderBy(*order).offset(first).limit(page_size)
    ranked = cells.global_rank(hits, order, "_position")
    wanted = ranked.filter((F.col("_position") >= first) & (F.col("_position") < first + page_size))
    return wanted.orderBy("_position").drop("_position")


def page_of(hits: DataFrame, page: int, page_size: int, sorts: Iterable[tuple[str, bool]] = (), deep: int = DEEP) -> DataFrame:
    """Page 0, 1, ... of the hits. A page near the front is a bounded top-k per task; one
    beyond ``deep`` rows comes from a range-partitioned sort, so that no task keeps all
    the rows ahead of it. The rows are the same."""
    return _page(hits, _order(sorts), page, page_size, deep)


def hit_count(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("count"))


def search(view: DataFrame, query: str | None, page: int, page_size: int, sorts: Iterable[tuple[str, bool]] = (),
           fields: Sequence[str] = USER_FIELDS, mode: str = "any") -> tuple[DataFrame, DataFrame]:
    """(items of the page, one row with the total count)."""
    hits = matching(view, query, fields, mode)
    return page_of(hits, page, page_size, sorts), hit_count(hits)


def all_pages(hits: DataFrame, sorts: Iterable[tuple[str, bool]] = (), page_size: int = STREAM_PAGE) -> DataFrame:
    """Every hit with its page number, for reading pages until none is left."""
    ranked = cells.global_rank(hits, _order(sorts), "_position")
    page = F.floor(F.col("_position") / page_size).cast("int")
    return ranked.withColumn("page", page).drop("_position")


def suggest(view: DataFrame, prefix: str, properties: Sequence[str] = SUGGESTED, size: int = SUGGESTIONS) -> DataFrame:
    """Completions: flat rows (property, rank, text, score, freq). An empty prefix
    suggests nothing. One bounded top-k per property instead of a two-group window."""
    def hits(name: str) -> DataFrame:
        hit = F.startswith(F.lower(F.col(name)), F.lit(prefix.lower())) if prefix else F.lit(False)
        return view.filter(hit).select("id", F.col(name).alias("text"))

    return completions([(name, hits(name)) for name in properties], size)


def completions(found: Sequence[tuple[str, DataFrame]], size: int = SUGGESTIONS) -> DataFrame:
    """The first ``size`` of each property's hits (``id``, ``text``), as ``suggest`` gives them."""
    parts = []
    for number, (name, hits) in enumerate(found):
        best = hits.select("id", "text").orderBy("text", "id").limit(size)
        parts.append(best.select(F.lit(number).alias("position"), F.lit(name).alias("property"), "id", "text"))
    rows = reduce(DataFrame.unionByName, parts)
    # At most `size` rows per property reach this window.
    rank = F.row_number().over(Window.partitionBy("position").orderBy("text", "id"))
    return rows.select("property", "position", rank.alias("rank"), "text", F.lit(1.0).alias("score"), F.lit(1).alias("freq"))


def suggestions(view: DataFrame, prefix: str, properties: Sequence[str] = SUGGESTED, size: int = SUGGESTIONS) -> DataFrame:
    """One row per property with its list; a property without a hit has an empty list."""
    entry = F.struct("rank", "text", "score", "freq")
    lists = suggest(view, prefix, properties, size).groupBy("property").agg(F.sort_array(F.collect_list(entry)).alias("found"))
    names = view.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(p) for p in properties])).alias("position", "property")
    )
    stripped = F.transform("found", lambda s: F.struct(s["text"].alias("text"), s["score"].alias("score"), s["freq"].alias("freq")))
    empty = F.array().cast("array<struct<text:string,score:double,freq:int>>")
    return names.join(lists, "property", "left").orderBy("position").select(
        "property", F.coalesce(stripped, empty).alias("suggestions")
    )


def ranked(documents: DataFrame, query: str, text_field: str = "text", key: str = "doc_id", k1: float = K1,
           b: float = B) -> DataFrame:
    """(key, ``score``) of the documents with any query term, by BM25.

    Texts are read once. What is kept of a document is its length and its count of each
    query term, taken inside the row; the corpus figures (documents, mean length,
    documents per term) are one aggregate row over these, read as a scalar subquery.
    Nothing is exploded or shuffled, whatever the corpus size.
    """
    terms = list(dict.fromkeys(text.words_of(query)))
    if not terms:
        return documents.filter(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    words = documents.select(key, text.tokens(F.col(text_field)).alias("_words"))
    found = words.select(key, F.size("_words").alias("_length"), text.only(F.col("_words"), terms).alias("_found"))
    counted = found.select(key, "_length", *[text.term_count(F.col("_found"), t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    counted = stored(counted, "counted")
    figures = counted.agg(
        F.struct(
            F.count("*").alias("docs"), F.avg("_length").alias("mean"),
            *[F.count(F.when(F.col(f"_tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))],
        ).alias("f")
    )
    any_term = reduce(lambda x, y: x | y, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])
    matched = counted.filter(any_term).withColumn("_f", figures.scalar())
    docs, mean = F.col("_f.docs"), F.col("_f.mean")
    score = F.lit(0.0)
    for i in range(len(terms)):
        df, tf = F.col(f"_f.df{i}"), F.col(f"_tf{i}")
        idf = F.log(F.lit(1.0) + (docs - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_length") / mean))
    return matched.select(key, score.alias("score"))


def relevant(view: DataFrame, query: str, page: int, page_size: int, fields: Sequence[str] = USER_FIELDS) -> DataFrame:
    """A page of the rows with any query term, best first: the order when no sort is
    given. Only the page's few ids go back to the view for their rows."""
    texts = view.select("id", F.concat_ws(" ", *fields).alias("text"))
    scored = ranked(texts, query, key="id").withColumn("score", F.round("score", 6))
    best = [F.col("score").desc(), F.col("id").asc()]
    top = _page(scored, best, page, page_size, DEEP)
    return view.join(F.broadcast(top) if page_size <= BROADCAST_PAGE else top, "id").orderBy(*best)


def dangling(users: DataFrame, departments: DataFrame) -> DataFrame:
    """Users whose department is gone: references are only checked when written."""
    ids = departments.select(F.col("id").alias("_department"))
    return users.filter(F.col("department.id").isNotNull()).join(ids, F.col("department.id") == F.col("_department"), "left_anti")


def placed(users: DataFrame, departments: DataFrame) -> DataFrame:
    """Users whose department exists."""
    ids = departments.select(F.col("id").alias("_department"))
    return users.join(ids, F.col("department.id") == F.col("_department"), "left_semi")
