"""URL filters: rules over hosts and paths, and a list of canonical URLs tested with a
blocked Bloom filter whose possible hits an exact hash join confirms. DataFrame functions
only."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.llm.common import maybe_in
from ledgerfold.session import stored

def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered;
    empty for null and for texts without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host and path, without scheme, query, fragment or a closing slash."""
    return F.regexp_replace(F.concat(host_of(url), path_of(url)), r"/+$", "")


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, _, tail = rule.partition("/")
    return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + tail))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame) -> DataFrame:
    """Every row of ``pages`` (page_id, url) with host, path, the rule that fits and a
    verdict. ``rules`` are (verdict, ``host/path``); the longest that fits wins. Without a
    rule a page is blocked if its canonical URL is in column ``url`` of ``listed``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule, are in no
    list and are allowed. Repeated pages and repeated list entries change nothing; ids may
    be null. A url that many pages share is a hot key of the last join only, where adaptive
    execution splits the pages; the list has each key once.
    """
    keys = stored(listed.select(canonical(F.col("url")).alias("key")).where("key <> ''").distinct(), "listed")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    rule = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):
        rule = F.when(_fits(F.col("host"), F.col("path"), text), text).otherwise(rule)
    rows = rows.withColumn("rule", rule)
    rows = maybe_in(rows.withColumn("open", F.when(F.col("rule").isNull(), F.col("key"))), "open", keys, "maybe")
    verdict = F.lit("allow")
    for says, text in rules:
        verdict = F.when(F.col("rule") == text, says).otherwise(verdict)
    sure = rows.where("NOT maybe").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    open_rows = rows.where("maybe")
    hits = open_rows.join(keys.withColumnRenamed("key", "in_list"), F.col("key") == F.col("in_list"), "left")
    return sure.union(hits.select("page_id", "host", "path", "rule", F.when(F.col("in_list").isNotNull(), "block").otherwise("allow").alias("verdict")))
