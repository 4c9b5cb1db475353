"""The registered queries: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ledgerfold.llm import alignment, decontam, html, langid, licenses, neardup, packing, substring, tokens, topk, toxicity, urls, whitening
from ledgerfold.llm.common import table

#: Rules of the URL filter, and the host labels of gambling, pharmacy and advert sites
#: whose pages make up the list of URLs.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LISTED_LABELS = ("casino-win", "free-bets", "cheap-pills", "ads-track")
TOKEN_LIMIT = 2048

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_top_k_search(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op2_decontamination(spark, folder):
    return decontam.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op3_toxicity(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_license_scan(spark, folder):
    return licenses.scan(table(spark, folder, "documents"))


@query
def op6_url_filters(spark, folder):
    pages = table(spark, folder, "pages")
    labels = F.split(urls.host_of(F.col("url")), r"\.")
    listed = pages.where(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in LISTED_LABELS])))
    return urls.judge(pages, URL_RULES, listed)


@query
def op5_best_fit_packing(spark, folder):
    docs = table(spark, folder, "documents")
    return packing.pack(tokens.counted(docs, word_tokenizer()))


def word_tokenizer(path: str | None = None, memo: int = tokens.MEMO) -> tokens.Tokenizer:
    return tokens.Tokenizer(path or public_tokenizers.path("word_bpe_49k.json"), by_space=True, memo=memo)


@query
def op7_html_extraction(spark, folder):
    return html.extracted(table(spark, folder, "pages"))


@query
def op9_token_counts(spark, folder):
    counts = tokens.cached_counts(table(spark, folder, "documents"), word_tokenizer())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op8_near_duplicates(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op10_substring_dedup(spark, folder):
    return substring.repeats(table(spark, folder, "documents"))


@query
def op11_embedding_whitening(spark, folder):
    return whitening.components(table(spark, folder, "embeddings"))


@query
def op12_cross_tokenizer_alignment(spark, folder):
    files = alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.report(table(spark, folder, "documents"), files)


@query
def op13_language_id(spark, folder):
    return langid.identified(table(spark, folder, "documents"))
