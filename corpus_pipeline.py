"""A training-data pipeline over ``documents``: five stages, each on all that the one
before kept. The first four return the columns of documents, the last the packed pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerfold.llm import decontam, neardup, packing, substring, tokens, toxicity
from ledgerfold.llm.common import table
from ledgerfold.llm.queries import word_tokenizer
from ledgerfold.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return neardup.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out."""
    return substring.without_repeats(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of tokens in sequences of the permitted lengths. The workers
    of the earlier stages still hold memory, so those that count remember little."""
    return packing.pack(tokens.counted(docs, word_tokenizer(memo=20_000)))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: Learned scores, signatures and token counts have no SQL form; tests/llm compares each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
