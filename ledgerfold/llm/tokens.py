"""Token counts through a digest cache: equal contents are encoded once per tokenizer
version, and what was encoded is appended to the cache for the next run."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ledgerfold.llm.common import give_back, kept, ship
from ledgerfold.session import stored, work_path

CACHE_SCHEMA = "digest binary, n_tokens bigint, version string"
#: Chunks whose counts a worker remembers, about 170 bytes each, and the longest that it
#: does.
MEMO, MEMO_CHARS = 700_000, 64
#: Marks that may follow a word; no apostrophe, which tokenizers read with the letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Tokenizer:
    """A ``.json`` or ``.model`` file. ``by_space`` tells that the tokenizer drops white
    space and that no token spans it, so a text's count is the sum over its chunks, of
    which a worker remembers ``memo``. Workers that are given less than ``MEMO`` are
    short of memory and hand back what each batch took."""

    path: str
    by_space: bool = False
    memo: int = MEMO

    @property
    def version(self) -> str:
        with open(self.path, "rb") as file:
            return hashlib.sha256(file.read()).hexdigest()


def _ready(tokenizer: Tokenizer):
    """Per worker process: functions from texts and from words to counts, and a memory of
    chunks."""
    ready = kept(__name__)
    if tokenizer not in ready:
        if tokenizer.path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to the tasks
            from tokenizers import Tokenizer as Library

            own = Library.from_file(tokenizer.path)
            own.no_truncation()
            own.no_padding()

            suffix = getattr(own.model, "end_of_word_suffix", None)
            ends = np.zeros(own.get_vocab_size(), bool)
            ends[[i for t, i in own.get_vocab().items() if suffix and t.endswith(suffix)]] = True

            def count(texts):
                return [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]

            def count_words(texts):
                """Counts of texts of letters alone, encoded as one text: a word's tokens
                are those up to one with the mark of a word's end. None if a text turns out
                to be more than one word for the tokenizer."""
                last = np.flatnonzero(ends[own.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids])
                return np.diff(last, prepend=-1).tolist() if suffix and len(last) == len(texts) else None
        else:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=tokenizer.path)

            def count(texts):
                return [len(ids) for ids in own.encode(texts, num_threads=1)]

            def count_words(texts):
                return None
        ready[tokenizer] = (count, count_words, {})
    return ready[tokenizer]


def count_texts(texts: list[str], tokenizer: Tokenizer) -> list[int]:
    """Token counts without begin, end or added special tokens."""
    count, count_words, memo = _ready(tokenizer)
    if not tokenizer.by_space:
        return count(texts) if texts else []
    if len(memo) > tokenizer.memo:
        memo.clear()
    rows, totals, missing = [], [], set()
    for text in texts:
        row = text.replace("\n", " ").split(" ")
        found = list(map(memo.get, row))
        new = [c for c, n in zip(row, found) if n is None] if None in found else []
        missing.update(new)
        rows.append(new)
        totals.append(sum(filter(None, found)))
    # Letters and the marks behind them are tokenized apart, but for a letter that is one no
    # more in lower case: the tokenizer lowers it to a letter and a mark, which joins them.
    cuts = {c: len(c.rstrip(MARKS)) for c in missing}
    cuts = {c: n for c, n in cuts.items() if 0 < n < len(c) and c[:n].isalpha() and c[:n].lower().isalpha()}
    parts = {c for c in missing if c not in cuts}
    parts.update(part for c, n in cuts.items() for part in (c[:n], c[n:]))
    known = {c: memo[c] for c in parts if c in memo}
    letters = [c for c in parts if c not in known and c.isalpha()]
    counts = count_words(letters) if letters else []
    known.update(zip(letters, counts or []))
    rest = [c for c in parts if c not in known]
    known.update(zip(rest, count(rest)) if rest else ())
    known.update([(c, known[c[:n]] + known[c[n:]]) for c, n in cuts.items()])
    memo.update(known if max(map(len, known), default=0) <= MEMO_CHARS else {c: n for c, n in known.items() if len(c) <= MEMO_CHARS})
    return [total + sum(map(known.__getitem__, row)) for total, row in zip(totals, rows)]


def counter(tokenizer: Tokenizer):
    """The count as a column function; null counts as empty."""

    @arrow_udf(T.LongType())
    def n_tokens(texts: pa.Array) -> pa.Array:
        counts = []
        for start in range(0, len(texts), 256):
            counts += count_texts([t or "" for t in texts.slice(start, 256).to_pylist()], tokenizer)
        if tokenizer.memo < MEMO:
            give_back()
        return pa.array(counts, pa.int64())

    return n_tokens


def content_digest(text: Column) -> Column:
    """SHA-256 of the text with every kind of line and tab space as a blank."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), "\t\r\n", "   "), 256))


def cached_counts(docs: DataFrame, tokenizer: Tokenizer, cache: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8) and n_tokens.

    Contents are joined with the cache folder by digest and tokenizer version. Of each
    content that the cache lacks one row is encoded, found by its digest and smallest
    doc_id, and appended. The texts cross the network once; copies meet their counts by
    digest, where adaptive execution splits the rows of a hot content. Without ``cache`` a
    new folder below the shared one is used.

    Null and empty texts have no bytes and no tokens. Repeated rows keep their number; ids
    may be null. A text is encoded whole, however long. An append that failed half way
    leaves no file behind, and a digest that two runs appended counts once.
    """
    spark, version = docs.sparkSession, tokenizer.version
    ship(spark)
    folder = cache or work_path(spark, "token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(folder)

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(folder).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    rows = docs.select("doc_id", "text").withColumn("digest", content_digest(F.col("text")))
    base = stored(rows.select("doc_id", "digest", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "digests")
    missing = base.groupBy(F.col("digest").alias("d")).agg(F.min("doc_id").alias("i"))
    missing = missing.join(known(), F.col("d") == F.col("digest"), "left_anti")
    first = (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i"))
    fresh = rows.join(missing.hint("shuffle_hash"), first, "left_semi")
    encoded = fresh.select("digest", counter(tokenizer)("text").alias("n_tokens")).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    encoded.withColumn("version", F.lit(version)).write.mode("append").parquet(folder)
    counts = stored(known(), "counts")
    return base.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def counted(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id and n_tokens of every row, without a cache and without a shuffle."""
    ship(docs.sparkSession)
    return docs.select("doc_id", counter(tokenizer)("text").alias("n_tokens"))
