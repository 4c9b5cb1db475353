"""Language identification by compression: a text is encoded once per language with a
zstandard compressor that starts from that language's raw-content dictionary, and belongs
to the language that makes it smallest."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.functions import arrow_udf

from ledgerfold.llm.common import ship, trimmed

#: The bound of what is learned from: of each of the most frequent ``LANGUAGES`` values of
#: lang at most ``SAMPLE`` stretches of ``STRETCH`` characters, one of a text, and of these
#: ``DICTIONARY`` bytes.
LANGUAGES, SAMPLE, STRETCH, DICTIONARY = 200, 600, 512, 100 << 10
#: Bytes that are compressed by themselves, so that the dictionary and not the text's own
#: beginning is what later words are found in; and the level of the compressor.
BLOCK, LEVEL = 4096, 9
#: A language is accepted if the next one needs this share of bytes more.
MARGIN = 0.01
UNKNOWN = "und"
#: Words are what lies between ASCII characters that are no letters.
APART = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Model:
    """(language, dictionary) in order of preference: most frequent first, ties by name."""

    languages: tuple[tuple[str, bytes], ...]


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def plain(text: str) -> bytes:
    """Lower case, everything between words as one blank, in UTF-8."""
    return APART.sub(" ", " " + text + " ").lower().encode()


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Dictionaries from the rows whose ``crc32(doc_id) mod 4`` is not 2 and whose text and
    lang are not null. The sample goes by a hash of the id, equal stretches count once; a
    language whose sample has no letter is not learned."""
    rows = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return Model(())
    # A hash below the language's threshold keeps a few times the sample, so that the
    # window sees a bounded number of rows however many a language has.
    limits = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * sample / r["count"])) for r in sizes], "of string, share double")
    hashed = F.xxhash64("doc_id", F.lit("sample"))
    some = rows.join(F.broadcast(limits), F.col("lang") == F.col("of")).where(F.pmod(hashed, F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    # One stretch of each text, from anywhere in it.
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1) + 1
    some = some.select("lang", F.substring("text", start.cast("int"), F.lit(STRETCH)).alias("stretch"), hashed.alias("h"))
    order = Window.partitionBy("lang").orderBy("h", "stretch")
    chosen = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).orderBy("lang", "rank").collect()
    parts: dict[str, list[bytes]] = {r["lang"]: [] for r in sizes}
    for r in chosen:
        part = plain(r["stretch"])
        if any(map(str.isalpha, r["stretch"])) and part not in parts[r["lang"]] and sum(map(len, parts[r["lang"]])) < DICTIONARY:
            parts[r["lang"]].append(part)
    return Model(tuple((lang, b"".join(own)[-DICTIONARY:]) for lang, own in parts.items() if own))


@functools.lru_cache(maxsize=1)
def _compressors(model: Model) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, content in model.languages:
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=BLOCK, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=settings)
        made.append((lang, zstandard.ZstdCompressor(dict_data=words, compression_params=settings)))
    return made


def sizes(text: str, model: Model) -> list[int]:
    """Compressed bytes of the whole text for each language of the model."""
    raw = plain(text)
    blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for _, c in _compressors(model)]


def judged(text: str | None, model: Model) -> tuple[str, float, float, bool]:
    """(language, score, margin, accepted) of one text. Ties go to the language that comes
    first in the model."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, False
    each = sizes(text, model)
    least, at = min((n, i) for i, n in enumerate(each))
    others = each[:at] + each[at + 1:]
    margin = min(others) / least - 1 if others else 1.0
    # Each byte more halves a language's likelihood.
    score = 1.0 / sum(2.0 ** -min(n - least, 60) for n in each)
    return model.languages[at][0], score, margin, margin >= MARGIN


_JUDGED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def classifier(model: Model):
    """The judgement of a text column as a struct."""

    @arrow_udf(_JUDGED)
    @trimmed
    def judge(texts: pa.Array) -> pa.Array:
        columns = zip(*[judged(t, model) for t in texts.to_pylist()]) if len(texts) else [[]] * 4
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=_JUDGED.names)

    return judge


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, margin and accepted.

    ``lang_pred`` is the language whose dictionary makes the whole text smallest, however
    long it is, or ``und`` for texts that are null, empty or have no letter, and for all if
    nothing was learned. ``score`` is that language's share if each byte more halves the
    likelihood; ``margin`` is how much more, relatively, the next language needs, and a
    text whose margin is below ``MARGIN`` is not accepted: a pipeline should leave its
    language open. With one learned language the margin is 1. A null doc_id counts as an
    empty text for ``held_out``. Repeated rows are judged alike. Only the text is judged.
    """
    ship(docs.sparkSession)
    judge = classifier(learn(docs) if model is None else model)
    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), judge(F.col("text")).alias("j"))
    return rows.select("doc_id", "held_out", "j.*")
