"""Tokens and matching inside one row; no explode, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK)
    return F.filter(words, lambda w: w != "")


def words_of(query: str) -> list[str]:
    """The words of a query given on the driver, cut as ``tokens`` cuts a column."""
    return re.findall(r"[^\W_]+", query.lower())


def _literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def has_any(words: Column, terms: Sequence[str]) -> Column:
    return F.arrays_overlap(words, _literal(terms))


def has_all(words: Column, terms: Sequence[str]) -> Column:
    return F.size(F.array_except(_literal(terms), words)) == 0


def has_phrase(words: Column, terms: Sequence[str]) -> Column:
    """The terms side by side. Words hold no blank, so the joined text is exact."""
    if not terms:
        return F.lit(False)
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    return F.contains(spaced, F.lit(" " + " ".join(terms) + " "))


def has_prefix(words: Column, terms: Sequence[str]) -> Column:
    """The terms side by side, the last as the beginning of a word."""
    if not terms:
        return F.lit(False)
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " ")), F.lit(" " + " ".join(terms)))


def only(words: Column, terms: Sequence[str]) -> Column:
    """The words that are one of the terms, repeats included."""
    return F.filter(words, lambda w: w.isin(list(terms)))


def term_count(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))
