"""Validators: columns of error messages. An empty array means valid."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The accepted forms of a ZIP code and of an e-mail address.
ZIP_PATTERN = r"^\d{5}(?:[-\s]\d{4})?\z"
EMAIL_PATTERN = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\z"


@lru_cache(maxsize=1)
def iso_countries() -> tuple[str, ...]:
    """The ISO 3166 alpha-2 codes known to the JVM (about 250)."""
    spark = SparkSession.active()
    return tuple(spark.sparkContext._jvm.java.util.Locale.getISOCountries())


def no_errors() -> Column:
    return F.array().cast("array<string>")


def errors_of(*messages: Column) -> Column:
    """Messages that are not null, in order."""
    return F.array_compact(F.array(*messages))


def combined(errors: Iterable[Column]) -> Column:
    """Errors of several validators, in validator order."""
    parts = [F.coalesce(e, no_errors()) for e in errors]
    return F.concat(*parts) if parts else no_errors()


def joined(errors: Column) -> Column:
    return F.array_join(errors, ", ")


def zip_error(zip_code: Column) -> Column:
    text = F.coalesce(zip_code, F.lit(""))
    return F.when(~text.rlike(ZIP_PATTERN), F.concat(F.lit("Zip: "), text, F.lit(" is not valid")))


def country_error(country: Column, countries: Sequence[str] | None = None) -> Column:
    text = F.coalesce(country, F.lit(""))
    known = list(countries if countries is not None else iso_countries())
    return F.when(~text.isin(known), F.concat(F.lit("Country: "), text, F.lit(" is not valid ISO country")))


def address_errors(address: Column, countries: Sequence[str] | None = None) -> Column:
    """ZIP first, then country; both are reported. A missing address is valid."""
    found = errors_of(zip_error(address.getField("zip")), country_error(address.getField("country"), countries))
    return F.when(address.isNull(), no_errors()).otherwise(found)


def department_errors(department: Column, exists: Column) -> Column:
    """``exists`` says whether the referenced department was there at command time."""
    missing = F.concat(F.lit("Department: "), department.getField("id"), F.lit(" not found"))
    return errors_of(F.when(department.isNotNull() & ~F.coalesce(exists, F.lit(False)), missing))


def min_length_error(name: str, value: Column, length: int) -> Column:
    short = F.char_length(F.coalesce(value, F.lit(""))) < length
    return F.when(short, F.lit(f"{name} must have at least {length} characters"))


def email_error(name: str, value: Column) -> Column:
    return F.when(~F.coalesce(value, F.lit("")).rlike(EMAIL_PATTERN), F.lit(f"{name} must be an email address"))
