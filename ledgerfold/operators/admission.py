"""Checks at the service surface, ahead of any entity: who may ask, and field rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.validation import email_error, errors_of, min_length_error

# Command kinds that need a verified caller, per entity and surface.
GATED = {
    ("user", "grpc"): ("remove", "changeEmail", "changePassword", "changeAddress", "changeDepartment"),
    ("user", "rest"): ("remove", "changeAddress"),
    ("department", "grpc"): (),
    ("department", "rest"): (),
}


@dataclass(frozen=True)
class FieldRule:
    kinds: tuple[str, ...]
    field: str
    min_length: int | None = None
    email: bool = False

    def error(self) -> Column:
        value = F.col(self.field)
        found = email_error(self.field, value) if self.email else min_length_error(self.field, value, self.min_length)
        applies = F.col("kind").isin(list(self.kinds))
        if "." in self.field:
            applies = applies & F.col(self.field.split(".")[0]).isNotNull()
        return F.when(applies, found)


# The request field rules. Only the gRPC surface applies them.
RULES: Mapping[str, tuple[FieldRule, ...]] = {
    "user": (
        FieldRule(("create",), "username", min_length=4),
        FieldRule(("create", "changeEmail"), "email", email=True),
        FieldRule(("create", "changePassword"), "pass", min_length=4),
        FieldRule(("create", "changeAddress"), "address.country", min_length=2),
    ),
    "department": (FieldRule(("create", "update"), "name", min_length=2),),
}


def rule_errors(rules: Sequence[FieldRule]) -> Column:
    return errors_of(*[r.error() for r in rules])


def unauthenticated(kinds: Sequence[str]) -> Column:
    """A gated command without a subject, or whose claim has run out by its time."""
    if not kinds:
        return F.lit(False)
    expired = F.coalesce(F.col("expires_at") <= F.col("cmd_ts"), F.lit(False))
    return F.coalesce(F.col("kind").isin(list(kinds)), F.lit(False)) & (F.col("subject").isNull() | expired)


def admit(commands: DataFrame, entity: str = "user", surface: str = "grpc") -> DataFrame:
    """Adds ``reply_kind`` (``Unauthenticated``, ``Invalid`` or null for admitted) and
    ``errors``. The caller is checked before the fields."""
    rules = RULES[entity] if surface == "grpc" else ()
    errors = rule_errors(rules) if rules else F.array().cast("array<string>")
    denied = unauthenticated(GATED[(entity, surface)])
    return (
        commands.withColumn("errors", F.when(denied, F.array().cast("array<string>")).otherwise(errors))
        .withColumn("reply_kind", F.when(denied, F.lit("Unauthenticated")).when(F.size("errors") > 0, F.lit("Invalid")))
    )


def admitted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reply_kind").isNull()).drop("reply_kind", "errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reply_kind").isNotNull())
