"""Row shapes: variants, timestamps, JSON, secrets, sort specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUGGEST_SUFFIX = "_sugg"


def variant_kind(variants: list[str]) -> Column:
    """Name of the one variant column that is set, ``empty`` if none is."""
    return F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(v)) for v in variants], F.lit("empty"))


def flatten_variants(events: DataFrame, variants: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """One row per event with ``kind`` and the payload fields side by side.

    ``variants`` maps a variant column to the payload fields it carries.
    """
    fields: dict[str, list[str]] = {}
    for variant, names in variants.items():
        for name in names:
            fields.setdefault(name, []).append(variant)
    payload = [F.coalesce(*[F.col(f"{v}.{name}") for v in owners]).alias(name) for name, owners in fields.items()]
    return events.select(*keep, variant_kind(list(variants)).alias("kind"), *payload)


def utc_micros(ts: str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ column, whatever the session time zone."""
    day = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minute = (F.hour(ts) * 60 + F.minute(ts)).cast("bigint")
    second = F.expr(f"cast(extract(second from `{ts}`) * 1000000 as bigint)")
    return day * 86_400_000_000 + minute * 60_000_000 + second


def instant(seconds: Column, nanos: Column) -> Column:
    """Seconds and nanos to a timestamp; digits below a microsecond are lost."""
    return F.timestamp_micros(seconds * 1_000_000 + F.floor(nanos / 1000).cast("bigint"))


def instant_parts(ts: Column) -> Column:
    """A timestamp to ``struct<seconds,nanos>``."""
    micros = F.unix_micros(ts)
    seconds = F.floor(micros / 1_000_000).cast("bigint")
    return F.struct(seconds.alias("seconds"), ((micros - seconds * 1_000_000) * 1000).cast("int").alias("nanos"))


def suggest_name(name: str) -> str:
    return name + SUGGEST_SUFFIX


def document_json(view: DataFrame, suggest: list[str]) -> Column:
    """A view row as JSON, with a copy of every suggested property."""
    copies = [F.col(p).alias(suggest_name(p)) for p in suggest]
    return F.to_json(F.struct(*view.columns, *copies), {"ignoreNullFields": "false"})


def document_from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def redact_secret(secret: Column, salt: Column) -> Column:
    """A salted digest in place of a secret. Not a password hash: it only keeps the
    plain text out of stored events."""
    return F.sha2(F.concat(salt, secret), 256)


def parse_sort(text: str) -> tuple[str, bool]:
    """``field:order`` to (field, ascending). Any other shape is a field name."""
    parts = text.split(":")
    while len(parts) > 1 and not parts[-1]:
        parts.pop()
    if len(parts) == 2:
        return parts[0], parts[1].lower() != "desc"
    return text, True


def sort_of(field: str, order: str) -> tuple[str, bool]:
    """A (field, ``ASC`` or ``DESC``) pair to (field, ascending)."""
    return field, order.upper() == "ASC"


def query_or_none(text: str | None) -> str | None:
    """A blank query is no query."""
    return text if text is not None and text.strip() else None


def prefix_or_empty(text: str | None) -> str:
    return text if text is not None else ""


def with_default_id(commands: DataFrame, always_username: bool = False) -> DataFrame:
    """The entity id of a registration: the given one, else the user name."""
    chosen = F.col("username") if always_username else F.coalesce(F.col("entity_id"), F.col("username"))
    return commands.withColumn("entity_id", F.when(F.col("kind") == "create", chosen).otherwise(F.col("entity_id")))


def time_bucket(ts: Column) -> Column:
    """The hour of an event as sortable text such as ``20200120T07:00``."""
    return F.date_format(ts, "yyyyMMdd'T'HH:00")
