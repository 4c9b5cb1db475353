"""Shard numbers and tags from entity ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHARDS = 3
USER_TAG = "UserEvent"
DEPARTMENT_TAG = "DepartmentEvent"


def java_hash(text: Column) -> Column:
    """The JVM's 32-bit string hash, over UTF-16 code units, as BIGINT. Characters above
    the basic plane count as their two surrogates."""

    def step(acc: Column, char: Column) -> Column:
        code = F.ascii(char)
        beyond = code - 0x10000
        first = acc * 31 + (F.shiftright(beyond, 10) + 0xD800)
        second = first * 31 + (beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
        return F.when(code < 0x10000, acc * 31 + code).otherwise(second).bitwiseAND(F.lit(0xFFFFFFFF))

    rolled = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), step)
    return F.when(rolled > 0x7FFFFFFF, rolled - (1 << 32)).otherwise(rolled)


def shard_number(entity_id: Column, shards: int = SHARDS, safe: bool = False) -> Column:
    """``abs(hash) % shards`` in 32-bit arithmetic: the one hash whose absolute value
    overflows keeps its sign. ``safe`` drops that sign, which gives that id a real shard
    and changes no other."""
    hashed = java_hash(entity_id)
    lowest, left = -(1 << 31), (1 << 31) % shards
    return F.when(hashed == lowest, left if safe else -left).otherwise(F.abs(hashed) % shards).cast("int")


def shard_tag(entity_id: Column, base_tag: str, shards: int = SHARDS, safe: bool = False) -> Column:
    return F.concat(F.lit(base_tag), shard_number(entity_id, shards, safe).cast("string"))


def tag_of(entity_id: str, base_tag: str, shards: int = SHARDS, safe: bool = False) -> str:
    """The tag of one known id."""
    raw = entity_id.encode("utf-16-be")
    hashed = 0
    for i in range(0, len(raw), 2):
        hashed = (hashed * 31 + int.from_bytes(raw[i:i + 2], "big")) % (1 << 32)
    signed = hashed - (1 << 32) if hashed >= 1 << 31 else hashed
    left = (1 << 31) % shards
    number = (left if safe else -left) if signed == -(1 << 31) else abs(signed) % shards
    return f"{base_tag}{number}"


def tags_of_id(entity_id: str, base_tag: str, shards: int = SHARDS) -> list[str]:
    """The tags that one known id may be stored under, for pruning partitions of a point
    lookup: one, and two for ids whose tag depends on ``safe``."""
    return sorted({tag_of(entity_id, base_tag, shards, safe) for safe in (False, True)})


def stored_tags(base_tag: str, shards: int = SHARDS) -> list[str]:
    """Every tag that a journal may hold: those of all shards, and that of the hash whose
    sign is kept."""
    return sorted({f"{base_tag}{n}" for n in range(shards)} | {f"{base_tag}{-((1 << 31) % shards)}"})


def all_tags(base_tag: str, shards: int = SHARDS) -> Column:
    """Every tag of an entity type, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.concat(F.lit(base_tag), i.cast("string")))
