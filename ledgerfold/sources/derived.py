"""Journals and command logs derived from the generated tables.

``events`` gives user events and user commands, ``orders`` gives department events and
commands. All rules are row-local but the numbering of events, which is a running count
per entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators.cells import CellPlan, uncut
from ledgerfold.operators.journal import number_events, with_tags
from ledgerfold.operators.specs import DEPARTMENT, USER
from ledgerfold.schemas import ADDRESS, DEPARTMENT_REF
from ledgerfold.sources.tables import table

# How the tables' own codes read as event and command kinds.
USER_EVENT_KINDS = {"signup": "created", "view": "emailUpdated", "click": "addressUpdated", "purchase": "departmentUpdated"}
USER_COMMAND_KINDS = {
    "signup": "create", "view": "changeEmail", "click": "changeAddress", "purchase": "changeDepartment", "error": "remove",
}
DEPARTMENT_EVENT_KINDS = {"O": "created", "P": "updated", "F": "removed"}
DEPARTMENT_COMMAND_KINDS = {"O": "create", "P": "update", "F": "remove"}
COUNTRIES = ("CA", "UK", "UA", "US", "MX")


def _mapped(code: Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for key, name in names.items():
        out = F.when(code == key, F.lit(name)).otherwise(out)
    return out


def _text(column: Column) -> Column:
    return column.cast("string")


def _country(event: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (event % len(COUNTRIES) + 1).cast("int"))


def _address(event: Column, zip_code: Column) -> Column:
    """An address for every event."""
    return F.struct(
        F.concat(F.lit("street "), _text(event % 100)).alias("street"),
        _text(event % 50).alias("number"),
        zip_code.alias("zip"),
        F.concat(F.lit("city "), _text(event % 20)).alias("city"),
        F.concat(F.lit("state "), _text(event % 10)).alias("state"),
        _country(event).alias("country"),
    )


def _user_base(events: DataFrame, kinds: dict[str, str], otherwise: str, zip_code: Column, departments: int) -> DataFrame:
    event = F.col("event_id")
    return events.select(
        "event_id", "ts", _text(F.col("user_id")).alias("entity_id"),
        _mapped(F.col("event_type"), kinds, otherwise).alias("kind"),
        F.concat(F.lit("user"), _text(F.col("user_id"))).alias("username"),
        F.concat(F.lit("u"), _text(event), F.lit("@test.com")).alias("email"),
        F.concat(F.lit("pass"), _text(event)).alias("pass"),
        _address(event, zip_code).alias("address"),
        F.struct(F.concat(F.lit("d"), _text(event % departments + 1)).alias("id")).alias("department"),
    )


def user_events(events: DataFrame) -> DataFrame:
    """User events without numbers; ``event_id`` and ``ts`` order them. Every 11th
    event carries no address, which clears it. Batch or stream."""
    event = F.col("event_id")
    zip_code = F.when(event % 7 == 0, F.lit("bad")).otherwise(F.lpad(_text(event % 100000), 5, "0"))
    base = _user_base(events, USER_EVENT_KINDS, "removed", zip_code, 4)
    return base.withColumn("address", F.when(event % 11 != 0, F.col("address")))


def planned_user_journal(spark: SparkSession, folder: str) -> tuple[DataFrame, CellPlan]:
    """The user journal, with ``event_id``, and the plan it was numbered by."""
    numbered, plan = number_events(user_events(table(spark, folder, "events")))
    return with_tags(numbered, USER), plan


def user_journal(spark: SparkSession, folder: str) -> DataFrame:
    return uncut(planned_user_journal(spark, folder)[0]).drop("event_id")


def user_journal_stream(stream: DataFrame) -> DataFrame:
    """A journal of streamed events. Their ids rise with time, so they serve as the
    sequence numbers that only have to be ordered per entity."""
    return with_tags(user_events(stream).withColumn("seq_nr", F.col("event_id") + 1).drop("event_id"), USER)


def user_commands(events: DataFrame) -> DataFrame:
    """User commands; every 13th comes without a verified subject. Batch or stream."""
    event = F.col("event_id")
    zip_code = F.when(event % 7 == 0, F.lit("bad")).otherwise(F.lit("12345"))
    base = _user_base(events, USER_COMMAND_KINDS, None, zip_code, 7)
    return base.withColumnsRenamed({"event_id": "cmd_id", "ts": "cmd_ts"}).withColumns({
        "subject": F.when(F.col("cmd_id") % 13 != 0, F.col("username")),
        "expires_at": F.lit(None).cast("timestamp_ntz"),
    })


def mixed_commands(events: DataFrame) -> DataFrame:
    """User commands as a surface receives them: some names too short, some addresses that
    are none, passwords and reads among the changes, claims that run out, and no id yet
    where a user registers."""
    rows, event, kind = user_commands(events), F.col("cmd_id"), F.col("kind")
    hour = F.make_dt_interval(hours=F.lit(1))
    return rows.withColumns({
        "kind": F.when((kind == "changeEmail") & (event % 5 == 0), "changePassword").when((kind == "changeAddress") & (event % 4 == 0), "get").otherwise(kind),
        "username": F.when(event % 17 == 0, "ab").otherwise(F.col("username")),
        "email": F.when(event % 19 == 0, F.replace("email", F.lit("@"), F.lit("."))).otherwise(F.col("email")),
        "entity_id": F.when(kind != "create", F.col("username")),
        "expires_at": F.when(event % 23 == 0, F.col("cmd_ts") - hour).when(event % 3 == 0, F.col("cmd_ts") + hour),
    })


def text_id_journal(spark: SparkSession, folder: str) -> DataFrame:
    """User events under text ids: hashes of both signs, characters beyond the basic
    plane, and one id with the lowest hash."""
    user = F.col("user_id")
    ids = F.when(user % 50 == 7, "polygenelubricants").when(user % 50 == 8, F.concat(F.lit("\U0001F600 "), _text(user))).otherwise(F.concat(F.lit("user id "), _text(user)))
    rows = table(spark, folder, "events").select(ids.alias("entity_id"), (F.col("event_id") + 1).alias("seq_nr"), "ts", F.lit("created").alias("kind"))
    empty = [F.lit(None).cast("string").alias(n) for n in ("username", "email", "pass")]
    return rows.select("*", *empty, F.lit(None).cast(ADDRESS).alias("address"), F.lit(None).cast(DEPARTMENT_REF).alias("department"))


def _department_rows(orders: DataFrame, kinds: dict[str, str]) -> DataFrame:
    key = F.col("o_orderkey")
    days = F.expr("datediff(cast(o_orderdate as date), date'1995-01-01')")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=days * 18)
    return orders.select(
        key.alias("order_id"), ts.alias("ts"), F.concat(F.lit("d"), _text(key % 6 + 1)).alias("entity_id"),
        _mapped(F.col("o_orderstatus"), kinds).alias("kind"),
        F.concat(F.lit("dep"), _text(key % 10)).alias("name"),
        F.concat(F.lit("department "), _text(key)).alias("description"),
    )


def department_events(orders: DataFrame) -> DataFrame:
    return _department_rows(orders, DEPARTMENT_EVENT_KINDS)


def planned_department_journal(spark: SparkSession, folder: str) -> tuple[DataFrame, CellPlan]:
    numbered, plan = number_events(department_events(table(spark, folder, "orders")), tie="order_id")
    return with_tags(numbered, DEPARTMENT), plan


def department_journal(spark: SparkSession, folder: str) -> DataFrame:
    return uncut(planned_department_journal(spark, folder)[0]).drop("order_id")


def department_commands(orders: DataFrame) -> DataFrame:
    rows = _department_rows(orders, DEPARTMENT_COMMAND_KINDS)
    return rows.withColumnsRenamed({"order_id": "cmd_id", "ts": "cmd_ts"}).withColumns({
        "subject": F.lit(None).cast("string"), "expires_at": F.lit(None).cast("timestamp_ntz"),
    })


def customer_view(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as user view rows, for search and paging. The nation table (25 rows by
    definition of the schema) only gives names; Spark picks the join."""
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customers = table(spark, folder, "customer").join(nations, "c_nationkey", "left")
    key = F.col("c_custkey")
    return customers.select(
        _text(key).alias("id"), F.col("c_name").alias("username"),
        F.concat(F.lit("c"), _text(key), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com")).alias("email"),
        F.struct(
            F.concat(F.lit("street "), _text(key % 100)).alias("street"), _text(key % 50).alias("number"),
            F.lpad(_text(key % 100000), 5, "0").alias("zip"), F.concat(F.lit("city "), _text(key % 20)).alias("city"),
            F.concat(F.lit("state "), _text(key % 10)).alias("state"), F.col("n_name").alias("country"),
        ).alias("address"),
        F.struct(F.concat(F.lit("d"), _text(key % 4 + 1)).alias("id")).alias("department"),
    )
