"""Replies as result messages of the two surfaces."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.validation import joined

# Fixed values: (entity, command, reply) -> message of the gRPC surface. A message with
# {} takes the error text.
GRPC_OK = {
    ("department", "create", "Created"): "Department created",
    ("department", "update", "Updated"): "Department updated",
    ("department", "remove", "Removed"): "Department removed",
    ("user", "create", "Created"): "User registered",
    ("user", "remove", "Removed"): "User removed",
    ("user", "changeEmail", "EmailChanged"): "User email updated",
    ("user", "changePassword", "PasswordChanged"): "User password updated",
    ("user", "changeAddress", "AddressChanged"): "User address updated",
    ("user", "changeDepartment", "DepartmentChanged"): "User department updated",
}
GRPC_FAILED = {
    ("department", "create", "AlreadyExists"): "Department already exists",
    ("department", "create", "Invalid"): "Department create error ({})",
    ("department", "update", "NotExists"): "Department not exists",
    ("department", "update", "Invalid"): "Department update error ({})",
    ("department", "remove", "NotExists"): "Department not exists",
    ("user", "create", "AlreadyExists"): "User already exists",
    ("user", "create", "CreatedFailed"): "User register error ({})",
    ("user", "create", "Invalid"): "User register error ({})",
    ("user", "remove", "NotExists"): "User not exists",
    ("user", "changeEmail", "NotExists"): "User not exists",
    ("user", "changeEmail", "Invalid"): "User email update error ({})",
    ("user", "changePassword", "NotExists"): "User not exists",
    ("user", "changePassword", "Invalid"): "User password update error ({})",
    ("user", "changeAddress", "NotExists"): "User not exists",
    ("user", "changeAddress", "Invalid"): "User address update error ({})",
    ("user", "changeAddress", "AddressChangedFailed"): "User address update error ({})",
    ("user", "changeDepartment", "NotExists"): "User not exists",
    ("user", "changeDepartment", "DepartmentChangedFailed"): "User department update error ({})",
}
# HTTP status of replies that are neither success nor a bad request.
REST_STATUS = {("user", "remove", "NotExists"): 404, ("user", "get", "NotExists"): 404, ("department", "get", "NotExists"): 404}


def _lookup(table: dict, entity: str, as_lit=F.lit) -> Column:
    """The entry of this row's command and reply, null if there is none."""
    rows = {f"{command}:{reply}": value for (owner, command, reply), value in table.items() if owner == entity}
    if not rows:
        return F.lit(None)
    pairs = F.create_map(*[as_lit(x) for x in chain.from_iterable(rows.items())])
    return F.try_element_at(pairs, F.concat_ws(":", "kind", "reply_kind"))


def with_messages(decisions: DataFrame, entity: str = "user", surface: str = "grpc") -> DataFrame:
    """Adds ``ok``, ``message`` and, for REST, ``status``. REST answers a successful
    command with the entity id. The tables are constants: a map lookup, no join."""
    good = _lookup(GRPC_OK, entity)
    bad = F.replace(_lookup(GRPC_FAILED, entity), F.lit("{}"), joined(F.col("errors")))
    denied = F.col("reply_kind") == "Unauthenticated"
    ok = F.col("reply_kind").eqNullSafe("State") | good.isNotNull()
    failure = F.when(denied, F.lit("Unauthenticated")).otherwise(F.coalesce(bad, F.col("reply_kind")))
    success = F.col("entity_id") if surface == "rest" else F.coalesce(good, F.lit(""))
    out = decisions.withColumn("ok", ok).withColumn("message", F.when(F.col("ok"), success).otherwise(failure))
    if surface == "rest":
        other = F.coalesce(_lookup(REST_STATUS, entity), F.lit(400))
        out = out.withColumn("status", F.when(F.col("ok"), 200).when(denied, 401).otherwise(other))
    return out


def replies(decisions: DataFrame, entity: str = "user", surface: str = "grpc") -> DataFrame:
    """One reply per command."""
    columns = ["cmd_id", "entity_id", "reply_kind", "ok", "message"] + (["status"] if surface == "rest" else [])
    return with_messages(decisions, entity, surface).select(*columns)
