"""Declared entities: which event sets which field, and which command gives which event."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from ledgerfold.functions.ids import DEPARTMENT_TAG, USER_TAG
from ledgerfold.schemas import ADDRESS, DEPARTMENT_REF


@dataclass(frozen=True)
class Field:
    """A state field, the event kinds that set it, and its value before any did."""

    name: str
    dtype: str
    kinds: tuple[str, ...]
    default: str | None = None
    secret: bool = False


@dataclass(frozen=True)
class EntitySpec:
    name: str
    base_tag: str
    fields: tuple[Field, ...]
    created: str = "created"
    removed: str = "removed"
    projections: tuple[str, ...] = ()

    @property
    def shown(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if not f.secret)


@dataclass(frozen=True)
class Rule:
    """What one command does in one state. ``failure`` is the reply, without an event,
    for a command whose validators found errors."""

    command: str
    reply: str
    event: str | None = None
    failure: str | None = None


@dataclass(frozen=True)
class GateSpec:
    entity: EntitySpec
    absent: tuple[Rule, ...]
    present: tuple[Rule, ...]
    absent_reply: str = "NotExists"
    present_reply: str = "AlreadyExists"


@dataclass(frozen=True)
class Validator:
    """Errors (array column) that count for some command kinds."""

    kinds: tuple[str, ...]
    errors: Callable[[], Column]


USER = EntitySpec(
    name="user",
    base_tag=USER_TAG,
    fields=(
        Field("username", "string", ("created",), ""),
        Field("email", "string", ("created", "emailUpdated"), ""),
        Field("pass", "string", ("created", "passwordUpdated"), "", secret=True),
        Field("address", ADDRESS, ("created", "addressUpdated")),
        Field("department", DEPARTMENT_REF, ("created", "departmentUpdated")),
    ),
    projections=("userView", "userKafka"),
)

DEPARTMENT = EntitySpec(
    name="department",
    base_tag=DEPARTMENT_TAG,
    fields=(
        Field("name", "string", ("created", "updated"), ""),
        Field("description", "string", ("created", "updated"), ""),
    ),
    projections=("departmentView", "departmentKafka"),
)

USER_GATE = GateSpec(
    entity=USER,
    absent=(Rule("create", "Created", "created", failure="CreatedFailed"),),
    present=(
        Rule("changeEmail", "EmailChanged", "emailUpdated"),
        Rule("changePassword", "PasswordChanged", "passwordUpdated"),
        Rule("changeAddress", "AddressChanged", "addressUpdated", failure="AddressChangedFailed"),
        Rule("changeDepartment", "DepartmentChanged", "departmentUpdated", failure="DepartmentChangedFailed"),
        Rule("remove", "Removed", "removed"),
        Rule("get", "State"),
    ),
)

DEPARTMENT_GATE = GateSpec(
    entity=DEPARTMENT,
    absent=(Rule("create", "Created", "created"),),
    present=(
        Rule("create", "AlreadyExists"),
        Rule("update", "Updated", "updated"),
        Rule("remove", "Removed", "removed"),
        Rule("get", "State"),
    ),
)
