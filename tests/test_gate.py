import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import model
from ledgerfold.operators import admission, fold, gate, replies, service, state
from ledgerfold.operators.specs import USER, EntitySpec, Field, GateSpec, Rule, Validator
from ledgerfold.schemas import DEPARTMENT_COMMANDS, USER_COMMANDS

LIFECYCLE = "entity_id string, seq_nr bigint, ts timestamp_ntz, kind string"


def at(minute):
    return model.START + timedelta(minutes=minute)


def command(cmd_id, kind, entity="u1", minute=None, address=None, department=None, subject="me", expires=None, **other):
    return (
        cmd_id, at(cmd_id if minute is None else minute), entity, kind, other.get("username", "name"), other.get("email", "a@b.com"),
        other.get("password", "secret"), address, department and (department,), subject, expires,
    )


def decide(spark, commands, marks=(), carried=None):
    rows = spark.createDataFrame(commands, USER_COMMANDS).repartition(3)
    departments = spark.createDataFrame(list(marks), LIFECYCLE)
    return gate.user_gate(rows, departments, carried)


def outcome(decided):
    return {r["cmd_id"]: (r["event_kind"], r["reply_kind"], r["seq_nr"]) for r in decided.collect()}


D1 = [("d1", 1, at(0), "created")]


def test_transition_table(spark):
    bad = model.address("x", "UK")
    got = outcome(decide(spark, [
        command(1, "changeEmail"), command(2, "get"), command(3, "remove"),
        command(4, "create", address=bad), command(5, "create", department="nope"),
        command(6, "create", address=model.address(), department="d1"),
        command(7, "create", address=bad), command(8, "changeEmail"), command(9, "changePassword"),
        command(10, "changeAddress", address=model.address()), command(11, "changeAddress", address=bad),
        command(12, "changeAddress"), command(13, "changeDepartment", department="d1"),
        command(14, "changeDepartment", department="d9"), command(15, "changeDepartment"), command(16, "get"),
        command(17, "remove"), command(18, "remove"), command(19, "create"),
    ], D1))
    assert got == {
        1: (None, "NotExists", None), 2: (None, "NotExists", None), 3: (None, "NotExists", None),
        4: (None, "CreatedFailed", None), 5: (None, "CreatedFailed", None), 6: ("created", "Created", 1),
        7: (None, "AlreadyExists", None), 8: ("emailUpdated", "EmailChanged", 2), 9: ("passwordUpdated", "PasswordChanged", 3),
        10: ("addressUpdated", "AddressChanged", 4), 11: (None, "AddressChangedFailed", None), 12: ("addressUpdated", "AddressChanged", 5),
        13: ("departmentUpdated", "DepartmentChanged", 6), 14: (None, "DepartmentChangedFailed", None),
        15: ("departmentUpdated", "DepartmentChanged", 7), 16: (None, "State", None), 17: ("removed", "Removed", 8),
        18: (None, "NotExists", None), 19: ("created", "Created", 9),
    }


def test_error_texts_in_validator_order(spark):
    decided = decide(spark, [command(1, "create", address=model.address("x", "UK"), department="d7")])
    row = replies.replies(decided).first()
    assert row["message"] == "User register error (Zip: x is not valid, Country: UK is not valid ISO country, Department: d7 not found)"
    assert not row["ok"]


def test_department_is_looked_up_as_of_the_command(spark, cell_mode):
    marks = [("d1", 1, at(10), "created"), ("d1", 2, at(20), "removed"), ("d1", 3, at(30), "created")]
    asks = [command(n, "changeDepartment", entity=f"u{n}", minute=m, department="d1") for n, m in enumerate([5, 10, 15, 20, 25, 30, 35])]
    rows = gate.with_department_exists(spark.createDataFrame(asks, USER_COMMANDS), spark.createDataFrame(marks, LIFECYCLE))
    got = [r["department_exists"] for r in rows.orderBy("cmd_id").collect()]
    # A lifecycle event counts for commands of the same instant.
    assert got == [False, True, True, False, False, True, True]


def test_scenario_user_with_department(spark):
    made = gate.department_gate(spark.createDataFrame([(1, at(0), "d1", "create", "dep1", "department 1", None, None)], DEPARTMENT_COMMANDS))
    assert [r["reply_kind"] for r in made.collect()] == ["Created"]
    marks = gate.lifecycle_events(gate.events(made, gate.DEPARTMENT_GATE))
    commands = spark.createDataFrame([
        command(2, "create", entity="id-1", department="d1", username="d", email="d@dd.com", password="p"), command(3, "get", entity="id-1"),
    ], USER_COMMANDS)
    decided = gate.user_gate(commands, marks)
    assert [r["reply_kind"] for r in decided.orderBy("cmd_id").collect()] == ["Created", "State"]
    row = state.read_state(gate.events(decided, gate.USER_GATE), USER, "id-1").first()
    assert row["id"] == "id-1" and row["department"]["id"] == "d1" and row["username"] == "d" and row["address"] is None


def test_scenario_unknown_department(spark):
    decided = decide(spark, [command(1, "create", entity="id-2", department="other", username="c", email="c@cc.com", password="p")], D1)
    assert [r["reply_kind"] for r in decided.collect()] == ["CreatedFailed"]
    assert gate.events(decided, gate.USER_GATE).count() == 0


def _simulate(commands, marks, start=None):
    """One command after the other. Returns cmd_id -> (event, reply, number)."""
    alive, numbers, out = {}, {}, {}
    for entity, (number, there) in (start or {}).items():
        alive[entity], numbers[entity] = there, number

    def known(department, when):
        last = max((m for m in marks if m[0] == department and m[2] <= when), key=lambda m: (m[2], m[1]), default=None)
        return last is not None and last[3] == "created"

    for c in sorted(commands, key=lambda c: (c[1], c[0])):
        cmd_id, when, entity, kind, address, department = c[0], c[1], c[2], c[3], c[7], c[8]
        good_address = address is None or (address[2] == "12345" and address[5] == "US")
        good_department = department is None or known(department[0], when)
        event, reply = None, "NotExists"
        if not alive.get(entity, False):
            if kind == "create":
                fine = good_address and good_department
                event, reply = ("created", "Created") if fine else (None, "CreatedFailed")
        elif kind == "create":
            reply = "AlreadyExists"
        elif kind == "changeAddress":
            event, reply = ("addressUpdated", "AddressChanged") if good_address else (None, "AddressChangedFailed")
        elif kind == "changeDepartment":
            event, reply = ("departmentUpdated", "DepartmentChanged") if good_department else (None, "DepartmentChangedFailed")
        else:
            event, reply = {
                "changeEmail": ("emailUpdated", "EmailChanged"), "changePassword": ("passwordUpdated", "PasswordChanged"),
                "remove": ("removed", "Removed"), "get": (None, "State"),
            }[kind]
        if event in ("created", "removed"):
            alive[entity] = event == "created"
        if event:
            numbers[entity] = numbers.get(entity, 0) + 1
        out[cmd_id] = (event, reply, numbers[entity] if event else None)
    return out


KINDS = ["create", "create", "changeEmail", "changePassword", "changeAddress", "changeDepartment", "remove", "get"]


def _random(seed, count=300):
    draw = random.Random(seed)
    commands = [
        command(
            n, draw.choice(KINDS), entity="hot" if draw.random() < 0.5 else f"u{draw.randint(0, 9)}", minute=draw.randint(0, 200),
            address=draw.choice([None, model.address(), model.address("bad", "US"), model.address("12345", "UK")]),
            department=draw.choice([None, "d1", "d2", "d3"]),
        ) for n in range(count)
    ]
    marks = [(f"d{d}", n + 1, at(10 * n + d), draw.choice(["created", "removed"])) for d in (1, 2) for n in range(20)]
    return commands, marks


@pytest.mark.parametrize("seed", range(3))
def test_gate_equals_a_sequential_run(spark, cell_mode, seed):
    commands, marks = _random(seed)
    assert outcome(decide(spark, commands, marks)) == _simulate(commands, marks)


def test_gate_continues_from_carried_state(spark, cell_mode):
    commands, marks = _random(9)
    start = {"hot": (17, True), "u1": (4, False), "u2": (9, True), "gone": (3, True)}
    carried = spark.createDataFrame([(e, n, a) for e, (n, a) in start.items()], "entity_id string, last_seq bigint, alive boolean")
    assert outcome(decide(spark, commands, marks, carried)) == _simulate(commands, marks, start)


def test_carried_state_of_a_journal(spark):
    rows = [("a", 1, at(0), "created"), ("a", 2, at(1), "emailUpdated"), ("b", 1, at(0), "created"), ("b", 2, at(1), "removed")]
    got = gate.carried_state(spark.createDataFrame(rows, LIFECYCLE), gate.USER_GATE)
    assert sorted(map(tuple, got.collect())) == [("a", 2, True), ("b", 2, False)]


def test_both_folds_agree_on_gated_events(spark):
    commands, marks = _random(4)
    events = gate.events(decide(spark, commands, marks), gate.USER_GATE)
    by_view = sorted(map(tuple, fold.view_fold(events, USER).collect()), key=repr)
    by_state = sorted(map(tuple, state.state_fold(events, USER).drop("last_seq").collect()), key=repr)
    assert by_view == by_state and by_view


def test_department_gate(spark, cell_mode):
    kinds = ["update", "create", "create", "update", "get", "remove", "remove", "get", "create"]
    rows = [(n, at(n), "d1", k, "n", "d", None, None) for n, k in enumerate(kinds)]
    decided = gate.department_gate(spark.createDataFrame(rows, DEPARTMENT_COMMANDS))
    assert [r["reply_kind"] for r in decided.orderBy("cmd_id").collect()] == [
        "NotExists", "Created", "AlreadyExists", "Updated", "State", "Removed", "NotExists", "NotExists", "Created"]
    events = gate.events(decided, gate.DEPARTMENT_GATE).orderBy("seq_nr").collect()
    assert [(e["seq_nr"], e["kind"]) for e in events] == [(1, "created"), (2, "updated"), (3, "removed"), (4, "created")]


def test_admission(spark):
    rows = spark.createDataFrame([
        command(1, "remove", subject=None), command(2, "remove"), command(3, "create", subject=None),
        command(4, "changeEmail", expires=at(3)), command(5, "changeEmail", expires=at(6)),
        command(6, "create", username="abc", email="nope", password="p"), command(7, "changeEmail", subject=None, email="nope"),
        command(8, "changeAddress", address=model.address("1", "U")), command(9, "changeDepartment"),
    ], USER_COMMANDS)
    grpc = {r["cmd_id"]: (r["reply_kind"], len(r["errors"])) for r in admission.admit(rows).collect()}
    assert grpc == {
        1: ("Unauthenticated", 0), 2: (None, 0), 3: (None, 0), 4: ("Unauthenticated", 0), 5: (None, 0), 6: ("Invalid", 3),
        7: ("Unauthenticated", 0), 8: ("Invalid", 1), 9: (None, 0),
    }
    rest = {r["cmd_id"]: r["reply_kind"] for r in admission.admit(rows, surface="rest").collect()}
    assert {k for k, v in rest.items() if v} == {1}


def test_service_calls(spark):
    rows = spark.createDataFrame([
        command(1, "create", entity=None, username="anna", subject=None), command(2, "create", entity=None, username="bo"),
        command(3, "changeEmail", entity="anna", subject=None), command(4, "changeEmail", entity="anna"),
        command(5, "remove", entity="anna"), command(6, "remove", entity="anna"),
    ], USER_COMMANDS)
    none = spark.createDataFrame([], LIFECYCLE)
    events, answers = service.handle(rows, departments=none, salt="salt")
    assert [(r["entity_id"], r["ok"], r["message"]) for r in answers.orderBy("cmd_id").collect()] == [
        ("anna", True, "User registered"), ("bo", False, "User register error (username must have at least 4 characters)"),
        ("anna", False, "Unauthenticated"), ("anna", True, "User email updated"), ("anna", True, "User removed"),
        ("anna", False, "User not exists"),
    ]
    created = events.filter(F.col("kind") == "created").first()
    assert len(created["pass"]) == 64 and created["pass"] != "secret"
    _, rest = service.handle(rows, surface="rest", departments=none)
    assert [(r["status"], r["message"]) for r in rest.orderBy("cmd_id").collect()] == [
        (200, "anna"), (200, "bo"), (200, "anna"), (200, "anna"), (200, "anna"), (404, "User not exists"),
    ]


def test_state_seen_by_reads(spark, cell_mode):
    decided = decide(spark, [
        command(1, "get"), command(2, "create", address=model.address(), email="x@y.com"), command(3, "get"),
        command(4, "changeAddress"), command(5, "get"), command(6, "remove"), command(7, "get"), command(8, "create", email="z@y.com"),
        *[command(n, "get") for n in range(9, 20)],
    ])
    rows = {r["cmd_id"]: r["state"] for r in gate.with_state(decided, gate.USER_GATE).collect()}
    assert rows[1] is None and rows[7] is None and "pass" not in rows[3]
    assert rows[3]["address"]["zip"] == "12345" and rows[5]["address"] is None and rows[5]["email"] == "x@y.com"
    assert all(rows[n]["email"] == "z@y.com" and rows[n]["address"] is None for n in range(9, 20))


def test_a_gate_of_ones_own(spark, cell_mode):
    """Rules and validators are declarations, too."""
    ticket = EntitySpec("ticket", "TicketEvent", (Field("owner", "string", ("opened", "assigned")),), created="opened", removed="closed")
    spec = GateSpec(
        ticket,
        absent=(Rule("open", "Opened", "opened", failure="Refused"),),
        present=(Rule("assign", "Assigned", "assigned", failure="Refused"), Rule("close", "Closed", "closed")),
        absent_reply="Unknown", present_reply="Open already",
    )
    owner = Validator(("open", "assign"), lambda: F.when(F.col("owner").isNull(), F.array(F.lit("no owner"))))
    steps = [("assign", "a"), ("open", None), ("open", "a"), ("open", "b"), ("assign", None), ("assign", "c"), ("close", None), ("close", None)]
    rows = [(n, at(n), "t1", kind, who) for n, (kind, who) in enumerate(steps)]
    commands = spark.createDataFrame(rows, "cmd_id bigint, cmd_ts timestamp_ntz, entity_id string, kind string, owner string")
    decided = gate.decide(gate.with_errors(commands, [owner]), spec)
    assert [r["reply_kind"] for r in decided.orderBy("cmd_id").collect()] == [
        "Unknown", "Refused", "Opened", "Open already", "Refused", "Assigned", "Closed", "Unknown"]
    events = gate.events(decided, spec).orderBy("seq_nr").collect()
    assert [(e["seq_nr"], e["kind"], e["owner"]) for e in events] == [(1, "opened", "a"), (2, "assigned", "c"), (3, "closed", None)]
