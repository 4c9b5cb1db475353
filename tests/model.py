"""Sequential models of the folds and gates, one row at a time."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

START = datetime(2024, 1, 1)
SETS = {
    "created": ("username", "email", "pass", "address", "department"), "emailUpdated": ("email",),
    "passwordUpdated": ("pass",), "addressUpdated": ("address",), "departmentUpdated": ("department",),
}
FIELDS = ("username", "email", "pass", "address", "department")
KINDS = ["created", "removed", "addressUpdated", "passwordUpdated", "emailUpdated", "departmentUpdated", "empty"]


def address(zip_code="12345", country="US"):
    return ("s", "1", zip_code, "c", "st", country)


def random_journal(seed: int, entities: int = 6, hot: int = 60, cold: int = 8):
    """Irregular events; entity ``e0`` has most of them."""
    draw = random.Random(seed)
    rows = []
    for e in range(entities):
        for seq in range(1, (hot if e == 0 else draw.randint(1, cold)) + 1):
            kind = draw.choice(KINDS)
            rows.append((
                f"e{e}", seq, START + timedelta(minutes=draw.randint(0, 5) + 10 * seq), kind, f"n{seq}", f"m{seq}", f"p{seq}",
                draw.choice([None, address(), address("9", "UK")]), draw.choice([None, ("d1",), ("d2",)]),
            ))
    draw.shuffle(rows)
    return rows


def _ordered(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(r[0], []).append(r)
    return by


def _values(row):
    return dict(zip(FIELDS, row[4:9]))


def view(rows):
    out = {}
    for entity, events in _ordered(rows).items():
        current = None
        for event in events:
            if event[3] == "removed":
                current = None
                continue
            current = current or dict(username="", email="", **{"pass": ""}, address=None, department=None)
            current.update({f: _values(event)[f] for f in SETS.get(event[3], ())})
        if current is not None:
            out[entity] = current
    return out


def history(rows):
    """(entity, seq) -> state or None after the event."""
    out = {}
    for entity, events in _ordered(rows).items():
        current = None
        for event in events:
            kind = event[3]
            if current is None:
                current = _values(event) if kind == "created" else None
            elif kind == "removed":
                current = None
            elif kind != "created":
                current = {**current, **{f: _values(event)[f] for f in SETS.get(kind, ())}}
            out[entity, event[1]] = dict(current) if current is not None else None
    return out


def state(rows):
    last = {}
    for (entity, seq), after in history(rows).items():
        last[entity] = max(last.get(entity, (0, None)), (seq, after), key=lambda x: x[0])
    return {e: after for e, (_, after) in last.items() if after is not None}
