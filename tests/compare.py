"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(row[i] for i in order) for row in rows), key=repr)


TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(frame, db, sql: str) -> str | None:
    """None if columns, types and all rows agree."""
    types = sorted((n, TYPES.get(t, t)) for n, t in frame.dtypes)
    found = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    answer = db.execute(sql)
    expected = sorted((d[0], str(d[1])) for d in answer.description)
    if types != expected:
        return f"types {set(types) ^ set(expected)}"
    wanted = _rows([d[0] for d in answer.description], answer.fetchall())
    if found[0] != wanted[0]:
        return f"columns {found[0]} / {wanted[0]}"
    if len(found[1]) != len(wanted[1]):
        return f"rows {len(found[1])} / {len(wanted[1])}"
    for ours, theirs in zip(found[1], wanted[1]):
        if repr(ours) != repr(theirs):
            return f"{ours} / {theirs}"
    return None
