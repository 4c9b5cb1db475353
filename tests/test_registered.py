"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
import compare
from ledgerfold.plans.catalog import QUERIES
from ledgerfold.plans.oracle import statements

FOLDER = "/root/testdata/sf0.001"
SQL = statements()


@pytest.fixture(scope="module")
def db():
    return compare.database(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.items() <= entry.queries().items() and SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), db, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 10


CUT = ["journal_scan", "user_state", "user_history", "department_gate_events", "dept_exists_as_of", "user_gate_events", "recover_from_snapshot", "tag_view"]


@pytest.mark.parametrize("name", CUT)
def test_query_with_cut_keys(spark, db, name):
    """The same results when entities are cut into small cells."""
    spark.conf.set("ledgerfold.cell.rows", "20")
    try:
        assert compare.differences(QUERIES[name](spark, FOLDER), db, SQL[name]) is None
    finally:
        spark.conf.unset("ledgerfold.cell.rows")


def test_known_reply_counts(spark):
    """Reply counts at sf0.01 that two independent engines agreed on beforehand."""
    rows = QUERIES["user_gate_replies"](spark, "/root/testdata/sf0.01").groupBy("reply_kind").count().collect()
    assert {r[0]: r[1] for r in rows} == {
        "NotExists": 6138, "CreatedFailed": 1085, "Created": 480, "AlreadyExists": 452, "EmailChanged": 449, "Removed": 442,
        "AddressChanged": 326, "DepartmentChangedFailed": 282, "DepartmentChanged": 185, "AddressChangedFailed": 161,
    }
