"""The sorted tables beside a view against the scans of the view."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import search
from ledgerfold.schemas import USER_VIEW
from ledgerfold.sources.lookup import Completions, Postings, begins

FIELDS = ("username", "address.city")


def user(n, name, city="Basel"):
    return (str(n), name, f"{name}@t.com" if name else None, ("Main street", "7", "12345", city, "BS", "CH"), None)


def frame(spark, rows):
    return spark.createDataFrame(rows, USER_VIEW)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Three batches: rows, then changes and removals, then a removed row that comes back."""
    folder = str(tmp_path_factory.mktemp("lookup"))
    names = ["Ann", "anna", "Bo b", "bo B b", None, "", "É t", "\U0010FFFFx", "ann-bo b", "x y x y z"]
    first = [user(n, names[n % 10], ["New York", "york new", None, "new, new York"][n % 4]) for n in range(40)]
    changed, back = [user(n, f"annex {n}", "New new york") for n in range(0, 8)], [user(9, "Ann", "late")]
    now = {r[0]: r for r in first} | {r[0]: r for r in changed}
    for n in (8, 9, 10):
        del now[str(n)]
    now["9"] = back[0]
    found = []
    for made in (Completions(spark, f"{folder}/c"), Postings(spark, f"{folder}/p", FIELDS)):
        assert made.read().count() == 0
        made.apply(frame(spark, first), 0)
        made.apply(frame(spark, changed[:2]), 1)
        made.apply(frame(spark, changed), 1, removed=frame(spark, first[8:11]).select("id"))  # a rerun of batch 1
        made.compact()
        made.apply(frame(spark, back), 2)
        found.append(made)
    return frame(spark, list(now.values())).cache(), *found


@pytest.mark.parametrize("compacted", [False, True])
def test_same_rows_as_a_scan(tables, compacted):
    view, completions, postings = tables
    if compacted:
        completions.compact()
        postings.compact()
    ids = lambda df: sorted(r["id"] for r in df.collect())
    asked = ("york", "new york", "new new york", "x y x", "y x y", "b b", "bo", "ann bo", "É", "none", "", None, "-")
    for mode in ("any", "all", "phrase", "prefix"):
        for query in asked if mode in ("phrase", "prefix") else asked[1::3]:
            assert ids(postings.matching(view, query, mode)) == ids(search.matching(view, query, FIELDS, mode)), (mode, query)
    for prefix in ("a", "ANN", "é", "\U0010FFFF", "", "zz"):
        assert completions.suggest(prefix).collect() == search.suggest(view, prefix).collect(), prefix


def test_ranges_of_prefixes(spark):
    values = ["a", "ab", "b", "퟿", "퟿x", "", "\U0010FFFF", "\U0010FFFFz", "a\U0010FFFF", "a\U0010FFFFq", ""]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for prefix in ("a", "퟿", "\U0010FFFF", "a\U0010FFFF", "b"):
        assert sorted(r["v"] for r in rows.filter(begins("v", prefix)).collect()) == sorted(v for v in values if v.startswith(prefix))


def test_a_search_reads_few_files(spark, tmp_path):
    """Files hold ranges of terms that do not meet but at their ends, and the predicate on
    the term reaches the scan."""
    rows = [user(n, f"w{n:05}") for n in range(4000)]
    made = Postings(spark, str(tmp_path / "p"), ("username", "address.city"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made.apply(frame(spark, rows), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made.compact()
    files = made.read().groupBy(F.input_file_name()).agg(F.min("term"), F.max("term")).collect()
    ends = sorted((r[1], r[2]) for r in files)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    plan = made.ids(["w00042"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(term,w00042\)", plan)
    assert sum(r[1] <= "w00042" <= r[2] for r in files) <= 2
    plan = made.ids(["w0004"], "prefix")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"GreaterThanOrEqual\(term,w0004\), LessThan\(term,w0005\)", plan)
    assert made.ids(["w0004"], "prefix").count() == 10
