import functools
import random

import pytest

from ledgerfold.operators import search
from ledgerfold.session import work_path
from ledgerfold.sources.pages import SortedHits

SHAPE = "id string, a string, b string"


def rows_of(seed, n=200):
    draw = random.Random(seed)
    return [(f"{i:04}", draw.choice([None, "x", "X", "y", "Z", ""]), draw.choice([None, "p", "q"])) for i in range(n)]


def ordered(rows, sorts):
    """Plain comparison: whole values without case, nulls last either way, then the id."""
    def compare(left, right):
        for column, asc in sorts:
            one, two = ((None if r["ab".index(column) + 1] is None else r["ab".index(column) + 1].lower()) for r in (left, right))
            if one != two:
                if one is None or two is None:
                    return 1 if one is None else -1
                return (1 if one > two else -1) * (1 if asc else -1)
        return -1 if left[0] < right[0] else 1

    return sorted(rows, key=functools.cmp_to_key(compare))


@pytest.mark.parametrize("sorts", [[("a", True), ("b", False)], [("a", False), ("b", True)]])
def test_pages_by_continuation(spark, sorts):
    rows = rows_of(7)
    hits = spark.createDataFrame(rows, SHAPE).repartition(6)
    arranged = SortedHits(spark, work_path(spark, "hits"), sorts, block=16).write(hits)
    want = ordered(rows, sorts)
    pages = list(arranged.following(30))
    assert [r["id"] for page in pages for r in page] == [r[0] for r in want] and [len(p) for p in pages] == [30] * 6 + [20]
    numbered = {r["id"]: r["page"] for r in search.all_pages(hits, sorts, 30).collect()}
    assert {r["id"]: n for n, page in enumerate(pages) for r in page} == numbered
    # From every row, the ends of blocks included.
    for at in (0, 15, 16, 198, 199):
        key = [None if v is None else v.lower() for v in ({"a": want[at][1], "b": want[at][2]}[c] for c, _ in sorts)]
        assert [r["id"] for r in arranged.page([*key, want[at][0]], 20).collect()] == [r[0] for r in want[at + 1:at + 21]]


def test_continuation_of_no_row_and_empty_hits(spark):
    rows = rows_of(3, 60)
    arranged = SortedHits(spark, work_path(spark, "hits"), [("a", True)], block=8).write(spark.createDataFrame(rows, SHAPE))
    want = ordered(rows, [("a", True)])
    behind = [r[0] for r in want if r[1] is None or r[1].lower() > "xx"]
    assert [r["id"] for r in arranged.page(("xx", "none"), 100).collect()] == behind
    assert arranged.page((None, "9999"), 5).count() == 0 and arranged.page(None, 0).count() == 0
    with pytest.raises(ValueError):
        arranged.page(("x",), 5)
    none = SortedHits(spark, work_path(spark, "hits"), [("a", True)]).write(spark.createDataFrame([], SHAPE))
    assert list(none.following()) == []


def test_a_page_reads_its_blocks_only(spark):
    arranged = SortedHits(spark, work_path(spark, "hits"), [("a", True)], block=100).write(spark.range(20_000).selectExpr("lpad(id, 6, '0') AS id", "'v' || id % 7 AS a"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = arranged.page(("v3", "000500"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(_block," in plan and "LessThanOrEqual(_block," in plan and "Exchange" not in plan
