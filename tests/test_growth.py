"""What a task reads and holds doesn't grow with the tables."""

import datetime

from seqtrend.operators import series


def test_a_timeframe_sorts_no_rows(spark):
    """weeks and variants are counted before anything is ordered, and a row without a date hides no variant."""
    day = datetime.date
    rows = [("a", "x", "l", day(1995, 1, 2), "v"), ("b", "x", "l", day(1995, 1, 20), "v"), ("c", "x", "l", None, "v"), ("d", "x", "l", day(1995, 3, 1), "late")]
    out = series.sequences_in_timeframe(spark.createDataFrame(rows, "acc string, location string, lineage string, d date, m string"), "1995-01-01", "1995-02-15")
    assert [tuple(r) for r in out.collect()] == [("v", day(1995, 1, 2), [1, 0, 1])]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan


def test_xml_files_grow_in_number():
    """a file is read by one task, so its members are bounded."""
    from seqtrend.plans import files

    for members in (0, 600_000, 36_000_000, 216_000_000):
        assert files.xml_files(members) >= 16 and members / files.xml_files(members) <= files.XML_MEMBERS
