"""Every registered query against its cross-check SQL, on the smallest data."""

from __future__ import annotations

import pytest

from tests.compare import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    sql = entry.oracle_sql().get(name)
    status, rows, _ = compare(spark, duck, FOLDER, name, entry.queries()[name], sql)
    # A few reports have no rows on so little data; agreement is what counts.
    assert status in ("ok", "rows-only") or (status == "EMPTY" and rows == 0), status


def test_entry(spark):
    report = entry.entry(spark)
    assert report.count() == 10
    assert "motion_p95" in report.columns
