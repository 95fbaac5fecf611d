"""Every registered query against its SQL, over the whole smallest tables."""

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    out = check.compare(spark, duck, name, SF)
    assert out["ok"] is not False, out
    assert out["rows"] > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["run_no", "line_id"]
