"""Every query with SQL agrees with DuckDB on the smallest tables; the others give rows."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from checks import fixtures
from checks.compare import connect, normal_rows

SF = "/root/testdata/sf0.001"
# A dozen model fits each, covered by unit tests on small tables.
SLOW = {"screen_all", "run_batch"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in fixtures.QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    pdf = pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(pdf) > 0
        return
    rel = duck.execute(sql)
    want = pd.DataFrame(rel.fetchall(), columns=[d[0] for d in rel.description])
    assert sorted(pdf.columns) == sorted(want.columns)
    assert normal_rows(pdf) == normal_rows(want)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["num_blank"] == 0 for r in rows)
