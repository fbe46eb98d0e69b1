"""Every query with SQL gives the SQL's rows; every other one gives rows of a stable schema."""

import pytest
from oracle import rows_of, sql_frame

from quillmark.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), sql_frame(data, ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
