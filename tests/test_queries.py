"""Each query with SQL against DuckDB; the others for rows and a stable schema."""

import pytest
from oracle import SF, connect, rows

from ultraframe.plans import fitted, longer, model, oracles, queries, streams, trained

SQL, QUERIES = {**oracles.SQL, **model.SQL, **fitted.SQL, **longer.SQL, **trained.SQL, **streams.SQL}, {**queries.QUERIES, **model.QUERIES, **fitted.QUERIES, **longer.QUERIES, **trained.QUERIES, **streams.QUERIES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connect().execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert "pua_frame" in found.columns and found.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
