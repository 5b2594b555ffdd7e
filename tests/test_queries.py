"""Every registered query of the reads against its SQL."""

import duckdb
import pytest

import __spark_entry__
from helixlens.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    assert len(got)
    sql = __spark_entry__.oracle_sql()[name]
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{sf}/orders.parquet'")
    want = con.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert tidy(got).equals(tidy(want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
