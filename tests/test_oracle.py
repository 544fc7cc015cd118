"""Every registered query against its DuckDB twin at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cloudinv.demo.queries import QUERIES
from check_oracle import rows_of, tables


@pytest.fixture(scope="module")
def duck(sf_dir):
    return tables(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(queries()) and set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 15


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    found = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())
