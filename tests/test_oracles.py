"""Every registered query with SQL gives the rows of that SQL."""

import __spark_entry__ as entry_point
import pytest

from corpusloom import catalog

from .compare import connect, rows


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, db, name):
    want = db.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    assert entry_point.entry(spark).count() == 4
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
