"""Every registered query of the library against its SQL in DuckDB, and the entry points' contract."""

import os

import pytest

from tests.compare import connected, rows_of
from textquarry import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connected(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF_DIR)
    rows = df.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:  # their operators are tested by hand in test_operators
        assert rows
        return
    relation = duck.sql(sql)
    columns = relation.columns
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(columns, relation.fetchall())


@pytest.mark.parametrize("name", "act_names_short batch_lines civil_acts crosswalk_compare crosswalk_reverse devanagari file_names jobs_due plain_texts synonyms_extended".split())
def test_reads_a_given_table(spark, name):
    """Queries that once ran on rows of their own: their plan reads a given table, and their rows grow with it."""
    df = catalog.queries()[name](spark, SF_DIR)
    assert df.inputFiles() and df.count() >= 50


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
