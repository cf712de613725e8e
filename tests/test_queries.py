"""Every registered query against its SQL, and the others for a sound result."""

import pytest

import __spark_entry__ as entry
import compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(compare.FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, oracle, name):
    frame = QUERIES[name](spark, compare.FOLDER)
    assert compare.type_differences(frame, oracle, ORACLES[name]) == {}
    assert compare.spark_rows(frame) == compare.oracle_rows(oracle, ORACLES[name])


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_answers(spark):
    assert entry.entry(spark).count() == 1
