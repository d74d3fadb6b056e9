"""Every operator is registered, and every registered query agrees with its SQL."""

import pytest

import __spark_entry__ as contract
from cartulary.plans import QUERIES
from tests.oracle import connect, problem

# rows that a tiny data set may legitimately leave empty
MAY_BE_EMPTY = {"table_by_params"}


def test_every_operator_is_covered():
    covered = {o for q in QUERIES.values() for o in q.operators}
    assert covered == {f"O-{i:02d}" for i in range(1, 114)}


def test_contract_lists_the_same_names():
    assert set(contract.oracle_sql()) <= set(contract.queries()) >= set(QUERIES)


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, small, name):
    said = problem(spark, con, small, name)
    if name in MAY_BE_EMPTY and said == "both sides are empty":
        return
    assert said is None
