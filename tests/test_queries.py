"""Every registered query against its SQL; the ones without SQL for shape and properties."""

import pytest

from prospecta.schemas import FEATURES
from prospecta.workload import all_queries, all_sql
from tests.oracle import connect, differences

SQL = all_sql()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, folder, connection, name):
    assert differences(QUERIES[name](spark, folder), connection, SQL[name]) is None


def test_registered_files(spark, folder):
    rows = QUERIES["registered_files"](spark, folder).collect()
    assert sorted(row["batch_id"] for row in rows) == list(range(1, len(rows) + 1))
    assert sum(row["total_records"] for row in rows if row["batch_id"] > 25) == 1500


def test_scored_test_rows(spark, folder):
    rows = QUERIES["scored_test_rows"](spark, folder).collect()
    assert len({row["row_key"] for row in rows}) == len(rows)
    assert all((row["subscription"] == "Yes") == (row["prediction"] == 1) for row in rows)


def test_permutation_importance(spark, folder):
    rows = QUERIES["permutation_importance"](spark, folder).collect()
    assert {row["feature"] for row in rows} == set(FEATURES)
    # The label of the fixture depends on the return flag (poutcome) and the quantity (age).
    assert {rows[0]["feature"], rows[1]["feature"]} == {"poutcome", "age"}
    assert rows[0]["importance"] > 0.1
