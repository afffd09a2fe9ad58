"""Every query with an SQL counterpart gives the same values as that SQL."""

import pytest

import __spark_entry__ as entry_points
import oracle_queries
from tools.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_queries.statements()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    assert difference(entry_points.queries()[name](spark, FOLDER), duck, SQL[name]) == ""


def test_registry_and_sql_agree():
    assert set(SQL) <= set(entry_points.REGISTRY)
    assert set(entry_points.REGISTRY) - set(SQL) == {"rf_train_score", "gbt_train_score", "feature_importances"}


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "congestion_predicted_15min" in df.columns
