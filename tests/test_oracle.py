"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__  # noqa: F401
from conftest import DATA, rows_of, rows_of_sql
from tabdrift.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    names, rows = rows_of_sql(duck, ORACLE_SQL[name])
    assert sorted(df.columns) == names
    assert list(map(repr, rows_of(df))) == list(map(repr, rows))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    got = {r["variant"]: r for r in __spark_entry__.entry(spark).collect()}
    assert got["baseline"]["rmse"] == 0 and got["baseline"]["ks"] == 0 and not got["baseline"]["silent_failure_candidate"]
    assert got["meaning"]["silent_failure_candidate"]
