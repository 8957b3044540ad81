"""Every registered query beside its SQL in DuckDB, whole results, value for value."""

import pytest
from conftest import SMALL
from oracle_check import compare, connect

import __spark_entry__ as entry
from deedwork import plans

QUERIES, ORACLES = plans.all_queries(), plans.all_oracles()
RANDOM = {"dp_noisy_counts", "dp_noisy_null_count", "dp_noisy_history", "dp_noisy_query_rate", "dp_noisy_rank", "dp_noisy_spearman"}
LATTICE = {"dp_exact_spearman"}  # one finished cell becomes a lattice point, in exact whole numbers


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql_without_python_or_products(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for shape in ("PythonUDF", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert shape not in plan or (shape == "InPandas" and name in LATTICE)
    ok, message = compare(df, duck, ORACLES[name])
    assert ok, message


def test_only_random_results_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == RANDOM


@pytest.mark.parametrize("name", sorted(RANDOM))
def test_noise_is_the_same_on_every_run(spark, name):
    first = sorted(map(tuple, QUERIES[name](spark, SMALL).collect()))
    again = sorted(map(tuple, QUERIES[name](spark, SMALL).collect()))
    assert first and first == again


def test_entry(spark):
    assert entry.entry(spark).count() > 0
