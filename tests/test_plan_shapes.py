"""Plans that have to hold at scale: bounded ranks cut early, filters and columns at the scan."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["win_ranking", "dp_bound_rows", "dp_bound_entities", "vector_topk", "expire_versions", "sdc_dominance"])
def test_bounded_ranks_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_filters_and_columns_reach_the_scan(spark):
    assert "GreaterThanOrEqual(ts" in plan(spark, "retention_sweep")
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan(spark, "select_columns_read")


def test_noise_is_the_only_work_in_python(spark):
    assert plan(spark, "dp_noisy_counts").count("MapInPandas") == 1


@pytest.mark.parametrize("name", ["join_as_of_version", "as_of_governed"])
def test_as_of_joins_hash_and_move_no_whole_rows(spark, name):
    text = plan(spark, name)
    assert "SortAggregate" not in text and "_row" not in text


def test_a_bridge_moves_business_keys(spark):
    text = plan(spark, "dv_bridge")
    assert "sha2(" in text and "sha2(" not in text[text.index("Join") :]


def test_keys_that_come_once_are_counted_behind_the_shuffle(spark):
    lines = plan(spark, "dv_load").split("\n")
    moved = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(key" in line and "REPARTITION_BY_COL" in line]
    assert len(moved) == 3
    assert all("partial_count" in lines[k - 1] and "partial_count" not in lines[k + 1] for k in moved)
