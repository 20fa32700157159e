"""Physical plans: what keeps the queries fast on large tables."""

from __future__ import annotations

import re

import pytest

from retention_spark.catalog import QUERIES, TABLE_QUERIES
from retention_spark.plans.prepare import prepare
from retention_spark.sources.derived import CONFIG as CFG
from tests.rows import random_rows, stored_tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The four tables as cleaning writes them."""
    folder = tmp_path_factory.mktemp("clean")
    return stored_tables(spark, folder, **random_rows(seed=5, users=80))


@pytest.fixture
def large_tables(spark):
    """Plan as if no table were small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# The others write files when called; they are made of queries listed here.
WRITING = re.compile(r"prepared|_land_|_split_|by_months|^s4_write|^s5_load|^s6_reconcile_store|^s7|one_pass|"
                     r"population|repeated_plans")
LAZY = sorted(n for n in QUERIES if not WRITING.search(n))


@pytest.mark.parametrize("name", LAZY)
def test_no_python_in_tasks_and_no_forced_products(spark, small, large_tables, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert not re.search(r"Python|ArrowEval|MapInPandas", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    # Broadcasts come from measured sizes only, never from a hint.
    assert "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", sorted(n for n in TABLE_QUERIES if n[0] in "bqura"))
def test_usage_is_read_by_month_and_column(stored, name):
    plan = plan_of(TABLE_QUERIES[name](stored))
    scans = [s for s in plan.splitlines() if "FileScan" in s and "total_secs" in s or "num_" in s
             and "FileScan" in s]
    for scan in scans:
        assert re.search(r"PartitionFilters: \[[^\]]*month", scan)
        assert "GreaterThanOrEqual(date" in scan
        assert "num_unq" not in scan


def test_feature_table_shuffles_each_input_once(stored, large_tables):
    plan = plan_of(TABLE_QUERIES["u1_user_features"](stored))
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert exchanges == ["msno"] * 4
    # Both reductions to one row per user start before the shuffle.
    assert len(re.findall(r"WindowGroupLimit .*Partial", plan)) == 1
    assert "partial_bit_or" in plan


def test_joins_of_a_bucketed_report_shuffle_nothing(spark, stored, large_tables):
    bucketed = prepare(spark, stored, CFG, buckets=4)
    for name in ("u1_user_features", "b5_rate", "b6_silent", "b4_active_days_clipped"):
        plan = plan_of(TABLE_QUERIES[name](bucketed))
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    # What is left is the exchange of the few finished groups.
    plan = plan_of(TABLE_QUERIES["a23_listener_renewal_churn"](bucketed))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["is_auto_renew"]


def test_silent_users_are_found_by_an_anti_join(stored):
    assert "LeftAnti" in plan_of(TABLE_QUERIES["b6_silent"](stored))
    assert "LeftSemi" in plan_of(TABLE_QUERIES["a23_listener_renewal_churn"](stored))


def test_distinct_days_need_no_distinct_aggregate(stored, large_tables):
    for name in ("b3_active_days", "b4_active_days_clipped", "a14_listening_intensity_by_label"):
        plan = plan_of(TABLE_QUERIES[name](stored))
        assert "Expand" not in plan and "distinct" not in plan
        assert not re.search(r"hashpartitioning\([^)]*date", plan)


def test_no_task_ranks_a_whole_label(stored):
    plan = plan_of(TABLE_QUERIES["a14_listening_intensity_by_label"](stored))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)
    assert windows and all("cell" in w for w in windows)


def test_latest_payment_reads_only_up_to_the_cut(stored):
    plan = plan_of(TABLE_QUERIES["a21_renewal_churn"](stored))
    assert f"LessThanOrEqual(transaction_date,{CFG.cut})" in plan


@pytest.mark.parametrize("name", ["p8_month_gaps", "p8_month_coverage"])
def test_months_are_computed_once_a_row(spark, small, name):
    """No filter repeats what the day is computed from."""
    filters = [s for s in plan_of(QUERIES[name](spark, small)).splitlines() if re.search(r"\bFilter ", s)]
    assert not any("trunc" in s or "make_date" in s for s in filters)


def test_population_checks_read_stored_results(spark, small):
    """What the driver plans at once is sums of stored rows, with no join and so no broadcast of users."""
    assert "Join" not in plan_of(QUERIES["q_population_checks"](spark, small))
