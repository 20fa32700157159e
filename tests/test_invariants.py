"""Totals that must agree between queries, and changes of the input that must not show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retention_spark.catalog import TABLE_QUERIES
from retention_spark.plans import coverage, features, kpi, renewal, usage
from retention_spark.sources.derived import CONFIG as CFG
from retention_spark.sources.derived import StarSchema
from retention_spark.sources.schemas import CLEAN
from retention_spark.sources.tables import Tables
from tests.conftest import DATA
from tests.rows import listen, random_rows, stored_tables, tables


def total(df, column="users"):
    return sum(r[column] for r in df.collect())


def per(df, key, column="users"):
    return {r[key]: r[column] for r in df.collect()}


@pytest.fixture(scope="module", params=["random", "sf0.01"])
def t(request, spark, tmp_path_factory):
    if request.param == "random":
        return stored_tables(spark, tmp_path_factory.mktemp("rows"), **random_rows(seed=7))
    folder = DATA / request.param
    if not folder.is_dir():
        pytest.skip("generated tables are not available")
    return Tables(StarSchema(spark, str(folder)).clean)


def test_populations_agree(t):
    cohort = t.train.count()
    status = per(coverage.coverage_status(t, CFG), "status")
    kept = per(coverage.analysable_status(t, CFG), "status")
    assert sum(status.values()) == cohort and sum(kept.values()) == cohort
    assert kept["kept"] + kept["dropped: expired before Oct 1"] == status["has both"]

    table = features.user_features(t, CFG)
    assert table.count() == kept["kept"]
    assert coverage.rate_sanity(t, CFG).first().total == kept["kept"]
    assert total(usage.active_rate_by_label(t, CFG)) == kept["kept"]
    tiers = per(usage.engagement_tiers(t, CFG), "bucket")
    assert sum(tiers.values()) == kept["kept"]

    renewals = per(renewal.renewal_churn(t, CFG), "is_auto_renew")
    assert sum(renewals.values()) == status["has both"] + status["missing member row"]
    assert total(renewal.plan_type_churn(t, CFG)) == sum(renewals.values())
    silent = per(renewal.silent_renewal_churn(t, CFG), "is_auto_renew")
    heard = per(renewal.listener_renewal_churn(t, CFG), "is_auto_renew")
    assert {k: silent.get(k, 0) + heard.get(k, 0) for k in renewals} == renewals

    inactive = total(kpi.features_silent_renewal(table))
    assert total(kpi.features_active_renewal(table)) + inactive == kept["kept"]
    assert tiers["Dormant"] >= inactive


def test_other_plans_add_up(t):
    lengths = renewal.plan_length_all_txn(t, CFG).filter(F.col("payment_plan_days") != 30)
    assert total(lengths, "txns") == renewal.non_monthly_auto_total(t, CFG).first().txns


ALL = ("u1_user_features", "a11_listening_time_by_label", "a12_skip_rate_by_label",
       "a13_active_rate_by_label", "a13b_engagement_tiers", "a14_listening_intensity_by_label",
       "a24_plan_type_churn", "a26_retention_scenario", "r9_features_revenue", "q6_rate_sanity")


def results(t, name):
    return sorted(map(str, TABLE_QUERIES[name](t).collect()))


@pytest.mark.parametrize("name", ALL)
def test_row_order_and_stray_usage_do_not_show(spark, name):
    rows = random_rows(seed=11, users=150)
    wanted = results(tables(spark, **rows), name)

    outside = [listen(f"user{i}", d, n100=5) for i in range(150)
               for d in (CFG.win_start.replace(month=9), CFG.win_end.replace(year=2001))]
    changed = {table: list(reversed(r)) for table, r in rows.items()}
    changed["user_logs"] = outside + changed["user_logs"]
    shuffled = tables(spark, **changed)
    moved = Tables(lambda table: getattr(shuffled, table).repartition(5))
    assert set(changed) == set(CLEAN)
    assert results(moved, name) == wanted
