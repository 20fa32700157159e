"""All profiles of a table from one scan, and the totals that gate a run."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from retention_spark.operators import profile
from retention_spark.operators.single_pass import Profile, figures, profiled
from retention_spark.plans import report
from retention_spark.plans.population import population_checks, require_populations
from retention_spark.sources.derived import CONFIG as CFG
from retention_spark.sources.schemas import CLEAN
from tests.rows import random_rows, stored_tables, tables
from tests.test_plans import plan_of


def same(a, b):
    assert a.dtypes == b.dtypes
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    return stored_tables(spark, tmp_path_factory.mktemp("rows"), **random_rows(seed=13, users=120))


def check_members(df):
    seen = profiled(df, Profile(
        categories=("gender", "registered_via"), bounds=("city",), averages=("bd",),
        flags=(("true_null", "gender is null"), ("empty_string", "gender = ''")),
        month_of="registration_init_time"))
    same(seen.row_count(), profile.row_count(df))
    same(seen.null_audit(), profile.null_audit(df, df.columns))
    same(seen.range_profile(["city"]), profile.range_profile(df, ["city"]))
    same(seen.numeric_summary("bd"), profile.numeric_summary(df, "bd"))
    same(seen.surviving_mean("bd"), profile.surviving_mean(df, "bd"))
    same(seen.missing_count("bd"), profile.missing_count(df, "bd"))
    same(seen.flag_counts(["true_null", "empty_string"]), profile.null_vs_blank(df, "gender"))
    same(seen.category_counts("gender"), profile.category_counts(df, "gender"))
    same(seen.missingness_by("registered_via", "gender"), profile.missingness_by(df, "registered_via", "gender"))
    same(seen.flag_by("registered_via", "true_null"),
         profile.category_counts(df.filter("gender is null"), "registered_via"))
    same(seen.monthly_counts(), profile.monthly_counts(df, "registration_init_time"))
    same(seen.schema_report("members"), profile.schema_report(df, "members"))


def test_members(t):
    check_members(t.members)


def test_empty_table(spark):
    check_members(tables(spark).members)


def test_the_report_equals_the_single_checks(t):
    got = report.clean_profiles(t)
    payments, members, logs = t.transactions, t.members, t.user_logs
    wanted = {
        "payment_nulls": profile.null_audit(payments, payments.columns),
        "payment_ranges": profile.range_profile(payments, report.CLEAN_PROFILES["transactions"].bounds),
        "zero_day_plans_by_cancel": profile.anomaly_split(payments),
        "usage_rows": profile.row_count(logs),
        "usage_months": profile.monthly_counts(logs, "date"),
        "usage_month_gaps": profile.month_gaps(logs, "date"),
        "usage_date_range": profile.range_profile(logs, ["date"]),
        "ages_missing": profile.missing_count(members, "bd"),
        "ages_left": profile.surviving_mean(members, "bd"),
        "city_counts": profile.category_counts(members, "city"),
        "gender_missing_by_method": profile.missingness_by(members, "registered_via", "gender"),
        "label_counts": profile.category_counts(t.train, "is_churn"),
        "base_rate": profile.base_rate(t.train, "is_churn"),
        **{f"{name}_schema": profile.schema_report(getattr(t, name), name) for name in CLEAN},
    }
    for name, df in wanted.items():
        same(got[name], df)


@pytest.mark.parametrize("name", list(report.CLEAN_PROFILES))
def test_one_scan_for_all_figures(t, name):
    plan = plan_of(figures(getattr(t, name), report.CLEAN_PROFILES[name]))
    assert plan.count("FileScan") == 1 and "partial_count" in plan


def test_populations(spark, t):
    from retention_spark.plans.features import user_features
    results = report.audits(t, CFG) | report.analyses(t, CFG)
    table = user_features(t, CFG)
    checks = population_checks(results, table)
    assert checks.count() == 12 and checks.filter("not holds").count() == 0
    require_populations(checks)
    # A user too many is seen by every total that the feature table is compared with.
    wrong = population_checks(results, table.unionByName(table.limit(1)))
    assert wrong.filter(~F.col("holds")).count() >= 1
    with pytest.raises(ValueError, match="kept users are in the feature table"):
        require_populations(wrong)
