"""The whole analysis by name: profiles, audits, usage, renewal, scenario, figures, indicators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..config import AnalysisConfig
from ..operators import blocks, clean, profile
from ..operators.single_pass import Profile, profiled
from ..sources.schemas import DATE_COLUMNS, RAW
from ..sources.tables import Tables
from . import coverage, kpi, renewal, scenario, usage

# What is looked at in each cleaned table.
CLEAN_PROFILES: dict[str, Profile] = {
    "train": Profile(categories=("is_churn",), label="is_churn"),
    "members": Profile(categories=("city", "registered_via"), averages=("bd",)),
    "transactions": Profile(
        categories=("is_cancel",),
        bounds=("plan_list_price", "actual_amount_paid", "payment_plan_days", "transaction_date",
                "membership_expire_date"),
        flags=(("zero_days", "payment_plan_days = 0"),)),
    "user_logs": Profile(bounds=("date",), month_of="date"),
}


def raw_profiles(raw: Mapping[str, DataFrame], cfg: AnalysisConfig) -> dict[str, DataFrame]:
    """What has to be looked at before cleaning changes it."""
    members = profiled(raw["members"], Profile(
        categories=("gender",), averages=("bd",), flags=(
            ("plausible", f"bd between {cfg.age_min} and {cfg.age_max}"), ("zeros", "bd = 0"),
            ("negative", "bd < 0"), ("too_high", f"bd > {cfg.age_max}"),
            ("true_null", "gender is null"), ("empty_string", "gender = ''"))))
    return {
        "transactions_rejected_dates": clean.rejected_dates(
            raw["transactions"], DATE_COLUMNS["transactions"]),
        "user_logs_rejects": raw["user_logs"].agg(*clean.reject_counts(raw["user_logs"])),
        "age_summary": members.numeric_summary("bd"),
        "age_bands": members.flag_counts(["total", "plausible", "zeros", "negative", "too_high"]),
        "gender_counts": members.category_counts("gender"),
        "gender_null_vs_blank": members.flag_counts(["true_null", "empty_string"]),
    }


def clean_profiles(t: Tables) -> dict[str, DataFrame]:
    """The profiles of the cleaned tables: each table is read once for all of its figures, and once
    more for what isn't a figure (its keys, and single rows)."""
    keys = {f"{name}_keys": profile.key_check(df, blocks.USER)
            for name, df in (("train", t.train), ("members", t.members))}
    seen = {name: profiled(getattr(t, name), spec) for name, spec in CLEAN_PROFILES.items()}
    payments, members, logs = seen["transactions"], seen["members"], seen["user_logs"]
    return keys | {
        "payment_nulls": payments.null_audit(RAW["transactions"].fieldNames()),
        "payment_ranges": payments.range_profile(),
        "zero_day_plans": profile.anomaly_rows(t.transactions),
        "zero_day_plans_by_cancel": payments.flag_by("is_cancel", "zero_days"),
        "usage_rows": logs.row_count(),
        "usage_months": logs.monthly_counts(),
        "usage_month_gaps": profile.month_gaps(logs.monthly_counts(), "month"),
        "usage_date_range": logs.range_profile(),
        **{f"{name}_schema": seen[name].schema_report(name) for name in RAW},
        "ages_missing": members.missing_count("bd"),
        "ages_left": members.surviving_mean("bd"),
        "city_counts": members.category_counts("city"),
        "gender_missing_by_method": members.missingness_by("registered_via", "gender"),
        "label_counts": seen["train"].category_counts("is_churn"),
        "base_rate": seen["train"].base_rate(),
    }


def audits(t: Tables, cfg: AnalysisConfig) -> dict[str, DataFrame]:
    return {
        "member_coverage": coverage.member_coverage(t),
        "tied_payments": blocks.tie_report(t.transactions, cfg.cut),
    } | {
        query.__name__: query(t, cfg) for query in (
            coverage.coverage_status, coverage.analysable_status, coverage.usage_coverage,
            coverage.silent_rate, coverage.rate_sanity, coverage.rate_sanity_diagnosis,
        )
    }


def analyses(t: Tables, cfg: AnalysisConfig) -> dict[str, DataFrame]:
    return {
        query.__name__: query(t, cfg) for query in (
            usage.listening_time_by_label, usage.skip_rate_by_label, usage.active_rate_by_label,
            usage.engagement_tiers, usage.listening_intensity_by_label, renewal.renewal_churn,
            renewal.silent_renewal_churn, renewal.listener_renewal_churn, renewal.plan_type_churn,
            renewal.plan_length_adoption, renewal.plan_length_all_txn,
            renewal.non_monthly_auto_total, scenario.retention_scenario, kpi.kpi_adoption,
            kpi.kpi_long_plan_churn, kpi.kpi_manual_to_auto,
        )
    }


def increments(combined: DataFrame, parts: list[DataFrame]) -> dict[str, DataFrame]:
    """Rows per month of all usage against those of each later file."""
    return {f"usage_increment_{i}": profile.reconcile_month(combined, part, "date")
            for i, part in enumerate(parts, 1)}


def figures(features: DataFrame, cfg: AnalysisConfig) -> dict[str, DataFrame]:
    """Results taken from the feature table."""
    return {
        query.__name__: query(features) for query in (
            kpi.features_skip_rate, kpi.features_intensity, kpi.features_listen_time,
            kpi.features_active_rate, kpi.features_renewal_churn, kpi.features_active_renewal,
            kpi.features_silent_renewal,
        )
    } | {
        query.__name__: query(features, cfg) for query in (
            kpi.features_plan_churn, kpi.features_revenue, kpi.monthly_conversion_gain,
        )
    } | {"test_vs_control_rate": kpi.test_vs_control_rate(kpi.longer_plan_arms(features, cfg), "arm")}
