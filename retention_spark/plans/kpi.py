"""Figures taken from the feature table, and the indicators that would track a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.buckets import plan_type
from ..functions.exact import exact_mean, label_percent, percent
from ..operators.blocks import USER, segment_rate
from ..sources.tables import Tables
from .renewal import paying_cohort
from .scenario import SCENARIOS, scenario_by_plan, with_total

LABEL = "is_churn"


# Means by label over the feature table. They include users without usage where the feature is 0
# and skip them where it is NULL, unlike the queries of the same name in `usage`.

def mean_by_label(features: DataFrame, column: str) -> DataFrame:
    return features.groupBy(LABEL).agg(exact_mean(F.col(column)).alias(f"avg_{column}"))


def features_skip_rate(features: DataFrame) -> DataFrame:
    return mean_by_label(features, "skip_rate")


def features_intensity(features: DataFrame) -> DataFrame:
    return mean_by_label(features, "mins_per_active_day")


def features_listen_time(features: DataFrame) -> DataFrame:
    return mean_by_label(features, "total_listen_mins")


def features_active_rate(features: DataFrame) -> DataFrame:
    return mean_by_label(features, "active_day_rate")


# Renewal and plans over the feature table

def features_renewal_churn(features: DataFrame) -> DataFrame:
    return segment_rate(features, ["is_auto_renew"])


def features_active_renewal(features: DataFrame) -> DataFrame:
    """Churn by renewal among users with an active day."""
    return segment_rate(features.filter("active_days > 0"), ["is_auto_renew"])


def features_silent_renewal(features: DataFrame) -> DataFrame:
    """Churn by renewal among users who played no song past its half."""
    return segment_rate(features.filter("active_days = 0"), ["is_auto_renew"])


def features_plan_churn(features: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    typed = features.withColumn("plan_type", plan_type(F.col("payment_plan_days"), cfg))
    return segment_rate(typed, ["plan_type", "is_auto_renew"])


def features_revenue(features: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Annual revenue kept from longer plans today, and under each scenario."""
    results = with_total(scenario_by_plan(features, cfg))
    today = F.col("today_usd")
    columns = []
    for s in SCENARIOS:
        gain = F.col(f"annual_{s}_usd")
        columns += [
            F.round(f"retained_{s}").alias(f"users_retained_{s}"),
            F.round(gain).alias(f"revenue_gain_{s}_usd"),
            F.round(today + gain).alias(f"revenue_{s}_usd"),
        ]
    return results.select(
        "plan_type", "users", F.round(today).alias("revenue_today_usd"), *columns
    )


def monthly_conversion_gain(features: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Users kept if manual monthly subscribers churned like those on auto-renew."""
    monthly = features.filter(plan_type(F.col("payment_plan_days"), cfg) == "Monthly")
    auto = F.col("is_auto_renew") == 1

    def total(of: Column, who: Column) -> Column:
        return F.coalesce(F.sum(F.when(who, of)), F.lit(0))

    sums = monthly.agg(
        total(F.lit(1), ~auto).alias("manual_users"),
        total(F.col(LABEL), ~auto).alias("manual_churned"),
        total(F.lit(1), auto).alias("auto_users"),
        total(F.col(LABEL), auto).alias("auto_churned"),
    )
    wide = {c: F.col(c).cast("decimal(15,0)") for c in sums.columns}
    expected = F.when(
        wide["auto_users"] > 0,
        wide["manual_users"] * wide["auto_churned"] / wide["auto_users"],
    )
    return sums.select(
        "manual_users",
        percent(F.col("manual_churned"), F.col("manual_users")).alias("manual_churn_rate"),
        percent(F.col("auto_churned"), F.col("auto_users")).alias("auto_churn_rate"),
        F.round(wide["manual_churned"] - expected).alias("users_kept"),
    )


# Tracking indicators

def _longer_plans(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    return paying_cohort(t, cfg).filter(F.col("payment_plan_days") > cfg.monthly_days)


def kpi_adoption(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Share of longer latest plans that are on auto-renew."""
    return _longer_plans(t, cfg).agg(
        F.count(F.lit(1)).alias("users"),
        label_percent("is_auto_renew").alias("pct_auto_renew"),
    )


def kpi_long_plan_churn(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Churn of longer plans against the two target rates, in percent."""
    typed = _longer_plans(t, cfg).withColumn(
        "plan_type", plan_type(F.col("payment_plan_days"), cfg)
    )
    rate = F.col("churn_rate")
    best, cautious = (F.lit(r * 100) for r in (cfg.optimistic_rate, cfg.conservative_rate))
    return segment_rate(typed, ["plan_type"]).select(
        "plan_type", "users", "churn_rate",
        (rate - cautious).alias("above_conservative_target"),
        (rate - best).alias("above_best_case"),
    )


def kpi_manual_to_auto(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Share of manual monthly subscribers who later paid a monthly plan on auto-renew.

    A subscriber has converted when the last monthly auto-renew payment is of a later day than the
    first manual one. Two extremes per user decide this, so the payments of a user are never
    brought together and sorted.
    """
    day, auto = F.col("transaction_date"), F.col("is_auto_renew") == 1
    monthly = t.transactions.filter(
        (plan_type(F.col("payment_plan_days"), cfg) == "Monthly") & (day <= F.lit(cfg.cut))
    )
    users = monthly.groupBy(USER).agg(
        F.min(F.when(~auto, day)).alias("first_manual"),
        F.max(F.when(auto, day)).alias("last_auto"),
    ).filter("first_manual is not null")
    switched = F.col("last_auto") > F.col("first_manual")
    return users.agg(
        F.count(F.lit(1)).alias("manual_users"),
        F.count_if(switched).alias("converted"),
        percent(F.count_if(switched), F.count(F.lit(1))).alias("conversion_pct"),
    )


def longer_plan_arms(features: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Subscribers on longer plans with `arm`: a stable random split into test and control."""
    test = F.md5(F.col(USER).cast("binary")) < "8"
    return features.filter(F.col("payment_plan_days") > cfg.monthly_days).withColumn(
        "arm", F.when(test, "test").otherwise("control"))


def test_vs_control_rate(df: DataFrame, group: str, label: str = LABEL) -> DataFrame:
    """Churn of the 'test' and the 'control' group and the gap between them, in points."""
    def rate(name: str) -> Column:
        inside = F.when(F.col(group) == name, F.col(label))
        return percent(F.sum(inside), F.count(inside))

    return df.agg(
        F.count_if(F.col(group) == "test").alias("test_users"),
        rate("test").alias("test_rate"),
        F.count_if(F.col(group) == "control").alias("control_users"),
        rate("control").alias("control_rate"),
    ).withColumn("gap", F.col("control_rate") - F.col("test_rate"))


#: Standard normal quantile of a two-sided 95 % interval (a fixed value).
Z95 = 1.959963984540054


def test_vs_control_interval(df: DataFrame, group: str, label: str = LABEL, z: float = Z95) -> DataFrame:
    """The gap between control and test churn in points, with an interval that holds the true one
    with the confidence of `z`; NULL where a group has no user with a label.

    Each rate gets its score interval, and the gap's ends combine theirs: unlike the plain normal
    interval this works for rates near 0 or 1 and small groups. Two counts per group are all
    it needs, so it costs one aggregate.
    """
    def counts(name: str) -> list[Column]:
        inside = F.when(F.col(group) == name, F.col(label))
        return [F.count(inside).cast("double").alias(f"{name}_n"),
                F.coalesce(F.sum(inside), F.lit(0)).cast("double").alias(f"{name}_x")]

    def ends(name: str) -> list[Column]:
        n, x = F.col(f"{name}_n"), F.col(f"{name}_x")
        reach = z * F.sqrt(z * z + 4 * x * (1 - F.try_divide(x, n)))
        return [F.when(n > 0, (2 * x + z * z + sign * reach) / (2 * (n + z * z))).alias(f"{name}_{end}")
                for end, sign in (("low", -1), ("high", 1))]

    sums = df.agg(*counts("test"), *counts("control"))
    at = sums.select(
        "test_n", "control_n", *[F.when(F.col(f"{g}_n") > 0, F.col(f"{g}_x") / F.col(f"{g}_n")).alias(g)
                                 for g in ("test", "control")], *ends("test"), *ends("control"))
    gap = F.col("control") - F.col("test")
    below = F.sqrt(F.pow(F.col("control") - F.col("control_low"), 2) + F.pow(F.col("test_high") - F.col("test"), 2))
    above = F.sqrt(F.pow(F.col("control_high") - F.col("control"), 2) + F.pow(F.col("test") - F.col("test_low"), 2))
    return at.select(
        F.col("test_n").cast("bigint").alias("test_users"), F.col("control_n").cast("bigint").alias("control_users"),
        *[F.round(100 * value, 4).alias(name) for name, value in (
            ("gap", gap), ("gap_low", gap - below), ("gap_high", gap + above))])
