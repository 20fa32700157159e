"""What auto-renew on longer plans could retain, under two target churn rates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.buckets import plan_type
from ..functions.exact import round_ratio
from ..sources.tables import Tables
from .renewal import paying_cohort

TOTAL = "TOTAL"
SCENARIOS = ("optimistic", "conservative")
_COUNT = "decimal(15,0)"
_MONEY = "decimal(26,12)"


def _annual(amount: Column, days: Column, cfg: AnalysisConfig) -> Column:
    """Payments for plans of `days`, in dollars per year."""
    per_year = (amount * cfg.year_days).cast("decimal(24,6)")
    return per_year / (days * cfg.fx).cast("decimal(8,0)")


def scenario_by_plan(users: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Unrounded scenario results per plan type over plans longer than a month.

    `users` has one row per user: label, plan length, amount paid. Amounts are summed as integers
    per plan length first; the division by the length is done once per length.
    """
    length, churned = F.col("payment_plan_days"), F.col("is_churn")
    paid = F.col("actual_amount_paid")
    per_length = (
        users.filter(length > cfg.monthly_days)
        .groupBy(plan_type(length, cfg).alias("plan_type"), length)
        .agg(
            F.count(F.lit(1)).alias("users"),
            F.sum(churned).alias("churned"),
            F.count(paid).alias("payers"),
            F.sum(paid).alias("paid"),
            F.coalesce(F.sum(F.when(churned == 0, paid)), F.lit(0)).alias("paid_by_stayers"),
        )
    )
    per_type = per_length.groupBy("plan_type").agg(
        F.sum("users").alias("users"),
        F.sum("churned").cast(_COUNT).alias("churned"),
        F.sum("payers").cast(_COUNT).alias("payers"),
        F.sum(_annual(F.col("paid"), length, cfg)).alias("revenue"),
        F.sum(_annual(F.col("paid_by_stayers"), length, cfg)).cast(_MONEY).alias("today_usd"),
    ).withColumn(
        "annual_revenue_per_user_usd", (F.col("revenue") / F.col("payers")).cast(_MONEY)
    )
    rates = dict(zip(SCENARIOS, (cfg.optimistic_rate, cfg.conservative_rate)))
    for name, rate in rates.items():
        kept = F.col("churned") - F.col("users").cast(_COUNT) * F.lit(rate)
        per_type = per_type.withColumn(f"retained_{name}", kept.cast("decimal(20,5)")).withColumn(
            f"annual_{name}_usd",
            F.col(f"retained_{name}") * F.col("annual_revenue_per_user_usd"),
        )
    return per_type


def with_total(results: DataFrame) -> DataFrame:
    """The plan types and their total, from one pass; sums are taken before any rounding.

    The total has no revenue per user, and is there even when no plan type is. Only the
    few finished lines, one per plan type, are brought together.
    """
    def total(name: str) -> Column:
        if name == "plan_type":
            return F.lit(TOTAL)
        if name == "annual_revenue_per_user_usd":
            return F.lit(None)
        return F.sum(name)

    line = F.struct(*[
        total(f.name).cast(f.dataType).alias(f.name) for f in results.schema.fields
    ])
    return results.agg(
        F.collect_list(F.struct(*results.columns)).alias("lines"), line.alias("total")
    ).select(F.inline(F.concat("lines", F.array("total"))))


def observed_rates(t: Tables, cfg: AnalysisConfig) -> AnalysisConfig:
    """The configuration with both target rates measured instead of given.

    The best case is the churn of monthly plans on auto-renew, the cautious one that of monthly
    plans renewed by hand, both in hundredths of a percent. A rate without users stays as given.
    One row of two numbers is fetched.
    """
    auto = F.col("is_auto_renew") == 1
    monthly = paying_cohort(t, cfg).filter(
        plan_type(F.col("payment_plan_days"), cfg) == "Monthly"
    )

    def rate(who: Column) -> Column:
        label = F.when(who, F.col("is_churn"))
        return round_ratio(F.sum(label), F.count(label), 4)

    found = monthly.agg(rate(auto).alias("best"), rate(~auto).alias("cautious")).first()
    return replace(
        cfg,
        optimistic_rate=cfg.optimistic_rate if found.best is None else found.best,
        conservative_rate=cfg.conservative_rate if found.cautious is None else found.cautious,
    )


def retention_scenario(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Users retained and annual revenue per plan type and in total, rounded at the end."""
    results = with_total(scenario_by_plan(paying_cohort(t, cfg), cfg))
    return results.select(
        "plan_type", "users",
        F.round("annual_revenue_per_user_usd", 2).alias("annual_revenue_per_user_usd"),
        *[
            column
            for s in SCENARIOS for column in (
                F.round(f"retained_{s}").alias(f"users_retained_{s}"),
                F.round(f"annual_{s}_usd").alias(f"annual_revenue_{s}_usd"),
            )
        ],
    )
