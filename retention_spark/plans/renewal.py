"""Do payment and renewal separate churners from stayers?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.buckets import plan_type
from ..functions.exact import label_percent
from ..operators.blocks import USER, listened, segment_rate, silent
from ..sources.tables import Tables
from .prepare import latest_payments, user_usage


def paying_cohort(t: Tables, cfg: AnalysisConfig, cohort: DataFrame | None = None) -> DataFrame:
    """Latest payment of every cohort user who has one, with the label."""
    cohort = t.train if cohort is None else cohort
    return latest_payments(t, cfg).join(cohort, USER)


def renewal_churn(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Churn by automatic or manual renewal."""
    return segment_rate(paying_cohort(t, cfg), ["is_auto_renew"])


def silent_renewal_churn(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """The same for users without any usage row."""
    cohort = silent(t.train, user_usage(t, cfg))
    return segment_rate(paying_cohort(t, cfg, cohort), ["is_auto_renew"])


def listener_renewal_churn(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """The same for users with at least one usage row."""
    cohort = t.train.join(listened(user_usage(t, cfg)), USER, "left_semi")
    return segment_rate(paying_cohort(t, cfg, cohort), ["is_auto_renew"])


def plan_type_churn(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Churn by plan type and renewal."""
    users = paying_cohort(t, cfg).withColumn(
        "plan_type", plan_type(F.col("payment_plan_days"), cfg)
    )
    return segment_rate(users, ["plan_type", "is_auto_renew"], rate="churn_rate_pct")


def plan_length_adoption(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Share on auto-renew and churn per plan length, for lengths with enough users."""
    return (
        paying_cohort(t, cfg).groupBy("payment_plan_days")
        .agg(
            F.count(F.lit(1)).alias("users"),
            label_percent("is_auto_renew").alias("pct_auto_renew"),
            label_percent("is_churn").alias("churn_rate_pct"),
        )
        .filter(F.col("users") > cfg.adoption_min_users)
        .orderBy(F.desc("users"), "payment_plan_days")
    )


def plan_length_all_txn(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Auto-renew payments per plan length over every payment on record."""
    return (
        t.transactions.filter(F.col("payment_plan_days").isin(*cfg.adoption_plans))
        .groupBy("payment_plan_days")
        .agg(
            F.count(F.lit(1)).alias("txns"),
            F.sum("is_auto_renew").alias("auto_renew_txns"),
            F.countDistinct(USER).alias("users"),
        )
        .orderBy("payment_plan_days")
    )


def non_monthly_auto_total(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Payments and auto-renew payments over the listed plans other than the monthly one."""
    others = [days for days in cfg.adoption_plans if days != cfg.monthly_days]
    return t.transactions.filter(F.col("payment_plan_days").isin(*others)).agg(
        F.count(F.lit(1)).alias("txns"),
        F.coalesce(F.sum("is_auto_renew"), F.lit(0)).alias("auto_renew_txns"),
    )
