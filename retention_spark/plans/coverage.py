"""Which cohort users can be analysed, and whether the others differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.buckets import bucket
from ..functions.exact import label_percent
from ..operators.blocks import (
    USER,
    cohort_usage,
    days_active_after,
    listened,
    segment_rate,
    silent,
    with_rate,
)
from ..sources.tables import Tables
from .prepare import exposed_cohort, paying_users, user_usage


def _flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.select(USER, F.lit(True).alias(flag))


def member_coverage(t: Tables) -> DataFrame:
    """Cohort size and how many have no member row."""
    return t.train.join(_flagged(t.members, "member"), USER, "left").agg(
        F.count(F.lit(1)).alias("in_train"),
        F.count_if(F.col("member").isNull()).alias("no_member_detail"),
    )


def coverage_status(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Why a user cannot be analysed: no payment, no member row, or both."""
    joined = (
        t.train.join(_flagged(paying_users(t, cfg), "paid"), USER, "left")
        .join(_flagged(t.members, "member"), USER, "left")
    )
    no_payment, no_member = F.col("paid").isNull(), F.col("member").isNull()
    status = bucket(
        [
            (no_payment & no_member, "missing both"),
            (no_payment, "missing transaction"),
            (no_member, "missing member row"),
        ],
        "has both",
    )
    rates = segment_rate(joined.withColumn("status", status), ["status"], rate="churn_rate_pct")
    return rates.orderBy(F.desc("users"), "status")


def analysable_status(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Users kept for the exposure analyses and users dropped from them."""
    days = exposed_cohort(t, cfg).select(
        USER, "possible_exposure_days", F.lit(True).alias("exposed")
    )
    opening = f"{cfg.win_start:%b} {cfg.win_start.day}"
    status = bucket(
        [
            (F.col("exposed").isNull(), "dropped: no txn or no member row"),
            (F.col("possible_exposure_days") <= 0, f"dropped: expired before {opening}"),
        ],
        "kept",
    )
    joined = t.train.join(days, USER, "left").withColumn("status", status)
    return segment_rate(joined, ["status"], rate="churn_rate_pct")


def usage_coverage(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Cohort users with and without usage in the window.

    Usage is cut to distinct users and the cohort to one counted row per user before they meet,
    so no distinct count runs over the joined rows.
    """
    cohort = t.train.groupBy(USER).agg(F.count(F.lit(1)).alias("copies"))
    heard = _flagged(listened(user_usage(t, cfg)), "heard")
    missing = F.col("heard").isNull()
    return cohort.join(heard, USER, "left").agg(
        F.count(USER).alias("in_train"),
        F.coalesce(F.sum(F.when(missing, F.col("copies"))), F.lit(0)).alias("no_user_log"),
        F.count_if(~missing).alias("have_user_log"),
    )


def silent_rate(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Users without usage in the window and their churn."""
    return silent(t.train, user_usage(t, cfg)).agg(
        F.count(F.lit(1)).alias("no_history"), label_percent("is_churn").alias("churn_rate_pct")
    )


def _rated(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    days = cohort_usage(t.train, user_usage(t, cfg))
    return with_rate(days.join(exposed_cohort(t, cfg), USER))


def rate_sanity(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """How many users are active on more days than they were exposed, and by how much."""
    rate = F.col("active_day_rate")
    return _rated(t, cfg).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(rate > 1).alias("impossible"),
        F.round(F.max(rate), 2).alias("worst"),
    )


def rate_sanity_diagnosis(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Why rates exceed 1: activity after the expiry date, and how often the latest payment is a
    cancellation, whose expiry date lies early."""
    after = days_active_after(F.col("membership_expire_date"), cfg)
    return _rated(t, cfg).filter("active_day_rate > 1").agg(
        F.count(F.lit(1)).alias("impossible"),
        F.count_if(after > 0).alias("active_after_expiry"),
        F.count_if(F.col("is_cancel") == 1).alias("latest_is_cancel"),
    )
