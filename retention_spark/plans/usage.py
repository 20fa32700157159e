"""Does usage separate churners from stayers?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.buckets import engagement_tier
from ..functions.exact import decimal_ratio, exact_mean
from ..functions.listening import NS_PER_MINUTE, minutes
from ..operators.blocks import (
    USER,
    active_days,
    active_days_clipped,
    cohort_usage,
    segment_rate,
    with_rate,
)
from ..operators.median import grouped_mean_median
from ..sources.tables import Tables
from .prepare import exposed_cohort, user_usage

LABEL = "is_churn"


def listening_time_by_label(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Mean minutes per listener; every listener counts once."""
    users = cohort_usage(t.train, user_usage(t, cfg), listeners_only=True)
    return users.groupBy(LABEL).agg(
        exact_mean(F.col("total_ns"), NS_PER_MINUTE).alias("avg_listen_time_min")
    )


def skip_rate_by_label(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Mean share of skipped songs per listener, in percent."""
    users = cohort_usage(t.train, user_usage(t, cfg), listeners_only=True).filter("total_songs > 0")
    share = decimal_ratio(F.col("skipped_songs"), F.col("total_songs"))
    return users.groupBy(LABEL).agg(
        F.count(USER).alias("no_users"), F.round(F.avg(share) * 100, 2).alias("avg_skip_rate")
    )


def active_rate_by_label(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Mean active-day rate; active days of the whole window."""
    days = active_days(t.train, user_usage(t, cfg))
    return with_rate(days.join(exposed_cohort(t, cfg), USER)).groupBy(LABEL).agg(
        F.count(USER).alias("users"),
        exact_mean(F.col("active_day_rate")).alias("avg_active_day_rate"),
    )


def engagement_tiers(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Churn per engagement tier; active days inside each user's own exposure interval."""
    users = with_rate(
        active_days_clipped(t.train, exposed_cohort(t, cfg), user_usage(t, cfg), cfg)
    ).withColumn("bucket", engagement_tier(F.col("active_day_rate"), cfg))
    return segment_rate(users, ["bucket"]).orderBy("bucket")


def listening_intensity_by_label(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Mean and median minutes per active day, over minutes of active rows only."""
    per_day = minutes(F.col("active_ns"), F.col("active_days"))
    users = (
        cohort_usage(t.train, user_usage(t, cfg), listeners_only=True)
        .filter("active_days > 0")
        .select(LABEL, per_day.alias("per_day"))
    )
    return grouped_mean_median(users, [LABEL], "per_day").select(
        LABEL,
        F.col("count").alias("users"),
        F.round("mean", 2).alias("avg_mins_per_active_day"),
        F.round("median", 2).alias("median_mins_per_active_day"),
    )
