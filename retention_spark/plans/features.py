"""The feature table: one row per analysable user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.exact import round_ratio
from ..functions.listening import rounded_minutes
from ..operators.blocks import USER, cohort_usage, with_rate
from ..sources.tables import Tables
from .prepare import exposed_cohort, user_usage


def user_features(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Payment, exposure and listening features of every cohort user with a payment, a member row
    and at least one exposure day.

    Users without usage have NULL totals but 0 for the per-day and per-song ratios. Rates are
    decimals; buckets are left to the consumer.
    """
    usage = cohort_usage(t.train, user_usage(t, cfg))
    users = with_rate(usage.join(exposed_cohort(t, cfg), USER))
    active, songs = F.col("active_days"), F.col("total_songs")
    total_ns = F.col("total_ns")
    per_day = F.when(active > 0, rounded_minutes(total_ns, active)).otherwise(0)
    skips = F.when(
        songs > 0, round_ratio(F.col("skipped_songs") * 100, songs, 2)
    ).otherwise(0)
    return users.select(
        USER, "is_churn", "is_auto_renew", "transaction_date", "payment_plan_days",
        "actual_amount_paid", "possible_exposure_days", "active_days", "active_day_rate",
        rounded_minutes(total_ns).alias("total_listen_mins"),
        per_day.cast("decimal(30,2)").alias("mins_per_active_day"),
        "total_songs", "skipped_songs",
        skips.cast("decimal(20,2)").alias("skip_rate"),
    )
