"""The building blocks shared by the audits, the feature table and the analyses.

Everything is keyed by user. Payments and usage are reduced to one row per user before any join,
and both reductions combine on the map side, so a single user holding a third of all rows reaches
the shuffle as one row per map task. What is joined afterwards is one row per user on each side.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions import day_bits, listening
from ..functions.exact import label_percent, round_ratio
from ..sources.tables import MONTH

USER = "msno"

# Order of payments made on the same day. It covers every column, so payments that still tie are
# identical and the choice between them cannot show.
TIE_BREAKERS: tuple[tuple[str, str], ...] = (
    ("membership_expire_date", "desc"),
    ("payment_plan_days", "desc"),
    ("plan_list_price", "desc"),
    ("actual_amount_paid", "desc"),
    ("is_auto_renew", "desc"),
    ("payment_method_id", "desc"),
    ("is_cancel", "asc"),
)


# Latest payment

def _direction(column: str, order: str) -> Column:
    return F.desc_nulls_last(column) if order == "desc" else F.asc_nulls_last(column)


def latest_as_of(transactions: DataFrame, cut: date,
                 tie_breakers: Sequence[tuple[str, str]] = TIE_BREAKERS) -> DataFrame:
    """Each user's most recent payment up to `cut`, however old it is.

    Spark turns the filter on the rank into a per-partition group limit ahead of the shuffle.
    """
    order = [F.desc("transaction_date"), *[_direction(c, o) for c, o in tie_breakers]]
    ranked = transactions.filter(F.col("transaction_date") <= F.lit(cut)).withColumn(
        "rn", F.row_number().over(Window.partitionBy(USER).orderBy(*order))
    )
    return ranked.filter("rn = 1").drop("rn")


def latest_at_each(transactions: DataFrame, cuts: Sequence[date],
                   tie_breakers: Sequence[tuple[str, str]] = TIE_BREAKERS) -> DataFrame:
    """`latest_as_of` at many cut dates at once, with the date in `cut`: an as-of join of users and
    cuts in one pass and one shuffle.

    A payment belongs to the first cut on or after it. Each user keeps the latest payment of
    every such span, which combines before the shuffle, and a cut without one takes that of the cut
    before. Payments after the last cut aren't read.
    """
    cuts = sorted(set(cuts))
    if not cuts:
        raise ValueError("no cut date")
    # The greatest struct is the first row of the order: NULL is the least value, so it comes last.
    keys = [F.col(c) if order == "desc" else -F.col(c) for c, order in tie_breakers]
    whole = F.struct(*[F.col(c) for c in transactions.columns if c != USER])
    ranked = F.struct("transaction_date", *[k.alias(f"k{i}") for i, k in enumerate(keys)], whole.alias("row"))
    bounds = [None, *cuts]
    spans = [
        F.max(F.when((F.col("transaction_date") <= F.lit(high)) &
                     (F.lit(True) if low is None else F.col("transaction_date") > F.lit(low)), ranked))
        .alias(f"span{i}") for i, (low, high) in enumerate(zip(bounds, cuts))
    ]
    best = transactions.filter(F.col("transaction_date") <= F.lit(cuts[-1])).groupBy(USER).agg(*spans)
    at = [F.struct(F.lit(cut).alias("cut"),
                   F.coalesce(*[F.col(f"span{j}.row") for j in range(i, -1, -1)]).alias("row"))
          for i, cut in enumerate(cuts)]
    held = best.select(USER, F.inline(F.array(*at))).filter("row is not null")
    columns = [F.col(USER) if c == USER else F.col(f"row.{c}") for c in transactions.columns]
    return held.select("cut", *columns)


def tie_report(transactions: DataFrame, cut: date,
               columns: Sequence[str] = tuple(c for c, _ in TIE_BREAKERS)) -> DataFrame:
    """Users whose payments on their latest day differ, with the number of such payments.

    For these the date alone does not define the latest payment. Days are summarised first, so
    the ranking sees at most one row per user and calendar day.
    """
    days = (
        transactions.filter(F.col("transaction_date") <= F.lit(cut))
        .groupBy(USER, "transaction_date")
        .agg(
            F.count(F.lit(1)).alias("payments"),
            *[F.min(c).alias(f"lo_{c}") for c in columns],
            *[F.max(c).alias(f"hi_{c}") for c in columns],
            *[F.count(c).alias(f"n_{c}") for c in columns],
        )
    )
    differ = F.lit(False)
    for c in columns:
        mixed = F.coalesce(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(False))
        part_null = F.col(f"n_{c}").between(1, F.col("payments") - 1)
        differ = differ | mixed | part_null
    newest = Window.partitionBy(USER).orderBy(F.desc("transaction_date"))
    return (
        days.select(USER, "transaction_date", "payments", differ.alias("differ"))
        .withColumn("rn", F.row_number().over(newest))
        .filter("rn = 1 and differ")
        .select(USER, "transaction_date", "payments")
    )


# Exposure

def exposure(snapshot: DataFrame, members: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """The part of the window in which each user could have been active.

    It runs from the later of window start and registration to the earlier of window end and
    expiry; an unknown date does not narrow it. `possible_exposure_days` may be 0 or negative.
    """
    registered = members.select(USER, "registration_init_time")
    return (
        snapshot.join(registered, USER)
        .withColumn("start_date", F.greatest(F.lit(cfg.win_start), "registration_init_time"))
        .withColumn("end_date", F.least(F.lit(cfg.win_end), "membership_expire_date"))
        .withColumn("possible_exposure_days", F.datediff("end_date", "start_date") + 1)
    )


# Usage

def in_window(logs: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Usage rows of the window; months outside it are not even listed when stored by month."""
    rows = logs.filter(F.col("date").between(F.lit(cfg.win_start), F.lit(cfg.win_end)))
    if MONTH not in logs.columns:
        return rows
    first, last = cfg.win_start.replace(day=1), cfg.win_end.replace(day=1)
    return rows.filter(F.col(MONTH).between(F.lit(first), F.lit(last)))


def _words(cfg: AnalysisConfig) -> list[str]:
    return [f"active_bits_{i}" for i in range(day_bits.word_count(cfg.win_days))]


def past_half() -> Column:
    """Songs of a usage row played past their half; a row with any is active."""
    return F.col("num_50") + F.col("num_75") + F.col("num_985") + F.col("num_100")


def row_sums() -> list[Column]:
    """Aggregates over usage rows, all of whole numbers: rows, songs, and parts of the seconds."""
    secs = F.col("total_secs")
    return [
        F.count(F.lit(1)).alias("log_rows"),
        F.sum(F.col("num_25") + past_half()).alias("total_songs"),
        F.sum("num_25").alias("skipped_songs"),
        *listening.part_sums(secs, "total"),
        *listening.part_sums(F.when(past_half() > 0, secs), "active"),
    ]


def usage_by_user(logs: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """One row per user with usage in the window: everything the analyses need of it.

    An active row has a song played past its half; a row with a NULL counter is not active and
    adds no songs. `active_ns` sums active rows, not active days. Unused columns are pruned.
    """
    words = day_bits.collect_days(F.col("date"), past_half() > 0, cfg.win_start, cfg.win_days)
    sums = in_window(logs, cfg).groupBy(USER).agg(
        *row_sums(), *[word.alias(name) for word, name in zip(words, _words(cfg))]
    )
    return sums.select(
        USER, "log_rows", "total_songs", "skipped_songs",
        listening.as_ns("total").alias("total_ns"),
        F.coalesce(listening.as_ns("active"), F.lit(0).cast("decimal(38,0)")).alias("active_ns"),
        day_bits.count_days([F.col(c) for c in _words(cfg)]).alias("active_days"),
        *_words(cfg),
    )


def cohort_usage(train: DataFrame, usage: DataFrame, listeners_only: bool = False) -> DataFrame:
    """The cohort with its usage sums; users without usage keep 0 active days unless dropped."""
    joined = train.join(usage, USER, "inner" if listeners_only else "left")
    return joined.withColumn("active_days", F.coalesce("active_days", F.lit(0).cast("bigint")))


def active_days(train: DataFrame, usage: DataFrame) -> DataFrame:
    """Active days of every cohort user inside the whole window."""
    return cohort_usage(train, usage).select(USER, "is_churn", "active_days")


def active_days_clipped(train: DataFrame, exposed: DataFrame, usage: DataFrame,
                        cfg: AnalysisConfig) -> DataFrame:
    """Active days of every exposed cohort user inside the user's own exposure interval.

    The interval lies in the window, so the day set of the window is cut; no range join is run.
    """
    words = [F.col(c) for c in _words(cfg)]
    days = day_bits.count_days_between(
        words, cfg.win_start, F.col("start_date"), F.col("end_date")
    )
    intervals = exposed.select(USER, "start_date", "end_date", "possible_exposure_days")
    return (
        train.join(intervals, USER)
        .join(usage.select(USER, *_words(cfg)), USER, "left")
        .select(USER, "is_churn", "possible_exposure_days", days.alias("active_days"))
    )


def days_active_after(day: Column, cfg: AnalysisConfig) -> Column:
    """Active days later than `day`, from the day set of `usage_by_user`."""
    words = [F.col(c) for c in _words(cfg)]
    return day_bits.count_days_between(
        words, cfg.win_start, F.date_add(day, 1), F.lit(cfg.win_end)
    )


def with_rate(df: DataFrame) -> DataFrame:
    """Users with at least one exposure day, and their active-day rate to four decimals.

    The rate is above 1 for users active after their membership ended; it is not capped.
    """
    return df.filter("possible_exposure_days > 0").withColumn(
        "active_day_rate",
        round_ratio(F.col("active_days"), F.col("possible_exposure_days"), 4),
    )


def listened(usage: DataFrame) -> DataFrame:
    """Users with at least one usage row in the window, active or not."""
    return usage.select(USER)


def silent(train: DataFrame, usage: DataFrame) -> DataFrame:
    """Cohort users without any usage row in the window."""
    return train.join(listened(usage), USER, "left_anti")


# Segments

def segment_rate(df: DataFrame, keys: Sequence[str], label: str = "is_churn",
                 rate: str = "churn_rate") -> DataFrame:
    """Users and label rate in percent per segment; no keys gives one row for all."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("users"), label_percent(label).alias(rate)
    )
