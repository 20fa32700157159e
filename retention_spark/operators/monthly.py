"""Usage per user and calendar month, from which the usage of any window is merged.

A row holds what `blocks.usage_by_user` sums, the active days of the month as bits, and `days`, the
same sums day by day. All sums are whole numbers, so months add up to what the rows would give,
exactly. A window takes the months inside it as they are; of the months at its edges, if it
doesn't cover them, it takes the days inside it. The day lists are read for those months only.
"""

from __future__ import annotations

import calendar
from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions import day_bits, listening
from ..sources.tables import MONTH
from .blocks import USER, past_half, row_sums

HELD = "held"
#: Usage rows that one task adds up; their days are what it holds in memory at once.
TASK_ROWS = 1 << 19
COUNTS = ("log_rows", "total_songs", "skipped_songs")
SECONDS = tuple(f"{name}_{part}" for name in ("total", "active") for part in ("high", "low", "nano"))
SUMS = (*COUNTS, *SECONDS)
BITS, DAYS = "active_bits", "days"
_DAY = f"struct<day:int,{','.join(f'{s}:bigint' for s in SUMS)},active:boolean>"
SCHEMA = f"{USER} string, {', '.join(f'{s} bigint' for s in SUMS)}, {BITS} bigint, {DAYS} array<{_DAY}>, " \
         f"{MONTH} date, {HELD} int"


def usage_by_month(logs: DataFrame, tasks: int = 1) -> DataFrame:
    """One row per user and month with usage; rows without a date are left out, as no window holds
    them.

    Rows are dealt to `tasks` tasks by ranges of month and user, the only shuffle: both sums, by day and
    by month, then find theirs in place, and a task holds the days of its own rows, however many rows
    there are in all. A user's month is added up by one task as its rows come, and has at most 31 days.
    """
    dealt = logs.filter("date is not null").withColumn(MONTH, F.trunc("date", "MM")).repartitionByRange(
        tasks, MONTH, USER)
    days = dealt.groupBy(MONTH, USER, "date").agg(
        *row_sums(), F.coalesce(F.max(past_half() > 0), F.lit(False)).alias("active"))
    number = F.day("date")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), number - 1)
    day = F.struct(number.alias("day"), *SUMS, "active")
    # A user's month has few days, so sorting them costs less than a hash table of lists.
    by_day = Window.partitionBy(MONTH, USER).orderBy("date")
    month = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = days.select(
        USER, MONTH, F.row_number().over(by_day).alias("nth"), *[F.sum(s).over(month).alias(s) for s in SUMS],
        F.coalesce(F.bit_or(F.when(F.col("active"), one)).over(month), F.lit(0).cast("bigint")).alias(BITS),
        F.collect_list(day).over(month).alias(DAYS))
    return summed.filter("nth = 1").drop("nth")


def write(logs: DataFrame, path: str, held: int, rows: int) -> None:
    """Write the rows of these usage rows, `rows` of them, a folder for each month and for this version; a
    version that was begun before is overwritten. A task has a range of months and users, so a
    month is in as many files as its rows need."""
    found = usage_by_month(logs, -(-rows // TASK_ROWS) or 1).withColumn(HELD, F.lit(held))
    (
        found.sortWithinPartitions(MONTH, HELD, USER)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH, HELD).parquet(path)
    )


def read(spark: SparkSession, path: str, versions: Mapping[date | None, int]) -> DataFrame:
    """The stored rows, of each month the given version."""
    by_version: dict[int, list[date]] = {}
    for month, held in versions.items():
        if month is not None:
            by_version.setdefault(held, []).append(month)
    if not by_version:
        return spark.createDataFrame([], SCHEMA).drop(HELD)
    counts = reduce(lambda a, b: a | b, [
        (F.col(HELD) == held) & F.col(MONTH).isin([F.lit(m) for m in sorted(months)])
        for held, months in sorted(by_version.items())])
    return spark.read.schema(SCHEMA).parquet(path).filter(counts).drop(HELD)


def usage_in_window(months: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """What `blocks.usage_by_user` gives for the usage rows of the window, from their months.

    Whole months are added up without their day lists; a month that the window cuts adds up the
    days inside. One shuffle, of at most a row per user, month and task.
    """
    first, last = cfg.win_start.replace(day=1), cfg.win_end.replace(day=1)
    edges = sorted({m for m, cut in ((first, cfg.win_start != first), (last, cfg.win_end != _end(last))) if cut})
    inside = F.col(MONTH).between(F.lit(first), F.lit(last))
    at_edge = F.col(MONTH).isin([F.lit(m) for m in edges])
    whole = months.filter(inside & ~at_edge if edges else inside).select(USER, MONTH, *SUMS, BITS)
    parts = whole.unionByName(_cut(months.filter(at_edge), cfg)) if edges else whole

    offset = F.datediff(F.col(MONTH), F.lit(cfg.win_start))
    names = [f"active_bits_{i}" for i in range(day_bits.word_count(cfg.win_days))]
    words = [F.bit_or(_word(F.col(BITS), offset - i * day_bits.WORD)).alias(name)
             for i, name in enumerate(names)]
    sums = parts.groupBy(USER).agg(*[F.sum(s).alias(s) for s in SUMS], *words)
    # A user without active days has no bits in the direct result either.
    shown = [F.when(F.col(name) != 0, F.col(name)).alias(name) for name in names]
    return sums.select(
        USER, *COUNTS, listening.as_ns("total").alias("total_ns"),
        F.coalesce(listening.as_ns("active"), F.lit(0).cast("decimal(38,0)")).alias("active_ns"),
        day_bits.count_days([F.col(name) for name in names]).alias("active_days"), *shown,
    )


def _end(month: date) -> date:
    return month.replace(day=calendar.monthrange(month.year, month.month)[1])


def _cut(months: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Months at the window's edges, of their days only those inside; users without any are left out."""
    def inside(day: Column) -> Column:
        return F.date_add(F.col(MONTH), day["day"] - 1).between(F.lit(cfg.win_start), F.lit(cfg.win_end))

    held = months.select(USER, MONTH, F.filter(DAYS, inside).alias(DAYS)).filter(F.size(DAYS) > 0)
    # At most 31 rows for each; they are added up again by the merge.
    days = held.select(USER, MONTH, F.explode(DAYS).alias("d"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("d.day") - 1)
    return days.select(USER, MONTH, *[F.col(f"d.{s}").alias(s) for s in SUMS],
                       F.when(F.col("d.active"), one).otherwise(F.lit(0).cast("bigint")).alias(BITS))


def _word(bits: Column, shift: Column) -> Column:
    """The month's bits moved to where the month lies in a word of the window; what falls outside
    the word belongs to its neighbours."""
    left = F.call_function("shiftleft", bits, shift)
    right = F.call_function("shiftrightunsigned", bits, -shift)
    return F.when(shift.between(0, day_bits.WORD - 1), left).when(
        shift.between(-(day_bits.WORD - 1), -1), right)
