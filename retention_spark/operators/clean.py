"""Raw tables to cleaned tables, as pure transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..functions.listening import usable
from ..sources.schemas import CLEAN, DATE_COLUMNS, conform


def yyyymmdd_date(number: Column) -> Column:
    """Date of an integer such as 20170331; NULL when no such day exists.

    Arithmetic instead of `to_date(text, pattern)`: it stays inside generated code and measured
    five times faster. A day past the end of its month lands in the next month and is dropped.
    """
    year = F.call_function("div", number, F.lit(10_000)).cast("int")
    month = (F.call_function("div", number, F.lit(100)) % 100).cast("int")
    day = (number % 100).cast("int")
    plausible = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    moved = F.when(plausible, F.date_add(F.make_date(year, month, F.lit(1)), day - 1))
    return F.when(F.month(moved) == month, moved)


def int_to_date(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn yyyyMMdd integer columns into dates."""
    return df.withColumns({c: yyyymmdd_date(F.col(c)) for c in columns})


def rejected_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: per column, how many filled integers are not a calendar day."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col(c).isNotNull() & yyyymmdd_date(F.col(c)).isNull())
            .alias(f"{c}_rejected")
            for c in columns
        ],
    )


def reject_counts(logs: DataFrame) -> list[Column]:
    """Aggregates over raw usage: rows, days that don't exist, readings that are not numbers."""
    day = F.col("date")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(day.isNotNull() & yyyymmdd_date(day).isNull()).alias("date_rejected"),
        F.count_if(~usable(F.col("total_secs"))).alias("total_secs_rejected"),
    ]


#: Epoch milliseconds from the year 1 up to, and without, the year 9999, so that no zone leaves the calendar.
EPOCH_MS = (-62_135_510_400_000, 253_370_764_799_999)


def epoch_ms_to_date(df: DataFrame, column: str, tz: str) -> DataFrame:
    """Turn epoch milliseconds into the calendar date of zone `tz`; NULL outside the years 1 to 9998.

    Whole seconds are counted from a zone-less epoch and then moved to `tz`, so the session time
    zone has no say in the result.
    """
    within = F.when(F.col(column).between(*EPOCH_MS), F.col(column))
    seconds = F.call_function("div", within, F.lit(1000))
    utc = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))
    return df.withColumn(column, F.convert_timezone(F.lit("UTC"), F.lit(tz), utc).cast("date"))


def null_out_of_range(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """NULL every value outside the inclusive bounds; nothing is converted or guessed."""
    return df.withColumn(column, F.when(F.col(column).between(low, high), F.col(column)))


def blank_to_null(df: DataFrame, column: str) -> DataFrame:
    """NULL the empty text; a text of spaces is kept."""
    return df.withColumn(column, F.nullif(F.col(column), F.lit("")))


def null_unusable_seconds(df: DataFrame, column: str = "total_secs") -> DataFrame:
    """NULL readings that are not numbers (NaN, infinities, 2**63 seconds on); the row stays."""
    return df.withColumn(column, F.when(usable(F.col(column)), F.col(column)))


def rejected_seconds(df: DataFrame, column: str = "total_secs") -> DataFrame:
    """One row: rows, and how many of them hold a reading that `null_unusable_seconds` drops."""
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(~usable(F.col(column))).alias(f"{column}_rejected"))


def value_reasons(table: str) -> Column:
    """The columns of a raw row, comma-separated, that hold a value which cleaning can't keep: days that
    don't exist, moments outside the calendar, readings that are not numbers. Empty when none does."""
    bad = {
        c: ~F.col(c).between(*EPOCH_MS) if table == "members" else yyyymmdd_date(F.col(c)).isNull()
        for c in DATE_COLUMNS[table]
    }
    if table == "user_logs":
        bad["total_secs"] = ~usable(F.col("total_secs"))
    return F.concat_ws(",", *[F.when(F.col(c).isNotNull() & test, F.lit(c)) for c, test in bad.items()])


def split_by_values(df: DataFrame, table: str, cfg: AnalysisConfig) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows of a raw table, and beside them the raw rows with a value that cleaning can't
    keep, with `reasons`. Each row is in one of the two."""
    marked = df.withColumn("reasons", value_reasons(table))
    fine = marked.filter(F.col("reasons") == "").drop("reasons")
    return clean_table(fine, table, cfg), marked.filter(F.col("reasons") != "")


def clean_table(df: DataFrame, table: str, cfg: AnalysisConfig) -> DataFrame:
    """The cleaning of one raw table. No row is dropped, so plans of zero days stay."""
    if table == "members":
        df = epoch_ms_to_date(df, "registration_init_time", cfg.tz)
        df = null_out_of_range(df, "bd", cfg.age_min, cfg.age_max)
        df = blank_to_null(df, "gender")
    else:
        df = int_to_date(df, DATE_COLUMNS[table])
    if table == "user_logs":
        df = null_unusable_seconds(df)
    return conform(df, CLEAN[table])
