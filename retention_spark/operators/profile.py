"""Profiling and quality checks. Each check is one pass with map-side combining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import label_percent
from ..sources.schemas import CLEAN, conform


def schema_report(df: DataFrame, table: str) -> DataFrame:
    """Column names and types of a cleaned table, with its rows and filled values per column.

    Raises when the table is not of its declared schema.
    """
    df = conform(df, CLEAN[table])
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns]
    )
    lines = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.col("rows"),
            F.col(field.name).alias("filled"),
        )
        for field in df.schema.fields
    ]
    return counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*lines)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of NULLs of every column."""
    return df.agg(*[
        (F.count(F.lit(1)) - F.count(c)).alias(f"{c}_nulls") for c in columns
    ])


def range_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the smallest and largest value of every column, in one scan."""
    return df.agg(*[
        bound(c).alias(f"{name}_{c}")
        for c in columns for name, bound in (("min", F.min), ("max", F.max))
    ])


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.min(column).alias("smallest"), F.max(column).alias("largest"),
        F.avg(column).alias("average"),
    )


def band_profile(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Counts of plausible, zero, negative and too high values.

    The bands are disjoint but leave out NULL and the values between 0 and `low`.
    """
    value = F.col(column)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(value.between(low, high)).alias("plausible"),
        F.count_if(value == 0).alias("zeros"),
        F.count_if(value < 0).alias("negative"),
        F.count_if(value > high).alias("too_high"),
    )


def missing_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).alias("missing"))


def surviving_mean(df: DataFrame, column: str) -> DataFrame:
    """How many values are left and their mean."""
    return df.agg(F.count(column).alias("present"), F.avg(column).alias("average"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; NULL is a value of its own."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def null_vs_blank(df: DataFrame, column: str) -> DataFrame:
    """NULLs and empty texts apart; meaningful only before `blank_to_null`."""
    return df.agg(
        F.count_if(F.col(column).isNull()).alias("true_null"),
        F.count_if(F.col(column) == "").alias("empty_string"),
    )


def missingness_by(df: DataFrame, by: str, column: str) -> DataFrame:
    """Rows and missing values of `column` per value of `by`, largest group first."""
    return (
        df.groupBy(by)
        .agg(F.count(F.lit(1)).alias("total_users"),
             F.count_if(F.col(column).isNull()).alias(f"missing_{column}"))
        .orderBy(F.desc("total_users"), by)
    )


def base_rate(df: DataFrame, label: str) -> DataFrame:
    """Mean of a 0/1 label over all rows, in percent."""
    return df.agg(label_percent(label).alias("churn_rate_pct"))


# Zero-day plans

def anomaly_rows(transactions: DataFrame) -> DataFrame:
    """Payments for a plan of zero days. They are looked at, not removed."""
    return transactions.filter(F.col("payment_plan_days") == 0).select(
        "msno", "plan_list_price", "is_cancel", "actual_amount_paid", "payment_plan_days"
    )


def anomaly_split(transactions: DataFrame) -> DataFrame:
    return category_counts(transactions.filter(F.col("payment_plan_days") == 0), "is_cancel")


# Calendar coverage

def monthly_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per calendar month, in order."""
    return (
        df.groupBy(F.trunc(column, "MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy("month")
    )


def _months(df: DataFrame, column: str) -> DataFrame:
    """The calendar months of a column, and NULL if it has any. A filter on NULL here would be pushed to the
    scan, with whatever the column is computed from written out several times over; the callers do without."""
    return df.select(F.trunc(column, "MM").alias("month")).distinct()


def month_gaps(df: DataFrame, column: str) -> DataFrame:
    """Calendar months without any row between the first and the last month."""
    following = F.lead("month").over(Window.orderBy("month"))
    # Distinct months are as few as the calendar has, so one task may order them. A gap after NULL, the first, is NULL.
    return (
        _months(df, column).withColumn("next", following)
        .filter(F.months_between("next", "month") > 1)
        .select(F.explode(F.sequence(
            F.add_months("month", 1), F.add_months("next", -1), F.expr("interval 1 month")
        )).alias("month"))
    )


def month_coverage(df: DataFrame, column: str) -> DataFrame:
    """First and last month, months present and months missing between them."""
    span = F.months_between(F.max("month"), F.min("month")).cast("bigint") + 1
    return _months(df, column).agg(
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.count("month").alias("months_present"),
        (span - F.count("month")).alias("months_missing"),
    )


def reconcile_month(combined: DataFrame, increment: DataFrame, column: str) -> DataFrame:
    """Rows per month after and before the load of the increment; `extra_rows` is 0 where the
    combined table holds the increment and nothing else."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.trunc(column, "MM").alias("month")).agg(
            F.count(F.lit(1)).alias(name)
        )

    both = counts(combined, "combined_rows").join(
        counts(increment, "increment_rows"), "month", "full"
    ).fillna(0, subset=["combined_rows", "increment_rows"])
    return both.withColumn("extra_rows", F.col("combined_rows") - F.col("increment_rows"))


# Keys

def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values found on more than one row."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def key_check(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, repeated keys and NULL keys. The joins need `repeated_keys` = 0 in
    the cohort and the member table; nothing in the data enforces it."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(key).alias("distinct_keys"),
        F.count_if(known & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_keys"),
    )
