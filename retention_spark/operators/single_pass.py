"""All profiles of a table from one scan of it.

The checks of `operators.profile` are a job each, and each reads its table. Here every count, bound, mean
and category count of a table is computed together: one aggregate over grouping sets, the empty set for
figures of the whole table and one set for each categorical column. Its result has a row for each
category, is stored, and the single reports are cut out of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import percent
from ..session import scratch_path
from ..sources.schemas import CLEAN

_SET = "profile_set"


@dataclass(frozen=True)
class Profile:
    """What to look at in one table: columns whose values are counted, columns bounded, columns
    averaged, flags counted (SQL conditions by name), a label, and a date whose months are counted."""

    categories: tuple[str, ...] = ()
    bounds: tuple[str, ...] = ()
    averages: tuple[str, ...] = ()
    flags: tuple[tuple[str, str], ...] = ()
    label: str | None = None
    month_of: str | None = None


class ProfiledTable:
    """The stored figures of one table and the reports cut out of them; each has the columns and rows
    of its namesake in `operators.profile`."""

    def __init__(self, figures: DataFrame, profile: Profile, columns: Sequence[str]):
        self.figures, self.profile, self.columns = figures, profile, list(columns)

    def _of(self, number: int) -> DataFrame:
        return self.figures.filter(F.col(_SET) == number)

    def row_count(self) -> DataFrame:
        return self._of(0).select("rows")

    def null_audit(self, columns: Sequence[str] | None = None) -> DataFrame:
        return self._of(0).select(*[(F.col("rows") - F.col(f"filled_{c}")).alias(f"{c}_nulls")
                                    for c in columns or self.columns])

    def range_profile(self, columns: Sequence[str] | None = None) -> DataFrame:
        return self._of(0).select(*[F.col(f"{end}_{c}") for c in columns or self.profile.bounds
                                    for end in ("min", "max")])

    def numeric_summary(self, column: str) -> DataFrame:
        return self._of(0).select(F.col(f"min_{column}").alias("smallest"),
                                  F.col(f"max_{column}").alias("largest"), self._average(column))

    def surviving_mean(self, column: str) -> DataFrame:
        return self._of(0).select(F.col(f"filled_{column}").alias("present"), self._average(column))

    def missing_count(self, column: str) -> DataFrame:
        return self._of(0).select((F.col("rows") - F.col(f"filled_{column}")).alias("missing"))

    def schema_report(self, table: str) -> DataFrame:
        lines = [F.struct(F.lit(f.name).alias("column_name"),
                          F.lit(f.dataType.simpleString()).alias("data_type"),
                          F.col("rows"), F.col(f"filled_{f.name}").alias("filled"))
                 for f in CLEAN[table].fields]
        return self._of(0).select(F.lit(table).alias("table_name"), F.inline(F.array(*lines)))

    def flag_counts(self, names: Sequence[str]) -> DataFrame:
        return self._of(0).select(*[F.col("rows" if n == "total" else f"flag_{n}").alias(n) for n in names])

    def base_rate(self) -> DataFrame:
        rate = percent(F.col(f"sum_{self.profile.label}"), F.col(f"filled_{self.profile.label}"))
        return self._of(0).select(rate.alias("churn_rate_pct"))

    def category_counts(self, column: str) -> DataFrame:
        return self._category(column).select(F.col(f"by_{column}").alias(column), "rows")

    def flag_by(self, column: str, flag: str) -> DataFrame:
        """Rows per category that have the flag; categories without any are left out."""
        return self._category(column).filter(F.col(f"flag_{flag}") > 0).select(
            F.col(f"by_{column}").alias(column), F.col(f"flag_{flag}").alias("rows"))

    def missingness_by(self, by: str, column: str) -> DataFrame:
        return self._category(by).select(
            F.col(f"by_{by}").alias(by), F.col("rows").alias("total_users"),
            (F.col("rows") - F.col(f"filled_{column}")).alias(f"missing_{column}"),
        ).orderBy(F.desc("total_users"), by)

    def monthly_counts(self) -> DataFrame:
        month = len(self.profile.categories) + 1
        return self._of(month).select(F.col("by_month").alias("month"), "rows").orderBy("month")

    def _category(self, column: str) -> DataFrame:
        return self._of(self.profile.categories.index(column) + 1)

    def _average(self, column: str) -> Column:
        return (F.col(f"sum_{column}").cast("double") / F.col(f"filled_{column}")).alias("average")


def _keys(profile: Profile) -> dict[str, Column]:
    by = {f"by_{c}": F.col(c) for c in profile.categories}
    return by | ({"by_month": F.trunc(profile.month_of, "MM")} if profile.month_of else {})


def _measures(df: DataFrame, profile: Profile) -> list[Column]:
    sums = dict.fromkeys([*profile.averages, *([profile.label] if profile.label else [])])
    return [
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"filled_{c}") for c in df.columns],
        *[end(c).alias(f"{name}_{c}") for c in dict.fromkeys([*profile.bounds, *profile.averages])
          for name, end in (("min", F.min), ("max", F.max))],
        *[F.sum(c).alias(f"sum_{c}") for c in sums],
        *[F.count_if(F.expr(flag)).alias(f"flag_{name}") for name, flag in profile.flags],
    ]


def figures(df: DataFrame, profile: Profile) -> DataFrame:
    """One row for the whole table and one for each category, all from one scan.

    A row enters the aggregate once for the table and once for each categorical column, and combines
    where it is read: what is shuffled has a row for each category and task.
    """
    by, measures = _keys(profile), _measures(df, profile)
    keys = [F.col(k) for k in by]
    sets = [[], *[[k] for k in keys]]
    # In a set's row its own column counts as kept, so its bit in the grouping id is 0.
    whole = 2 ** len(keys) - 1
    number = F.lit(0)
    for i in range(len(keys)):
        bit = 1 << (len(keys) - 1 - i)
        number = F.when(F.col("gid") == whole - bit, i + 1).otherwise(number)
    keyed = df.withColumns(by) if by else df
    if not keys:
        return df.agg(*measures).withColumn(_SET, F.lit(0))
    found = keyed.groupingSets(sets, *keys).agg(F.grouping_id().alias("gid"), *measures)
    return found.withColumn(_SET, number).drop("gid")


def profiled(df: DataFrame, profile: Profile) -> ProfiledTable:
    """Compute the figures of a table once and store them; reports read the stored ones."""
    path = scratch_path(df.sparkSession, "profile")
    found = figures(df, profile)
    found.coalesce(1).write.parquet(path)
    stored = df.sparkSession.read.schema(found.schema).parquet(path)
    if stored.isEmpty():
        # Grouping sets of no rows are no groups; the whole table has its figures all the same.
        stored = found.limit(0).unionByName(
            df.agg(*_measures(df, profile)).withColumn(_SET, F.lit(0)), allowMissingColumns=True)
    return ProfiledTable(stored, profile, df.columns)
