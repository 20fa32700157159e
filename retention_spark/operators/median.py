"""Count, mean and exact median per group without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quantiles around the middle that split a group, further apart than the sketch can err.
SPLITS = tuple(0.5 + step * 0.0005 for step in range(-3, 4))
ACCURACY = 10_000


def grouped_mean_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: count, mean and exact median (mean of the two middle values) of a decimal column.

    `median` and `percentile` keep every distinct value of a group in one task's memory. Here a
    quantile sketch, of bounded size and combined before the shuffle, gives values close to the
    middle. They split the group into cells; counting those finds the one or two cells that hold the
    middle ranks, exactly, and only their distinct values are ranked: about 0.05 % of a
    group, however the values are spread, while a value shared by a third of all rows is a single counted row.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"))
    values = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"),
        F.percentile_approx("value", list(SPLITS), ACCURACY).alias("splits"))
    cell = sum((F.coalesce((F.col("value") > F.col("splits")[i]).cast("int"), F.lit(0))
                for i in range(len(SPLITS))), F.lit(0))
    placed = _join(values, groups, keys).select(
        *keys, "value", "n", "count", "sum", cell.alias("cell"))

    def below(limit: int) -> Column:
        return F.sum(F.when(F.col("cell") < limit, F.col("n")).otherwise(0))

    cells = placed.groupBy(*keys, "count", "sum").agg(
        F.array(*[below(i) for i in range(len(SPLITS) + 2)]).alias("below")
    ).select(
        *keys, "count", "sum", "below",
        F.call_function("div", F.col("count") + 1, F.lit(2)).alias("low_rank"),
        (F.call_function("div", F.col("count"), F.lit(2)) + 1).alias("high_rank"))

    def holds(rank: str) -> Column:
        before = F.get("below", F.col("cell"))
        return (before < F.col(rank)) & (F.get("below", F.col("cell") + 1) >= F.col(rank))

    middle = _join(placed.drop("count", "sum"), cells, keys).filter(
        holds("low_rank") | holds("high_rank"))
    in_cell = Window.partitionBy(*keys, "cell").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("upto") >= F.col(rank), F.col("value")))

    upto = F.get("below", F.col("cell")) + F.sum("n").over(in_cell)
    return (
        middle.withColumn("upto", upto).groupBy(*keys, "count", "sum")
        .agg(((at("low_rank") + at("high_rank")) / 2).alias("median"))
        .select(*keys, "count", (F.col("sum") / F.col("count")).alias("mean"), "median")
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join with the few rows of `right`, one per group; NULL is a group of its own."""
    named = right.withColumnsRenamed({k: f"{k}_of_group" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_of_group")) for k in keys])
    return left.join(named, same).drop(*[f"{k}_of_group" for k in keys])
