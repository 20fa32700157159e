"""Readers and writers of the raw and cleaned tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from .schemas import CLEAN, RAW, conform

MONTH = "month"


class Tables:
    """The four cleaned tables, each built on first use so a query opens only what it reads."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load

    @cached_property
    def train(self) -> DataFrame:
        return self._load("train")

    @cached_property
    def members(self) -> DataFrame:
        return self._load("members")

    @cached_property
    def transactions(self) -> DataFrame:
        return self._load("transactions")

    @cached_property
    def user_logs(self) -> DataFrame:
        return self._load("user_logs")


def read_raw(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """One raw table under its declared schema; types are never inferred from the data.

    CSV headers are checked against the declared names, so a reordered file fails loudly.
    """
    reader = spark.read.schema(RAW[table])
    if fmt != "csv":
        return conform(reader.format(fmt).load(path), RAW[table])
    df = reader.csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    return conform(blank_texts(df), RAW[table])


def to_lines(df: DataFrame, table: str) -> DataFrame:
    """The raw table as the lines of its CSV file, without a header."""
    return conform(df, RAW[table]).select(F.to_csv(F.struct("*")).alias("line"))


def from_lines(lines: DataFrame, table: str) -> DataFrame:
    """Lines of a CSV file (text tables, streams of a queue) under the declared schema; a line
    that doesn't fit fails."""
    row = F.from_csv("line", RAW[table].simpleString()[len("struct<"):-1].replace(":", " "),
                     {"mode": "FAILFAST"})
    return conform(blank_texts(lines.select(row.alias("row")).select("row.*")), RAW[table])


def blank_texts(df: DataFrame) -> DataFrame:
    """CSV cannot tell an empty text from a missing one; a missing gender is read as the empty
    text. A missing user stays NULL, so that it meets no other in a join."""
    blank = [c for c in ("gender",) if c in df.columns]
    return df.fillna("", subset=blank) if blank else df


def union_usage(full: DataFrame, increment: DataFrame) -> DataFrame:
    """The history file and the later increment as one table; nothing is de-duplicated."""
    return full.unionByName(increment)


def write_clean(df: DataFrame, path: str, table: str) -> None:
    """Write one cleaned table as Parquet; usage is split into one folder per month.

    `rebalance` lets AQE size the files from the measured shuffle: a month, or a user, holding a
    third of the rows is spread over many tasks and small months share none of their files with
    others. Sorting inside each file by user makes later per-user sums combine before the shuffle
    and lets Parquet statistics skip.
    """
    df = conform(df, CLEAN[table])
    if table != "user_logs":
        df.write.mode("errorifexists").parquet(path)
        return
    by_month = df.withColumn(MONTH, F.trunc("date", "MM"))
    (
        by_month.hint("rebalance", F.col(MONTH))
        .sortWithinPartitions(MONTH, "msno", "date")
        .write.mode("errorifexists").partitionBy(MONTH).parquet(path)
    )


def read_clean(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One cleaned table. For usage the month folder is kept as a column, see `in_window`."""
    schema = CLEAN[table]
    if table == "user_logs":
        schema = StructType([*schema.fields, StructField(MONTH, DateType())])
    return conform(spark.read.schema(schema).parquet(path), schema)


def write_features(df: DataFrame, path: str) -> None:
    """Hand the feature table to its consumers as Parquet, raw values only."""
    df.write.mode("errorifexists").parquet(path)
