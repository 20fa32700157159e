"""A published table: whole versions, one of which is current, with figures of every column.

    PATH/versions/version=3/part-...    the rows
    PATH/published/version=3/part-...   its figures; written last, it makes the version exist

Readers open the last version that was published and see it whole, also while the next is being
written; earlier ones stay readable. A version that was not finished is overwritten by the next try.
One publisher at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_exists

VERSION = "version"
_FIGURES = "position int, column_name string, data_type string, rows bigint, filled bigint, " \
           "about_distinct bigint, smallest string, largest string"


class PublishedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def figures(self) -> DataFrame:
        """Per version and column: rows, filled values, about how many distinct ones (5 % off at
        most times), smallest and largest as text."""
        if not path_exists(self.spark, f"{self.path}/published"):
            return self.spark.createDataFrame([], f"{_FIGURES}, {VERSION} int")
        return self.spark.read.schema(f"{_FIGURES}, {VERSION} int").parquet(f"{self.path}/published")

    def last_version(self) -> int:
        """0 before the first."""
        return self.figures().agg(F.max(VERSION)).first()[0] or 0

    def open(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the current one."""
        version = version or self.last_version()
        columns = self.figures().filter(F.col(VERSION) == version).orderBy("position").collect()
        if not columns:
            raise ValueError(f"{self.path} has no version {version}")
        schema = ", ".join(f"`{c.column_name}` {c.data_type}" for c in columns)
        return self.spark.read.schema(schema).parquet(f"{self.path}/versions/{VERSION}={version}")

    def publish(self, df: DataFrame) -> int:
        """Write the rows as the next version, take its figures from what was written, and make it
        the current one."""
        version = 1 + self.last_version()
        path = f"{self.path}/versions/{VERSION}={version}"
        df.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        _figures_of(written).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/published/{VERSION}={version}")
        return version

    def as_table(self, name: str, version: int | None = None) -> DataFrame:
        """The version as an external table of the session's catalog, with the statistics that the
        optimizer plans joins by."""
        version = version or self.last_version()
        columns = ", ".join(f"`{n}` {kind}" for n, kind in self.open(version).dtypes)
        location = f"{self.path}/versions/{VERSION}={version}"
        self.spark.sql(f"drop table if exists {name}")
        self.spark.sql(f"create table {name} ({columns}) using parquet location '{location}'")
        self.spark.sql(f"analyze table {name} compute statistics for all columns")
        return self.spark.table(name)


def _figures_of(df: DataFrame) -> DataFrame:
    """A row for each column, from one aggregate over the rows."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.struct(F.count(c).alias("filled"), F.approx_count_distinct(c).alias("about_distinct"),
                 F.min(c).cast("string").alias("smallest"), F.max(c).cast("string").alias("largest"))
        .alias(f"c{i}") for i, c in enumerate(df.columns)])
    lines = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"),
                 F.lit(kind).alias("data_type"), F.col("rows"), *[
                     F.col(f"c{i}.{f}").alias(f) for f in ("filled", "about_distinct", "smallest", "largest")])
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return one.select(F.inline(F.array(*lines)))
