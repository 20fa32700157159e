"""Groups with many rows, out of very many groups: HAVING count(*) > n on a wide key.

Grouping by a key with billions of values shuffles nearly every row, to keep a few groups. Here rows are
counted first by a hash of the key, into about four times as many buckets as there can be groups
of that size. A bucket holds all rows of its keys, so a key in a bucket of at most n rows can't have more,
and its rows are left out. What is left is grouped by the key itself, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

#: Buckets sent to every task at most, 8 bytes each; more are joined by shuffle.
SMALL_ROWS = 1_000_000


def bucket_count(rows: int, more_than: int) -> int:
    """A power of two, at least four times the groups that can have more than so many rows."""
    return 1 << max(10, (4 * rows // max(more_than, 1)).bit_length())


def frequent_groups(df: DataFrame, keys: Sequence[str], more_than: int,
                    measures: Sequence[Column] = (), name: str = "rows") -> DataFrame:
    """`df.groupBy(keys).agg(count as name, *measures)`, only groups of more than so many rows.

    A NULL key is a group of its own. The input is read three times, once without any column, and
    shuffled are a count for each bucket and task, and the groups in buckets that hold enough rows; this pays
    where few groups are that large. A key with a third of all rows combines before either shuffle.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(bucket_count(df.count(), more_than)))
    path = scratch_path(spark, "iceberg")
    counted = df.groupBy(bucket.alias("iceberg_bucket")).agg(F.count(F.lit(1)).alias("held"))
    counted.filter(F.col("held") > more_than).select("iceberg_bucket").write.parquet(path)
    full = spark.read.schema("iceberg_bucket bigint").parquet(path)
    full = F.broadcast(full) if full.count() <= SMALL_ROWS else full
    left = df.join(full, bucket == F.col("iceberg_bucket"), "left_semi")
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias(name), *measures).filter(F.col(name) > more_than)
