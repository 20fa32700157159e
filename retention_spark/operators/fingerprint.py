"""Fingerprints of bags of rows: equal for the same rows in any order, and they add up.

A bag is summarised by its row count, and by the sum and the exclusive or of its row hashes. A row replaced by
another, which a count doesn't show, changes the sum; a row that came twice changes it too, which an exclusive or
alone might not show. The fingerprint of two bags together is the sum of theirs, so what was loaded piece by
piece is compared with the pieces, without reading them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Sums of the upper and lower half of the hashes: neither overflows below 2**31 rows in each of 2**31 tasks.
PARTS = ("rows", "hash_high", "hash_low", "hash_xor")


def row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """A 64-bit hash of the columns and of which of them are null, which hashing alone skips."""
    def plain(c: str) -> Column:
        # One zero and one NaN.
        fractional = isinstance(df.schema[c].dataType, (DoubleType, FloatType))
        return F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) if fractional else F.col(c)

    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(nulls, *map(plain, columns))


def parts_of(h: Column) -> list[Column]:
    """Aggregates over row hashes."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.shiftright(h, 32)), F.lit(0)).alias("hash_high"),
        F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias("hash_low"),
        F.coalesce(F.bit_xor(h), F.lit(0).cast("bigint")).alias("hash_xor"),
    ]


def fingerprint(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One row per group, or one for all: `by`, rows, hash_high, hash_low, hash_xor. Hashes are of
    `columns`, by default all others."""
    columns = columns or [c for c in df.columns if c not in by]
    hashed = df.select(*by, row_hash(df, columns).alias("h"))
    return hashed.groupBy(*by).agg(*parts_of(F.col("h")))


def added(prints: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The fingerprint of all bags together, from theirs."""
    return prints.groupBy(*by).agg(
        *[F.sum(p).alias(p) for p in PARTS[:3]], F.bit_xor("hash_xor").alias("hash_xor"))


def compared(found: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Per group that either has: found_rows, wanted_rows and `same`, whether the bags agree. A
    group that one side lacks is an empty bag there."""
    left = found.select(by, *[F.col(p).alias(f"found_{p}") for p in PARTS])
    right = wanted.select(F.col(by).alias("wanted_by"), *[F.col(p).alias(f"wanted_{p}") for p in PARTS])
    both = left.join(right, F.col(by).eqNullSafe(F.col("wanted_by")), "full")
    held = {f"{side}_{p}": F.coalesce(f"{side}_{p}", F.lit(0)) for side in ("found", "wanted") for p in PARTS}
    same = F.lit(True)
    for p in PARTS:
        same = same & (F.col(f"found_{p}") == F.col(f"wanted_{p}"))
    return both.withColumn(by, F.coalesce(by, "wanted_by")).withColumns(held).select(
        by, "found_rows", "wanted_rows", same.alias("same"))
