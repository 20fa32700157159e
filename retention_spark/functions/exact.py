"""Exact rounding and averaging.

Rounding a binary double is wrong at ties (1.005 is stored below 1.005), so shares and rates are
rounded on integers and kept as decimals. Sums of integers and decimals do not depend on row
order, so neither do the results.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_ratio(num: Column, den: Column, places: int) -> Column:
    """`num / den` rounded half up to `places` decimals; NULL where `den` is 0 or either is NULL.

    Both are non-negative integers. The result is `decimal(20, places)`.
    """
    num, den = num.cast("bigint"), den.cast("bigint")
    scaled = F.call_function("div", num * F.lit(2 * 10**places).cast("bigint") + den, den * 2)
    units = F.when(den > 0, scaled).cast("decimal(20,0)")
    return (units * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(20,{places})")


def percent(part: Column, whole: Column) -> Column:
    """`part / whole` in percent, two decimals."""
    return round_ratio(part * 100, whole, 2)


def label_percent(label: str) -> Column:
    """Aggregate: mean of a 0/1 label in percent, two decimals; NULL labels do not count."""
    return percent(F.sum(label), F.count(label))


def exact_mean(value: Column, unit: int = 1) -> Column:
    """Aggregate: unrounded mean of an integer or decimal column, divided by `unit`, as double."""
    return F.sum(value).cast("double") / unit / F.count(value)


def decimal_ratio(num: Column, den: Column) -> Column:
    """`num / den` as `decimal(38,18)`, guarded against division by zero."""
    return F.when(den != 0, num.cast("decimal(20,0)") / den.cast("decimal(20,0)"))
