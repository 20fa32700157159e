"""Column helpers against plain arithmetic."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from retention_spark.config import AnalysisConfig
from retention_spark.functions import buckets, day_bits, exact, listening
from retention_spark.operators.median import grouped_mean_median

CFG = AnalysisConfig()


def half_up(value: Decimal, places: int) -> Decimal:
    return value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def test_round_ratio_is_half_up_at_every_tie(spark):
    pairs = [(a, b) for b in range(1, 201) for a in range(0, 2 * b + 1)]
    rows = spark.createDataFrame(pairs, "a int, b int").select(
        "a", "b", exact.round_ratio(F.col("a"), F.col("b"), 4).alias("rate"),
        exact.percent(F.col("a"), F.col("b")).alias("pct")).collect()
    for r in rows:
        # 40 digits are enough to tell a tie from its neighbours at these sizes.
        assert r.rate == half_up(Decimal(r.a) / r.b, 4)
        assert r.pct == half_up(Decimal(100 * r.a) / r.b, 2)


def test_ratio_without_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 0), (None, 3), (3, None)], "a int, b int")
    rows = df.select(exact.percent(F.col("a"), F.col("b")).alias("p"),
                     exact.decimal_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [tuple(r) for r in rows] == [(None, None)] * 3


def total_ns(df):
    return df.agg(*listening.part_sums(F.col("s"), "t")).select(listening.as_ns("t")).first()[0]


def test_seconds_add_up_exactly_in_any_order(spark):
    r = random.Random(3)
    values = [r.randint(0, 10**9) / 7 for _ in range(5000)] + [0.0004] * 90
    df = spark.createDataFrame([(v,) for v in values], "s double").repartition(7)
    whole = [int(v // 1) for v in values]
    nanos = [round((v - w) * 10**9) for v, w in zip(values, whole, strict=True)]
    assert total_ns(df) == sum(whole) * 10**9 + sum(nanos)


def test_absurd_seconds_do_not_overflow(spark):
    values = [-9223372036854774.0] + [9223372036854774.0] * 3000 + [6309.273, 2.0**62]
    odd = [float("nan"), float("inf"), float("-inf"), 2.0**63, None]
    df = spark.createDataFrame([(v,) for v in values + odd], "s double")
    assert total_ns(df) == (9223372036854774 * 2999 + 2**62) * 10**9 + 6309_273_000_000


def test_minutes_are_rounded_once(spark):
    cases = [(300_000_000, 1), (299_999_999, 1), (-300_000_000, 1), (10**31 + 7, 3), (1, 92), (5, 0)]
    df = spark.createDataFrame([(Decimal(n), d) for n, d in cases], "ns decimal(38,0), d bigint")
    got = df.select(listening.rounded_minutes(F.col("ns"), F.col("d")).alias("r"),
                    listening.minutes(F.col("ns"), F.col("d")).alias("m")).collect()
    assert [r.r for r in got] == [
        Decimal(s) for s in ("0.01", "0.00", "-0.01", "55555555555555555555.56", "0.00")] + [None]
    assert got[0].m == Decimal("0.005") and got[5].m is None


@pytest.mark.parametrize("days", [1, 63, 64, 65, 92, 128, 200])
def test_day_sets(spark, days):
    start = date(2017, 1, 1)
    r = random.Random(days)
    sample = [(start + timedelta(days=r.randrange(days)), r.random() < 0.7) for _ in range(60)]
    sample += [(start, True), (start + timedelta(days=days - 1), True)]
    active = {d for d, keep in sample if keep}
    intervals = [(start + timedelta(days=r.randint(-3, days + 3)),
                  start + timedelta(days=r.randint(-3, days + 3))) for _ in range(60)]
    intervals += [(None, start), (start, None), (None, None)]
    words = [c.alias(f"w{i}") for i, c in enumerate(
        day_bits.collect_days(F.col("d"), F.col("keep"), start, days))]
    sets = spark.createDataFrame(sample, "d date, keep boolean").agg(*words)
    columns = [F.col(c) for c in sets.columns]
    rows = sets.join(spark.createDataFrame(intervals, "lo date, hi date")).select(
        "lo", "hi", day_bits.count_days(columns).alias("n"),
        day_bits.count_days_between(columns, start, F.col("lo"), F.col("hi")).alias("cut"),
    ).collect()
    for row in rows:
        assert row.n == len(active)
        known = row.lo is not None and row.hi is not None
        assert row.cut == (sum(row.lo <= d <= row.hi for d in active) if known else 0)


def test_plan_types(spark):
    lengths = [0, 7, 8, 30, 31, 90, 91, None]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = [r[0] for r in df.select(buckets.plan_type(F.col("n"), CFG)).collect()]
    assert got == ["Trial", "Trial", "Monthly", "Monthly", "Quarterly", "Quarterly",
                   "Long-term", "Long-term"]


def test_tier_is_cut_on_the_rounded_rate(spark):
    # 24498 / 50000 = 0.48996, which rounds to 0.4900.
    df = spark.createDataFrame([(24498, 50000), (489, 1000), (0, 9)], "a int, b int")
    rate = exact.round_ratio(F.col("a"), F.col("b"), 4)
    got = [r[0] for r in df.select(buckets.engagement_tier(rate, CFG)).collect()]
    assert got == ["Regular", "Light User", "Dormant"]


@pytest.mark.parametrize("case", ["mixed", "one hot value", "two values", "single"])
def test_median(spark, case):
    r = random.Random(case)
    groups = {
        "mixed": {g: [r.randint(-500, 10**6) for _ in range(200 + g)] for g in range(4)},
        "one hot value": {0: [777] * 3000 + [r.randint(0, 2000) for _ in range(1500)]},
        "two values": {0: [100, 101], 1: [100, 900], 2: [100, 100, 900, 900]},
        "single": {0: [5], 1: [-5]},
    }[case]
    rows = [(g, Decimal(v).scaleb(-3)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g int, v decimal(20,3)").repartition(3)
    rows = grouped_mean_median(df, ["g"], "v").collect()
    assert {row.g: row["median"] for row in rows} == {
        g: Decimal(median(values)) / 1000 for g, values in groups.items()}
    for row in rows:
        values = groups[row.g]
        assert row["count"] == len(values)
        assert float(row["mean"]) == pytest.approx(sum(values) / len(values) / 1000)


def test_median_skips_nulls_and_keeps_null_groups(spark):
    rows = [(None, Decimal(1)), (None, Decimal(3)), (1, None), (2, None), (2, Decimal(7))]
    df = spark.createDataFrame(rows, "g int, v decimal(20,3)")
    got = {r.g: r["median"] for r in grouped_mean_median(df, ["g"], "v").collect()}
    assert got == {None: 2, 2: 7}


def test_window_must_not_be_reversed():
    with pytest.raises(ValueError):
        AnalysisConfig(win_start=date(2017, 2, 1), win_end=date(2017, 1, 1))
