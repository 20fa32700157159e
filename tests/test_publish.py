"""Published versions, rejected values, frequent groups and the interval of a gap."""

from __future__ import annotations

import math
import random


import pytest
from pyspark.sql import functions as F

from retention_spark.operators import clean
from retention_spark.operators.iceberg import bucket_count, frequent_groups
from retention_spark.plans import renewal
from retention_spark.plans.kpi import Z95, test_vs_control_interval as interval
from retention_spark.run import run
from retention_spark.sources.derived import CONFIG as CFG
from retention_spark.sources.landing import REASON, TEXT, land, read_delivery, reject_values
from retention_spark.sources.publish import PublishedTable
from retention_spark.sources.schemas import RAW
from retention_spark.sources.usage_store import UsageStore
from tests.rows import random_rows, tables
from tests.test_plans import plan_of
from tests.test_run import write_csv


# Published versions

def test_versions(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "t"))
    assert table.last_version() == 0
    with pytest.raises(ValueError, match="has no version"):
        table.open()
    one = spark.createDataFrame([("a", 1, None), ("b", None, 2.5)], "k string, n int, x double")
    assert table.publish(one) == 1 and table.publish(one.limit(0)) == 2
    assert table.publish(one.unionByName(one)) == 3
    assert [table.open(v).count() for v in (1, 2, 3)] == [2, 0, 4] and table.open().count() == 4
    assert table.open().dtypes == one.dtypes
    found = [tuple(r) for r in table.figures().filter("version = 1").orderBy("position").drop(
        "position", "version").collect()]
    assert found == [("k", "string", 2, 2, 2, "a", "b"), ("n", "int", 2, 1, 1, "1", "1"),
                     ("x", "double", 2, 1, 1, "2.5", "2.5")]


def test_a_half_written_version_is_not_seen(spark, tmp_path, monkeypatch):
    from retention_spark.sources import publish
    table = PublishedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(3))
    def stop(df):
        raise RuntimeError("stopped")
    with monkeypatch.context() as broken:
        broken.setattr(publish, "_figures_of", stop)
        with pytest.raises(RuntimeError):
            table.publish(spark.range(50))
    assert (tmp_path / "t" / "versions" / "version=2").is_dir()
    assert table.last_version() == 1 and table.open().count() == 3
    assert table.publish(spark.range(7)) == 2 and table.open().count() == 7


def test_statistics_for_the_optimizer(spark, tmp_path):
    table = PublishedTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(1000).selectExpr("id", "id % 10 as k", "cast(id as decimal(20,4)) as d"))
    opened = table.as_table("published_statistics")
    try:
        assert opened.count() == 1000 and opened.dtypes == table.open().dtypes
        lines = {r[0]: r[1] for r in spark.sql("describe extended published_statistics k").collect()}
        assert (lines["distinct_count"], lines["min"], lines["max"]) == ("10", "0", "9")
    finally:
        spark.sql("drop table published_statistics")


# Rejected values

LOGS = [("a", 20170105, 60.0), ("b", 20170231, 60.0), ("c", 20170106, float("nan")),
        ("d", 20171301, float("inf")), ("e", None, None), ("f,\"", 0, 1.5)]


def raw_logs(spark):
    rows = [(u, d, 0, 1, 0, 0, 0, 1, s) for u, d, s in LOGS]
    return spark.createDataFrame(rows, RAW["user_logs"])


def test_every_row_is_clean_or_rejected(spark):
    cleaned, rejects = clean.split_by_values(raw_logs(spark), "user_logs", CFG)
    assert sorted(r.msno for r in cleaned.collect()) == ["a", "e"]
    assert sorted((r.msno, r.date, r.reasons) for r in rejects.collect()) == [
        ("b", 20170231, "date"), ("c", 20170106, "total_secs"), ("d", 20171301, "date,total_secs"),
        ('f,"', 0, "date")]
    # The counts that cleaning reports agree.
    counts = raw_logs(spark).agg(*clean.reject_counts(raw_logs(spark))).first()
    assert (counts.total, counts.date_rejected, counts.total_secs_rejected) == (6, 3, 2)


def test_moments_outside_the_calendar(spark):
    rows = [(n, 1, 1, "", 1, ms) for n, ms in (
        ("a", 1315695600000), ("b", 2**62), ("c", -2**62), ("d", None), ("e", clean.EPOCH_MS[0]),
        ("f", clean.EPOCH_MS[1]))]
    df = spark.createDataFrame(rows, RAW["members"])
    for tz in ("UTC", "Asia/Taipei", "America/Los_Angeles"):
        days = {r.msno: r.t for r in clean.epoch_ms_to_date(df, "registration_init_time", tz).selectExpr(
            "msno", "string(registration_init_time) as t").collect()}
        assert days["b"] is days["c"] is days["d"] is None
        assert days["e"] in ("0001-01-01", "0001-01-02") and days["f"][:4] in ("9998", "9999")
    cleaned, rejects = clean.split_by_values(df, "members", CFG)
    assert cleaned.count() == 4 and {r.reasons for r in rejects.collect()} == {"registration_init_time"}


def test_strict_landing_keeps_the_row_as_text(spark, tmp_path):
    (tmp_path / "logs.csv").write_text(",".join(RAW["user_logs"].fieldNames()) + "\n"
                                       + "".join(f'"{u.replace(chr(34), chr(34) * 2)}",{d if d is not None else ""},0,1,0,0,0,1,'
                                                 f'{"NaN" if s != s else "Inf" if s == math.inf else s}\n'
                                                 for u, d, s in LOGS if s is not None) + "x\n")
    delivery = read_delivery(spark, str(tmp_path / "logs.csv"), "user_logs")
    found = land(reject_values(delivery, "user_logs"), str(tmp_path / "landed"), "user_logs")
    assert [r.msno for r in found.rows.collect()] == ["a"]
    assert sorted((r[REASON], r[TEXT]) for r in found.rejects.collect()) == [
        ("line", "x"), ("value:date", '"f,""",0,0,1,0,0,0,1,1.5'), ("value:date", "b,20170231,0,1,0,0,0,1,60.0"),
        ("value:date,total_secs", "d,20171301,0,1,0,0,0,1,Infinity"),
        ("value:total_secs", "c,20170106,0,1,0,0,0,1,NaN")]


def test_strict_run_publishes(spark, tmp_path):
    rows = random_rows(seed=8, users=30)
    for name in ("train", "members", "transactions"):
        write_csv(tmp_path / f"{name}.csv", name, rows[name])
    usage = write_csv(tmp_path / "usage.csv", "user_logs", rows["user_logs"])
    with open(usage, "a") as file:
        file.write("user1,20001301,0,1,0,0,0,1,5.0\n")
    out = str(tmp_path / "out")
    run(spark, str(tmp_path), [usage], out, CFG, strict_values=True, publish=f"{out}/published")
    assert UsageStore(spark, f"{out}/usage").usage().count() == len(rows["user_logs"])
    rejects = spark.read.parquet(f"{out}/results/user_logs_usage_rejects").collect()
    assert [(r[REASON], r[TEXT]) for r in rejects] == [("value:date", "user1,20001301,0,1,0,0,0,1,5.0")]
    table = PublishedTable(spark, f"{out}/published").open()
    assert table.count() == spark.read.parquet(f"{out}/features").count() > 0


# Frequent groups

@pytest.mark.parametrize("more_than", [0, 1, 3, 50, 10**6])
def test_frequent_groups(spark, more_than):
    r = random.Random(more_than)
    rows = [(r.choice([None, "hot", f"k{r.randint(0, 400)}"]), r.randint(0, 3), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, n int, v int").repartition(4)
    got = frequent_groups(df, ["k", "n"], more_than, [F.sum("v").alias("v")])
    wanted = df.groupBy("k", "n").agg(F.count(F.lit(1)).alias("rows"), F.sum("v").alias("v")).filter(
        F.col("rows") > more_than)
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_frequent_groups_of_nothing(spark):
    assert frequent_groups(spark.range(0), ["id"], 5).count() == 0


def test_buckets_follow_the_rows():
    assert bucket_count(0, 5) == 1024
    for rows in (10**6, 10**9, 10**12):
        assert 4 * rows / 500 <= bucket_count(rows, 500) <= 16 * rows / 500


def test_few_groups_reach_the_second_shuffle(spark):
    """Of 300,000 keys, one of which holds many rows, next to none are grouped."""
    df = spark.range(400_000).selectExpr("if(id < 100000, -1, id) as k")
    got = frequent_groups(df, ["k"], 1000)
    plan = plan_of(got)
    assert "LeftSemi" in plan and plan.count("hashpartitioning(k") == 1
    assert [tuple(r) for r in got.collect()] == [(-1, 100_000)]


def test_plan_length_adoption_as_frequent_groups(spark):
    t = tables(spark, **random_rows(seed=4, users=200))
    from dataclasses import replace
    cfg = replace(CFG, adoption_min_users=20)
    wanted = {r.payment_plan_days: r.users for r in renewal.plan_length_adoption(t, cfg).collect()}
    got = frequent_groups(renewal.paying_cohort(t, cfg), ["payment_plan_days"], 20, name="users")
    assert {r.payment_plan_days: r.users for r in got.collect()} == wanted and len(wanted) > 0


# The interval of a gap

def newcombe(x1, n1, x2, n2, z=Z95):
    def score(x, n):
        p = x / n
        mid, reach = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        return p, (mid - reach) / (1 + z * z / n), (mid + reach) / (1 + z * z / n)
    (p1, l1, u1), (p2, l2, u2) = score(x1, n1), score(x2, n2)
    d = p2 - p1
    return [round(100 * v, 4) for v in (d, d - math.hypot(p2 - l2, u1 - p1), d + math.hypot(u2 - p2, p1 - l1))]


@pytest.mark.parametrize("x1, n1, x2, n2", [(3, 40, 12, 50), (0, 10, 0, 12), (10, 10, 0, 10), (1, 1, 1, 2),
                                            (56, 70, 48, 80)])
def test_interval(spark, x1, n1, x2, n2):
    rows = [("test", int(i < x1)) for i in range(n1)] + [("control", int(i < x2)) for i in range(n2)]
    rows += [("test", None), (None, 1), ("other", 1)]
    got = interval(spark.createDataFrame(rows, "arm string, is_churn int"), "arm").first()
    assert (got.test_users, got.control_users) == (n1, n2)
    assert [got.gap, got.gap_low, got.gap_high] == pytest.approx(newcombe(x1, n1, x2, n2), abs=2e-4)


def test_interval_without_a_group(spark):
    got = interval(spark.createDataFrame([("test", 1)], "arm string, is_churn int"), "arm").first()
    assert tuple(got) == (1, 0, None, None, None)
    assert tuple(interval(spark.createDataFrame([], "arm string, is_churn int"), "arm").first()) == (
        0, 0, None, None, None)
