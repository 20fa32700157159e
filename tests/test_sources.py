"""Readers, writers and cleaning."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from retention_spark.config import AnalysisConfig
from retention_spark.operators import clean, profile
from retention_spark.operators.blocks import in_window, usage_by_user
from retention_spark.sources import tables as io
from retention_spark.sources.derived import CONFIG, StarSchema
from retention_spark.sources.schemas import CLEAN, RAW, conform
from tests.rows import listen

CFG = AnalysisConfig()


def values(df, column):
    return [r[column] for r in df.collect()]


def test_csv_keeps_blank_text_and_missing_numbers(spark, tmp_path):
    path = tmp_path / "members.csv"
    path.write_text("msno,city,bd,gender,registered_via,registration_init_time\n"
                    "a,1,0,,7,1315695600000\nb,,32,male,9,\n")
    df = io.read_raw(spark, str(path), "members")
    assert df.dtypes == spark.createDataFrame([], RAW["members"]).dtypes
    assert [tuple(r) for r in df.collect()] == [
        ("a", 1, 0, "", 7, 1315695600000), ("b", None, 32, "male", 9, None)]


def test_csv_with_other_columns_is_refused(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("is_churn,msno\n1,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        io.read_raw(spark, str(path), "train").collect()


def test_conform_names_what_is_wrong(spark):
    df = spark.createDataFrame([("a", 1)], "msno string, is_churn bigint")
    with pytest.raises(ValueError, match="is_churn: bigint instead of int"):
        conform(df, CLEAN["train"])


@pytest.mark.parametrize("table", list(RAW))
def test_cleaning_the_raw_table_gives_the_clean_table(spark, small, table):
    star = StarSchema(spark, small)
    cleaned = clean.clean_table(star.raw(table), table, CONFIG)
    assert cleaned.dtypes == spark.createDataFrame([], CLEAN[table]).dtypes
    wanted = star.clean(table)
    assert cleaned.exceptAll(wanted).isEmpty() and wanted.exceptAll(cleaned).isEmpty()
    assert cleaned.count() == star.raw(table).count()


def test_dates_that_do_not_exist_become_null_and_are_counted(spark):
    numbers = [20170331, 20170231, 20160229, 20170229, 20171301, 20170100, 0, -1, None]
    df = spark.createDataFrame([(n,) for n in numbers], "d int")
    got = values(clean.int_to_date(df, ["d"]), "d")
    assert got == [date(2017, 3, 31), None, date(2016, 2, 29)] + [None] * 6
    assert tuple(clean.rejected_dates(df, ["d"]).first()) == (9, 6)


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_epoch_date_depends_on_the_named_zone_only(spark, session_zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(1315695600000,)], "t bigint")
        days = {tz: values(clean.epoch_ms_to_date(df, "t", tz), "t")[0]
                for tz in ("UTC", "Europe/London", "Asia/Taipei")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert days == {"UTC": date(2011, 9, 10), "Europe/London": date(2011, 9, 11),
                    "Asia/Taipei": date(2011, 9, 11)}


def test_age_bounds_and_blank_gender(spark):
    df = spark.createDataFrame(
        [(12, ""), (13, None), (85, " "), (86, "male"), (None, "female"), (1987, "")],
        "bd int, gender string")
    cleaned = clean.blank_to_null(clean.null_out_of_range(df, "bd", 13, 85), "gender")
    assert values(cleaned, "bd") == [None, 13, 85, None, None, None]
    assert values(cleaned, "gender") == [None, None, " ", "male", "female", None]


def test_usage_is_stored_by_month_and_read_by_month(spark, tmp_path):
    rows = [listen("a", date(2016, 12, 31), n50=1), listen("a", date(2017, 1, 1), n50=1),
            listen("b", date(2017, 3, 31), n100=2), listen("b", date(2017, 4, 1), n100=2)]
    path = str(tmp_path / "user_logs")
    io.write_clean(spark.createDataFrame(rows, CLEAN["user_logs"]), path, "user_logs")
    stored = io.read_clean(spark, path, "user_logs")
    assert sorted(p.name for p in (tmp_path / "user_logs").glob("month=*")) == [
        "month=2016-12-01", "month=2017-01-01", "month=2017-03-01", "month=2017-04-01"]
    assert stored.count() == 4
    window = in_window(stored, CFG)
    assert sorted(values(window, "date")) == [date(2017, 1, 1), date(2017, 3, 31)]
    assert len(window.inputFiles()) >= 2
    plan = usage_by_user(stored, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_union_keeps_every_row(spark):
    one = spark.createDataFrame([listen("a", date(2017, 3, 1))], CLEAN["user_logs"])
    assert io.union_usage(one, one).count() == 2


def test_reconcile_shows_rows_that_came_twice(spark):
    def logs(*days):
        return spark.createDataFrame([listen("a", d) for d in days], CLEAN["user_logs"])

    full, march = logs(date(2017, 2, 1), date(2017, 3, 5)), logs(date(2017, 3, 1), date(2017, 3, 2))
    rows = profile.reconcile_month(io.union_usage(full, march), march, "date").orderBy("month")
    assert [tuple(r) for r in rows.collect()] == [
        (date(2017, 2, 1), 1, 0, 1), (date(2017, 3, 1), 3, 2, 1)]


def test_month_gaps(spark):
    days = [date(2016, 11, 30), date(2017, 1, 1), date(2017, 1, 31), date(2017, 4, 1)]
    df = spark.createDataFrame([(d,) for d in [*days, None]], "d date")
    assert sorted(values(profile.month_gaps(df, "d"), "month")) == [
        date(2016, 12, 1), date(2017, 2, 1), date(2017, 3, 1)]
    assert tuple(profile.month_coverage(df, "d").first()) == (
        date(2016, 11, 1), date(2017, 4, 1), 3, 3)


def test_key_check(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "msno string")
    assert tuple(profile.key_check(df, "msno").first()) == (5, 2, 1, 2)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from retention_spark.session import scratch_path

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None),
                              sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(cluster, "x")
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_counts_on_empty_input(spark):
    df = spark.createDataFrame([], CLEAN["transactions"])
    assert profile.row_count(df).first()[0] == 0
    assert profile.null_audit(df, df.columns).first()[0] == 0
    assert df.filter(F.lit(True)).isEmpty()


def test_a_missing_user_stays_null_and_joins_nothing(spark, tmp_path):
    path = tmp_path / "logs.csv"
    path.write_text(",".join(RAW["user_logs"].fieldNames()) + "\n,20170105,0,1,0,0,0,1,60.5\n"
                    "a,20170105,0,1,0,0,0,1,60.5\n")
    logs = io.read_raw(spark, str(path), "user_logs")
    again = io.from_lines(io.to_lines(logs, "user_logs"), "user_logs")
    for df in (logs, again):
        assert sorted(map(str, values(df, "msno"))) == ["None", "a"]
        assert df.join(df.select("msno"), "msno").count() == 1
    assert profile.key_check(again, "msno").first().null_keys == 1


def test_days_missing_are_no_month(spark):
    days = [date(2000, 3, 5), None, date(2000, 6, 1), date(2000, 3, 9), None]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    assert sorted(r.month for r in profile.month_gaps(df, "date").collect()) == [date(2000, 4, 1), date(2000, 5, 1)]
    assert profile.month_coverage(df, "date").collect() == [(date(2000, 3, 1), date(2000, 6, 1), 2, 2)]
    none = df.filter("date is null")
    assert profile.month_gaps(none, "date").collect() == []
    assert profile.month_coverage(none, "date").collect() == [(None, None, 0, None)]
