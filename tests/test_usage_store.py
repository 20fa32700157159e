"""The usage store: loads, manifest, months, fingerprints."""

from __future__ import annotations

import shutil
from dataclasses import replace
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from retention_spark.catalog import TABLE_QUERIES
from retention_spark.operators import monthly
from retention_spark.operators.blocks import usage_by_user
from retention_spark.operators.fingerprint import added, compared, fingerprint
from retention_spark.plans import features, usage
from retention_spark.plans.prepare import MonthlyTables, prepare
from retention_spark.sources.derived import CONFIG as CFG
from retention_spark.sources.schemas import CLEAN
from retention_spark.sources.usage_store import UsageStore
from tests.rows import listen, random_rows, tables
from tests.test_plans import plan_of


def logs(spark, rows):
    return spark.createDataFrame(list(rows), CLEAN["user_logs"])


def same(a, b):
    assert a.dtypes == b.dtypes
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def files(path: Path) -> dict[str, int]:
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in (path / "rows").rglob("*.parquet")}


JAN = [listen("a", date(2017, 1, 5), n100=2), listen("b", date(2017, 1, 31), n25=1)]
FEB = [listen("a", date(2017, 2, 1), n50=1), listen("a", date(2017, 2, 1), n50=1)]
MAR = [listen("c", date(2017, 3, 9), n100=1)]


@pytest.fixture
def store(spark, tmp_path):
    return UsageStore(spark, str(tmp_path / "store"))


def test_loading_twice_equals_once(spark, store, tmp_path):
    assert store.load("full", logs(spark, JAN + FEB)).months == [date(2017, 1, 1), date(2017, 2, 1)]
    first = store.load("march", logs(spark, FEB[:1] + MAR))
    assert (first.months, first.entry) == ([date(2017, 2, 1), date(2017, 3, 1)], 2)
    before = files(tmp_path / "store")
    again = store.load("march", logs(spark, reversed(FEB[:1] + MAR)))
    assert (again.months, again.entry, store.last_entry()) == ([], None, 2)
    assert files(tmp_path / "store") == before
    assert same(store.usage().drop("month"), logs(spark, JAN + FEB + FEB[:1] + MAR))
    assert store.reconcile().filter("not same").count() == 0


def test_a_corrected_delivery_rewrites_its_changed_months_only(spark, store, tmp_path):
    store.load("full", logs(spark, JAN + FEB))
    store.load("late", logs(spark, MAR + JAN[:1]))
    before = files(tmp_path / "store")
    better = [*MAR, listen("d", date(2017, 3, 10), n100=1), *JAN[:1]]
    assert store.load("late", logs(spark, better)).months == [date(2017, 3, 1)]
    new = {f for f in files(tmp_path / "store") if f not in before}
    assert new and all("month=2017-03-01/load=late/held=3" in f for f in new)
    assert same(store.usage().drop("month"), logs(spark, JAN + FEB + better))
    # The state before is still readable, rows and months.
    assert same(store.usage(as_of=2).drop("month"), logs(spark, JAN + FEB + MAR + JAN[:1]))
    assert store.months(as_of=2).filter("month = '2017-03-01'").count() == 1
    assert store.months().filter("month = '2017-03-01'").count() == 2


def test_a_month_that_a_load_no_longer_has_is_gone(spark, store):
    store.load("full", logs(spark, JAN + FEB))
    assert store.load("full", logs(spark, JAN)).months == [date(2017, 2, 1)]
    assert same(store.usage().drop("month"), logs(spark, JAN))
    assert store.months().filter("month = '2017-02-01'").count() == 0
    assert store.load("full", logs(spark, [])).months == [date(2017, 1, 1)]
    assert store.usage().count() == 0 and store.months().count() == 0
    assert store.load("full", logs(spark, [])).entry is None


def test_the_same_rows_by_another_name_are_refused(spark, store):
    store.load("march", logs(spark, MAR))
    with pytest.raises(ValueError, match="copy holds the rows of march"):
        store.load("copy", logs(spark, MAR))
    assert store.last_entry() == 1


def test_rows_without_a_date_are_kept(spark, store):
    rows = [listen("a", None, n50=1), *JAN]
    assert store.load("full", logs(spark, rows)).months == [None, date(2017, 1, 1)]
    assert same(store.usage().drop("month"), logs(spark, rows))
    assert store.reconcile().count() == 2 and store.months().count() == 2


def test_a_load_that_broke_off_counts_for_nothing(spark, store, monkeypatch):
    store.load("full", logs(spark, JAN))
    def stop(*args):
        raise RuntimeError("stopped")
    with monkeypatch.context() as broken:
        broken.setattr(monthly, "write", stop)
        with pytest.raises(RuntimeError):
            store.load("march", logs(spark, [*MAR, *FEB]))
    assert same(store.usage().drop("month"), logs(spark, JAN)) and store.last_entry() == 1
    # What it left under the number that the next load takes is overwritten, or not read.
    store.load("march", logs(spark, MAR))
    assert same(store.usage().drop("month"), logs(spark, JAN + MAR))
    store.require_reconciled()


def test_a_replaced_row_is_seen(spark, store, tmp_path):
    store.load("full", logs(spark, JAN + FEB))
    store.require_reconciled()
    folder = tmp_path / "store" / "rows" / "month=2017-01-01" / "load=full" / "held=1"
    shutil.rmtree(folder)
    changed = logs(spark, [JAN[0], listen("b", date(2017, 1, 30), n25=1)])
    changed.write.parquet(str(folder))
    assert [tuple(r) for r in store.reconcile().filter("not same").collect()] == [
        (date(2017, 1, 1), 2, 2, False)]
    with pytest.raises(ValueError, match="2017-01-01: 2 rows for 2"):
        store.require_reconciled()


def test_only_counting_folders_are_read(spark, store):
    store.load("full", logs(spark, JAN + FEB))
    store.load("full", logs(spark, JAN + FEB[:1]))
    window = replace(CFG, win_start=date(2017, 2, 1), win_end=date(2017, 2, 28))
    plan = plan_of(usage_by_user(store.usage(), window))
    assert "PartitionFilters: [" in plan and "held" in plan
    assert store.usage().filter("month = '2017-02-01'").count() == 1


# Fingerprints

def test_fingerprints(spark):
    rows = [("a", 1, 0.0), ("a", 1, 0.0), ("b", None, float("nan")), (None, 2, -1.5)]
    def of(rows):
        return tuple(fingerprint(spark.createDataFrame(rows, "k string, n int, x double").repartition(3)).first())
    assert of(rows) == of(rows[::-1]) == of([("a", 1, -0.0), *rows[1:]])
    others = [rows[:3], rows + rows[:1], [rows[0], *rows[2:], rows[2]], [("a", 1, 0.5), *rows[1:]],
              [("a", None, 0.0), *rows[1:]], [(None, 1, 0.0), *rows[1:]]]
    assert len({of(rows), *map(of, others)}) == 7
    # A null column and a moved value don't look the same.
    assert of([(None, 7, 1.0)]) != of([("7", None, 1.0)])
    assert of([]) == (0, 0, 0, 0)


def test_fingerprints_add_up(spark):
    df = spark.range(2000).selectExpr("id % 5 as k", "id * 7 as v")
    parts = [fingerprint(df.filter(f"v % 3 = {i}"), ["k"]) for i in range(3)]
    whole = fingerprint(df, ["k"])
    summed = added(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["k"])
    got = compared(summed, whole, "k").collect()
    assert len(got) == 5 and all(r.same and r.found_rows == 400 for r in got)
    lacking = compared(summed.filter("k <> 3"), whole, "k").filter("not same").collect()
    assert [tuple(r) for r in lacking] == [(3, 0, 400, False)]


# Months

WINDOWS = [(date(2000, 10, 1), date(2000, 12, 31)), (date(2000, 10, 7), date(2000, 12, 24)),
           (date(2000, 11, 3), date(2000, 11, 3)), (date(2000, 12, 10), date(2001, 1, 31)),
           (date(1999, 5, 5), date(2001, 1, 5)), (date(2003, 1, 1), date(2003, 1, 31))]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    rows = random_rows(seed=31, users=120)
    store = UsageStore(spark, str(tmp_path_factory.mktemp("months")))
    half = len(rows["user_logs"]) // 2
    store.load("one", logs(spark, rows["user_logs"][:half]))
    store.load("two", logs(spark, rows["user_logs"][half:]))
    return rows, store


@pytest.mark.parametrize("window", WINDOWS)
def test_months_give_what_rows_give(spark, loaded, window):
    rows, store = loaded
    cfg = replace(CFG, win_start=window[0], win_end=window[1])
    direct = usage_by_user(logs(spark, rows["user_logs"]), cfg)
    assert same(monthly.usage_in_window(store.months(), cfg), direct)


@pytest.mark.parametrize("window", WINDOWS[:3])
def test_analyses_from_months(spark, loaded, window):
    rows, store = loaded
    cfg = replace(CFG, win_start=window[0], win_end=window[1])
    direct = tables(spark, **rows)
    t = MonthlyTables(lambda name: getattr(direct, name), store.months())
    for query in (features.user_features, usage.engagement_tiers):
        assert same(query(t, cfg), query(direct, cfg))
    assert same(features.user_features(prepare(spark, t, cfg), cfg), features.user_features(direct, cfg))


def test_a_window_reads_no_usage_row_and_few_day_lists(loaded):
    store = loaded[1]
    whole = plan_of(monthly.usage_in_window(store.months(), CFG))
    scans = [s for s in whole.splitlines() if "FileScan" in s]
    assert len(scans) == 1 and whole.count("Exchange") == 1
    assert "days#" not in scans[0] and "num_100" not in scans[0]
    cut = replace(CFG, win_start=date(2000, 10, 7))
    scans = [s for s in plan_of(monthly.usage_in_window(store.months(), cut)).splitlines() if "FileScan" in s]
    assert len(scans) == 2
    assert sum("days#" in s for s in scans) == 1
    assert all("PartitionFilters: [" in s and "month" in s for s in scans)


def test_a_hot_user_leaves_a_row_for_each_day(spark):
    hot = spark.range(20_000).selectExpr(
        "'hot' as msno", "date_add(date'2000-10-01', int(id % 60)) as date", "0 as num_25", "1 as num_50",
        "0 as num_75", "0 as num_985", "0 as num_100", "1 as num_unq", "double(id) / 7 as total_secs")
    months = monthly.usage_by_month(hot)
    assert sorted((r.month, len(r.days)) for r in months.select("month", "days").collect()) == [
        (date(2000, 10, 1), 31), (date(2000, 11, 1), 29)]
    merged = monthly.usage_in_window(months, CFG)
    assert same(merged, usage_by_user(hot, CFG))


def test_months_take_one_shuffle_by_ranges(spark):
    """The first sums of a task were as many as the rows of its piece of the table, in a hash table."""
    rows = random_rows(seed=8, users=60)["user_logs"]
    months = monthly.usage_by_month(logs(spark, [*rows, (None, *rows[0][1:])]), tasks=7)
    plan = plan_of(months)
    assert plan.count("Exchange") == 1 and "rangepartitioning(month" in plan and ", 7)" in plan
    assert same(months, monthly.usage_by_month(logs(spark, [*rows, (None, *rows[0][1:])])))
    for row in months.collect():
        assert [d.day for d in row.days] == sorted({d.day for d in row.days})
        assert row.log_rows == sum(d.log_rows for d in row.days)


def test_months_are_dealt_by_the_rows_they_have(spark, store, monkeypatch):
    seen = []
    plain = monthly.usage_by_month
    monkeypatch.setattr(monthly, "TASK_ROWS", 2)
    monkeypatch.setattr(monthly, "usage_by_month", lambda logs, tasks: seen.append(tasks) or plain(logs, tasks))
    store.load("full", logs(spark, JAN + FEB + MAR))
    store.load("more", logs(spark, [*MAR, *MAR]))
    store.load("full", logs(spark, []))
    assert seen == [3, 2, 1]
    assert same(store.usage().drop("month"), logs(spark, [*MAR, *MAR])) and store.months().count() == 1


def test_deliveries_are_stored_and_windows_share_what_they_can(spark, small, monkeypatch):
    from retention_spark import catalog
    from retention_spark.operators.blocks import latest_as_of
    plans, load = [], UsageStore.load
    monkeypatch.setattr(UsageStore, "load", lambda self, name, rows: plans.append(plan_of(rows)) or load(self, name, rows))
    t, windows = catalog._monthly(spark, small)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
    for _, cfg in windows:
        plan = plan_of(catalog.latest_payments(t, cfg))
        assert "Window" not in plan and "Exchange" not in plan
    direct = catalog._tables(spark, small)
    assert same(t.latest[CFG.cut], latest_as_of(direct.transactions, CFG.cut))
    other = replace(CFG, cut=date(2000, 6, 30))
    assert same(catalog.latest_payments(t, other), latest_as_of(direct.transactions, other.cut))
    # Windows come one by one: the union reads files alone.
    plan = plan_of(catalog.QUERIES["b4_active_days_by_months"](spark, small))
    assert plan.count("FileScan") == len(windows) and "Join" not in plan


# Snapshots at many dates

def test_snapshots_at_many_dates(spark):
    from retention_spark.operators.blocks import latest_as_of, latest_at_each
    payments = tables(spark, **random_rows(seed=5, users=150)).transactions
    cuts = [date(2000, m, 15) for m in range(5, 13)] + [date(2001, 1, 31), date(2000, 12, 1)]
    got = latest_at_each(payments, cuts)
    for cut in cuts:
        assert same(got.filter(F.col("cut") == F.lit(cut)).drop("cut"), latest_as_of(payments, cut))
    plan = plan_of(got)
    assert plan.count("Exchange") == 1 and "partial_max" in plan
    with pytest.raises(ValueError, match="no cut date"):
        latest_at_each(payments, [])


def test_snapshots_equal_the_single_query(spark, small):
    from retention_spark.catalog import _tables
    from retention_spark.operators.blocks import latest_at_each
    t = _tables(spark, small)
    assert same(latest_at_each(t.transactions, [CFG.cut]).drop("cut"), TABLE_QUERIES["b1_latest_as_of"](t))
