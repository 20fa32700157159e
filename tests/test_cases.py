"""Hand-made users, one per rule that is easy to get wrong."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retention_spark.config import AnalysisConfig
from retention_spark.operators import blocks
from retention_spark.plans import coverage, features, kpi, renewal, scenario, usage
from retention_spark.plans.prepare import exposed_cohort, prepare, user_usage
from retention_spark.sources.derived import CONFIG as CFG
from tests.rows import WIN_END, WIN_START, listen, member, payment, tables


def by_user(df):
    return {r.msno: r for r in df.collect()}


def users(spark, spec, **extra):
    """One cohort user per entry: (payment fields, member fields, usage rows)."""
    train, members, payments, logs = [], [], [], []
    for msno, (pay, who, rows) in spec.items():
        train.append((msno, 0))
        payments.append(payment(msno, **pay))
        members.append(member(msno, **who))
        logs += [listen(msno, **row) for row in rows]
    return tables(spark, train, members, payments, logs)


DAY = date(2000, 11, 5)


@pytest.fixture(scope="module")
def table(spark):
    return users(spark, {
        "expired before": ({"until": date(2000, 9, 30)}, {}, []),
        "one day": ({"until": WIN_START}, {}, [{"on": WIN_START, "n50": 1}]),
        "registered inside": ({}, {"registered": date(2000, 10, 11)}, []),
        "unknown dates": ({"until": None}, {"registered": None}, []),
        "silent": ({}, {}, []),
        "skips only": ({}, {}, [{"on": DAY, "n25": 3, "secs": 90.0}]),
        "two rows a day": ({}, {}, [{"on": DAY, "n100": 2, "secs": 120.0},
                                    {"on": DAY, "n25": 1, "secs": 30.0}]),
        "after expiry": ({"until": WIN_START, "cancel": 1}, {},
                         [{"on": DAY, "n50": 1}, {"on": WIN_END, "n50": 1}]),
        "unknown counter": ({}, {}, [{"on": DAY, "n50": None, "n100": 4, "n25": 2},
                                     {"on": WIN_END, "n75": 1, "n25": 1}]),
        "outside window": ({}, {}, [{"on": date(2000, 9, 30), "n50": 1},
                                    {"on": date(2001, 1, 1), "n50": 1}]),
        "tie in minutes": ({}, {}, [{"on": DAY, "n50": 1, "secs": 60.30}]),
    })


def test_features(table):
    got = by_user(features.user_features(table, CFG))
    assert "expired before" not in got
    assert got["one day"].possible_exposure_days == 1
    assert got["one day"].active_day_rate == 1
    assert got["registered inside"].possible_exposure_days == 82
    assert got["unknown dates"].possible_exposure_days == 92

    silent = got["silent"]
    assert (silent.active_days, silent.total_listen_mins, silent.total_songs) == (0, None, None)
    assert (silent.mins_per_active_day, silent.skip_rate) == (0, 0)
    assert got["outside window"][7:] == silent[7:]

    skips = got["skips only"]
    assert (skips.active_days, skips.total_songs, skips.skip_rate) == (0, 3, 100)
    assert (skips.total_listen_mins, skips.mins_per_active_day) == (Decimal("1.50"), 0)

    two = got["two rows a day"]
    assert (two.active_days, two.total_listen_mins) == (1, Decimal("2.50"))
    assert (two.total_songs, two.skipped_songs, two.skip_rate) == (3, 1, Decimal("33.33"))

    assert (got["after expiry"].active_days, got["after expiry"].active_day_rate) == (2, 2)
    part = got["unknown counter"]
    assert (part.active_days, part.total_songs, part.skipped_songs) == (1, 2, 3)
    # 60.30 s are exactly 1.005 minutes; as a double that lies below the tie.
    assert got["tie in minutes"].total_listen_mins == Decimal("1.01")


def test_tiers_count_only_days_of_the_own_interval(table):
    days = by_user(blocks.active_days_clipped(
        table.train, exposed_cohort(table, CFG), user_usage(table, CFG), CFG))
    assert days["after expiry"].active_days == 0
    assert days["two rows a day"].active_days == 1
    tiers = {r.bucket: r.users for r in usage.engagement_tiers(table, CFG).collect()}
    assert tiers == {"Dormant": 6, "Light User": 3, "Regular": 1}


def test_intensity_counts_active_rows_not_active_days(spark):
    t = users(spark, {"a": ({}, {}, [{"on": DAY, "n100": 2, "secs": 120.0},
                                     {"on": DAY, "n25": 1, "secs": 30.0}])})
    row = usage.listening_intensity_by_label(t, CFG).first()
    assert (row.users, row.avg_mins_per_active_day, row.median_mins_per_active_day) == (1, 2, 2)


def test_rates_above_one_are_reported_and_explained(table):
    assert tuple(coverage.rate_sanity(table, CFG).first()) == (10, 1, 2)
    assert tuple(coverage.rate_sanity_diagnosis(table, CFG).first()) == (1, 1, 1)


def test_three_meanings_of_not_listening(table):
    silent = set(by_user(blocks.silent(table.train, user_usage(table, CFG))))
    assert silent == {"expired before", "registered inside", "unknown dates", "silent",
                      "outside window"}
    inactive = kpi.features_silent_renewal(features.user_features(table, CFG)).first()
    assert inactive.users == 5  # the silent users with exposure, and the one who only skipped


TIED = [payment("a", on=DAY, auto=0, until=date(2000, 12, 1)),
        payment("a", on=DAY, auto=1, until=date(2000, 12, 2)),
        payment("a", on=date(2000, 1, 1), auto=0),
        payment("b", on=DAY, plan=None), payment("b", on=DAY, plan=30),
        payment("c", on=DAY), payment("c", on=DAY),
        payment("d", on=DAY, method=None), payment("d", on=DAY, method=None),
        payment("e", on=date(2001, 1, 1)), payment("f", on=None)]


@pytest.mark.parametrize("parts", [1, 3, 8])
@pytest.mark.parametrize("flip", [False, True])
def test_latest_payment_does_not_depend_on_row_order(spark, parts, flip):
    rows = TIED[::-1] if flip else TIED
    t = tables(spark, transactions=rows).transactions.repartition(parts)
    got = by_user(blocks.latest_as_of(t, CFG.cut))
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"].is_auto_renew == 1 and got["b"].payment_plan_days == 30


def test_ties_that_matter_are_reported(spark):
    got = by_user(blocks.tie_report(tables(spark, transactions=TIED).transactions, CFG.cut))
    assert {u: r.payments for u, r in got.items()} == {"a": 2, "b": 2}


def test_old_payments_still_count(spark):
    t = users(spark, {"a": ({"on": date(1999, 1, 1), "until": date(2001, 1, 1)}, {}, [])})
    assert features.user_features(t, CFG).count() == 1


def test_repeated_cohort_rows_do_not_distort_usage_coverage(spark):
    t = tables(spark, train=[("a", 0), ("a", 0), ("b", 1)],
               user_logs=[listen("b", DAY)] * 3)
    assert tuple(coverage.usage_coverage(t, CFG).first()) == (2, 2, 1)


def scenario_users(spark):
    spec = [("a", 1, 410, 4100), ("b", 1, 180, 900), ("c", 0, 90, 450), ("d", 1, 31, 62),
            ("e", 1, 30, 149), ("f", 1, None, 149)]
    return tables(spark, train=[(u, churn) for u, churn, _, _ in spec],
                  members=[member(u) for u, *_ in spec],
                  transactions=[payment(u, plan=plan, paid=paid) for u, _, plan, paid in spec])


def test_scenario_total_is_rounded_after_adding(spark):
    t = scenario_users(spark)
    rows = {r.plan_type: r for r in scenario.retention_scenario(t, CFG).collect()}
    assert set(rows) == {"Quarterly", "Long-term", "TOTAL"}

    def annual(paid, days):
        return paid / 30 * 365 / days

    revenue = {"Quarterly": (annual(450, 90) + annual(62, 31)) / 2,
               "Long-term": (annual(4100, 410) + annual(900, 180)) / 2}
    kept = {"Quarterly": 1 - 2 * 0.0383, "Long-term": 2 - 2 * 0.0383}
    for plan, per_user in revenue.items():
        assert float(rows[plan].annual_revenue_per_user_usd) == pytest.approx(per_user, abs=0.0051)
        assert rows[plan].annual_revenue_optimistic_usd == round(kept[plan] * per_user)
    total = rows["TOTAL"]
    assert (total.users, total.annual_revenue_per_user_usd) == (4, None)
    assert total.annual_revenue_optimistic_usd == round(
        sum(kept[p] * revenue[p] for p in revenue))


def test_scenario_without_longer_plans_has_only_an_empty_total(spark):
    t = tables(spark, train=[("a", 1)], transactions=[payment("a", plan=30)])
    rows = scenario.retention_scenario(t, CFG).collect()
    assert [(r.plan_type, r.users) for r in rows] == [("TOTAL", None)]


def test_target_rates_can_be_measured(spark):
    t = tables(spark, train=[(f"u{i}", int(i < 2)) for i in range(9)], transactions=[
        payment(f"u{i}", plan=30, auto=int(i % 2 == 0)) for i in range(6)] + [
        payment("u6", plan=90), payment("u7", plan=7, auto=1)])
    found = scenario.observed_rates(t, CFG)
    assert (found.optimistic_rate, found.conservative_rate) == (
        Decimal("0.3333"), Decimal("0.3333"))
    without_auto = tables(spark, train=[("a", 1)], transactions=[payment("a", plan=30)])
    found = scenario.observed_rates(without_auto, CFG)
    assert (found.optimistic_rate, found.conservative_rate) == (CFG.optimistic_rate, 1)


def test_revenue_today_counts_those_who_stayed(spark):
    table = features.user_features(scenario_users(spark), CFG)
    rows = {r.plan_type: r for r in kpi.features_revenue(table, CFG).collect()}
    assert rows["Quarterly"].revenue_today_usd == round(450 / 30 * 365 / 90)
    assert rows["Long-term"].revenue_today_usd == 0


def test_conversion_needs_a_later_day(spark):
    early, late = date(2000, 5, 1), date(2000, 6, 1)
    t = tables(spark, transactions=[
        payment("switched", on=early, auto=0), payment("switched", on=late, auto=1),
        payment("went back", on=early, auto=1), payment("went back", on=late, auto=0),
        payment("same day", on=late, auto=0), payment("same day", on=late, auto=1),
        payment("always auto", on=early, auto=1), payment("other plan", on=early, plan=90),
        payment("too late", on=early), payment("too late", on=date(2001, 2, 1), auto=1)])
    assert tuple(kpi.kpi_manual_to_auto(t, CFG).first()) == (4, 1, Decimal("25.00"))


def test_arms_are_compared(spark):
    rows = [("test", 1), ("test", 0), ("test", 0), ("control", 1), ("control", 0), (None, 1)]
    df = spark.createDataFrame(rows, "arm string, is_churn int")
    assert tuple(kpi.test_vs_control_rate(df, "arm").first()) == (
        3, Decimal("33.33"), 2, Decimal("50.00"), Decimal("16.67"))


def test_long_plan_adoption_ignores_other_lengths(spark):
    t = tables(spark, train=[("a", 0), ("b", 0), ("c", 0)],
               transactions=[payment("a", plan=360, auto=1), payment("b", plan=45),
                             payment("c", plan=360, auto=1), payment("x", plan=90, auto=1)])
    assert tuple(kpi.kpi_adoption(t, CFG).first()) == (3, Decimal("66.67"))
    all_payments = renewal.plan_length_all_txn(t, CFG).select(
        "payment_plan_days", "txns", "auto_renew_txns").collect()
    assert [tuple(r) for r in all_payments] == [(90, 1, 1), (360, 2, 2)]
    assert tuple(renewal.non_monthly_auto_total(t, CFG).first()) == (3, 3)


def test_zero_day_plans_are_kept(spark):
    t = users(spark, {"a": ({"plan": 0}, {}, [])})
    row = features.user_features(t, CFG).first()
    assert row.payment_plan_days == 0
    assert renewal.plan_type_churn(t, CFG).select(F.col("plan_type")).first()[0] == "Trial"


@pytest.mark.parametrize("buckets", [None, 3])
def test_prepared_tables_give_the_same_features(spark, table, buckets):
    stored = prepare(spark, table, CFG, buckets=buckets)
    wanted = sorted(map(str, features.user_features(table, CFG).collect()))
    assert sorted(map(str, features.user_features(stored, CFG).collect())) == wanted
    with pytest.raises(ValueError, match="prepared for"):
        features.user_features(stored, AnalysisConfig())
