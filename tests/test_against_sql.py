"""Every query on the generated tables against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from retention_spark.catalog import QUERIES
from tools.compare import connect, differences


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.oracle_sql())


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, con, name):
    got = contract.queries()[name](spark, small)
    assert differences(got, con.sql(contract.oracle_sql()[name])) == []


def test_entry_is_the_feature_table(spark, small):
    assert contract.entry(spark).columns[:2] == ["msno", "is_churn"]
    assert contract.entry(spark).count() > 0


FINDINGS = {
    "p1_null_audit": "msno_nulls > 0 and membership_expire_date_nulls > 0",
    "p8_month_gaps": "month = date '1997-03-01'",
    "p8_month_coverage": "months_missing = 1",
    "p14_null_vs_blank": "true_null > 0 and empty_string > 0",
    "p19_key_check": "null_keys > 0 or repeated_keys > 0",
    "c1_rejected_dates": "membership_expire_date_rejected > 0",
    "c7_rejected_seconds": "total_secs_rejected > 0",
    "a25c_auto_renew_on_longer_plans": "auto_renew_txns > 0",
    "r11_kpi_adoption_with_renewals": "pct_auto_renew > 0",
}


@pytest.mark.parametrize("name", FINDINGS)
def test_checks_have_something_to_find(spark, small, name):
    found = QUERIES[name](spark, small)
    assert found.count() == found.filter(FINDINGS[name]).count() > 0


def test_no_row_of_the_given_tables_is_left_out(spark, small):
    size = {t: spark.read.parquet(f"{small}/{t}.parquet").count()
            for t in ("customer", "part", "supplier", "orders", "lineitem", "events")}
    rows = {n: QUERIES[n](spark, small).count()
            for n in ("s2_read_members", "s3_read_transactions", "s4_read_user_logs")}
    assert rows == {
        "s2_read_members": size["customer"] + size["part"],
        "s3_read_transactions": size["orders"] + size["supplier"],
        "s4_read_user_logs": size["lineitem"] + size["events"],
    }
