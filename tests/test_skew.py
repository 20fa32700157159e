"""One user with most rows: how many rows the shuffles carry."""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

import pytest

from retention_spark.operators import blocks
from retention_spark.operators.median import grouped_mean_median
from retention_spark.plans import kpi
from retention_spark.sources.derived import CONFIG as CFG
from retention_spark.sources.tables import Tables
from tests.rows import WIN_START, listen, payment, tables

TASKS, OTHERS, HOT_ROWS = 4, 100, 6000


def shuffled_rows(df) -> list[int]:
    """Rows written by each shuffle of the finished plan."""
    df.collect()
    found: list[int] = []

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ShuffleExchangeExec":
            found.append(node.metrics().get("shuffleRecordsWritten").get().value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    """The hot user is spread over all files, as in data stored by month."""
    days = [WIN_START + timedelta(days=i) for i in range(CFG.win_days)]
    logs = [listen("hot", days[i % 92], n100=i % 3) for i in range(HOT_ROWS)]
    logs += [listen(f"u{i}", days[i % 92], n50=1) for i in range(OTHERS)]
    paid = [payment("hot", on=days[i % 92], auto=i % 2, paid=i) for i in range(HOT_ROWS)]
    paid += [payment(f"u{i}") for i in range(OTHERS)]
    made = tables(spark, transactions=paid, user_logs=logs)
    folder = tmp_path_factory.mktemp("hot")
    for name in ("transactions", "user_logs"):
        getattr(made, name).repartition(TASKS).write.parquet(f"{folder}/{name}")
    return Tables(lambda name: spark.read.parquet(f"{folder}/{name}"))


def test_usage(t):
    df = blocks.usage_by_user(t.user_logs, CFG)
    hot = df.filter("msno = 'hot'").first()
    assert (hot.log_rows, hot.active_days) == (HOT_ROWS, 92)
    assert sum(shuffled_rows(df)) <= TASKS + OTHERS


def test_latest_payment(t):
    assert sum(shuffled_rows(blocks.latest_as_of(t.transactions, CFG.cut))) <= TASKS + OTHERS


def test_conversion(t):
    users, _ = sorted(shuffled_rows(kpi.kpi_manual_to_auto(t, CFG)), reverse=True)
    assert users <= TASKS + OTHERS


def test_tie_report(t):
    df = blocks.tie_report(t.transactions, CFG.cut)
    assert [r.msno for r in df.collect()] == ["hot"]
    # One row per user, day and task, then one per user and task of the ranking.
    assert max(shuffled_rows(df)) <= 92 * TASKS + OTHERS


def test_median_of_a_value_shared_by_most(spark):
    values = [Decimal(7)] * HOT_ROWS + [Decimal(i) for i in range(OTHERS)]
    df = spark.createDataFrame([(0, v) for v in values], "g int, v decimal(20,3)")
    result = grouped_mean_median(df.repartition(TASKS), ["g"], "v")
    assert result.first()["median"] == 7
    # Apart from the repartitioning above, which moves every row.
    assert max(n for n in shuffled_rows(result) if n != len(values)) <= TASKS * (OTHERS + 1)
