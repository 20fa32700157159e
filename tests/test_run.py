"""From raw files to every result."""

from __future__ import annotations

import csv
from datetime import date, datetime, timezone

import pytest

from retention_spark.catalog import TABLE_QUERIES
from retention_spark.run import run
from retention_spark.sources.derived import CONFIG as CFG
from retention_spark.sources.schemas import DATE_COLUMNS, RAW
from retention_spark.sources.usage_store import UsageStore
from tests.rows import random_rows, tables


def delivered(table: str, column: str, value):
    """A cleaned value as the raw file holds it."""
    if value is None:
        return ""
    if column in DATE_COLUMNS[table]:
        if table == "members":
            midnight = datetime(value.year, value.month, value.day, tzinfo=timezone.utc)
            return int(midnight.timestamp() * 1000)
        return f"{value:%Y%m%d}"
    return value


def write_csv(path, table, rows) -> str:
    names = RAW[table].fieldNames()
    with open(path, "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(names)
        out.writerows([delivered(table, n, v) for n, v in zip(names, r)] for r in rows)
    return str(path)


SAME = {
    "u1_user_features": "features",
    "q3_analysable_status": "results/analysable_status",
    "a13b_engagement_tiers": "results/engagement_tiers",
    "r8_features_plan_churn": "results/features_plan_churn",
}


def test_run(spark, tmp_path):
    rows = random_rows(seed=21, users=80)
    for name in ("train", "members", "transactions"):
        write_csv(tmp_path / f"{name}.csv", name, rows[name])
    logs, split = rows["user_logs"], date(2000, 12, 1)
    parts = [[r for r in logs if (r[1] or split) < split],
             [r for r in logs if (r[1] or split) >= split]]
    files = [write_csv(tmp_path / f"usage{i}.csv", "user_logs", p) for i, p in enumerate(parts)]
    out = str(tmp_path / "out")
    run(spark, str(tmp_path), files, out, CFG, buckets=3)

    t = tables(spark, **rows)
    for name, path in SAME.items():
        stored, wanted = spark.read.parquet(f"{out}/{path}"), TABLE_QUERIES[name](t)
        as_wanted = stored.select([stored[c].cast(kind).alias(c) for c, kind in wanted.dtypes])
        assert sorted(map(str, as_wanted.collect())) == sorted(map(str, wanted.collect()))
    assert UsageStore(spark, f"{out}/usage").usage().count() == len(logs)
    results = {p.name for p in (tmp_path / "out" / "results").iterdir()}
    assert {"user_logs_rejects", "usage_increment_1", "usage_rows", "train_schema",
            "test_vs_control_rate", "user_logs_usage1_rejects", "population_checks"} <= results
    assert len(results) == 70
    assert spark.read.parquet(f"{out}/results/user_logs_rejects").first().total == len(logs)
    checks = spark.read.parquet(f"{out}/results/population_checks").collect()
    assert len(checks) == 12 and all(r.holds for r in checks)


def test_next_month_names_only_the_new_file(spark, tmp_path):
    """Two runs on one store give what one run of both files gives; a third with the same file
    changes nothing."""
    rows = random_rows(seed=22, users=40)
    for name in ("train", "members", "transactions"):
        write_csv(tmp_path / f"{name}.csv", name, rows[name])
    logs, split = rows["user_logs"], date(2000, 12, 1)
    parts = [[r for r in logs if (r[1] or split) < split],
             [r for r in logs if (r[1] or split) >= split]]
    files = [write_csv(tmp_path / f"usage{i}.csv", "user_logs", p) for i, p in enumerate(parts)]
    store = str(tmp_path / "store")
    run(spark, str(tmp_path), files[:1], str(tmp_path / "out1"), CFG, store=store)
    run(spark, str(tmp_path), files[1:], str(tmp_path / "out2"), CFG, store=store)
    wanted = TABLE_QUERIES["u1_user_features"](tables(spark, **rows))
    def shown(out):
        stored = spark.read.parquet(f"{tmp_path}/{out}/features")
        return sorted(map(str, stored.select(
            [stored[c].cast(kind).alias(c) for c, kind in wanted.dtypes]).collect()))
    assert shown("out2") == sorted(map(str, wanted.collect()))
    entry = UsageStore(spark, store).last_entry()
    run(spark, str(tmp_path), files[1:], str(tmp_path / "out3"), CFG, store=store)
    assert shown("out3") == shown("out2") and UsageStore(spark, store).last_entry() == entry


def test_too_many_bad_lines_stop_the_run(spark, tmp_path):
    rows = random_rows(seed=3, users=20)
    for name in ("train", "members", "transactions"):
        write_csv(tmp_path / f"{name}.csv", name, rows[name])
    usage = write_csv(tmp_path / "usage.csv", "user_logs", rows["user_logs"])
    with open(tmp_path / "train.csv", "a") as file:
        file.write("half a line\nuser1,yes\n")
    with pytest.raises(ValueError, match=r"train: 2 of \d+ lines rejected, most in .*train.csv: 2 \(line\)"):
        run(spark, str(tmp_path), [usage], str(tmp_path / "out"), CFG)
    run(spark, str(tmp_path), [usage], str(tmp_path / "out2"), CFG, most_rejected=0.5)
    found = spark.read.parquet(f"{tmp_path}/out2/results/train_rejects").collect()
    assert sorted(r.reject_text for r in found) == ["half a line", "user1,yes"]


def test_users_listed_twice_are_refused(spark, tmp_path):
    rows = random_rows(seed=3, users=20)
    rows["train"].append(rows["train"][0])
    for name in ("train", "members", "transactions"):
        write_csv(tmp_path / f"{name}.csv", name, rows[name])
    usage = write_csv(tmp_path / "usage.csv", "user_logs", rows["user_logs"])
    with pytest.raises(ValueError, match="train needs one row per user"):
        run(spark, str(tmp_path), [usage], str(tmp_path / "out"), CFG)
