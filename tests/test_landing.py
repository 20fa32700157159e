"""Deliveries with faults: what fits is read, what doesn't is kept as it came."""

from __future__ import annotations

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from retention_spark.sources.derived import StarSchema
from retention_spark.sources.landing import FILE, REASON, TEXT, land, read_delivery
from retention_spark.sources.schemas import RAW
from tests.test_plans import plan_of

HEAD = "msno,city,bd,gender,registered_via,registration_init_time\n"


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, newline="", encoding="utf-8")
    return str(folder)


def split(df):
    rows = sorted(map(tuple, df.filter(f"{REASON} is null").drop(FILE, TEXT, REASON).collect()), key=str)
    rejects = sorted((r[FILE].rpartition("/")[2], r[TEXT], r[REASON])
                     for r in df.filter(f"{REASON} is not null").collect())
    return rows, rejects


def test_good_and_bad_lines(spark, tmp_path):
    write(tmp_path, a=HEAD + 'a,1,30,male,7,1315695600000\nb,x,30,male,7,1\n"c,""q""",,,,9,\n'
                      "short,1\nlong,1,2,male,3,4,5\n\nd,1.5,2,male,3,4\n,2,,,,\n")
    rows, rejects = split(read_delivery(spark, str(tmp_path / "a.csv"), "members"))
    assert rows == [("a", 1, 30, "male", 7, 1315695600000), ('c,"q"', None, None, "", 9, None),
                    (None, 2, None, "", None, None)]
    assert rejects == [("a.csv", text, "line") for text in (
        "b,x,30,male,7,1", "d,1.5,2,male,3,4", "long,1,2,male,3,4,5", "short,1")]


def test_columns_are_found_by_name(spark, tmp_path):
    write(tmp_path, a="msno,is_churn\na,1\n", b="is_churn,extra,msno\n0,'x',b\n1,,c\n",
          c="﻿msno, is_churn\r\nd,0\r\n", d="msno\ne\n", e="msno,is_churn,msno\nf,1,g\n", f="", g="msno,is_churn\n")
    rows, rejects = split(read_delivery(spark, str(tmp_path), "train"))
    assert rows == [("a", 1), ("b", 0), ("c", 1), ("d", 0)]
    assert rejects == [("d.csv", "e", "header"), ("d.csv", "msno", "header"),
                       ("e.csv", "f,1,g", "header"), ("e.csv", "msno,is_churn,msno", "header")]


def test_line_breaks_in_quotes(spark, tmp_path):
    write(tmp_path, a='msno,is_churn\n"a\nb",1\nc,0\n')
    assert split(read_delivery(spark, str(tmp_path), "train", line_breaks=True)) == (
        [("a\nb", 1), ("c", 0)], [])
    # Without the switch nothing is read wrongly: both halves are rejected, though the second has all fields.
    rows, rejects = split(read_delivery(spark, str(tmp_path), "train"))
    assert rows == [("c", 0)] and [r[1] for r in rejects] == ['"a', 'b",1']


def test_no_files_with_lines(spark, tmp_path):
    write(tmp_path, a="", b="\n")
    for paths in (str(tmp_path / "a.csv"), str(tmp_path)):
        df = read_delivery(spark, paths, "train")
        assert df.columns == [*RAW["train"].fieldNames(), FILE, TEXT, REASON] and df.count() <= 1


def test_names_with_blanks(spark, tmp_path):
    (tmp_path / "march 2017 +%").mkdir()
    write(tmp_path / "march 2017 +%", **{"a b": "msno,is_churn\na,1\nb\n"})
    rows, rejects = split(read_delivery(spark, str(tmp_path / "march 2017 +%"), "train"))
    assert rows == [("a", 1)] and len(rejects) == 1


def test_compressed_files(spark, tmp_path):
    import gzip
    with gzip.open(tmp_path / "a.csv.gz", "wt") as file:
        file.write("is_churn,msno\n1,a\n0,b\nx,c\n")
    rows, rejects = split(read_delivery(spark, str(tmp_path / "a.csv.gz"), "train"))
    assert rows == [("a", 1), ("b", 0)] and [r[1] for r in rejects] == ["x,c"]


def test_many_files_need_no_job_each(spark, tmp_path):
    for i in range(300):
        write(tmp_path, **{f"f{i}": f"msno,is_churn\nu{i},{i % 2}\n"})
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers of many files")
    try:
        delivery = read_delivery(spark, str(tmp_path), "train")
        assert len(jobs.getJobIdsForGroup("headers")) < 5
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert delivery.count() == 300


def test_landing_splits_and_counts(spark, tmp_path):
    write(tmp_path, a="msno,is_churn\n" + "".join(f"u{i},{i % 2}\n" for i in range(98)) + "x\ny,z\n")
    found = land(read_delivery(spark, str(tmp_path / "a.csv"), "train"), str(tmp_path / "out"), "train")
    assert found.rejected_share() == (2, 100)
    assert found.rows.columns == RAW["train"].fieldNames() and found.rejects.columns == [FILE, TEXT, REASON]
    found.require_few_rejects(0.02)
    with pytest.raises(ValueError, match=r"train: 2 of 100 lines rejected, most in file:.*a.csv: 2 \(line\)"):
        found.require_few_rejects(0.019)
    # Rows and rejects lie apart: neither's reader opens the other's files.
    assert "PartitionFilters: [isnotnull(rejected" in plan_of(found.rows)
    assert all("rejected=true" in f for f in found.rejects.inputFiles()) or found.rejects.count() == 2


def test_landing_reads_the_files_once(spark, tmp_path):
    write(tmp_path, a="msno,is_churn\na,1\nb\n")
    delivery = read_delivery(spark, str(tmp_path / "a.csv"), "train")
    assert plan_of(delivery).count("FileScan") == 1


@pytest.mark.parametrize("table", list(RAW))
def test_no_row_of_a_delivery_is_lost(spark, small, tmp_path, table):
    star = StarSchema(spark, small)
    star.deliver(table, f"{tmp_path}/files")
    raw = star.raw(table)
    plain = [f"{tmp_path}/files/{p}" for p in ("plain", "reordered", "damaged", "headless")]
    df = read_delivery(spark, plain, table).unionByName(
        read_delivery(spark, f"{tmp_path}/files/quoted", table, line_breaks=True))
    found = land(df, f"{tmp_path}/landed", table)
    header = ",".join(raw.columns[:-1])
    assert found.rows.count() + found.rejects.filter(f"{TEXT} <> '{header}'").count() == raw.count()
    assert {r[0] for r in found.rejects.select(REASON).distinct().collect()} == {"line", "header"}


def test_a_delivery_runs_its_joins_once(spark, small, tmp_path, monkeypatch):
    """Each kind of file joined all line items to their orders again."""
    star, plans, lines = StarSchema(spark, small), [], DataFrameWriter.csv
    monkeypatch.setattr(DataFrameWriter, "csv", lambda self, *args, **options: plans.append(
        plan_of(self._df)) or lines(self, *args, **options))
    star.deliver("user_logs", f"{tmp_path}/files")
    assert len(plans) == 5 and not any("Join" in plan for plan in plans)
    assert all(plan.count("FileScan parquet") == 1 for plan in plans)
