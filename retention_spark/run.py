"""Raw files to cleaned tables, feature table and every result, for spark-submit.

    spark-submit --py-files retention_spark.zip retention_spark/run.py \\
        --raw RAW --usage LOGS [LOGS ...] --tz ZONE --out OUT [--store STORE]

RAW holds train, members and transactions, each a file or folder of that name. Every file is landed
first: lines that can't be read are set aside with their text, and the run stops where there are too many. Each
usage file (history, later increments) is a load of the usage store, by the file's name; with --store it outlives the
run, and the next month's run names only the new file. Results are written below OUT.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retention_spark.config import AnalysisConfig
from retention_spark.operators.blocks import USER
from retention_spark.operators.clean import clean_table
from retention_spark.operators.profile import key_check
from retention_spark.plans import report
from retention_spark.plans.features import user_features
from retention_spark.plans.population import population_checks, require_populations
from retention_spark.plans.prepare import MonthlyTables, prepare
from retention_spark.session import build_session
from retention_spark.sources import tables as io
from retention_spark.sources.landing import (
    FILE,
    REASON,
    TEXT,
    Landed,
    land,
    read_delivery,
    reject_values,
)
from retention_spark.sources.publish import PublishedTable
from retention_spark.sources.schemas import RAW
from retention_spark.sources.usage_store import UsageStore

AT_ONCE = 8
MOST_REJECTED = 0.01


def run(spark: SparkSession, raw: str, usage: Sequence[str], out: str, cfg: AnalysisConfig,
        fmt: str = "csv", buckets: int | None = None, store: str | None = None,
        most_rejected: float = MOST_REJECTED, line_breaks: bool = False,
        strict_values: bool = False, publish: str | None = None) -> None:
    """`most_rejected` is the share of a table's lines that may be rejected; `line_breaks` is
    for files whose quoted texts hold line breaks; with `strict_values`, rows with a day that doesn't exist or a
    reading that is no number are rejected, otherwise they lose the value and are counted. The feature table becomes
    the next version of the table at `publish`, once all checks have passed."""
    suffix = ".csv" if fmt == "csv" else ""

    def landed(path: str, name: str, table: str) -> Landed:
        df = (read_delivery(spark, path, table, line_breaks) if fmt == "csv"
              else _without_rejects(io.read_raw(spark, path, table, fmt)))
        df = reject_values(df, table) if strict_values else df
        found = land(df, f"{out}/landed/{name}", table)
        found.require_few_rejects(most_rejected)
        return found

    files = {name: landed(f"{raw}/{name}{suffix}", name, name) for name in RAW if name != "user_logs"}
    logs = {name: landed(path, f"user_logs/{name}", "user_logs") for name, path in load_names(usage).items()}

    kept = UsageStore(spark, store or f"{out}/usage")
    for name, found in logs.items():
        kept.load(name, clean_table(found.rows, "user_logs", cfg))
    kept.require_reconciled()
    for name, found in files.items():
        io.write_clean(clean_table(found.rows, name, cfg), f"{out}/clean/{name}", name)

    def stored(name: str) -> DataFrame:
        return kept.usage() if name == "user_logs" else io.read_clean(spark, f"{out}/clean/{name}", name)

    t = MonthlyTables(stored, kept.months())
    require_one_row_per_user(t)
    prepared = prepare(spark, t, cfg, f"{out}/prepared", buckets)
    io.write_features(user_features(prepared, cfg), f"{out}/features")
    features = spark.read.parquet(f"{out}/features")

    delivered = {name: found.rows for name, found in files.items()}
    arrived = [found.rows for found in logs.values()]
    delivered["user_logs"] = arrived[0]
    for rows in arrived[1:]:
        delivered["user_logs"] = io.union_usage(delivered["user_logs"], rows)
    later = [clean_table(rows, "user_logs", cfg) for rows in arrived[1:]]
    results = (
        {f"{name}_rejects": found.rejects for name, found in files.items()}
        | {f"user_logs_{name}_rejects": found.rejects for name, found in logs.items()}
        | {"usage_reconciled": kept.reconcile(), "usage_manifest": kept.manifest()}
        | report.increments(t.user_logs, later)
        | report.raw_profiles(delivered, cfg) | report.clean_profiles(t)
        | report.audits(prepared, cfg) | report.analyses(prepared, cfg)
        | report.figures(features, cfg)
    )
    _write_all(results, out)
    written = {name: spark.read.schema(df.schema).parquet(f"{out}/results/{name}")
               for name, df in results.items()}
    _write_all({"population_checks": population_checks(written, features)}, out)
    require_populations(spark.read.parquet(f"{out}/results/population_checks"))
    if publish:
        PublishedTable(spark, publish).publish(features)


def load_names(usage: Sequence[str]) -> dict[str, str]:
    """A load's name is its file's, without folder and ending; two files of one name are refused."""
    names = [path.rstrip("/").rpartition("/")[2].partition(".")[0] for path in usage]
    if len(set(names)) < len(names):
        raise ValueError(f"usage files need names of their own: {names}")
    return dict(zip(names, usage))


def _without_rejects(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.lit(None).cast("string") for name in (FILE, TEXT, REASON)})


def _write_all(results: dict[str, DataFrame], out: str) -> None:
    # Each result is a few small stages; side by side they keep the executors busy.
    with ThreadPoolExecutor(AT_ONCE) as pool:
        written = [
            pool.submit(df.write.parquet, f"{out}/results/{name}") for name, df in results.items()
        ]
        for job in written:
            job.result()


def require_one_row_per_user(t: io.Tables) -> None:
    """Every join counts a user listed twice twice, so such tables are refused with the figures."""
    for name in ("train", "members"):
        found = key_check(getattr(t, name), USER).first()
        if found.repeated_keys or found.null_keys:
            raise ValueError(f"{name} needs one row per user: {found.asDict()}")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--raw", required=True)
    parser.add_argument("--usage", required=True, nargs="+")
    parser.add_argument("--out", required=True)
    parser.add_argument("--format", default="csv", choices=("csv", "parquet"))
    parser.add_argument("--buckets", type=int)
    parser.add_argument("--tz", required=True)
    parser.add_argument("--store")
    parser.add_argument("--most-rejected", type=float, default=MOST_REJECTED)
    parser.add_argument("--line-breaks", action="store_true")
    parser.add_argument("--strict-values", action="store_true")
    parser.add_argument("--publish")
    for name in ("cut", "win-start", "win-end"):
        parser.add_argument(f"--{name}", type=date.fromisoformat)
    args = parser.parse_args()
    given = {name: getattr(args, name) for name in ("cut", "win_start", "win_end")}
    cfg = replace(AnalysisConfig(tz=args.tz), **{k: v for k, v in given.items() if v})
    spark = build_session("retention_spark", spark__sql__warehouse__dir=f"{args.out}/warehouse")
    run(spark, args.raw, args.usage, args.out, cfg, args.format, args.buckets, args.store,
        args.most_rejected, args.line_breaks, args.strict_values, args.publish)
    spark.stop()


if __name__ == "__main__":
    main()
