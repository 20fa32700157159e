"""The two per-user reductions every analysis starts from, computed in place or stored once.

Each audit and analysis reduces payments to the latest one and usage to one row per user. A single
query does that on the fly. A full report runs some thirty queries, and reading all usage
for each of them is the whole cost; `prepare` reads it once and stores the reductions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..operators.blocks import USER, exposure, latest_as_of, usage_by_user
from ..operators.monthly import usage_in_window
from ..session import scratch_path
from ..sources.tables import Tables


class PreparedTables(Tables):
    """Cleaned tables together with the stored reductions of one configuration."""

    def __init__(self, load: Callable[[str], DataFrame], cfg: AnalysisConfig,
                 latest: DataFrame, usage: DataFrame):
        super().__init__(load)
        self.cfg, self.latest, self.usage = cfg, latest, usage

    def check(self, cfg: AnalysisConfig) -> None:
        mine, other = ((c.cut, c.win_start, c.win_end) for c in (self.cfg, cfg))
        if mine != other:
            raise ValueError(f"prepared for {mine}, asked for {other}")


class MonthlyTables(Tables):
    """Cleaned tables together with usage per user and month: any window is merged from its months,
    and no usage row is read. Windows of one cut can share its stored latest payments, `latest` by cut."""

    def __init__(self, load: Callable[[str], DataFrame], months: DataFrame,
                 latest: Mapping[date, DataFrame] | None = None):
        super().__init__(load)
        self.months, self.latest = months, latest or {}


def prepare(spark: SparkSession, t: Tables, cfg: AnalysisConfig,
            path: str | None = None, buckets: int | None = None) -> PreparedTables:
    """Store both reductions as Parquet and return tables that read them.

    With `buckets`, cohort and members are stored too, and all four as external tables bucketed and
    sorted by user: every join of the report then finds its rows in place and shuffles nothing.
    Choose the number so that one bucket of the usage table fits a task. Written tables rather than
    cached ones: they outlive lost executors and, as files, the session.
    """
    path = path or scratch_path(spark, "prepared")
    run = uuid.uuid4().hex

    def store(name: str, df: DataFrame) -> DataFrame:
        if not buckets:
            df.write.parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")
        table = f"prepared_{run}_{name}"
        (
            # The bucket function is the shuffle's, so each task writes the file of one bucket.
            df.repartition(buckets, USER)
            .write.bucketBy(buckets, USER).sortBy(USER)
            .option("path", f"{path}/{name}").format("parquet").saveAsTable(table)
        )
        return spark.table(table)

    latest = store("latest", latest_as_of(t.transactions, cfg.cut))
    usage = store("usage", user_usage(t, cfg))
    both = ("train", "members") if buckets else ()
    kept = {name: store(name, getattr(t, name)) for name in both}
    return PreparedTables(lambda name: kept[name] if name in kept else getattr(t, name), cfg, latest, usage)


def latest_payments(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """One row per user: the most recent payment up to the cut."""
    if isinstance(t, PreparedTables):
        t.check(cfg)
        return t.latest
    if isinstance(t, MonthlyTables) and cfg.cut in t.latest:
        return t.latest[cfg.cut]
    return latest_as_of(t.transactions, cfg.cut)


def paying_users(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Users with a payment up to the cut; no payment has to be ranked to know them."""
    if isinstance(t, PreparedTables):
        return latest_payments(t, cfg).select(USER)
    return t.transactions.filter(F.col("transaction_date") <= F.lit(cfg.cut)).select(
        USER).distinct()


def user_usage(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """One row per user with usage in the window."""
    if isinstance(t, PreparedTables):
        t.check(cfg)
        return t.usage
    if isinstance(t, MonthlyTables):
        return usage_in_window(t.months, cfg)
    return usage_by_user(t.user_logs, cfg)


def exposed_cohort(t: Tables, cfg: AnalysisConfig) -> DataFrame:
    """Latest payment with its exposure interval, for users with a member row."""
    return exposure(latest_payments(t, cfg), t.members, cfg)
