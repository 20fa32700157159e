"""Totals that must agree between results: every user is accounted for, on every way they are counted."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EQUAL, AT_LEAST = "=", ">="
#: The results that the rules compare.
COMPARED = ("member_coverage", "coverage_status", "analysable_status", "rate_sanity", "active_rate_by_label",
            "engagement_tiers", "renewal_churn", "plan_type_churn", "silent_renewal_churn",
            "listener_renewal_churn", "plan_length_all_txn", "non_monthly_auto_total")


def _total(df: DataFrame, column: str = "users", where: Column | None = None) -> DataFrame:
    df = df if where is None else df.filter(where)
    return df.agg(F.coalesce(F.sum(F.col(column).cast("bigint")), F.lit(0)).alias("users"))


def population_checks(results: Mapping[str, DataFrame], features: DataFrame) -> DataFrame:
    """One row per rule: rule, left_users, relation, right_users, holds.

    `results` are results of `report.audits` and `report.analyses` by name, each a few rows; `features` is the
    feature table. Both are best stored (see `stored`): a result in several rules is computed for each, and all
    of their broadcasts are held by the driver at once.
    """
    status = results["coverage_status"]
    analysable = results["analysable_status"]
    cohort = _total(results["member_coverage"], "in_train")
    paying = _total(status, where=F.col("status").isin("has both", "missing member row"))
    kept = _total(analysable, where=F.col("status") == "kept")
    exposed = _total(analysable, where=~F.col("status").startswith("dropped: no"))
    renewals = _total(results["renewal_churn"])
    rows = features.agg(F.count(F.lit(1)).alias("users"),
                        F.count_if(F.col("active_days") == 0).alias("inactive"))
    others = F.col("payment_plan_days") != 30
    rules: list[tuple[str, list[DataFrame], str, list[DataFrame]]] = [
        ("coverage statuses make up the cohort", [_total(status)], EQUAL, [cohort]),
        ("analysable statuses make up the cohort", [_total(analysable)], EQUAL, [cohort]),
        ("kept and expired users have both rows", [exposed], EQUAL,
         [_total(status, where=F.col("status") == "has both")]),
        ("kept users are in the feature table", [rows.select("users")], EQUAL, [kept]),
        ("kept users have a rate", [_total(results["rate_sanity"], "total")], EQUAL, [kept]),
        ("kept users are in the rates by label", [_total(results["active_rate_by_label"])], EQUAL, [kept]),
        ("kept users are in a tier", [_total(results["engagement_tiers"])], EQUAL, [kept]),
        ("paying users are in the renewal rates", [renewals], EQUAL, [paying]),
        ("paying users have a plan type", [_total(results["plan_type_churn"])], EQUAL, [paying]),
        ("paying users are silent or listen", [_total(results["silent_renewal_churn"]),
                                               _total(results["listener_renewal_churn"])], EQUAL, [paying]),
        ("other plans are in the total of other plans",
         [_total(results["plan_length_all_txn"], "txns", others)], EQUAL,
         [_total(results["non_monthly_auto_total"], "txns")]),
        ("dormant users include the inactive ones",
         [_total(results["engagement_tiers"], where=F.col("bucket") == "Dormant")], AT_LEAST,
         [rows.select(F.col("inactive").alias("users"))]),
    ]
    terms = [
        side.select(F.lit(rule).alias("rule"), F.lit(relation).alias("relation"),
                    *[F.when(F.lit(here), F.col("users")).alias(f"{name}_users")
                      for name, here in (("left", is_left), ("right", not is_left))])
        for rule, left, relation, right in rules
        for is_left, sides in ((True, left), (False, right)) for side in sides
    ]
    sums = reduce(DataFrame.unionByName, terms).groupBy("rule", "relation").agg(
        F.sum("left_users").alias("left_users"), F.sum("right_users").alias("right_users"))
    holds = F.when(F.col("relation") == EQUAL, F.col("left_users") == F.col("right_users")).otherwise(
        F.col("left_users") >= F.col("right_users"))
    return sums.withColumn("holds", holds)


def stored(results: Mapping[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The results written below `path` one after the other, so the driver holds the plan and broadcasts of one."""
    for name, df in results.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return {name: df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in results.items()}


def require_populations(checks: DataFrame) -> None:
    """Raises with the figures when a rule doesn't hold."""
    wrong = checks.filter("not holds").orderBy("rule").collect()
    if wrong:
        raise ValueError("users don't add up: " + "; ".join(
            f"{r.rule}: {r.left_users} {r.relation} {r.right_users}" for r in wrong))
