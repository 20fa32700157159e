"""Every operator as a named query over the derived tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date, timedelta
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .config import AnalysisConfig
from .functions.buckets import plan_type
from .functions.exact import percent
from .operators import blocks, clean, profile
from .operators.fingerprint import compared, fingerprint
from .operators.iceberg import frequent_groups
from .operators.single_pass import Profile, profiled
from .plans import coverage, features, kpi, renewal, report, scenario, usage
from .plans.population import COMPARED, population_checks, stored
from .plans.prepare import MonthlyTables, exposed_cohort, latest_payments, prepare, user_usage
from .session import scratch_path
from .sources import landing
from .sources import tables as io
from .sources.derived import CONFIG as CFG
from .sources.derived import StarSchema
from .sources.schemas import CLEAN, DATE_COLUMNS, RAW
from .sources.publish import PublishedTable
from .sources.usage_store import UsageStore

Query = Callable[[SparkSession, str], DataFrame]
TableQuery = Callable[[io.Tables], DataFrame]

# Every query by name, over a folder of generated tables.
QUERIES: dict[str, Query] = {}
# Those of them that start from the four cleaned tables, wherever these come from.
TABLE_QUERIES: dict[str, TableQuery] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Exact decimals leave the library as doubles."""
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df


@lru_cache(maxsize=4)
def _open(spark: SparkSession, folder: str) -> tuple[StarSchema, io.Tables]:
    """The tables of a folder, opened once per session: plans and file lists, no rows."""
    star = StarSchema(spark, folder)
    return star, io.Tables(star.clean)


def _star(spark: SparkSession, folder: str) -> StarSchema:
    return _open(spark, folder)[0]


def _tables(spark: SparkSession, folder: str) -> io.Tables:
    return _open(spark, folder)[1]


def _add(name: str, query: Query) -> None:
    QUERIES[name] = lambda spark, folder: _plain(query(spark, folder))


def _on_clean(name: str, query: TableQuery) -> None:
    TABLE_QUERIES[name] = lambda t: _plain(query(t))
    _add(name, lambda spark, folder: query(_tables(spark, folder)))


def _on_raw(name: str, table: str, query: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, lambda spark, folder: query(_star(spark, folder).raw(table)))


def _on_odd(name: str, table: str, query: Callable[[DataFrame], DataFrame],
            cleaned: bool = False) -> None:
    """A query whose finding the plain tables lack."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        star = _star(spark, folder)
        return query(star.odd_clean(table) if cleaned else star.odd(table))
    _add(name, run)


def _on_features(name: str, query: Callable[[DataFrame], DataFrame]) -> None:
    _on_clean(name, lambda t: query(features.user_features(t, CFG)))


# Sources and sinks

def _delivered(table: str) -> Query:
    """The raw table as lines of its CSV file, read under its declared schema."""
    return lambda spark, folder: io.from_lines(
        io.to_lines(_star(spark, folder).raw(table), table), table)


def _landed(table: str) -> Query:
    """The raw table delivered as CSV files, with faults, and landed: rows and rejects together."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, f"delivery-{table}")
        _star(spark, folder).deliver(table, f"{path}/files")
        plain = [f"{path}/files/{part}" for part in ("plain", "reordered", "damaged", "headless")]
        delivery = landing.read_delivery(spark, plain, table).unionByName(
            landing.read_delivery(spark, f"{path}/files/quoted", table, line_breaks=True))
        found = landing.land(delivery, f"{path}/landed", table)
        file = F.regexp_extract(landing.FILE, "/([^/]+)/[^/]+$", 1)
        # A headless file's header is a rejected line too; how many files there are depends on the cluster.
        lines = found.rejects.filter(F.col(landing.TEXT) != ",".join(RAW[table].fieldNames()[:-1]))
        return found.rows.withColumns({c: F.lit(None).cast("string") for c in (
            landing.FILE, landing.TEXT, landing.REASON)}).unionByName(
            lines.withColumn(landing.FILE, file), allowMissingColumns=True)
    return run


def _loaded(spark: SparkSession, folder: str) -> UsageStore:
    """A usage store with the history and the increment, the increment loaded twice. A load goes over its
    delivery more than once, so deliveries are files, as landed ones are, not joins of the star schema."""
    star, path = _star(spark, folder), scratch_path(spark, "usage-deliveries")
    store = UsageStore(spark, scratch_path(spark, "usage-store"))
    delivered = {name: stored({name: star.clean(f"usage_{name}")}, path)[name] for name in ("full", "increment")}
    for name in ("full", "increment", "increment"):
        store.load(name, delivered[name])
    return store


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per load and month by the manifest, which entry holds them, and the rows stored."""
    store = _loaded(spark, folder)
    stored = store.usage().groupBy(io.MONTH).agg(F.count(F.lit(1)).alias("stored_rows"))
    entry = store.last_entry()
    now = store.manifest().filter(F.col("entry") == entry)
    return now.join(stored, io.MONTH).select("load", io.MONTH, "held", "rows", "stored_rows", "entry")


def _fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The stored usage against what was delivered, after one row of each month was replaced by another: rows
    are as many, but not the same."""
    star = _star(spark, folder)
    delivered = star.clean("user_logs").withColumn(io.MONTH, F.trunc("date", "MM"))
    # In the first days of a month, one song more.
    changed = delivered.withColumn("num_100", F.col("num_100") + (F.day("date") <= 2).cast("int"))
    return compared(fingerprint(changed, [io.MONTH]), fingerprint(delivered, [io.MONTH]), io.MONTH)


#: Windows that begin and end within months, lie in one month, or cover whole ones.
WINDOWS = {
    "quarter": (date(2000, 10, 1), date(2000, 12, 31)),
    "within": (date(2000, 10, 5), date(2000, 12, 20)),
    "year": (date(2000, 1, 15), date(2000, 12, 31)),
}


def _monthly(spark: SparkSession, folder: str) -> tuple[io.Tables, list[tuple[str, AnalysisConfig]]]:
    """The stored months, and the windows. What all windows share is stored once."""
    star, store = _star(spark, folder), _loaded(spark, folder)
    t = _tables(spark, folder)
    kept = stored({"train": t.train, "members": t.members, "latest": latest_payments(t, CFG)},
                  scratch_path(spark, "shared"))
    months = MonthlyTables(lambda name: kept[name] if name in kept else star.clean(name), store.months(),
                           {CFG.cut: kept["latest"]})
    return months, [(name, replace(CFG, win_start=a, win_end=b)) for name, (a, b) in WINDOWS.items()]


def _in_windows(query: Callable[[io.Tables, AnalysisConfig], DataFrame]) -> Query:
    """A query over three windows, all merged from the stored months. Each window is a job of its own: in
    one, a task would hold its users' sorted rows of all windows at once."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        t, windows = _monthly(spark, folder)
        found = stored({name: query(t, cfg) for name, cfg in windows}, scratch_path(spark, "windows"))
        return reduce(DataFrame.unionByName, [
            df.withColumn("window", F.lit(name)) for name, df in found.items()])
    return run


def _single_pass(spark: SparkSession, folder: str) -> DataFrame:
    """Every figure of the members' profiles, from one scan, as rows."""
    seen = profiled(_star(spark, folder).raw("members"), Profile(
        categories=("gender", "city", "registered_via"), averages=("bd",), flags=(
            ("zeros", "bd = 0"), ("blank", "gender = ''"))))

    def rows(name: str, df: DataFrame, key: str | None, value: str) -> DataFrame:
        return df.select(F.lit(name).alias("figure"),
                         (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("of"),
                         F.col(value).cast("bigint").alias("value"))

    nulls = seen.null_audit()
    found = [rows("rows", seen.row_count(), None, "rows"),
             rows("smallest age", seen.numeric_summary("bd"), None, "smallest"),
             rows("largest age", seen.numeric_summary("bd"), None, "largest"),
             rows("zero ages", seen.flag_counts(["zeros"]), None, "zeros"),
             *[rows(f"no {c}", nulls, None, f"{c}_nulls") for c in RAW["members"].fieldNames()],
             *[rows(c, seen.category_counts(c), c, "rows") for c in ("gender", "city", "registered_via")],
             rows("blank by method", seen.flag_by("registered_via", "blank"), "registered_via", "rows")]
    return reduce(DataFrame.unionByName, found)


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of the published feature table, of two windows, the older one still readable."""
    t, windows = _tables(spark, folder), WINDOWS
    table = PublishedTable(spark, scratch_path(spark, "published"))
    for first, last in (windows["quarter"], windows["within"]):
        table.publish(features.user_features(t, replace(CFG, win_start=first, win_end=last)))
    found = [table.open(version).withColumn("window", F.lit(name))
             for version, name in ((1, "quarter"), (None, "within"))]
    return found[0].unionByName(found[1])


def _split_values(table: str) -> Query:
    """Cleaned rows and rejected raw rows of the odd table together; raw days are kept for the latter."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = scratch_path(spark, f"odd-{table}")
        _star(spark, folder).odd(table).write.parquet(path)
        cleaned, rejects = clean.split_by_values(io.read_raw(spark, path, table, "parquet"), table, CFG)
        dates = DATE_COLUMNS[table]
        raw = rejects.withColumnsRenamed({c: f"raw_{c}" for c in dates})
        return cleaned.unionByName(raw, allowMissingColumns=True)
    return run


def _population(spark: SparkSession, folder: str) -> DataFrame:
    path, derived = scratch_path(spark, "populations"), _tables(spark, folder)
    kept = stored({name: getattr(derived, name) for name in ("train", "members")}, path)
    t = prepare(spark, io.Tables(lambda name: kept[name] if name in kept else getattr(derived, name)), CFG)
    results = report.audits(t, CFG) | report.analyses(t, CFG)
    kept = stored({name: results[name] for name in COMPARED} | {"features": features.user_features(t, CFG)},
                  f"{path}/results")
    return population_checks(kept, kept["features"])


def _stored_usage(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "user_logs")
    io.write_clean(_tables(spark, folder).user_logs, path, "user_logs")
    stored = io.read_clean(spark, path, "user_logs")
    return stored.groupBy(io.MONTH).agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_day"),
        F.max("date").alias("last_day"), F.sum("num_100").alias("full_plays"),
    )


def _stored_features(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "features")
    io.write_features(features.user_features(_tables(spark, folder), CFG), path)
    return spark.read.parquet(path)


def _union_raw(spark: SparkSession, folder: str) -> DataFrame:
    star = _star(spark, folder)
    return io.union_usage(star.raw("usage_full"), star.raw("usage_increment"))


def _reconcile(spark: SparkSession, folder: str) -> DataFrame:
    star = _star(spark, folder)
    increment = star.clean("usage_increment")
    combined = io.union_usage(star.clean("usage_full"), increment)
    return profile.reconcile_month(combined, increment, "date")


def _schema_reports(t: io.Tables) -> DataFrame:
    reports = [profile.schema_report(getattr(t, table), table) for table in CLEAN]
    return reduce(DataFrame.unionByName, reports)


_add("s1_read_train", _delivered("train"))
_add("s2_read_members", _delivered("members"))
_add("s3_read_transactions", _delivered("transactions"))
_add("s4_read_user_logs", _delivered("user_logs"))
_add("s1_land_train", _landed("train"))
_add("s2_land_members", _landed("members"))
_add("s3_land_transactions", _landed("transactions"))
_add("s4_land_user_logs", _landed("user_logs"))
_add("s4_write_usage_by_month", _stored_usage)
_add("s5_union_usage", _union_raw)
_add("s5_load_increment_twice", lambda spark, folder: _loaded(spark, folder).usage())
_add("s5_load_manifest", _manifest)
_add("s6_reconcile_month", _reconcile)
_add("s6_reconcile_fingerprints", _fingerprints)
_add("s6_reconcile_store", lambda spark, folder: _loaded(spark, folder).reconcile())
_add("s7_write_features", _stored_features)
_add("s7_publish_features", _published)
_on_clean("s8_schema_report", _schema_reports)

# Cleaning

_TXN_DATES = DATE_COLUMNS["transactions"]

_on_raw("c1_int_to_date_transactions", "transactions",
        lambda df: clean.int_to_date(df, _TXN_DATES))
_on_raw("c1_int_to_date_user_logs", "user_logs", lambda df: clean.int_to_date(df, ["date"]))
_on_odd("c1_rejected_dates", "transactions", lambda df: clean.rejected_dates(df, _TXN_DATES))
_on_raw("c2_epoch_ms_to_date", "members",
        lambda df: clean.epoch_ms_to_date(df, "registration_init_time", CFG.tz))
_on_raw("c3_null_out_of_range", "members",
        lambda df: clean.null_out_of_range(df, "bd", CFG.age_min, CFG.age_max))
_on_raw("c4_blank_to_null", "members", lambda df: clean.blank_to_null(df, "gender"))
_on_raw("c5_keep_zero_day_plans", "transactions",
        lambda df: clean.clean_table(df, "transactions", CFG).agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("payment_plan_days") == 0).alias("zero_day_rows")))
_on_raw("c6_never_convert_birth_years", "members",
        lambda df: clean.null_out_of_range(
            df.withColumn("raw_bd", F.col("bd")), "bd", CFG.age_min, CFG.age_max)
        .filter("raw_bd is not null and (bd is null or bd <> raw_bd)")
        .agg(F.count(F.lit(1)).alias("changed"), F.count("bd").alias("converted")))
_on_odd("c7_rejected_seconds", "user_logs", clean.rejected_seconds)
_on_raw("c_clean_members", "members", lambda df: clean.clean_table(df, "members", CFG))

_add("c1_split_transactions", _split_values("transactions"))
_add("c7_split_user_logs", lambda spark, folder: _split_values("user_logs")(spark, folder).drop("total_secs"))

# Profiling

_on_odd("p1_null_audit", "transactions", lambda df: profile.null_audit(
    df, RAW["transactions"].fieldNames()), cleaned=True)
_on_clean("p2_range_profile", lambda t: profile.range_profile(t.transactions, [
    "plan_list_price", "actual_amount_paid", "payment_plan_days", "transaction_date",
    "membership_expire_date"]))
_on_clean("p3_anomaly_rows", lambda t: profile.anomaly_rows(t.transactions))
_on_clean("p4_anomaly_split", lambda t: profile.anomaly_split(t.transactions))
_on_clean("p5_date_range", lambda t: profile.range_profile(t.user_logs, ["date"]))
_on_clean("p6_row_count", lambda t: profile.row_count(t.user_logs))
_on_clean("p7_monthly_counts", lambda t: profile.monthly_counts(t.user_logs, "date"))
_on_odd("p8_month_gaps", "user_logs", lambda df: profile.month_gaps(df, "date"), cleaned=True)
_on_odd("p8_month_coverage", "user_logs", lambda df: profile.month_coverage(df, "date"),
        cleaned=True)
_on_raw("p9_numeric_summary", "members", lambda df: profile.numeric_summary(df, "bd"))
_on_raw("p10_band_profile", "members",
        lambda df: profile.band_profile(df, "bd", CFG.age_min, CFG.age_max))
_on_raw("p11_missing_count", "members", lambda df: profile.missing_count(
    clean.clean_table(df, "members", CFG), "bd"))
_on_raw("p12_surviving_mean", "members", lambda df: profile.surviving_mean(
    clean.clean_table(df, "members", CFG), "bd"))
_on_raw("p13_category_counts_gender", "members",
        lambda df: profile.category_counts(df, "gender"))
_on_odd("p14_null_vs_blank", "members", lambda df: profile.null_vs_blank(df, "gender"))
_on_raw("p15_category_counts_city", "members", lambda df: profile.category_counts(df, "city"))
_on_raw("p16_missingness_by", "members", lambda df: profile.missingness_by(
    clean.clean_table(df, "members", CFG), "registered_via", "gender"))
_on_clean("p17_category_counts_label", lambda t: profile.category_counts(t.train, "is_churn"))
_on_clean("p18_base_rate", lambda t: profile.base_rate(t.train, "is_churn"))
_add("p_members_in_one_pass", _single_pass)
_add("p19_key_check", lambda spark, folder: reduce(DataFrame.unionByName, [
    profile.key_check(_star(spark, folder).odd(name), blocks.USER).withColumn(
        "table_name", F.lit(name)) for name in CLEAN]))
_on_clean("p19_duplicate_keys", lambda t: profile.duplicate_keys(t.transactions, blocks.USER))

# Building blocks

_on_clean("b1_latest_as_of", lambda t: latest_payments(t, CFG))
#: The first of 24 months, at whose ends snapshots are taken.
SNAPSHOTS_FROM = (1999, 1)


def _month_ends(first: tuple[int, int], months: int) -> list[date]:
    at = [first[0] * 12 + first[1] - 1 + i for i in range(1, months + 1)]
    return [date(m // 12, m % 12 + 1, 1) - timedelta(days=1) for m in at]


_on_clean("b1_latest_at_month_ends", lambda t: blocks.latest_at_each(
    t.transactions, _month_ends(SNAPSHOTS_FROM, 24)))
_on_clean("b1_tie_report", lambda t: blocks.tie_report(t.transactions, CFG.cut))
_on_clean("b2_exposure", lambda t: exposed_cohort(t, CFG).select(
    blocks.USER, "start_date", "end_date", "possible_exposure_days"))
_on_clean("b3_active_days", lambda t: blocks.active_days(t.train, user_usage(t, CFG)))
_on_clean("b4_active_days_clipped", lambda t: blocks.active_days_clipped(
    t.train, exposed_cohort(t, CFG), user_usage(t, CFG), CFG))
_on_clean("b5_rate", lambda t: blocks.with_rate(
    blocks.active_days(t.train, user_usage(t, CFG))
    .join(exposed_cohort(t, CFG), blocks.USER)
).select(blocks.USER, "active_days", "possible_exposure_days", "active_day_rate"))
_on_clean("b6_silent", lambda t: blocks.silent(t.train, user_usage(t, CFG)))
_on_clean("b7_listened", lambda t: blocks.listened(user_usage(t, CFG)))
_on_clean("b8_segment_rate", lambda t: blocks.segment_rate(
    renewal.paying_cohort(t, CFG), ["payment_plan_days", "is_cancel"]))
_on_clean("b9_bucket", lambda t: t.transactions.groupBy(
    plan_type(F.col("payment_plan_days"), CFG).alias("plan_type")
).agg(F.count(F.lit(1)).alias("rows")))

# Coverage audit

_on_clean("q1_member_coverage", coverage.member_coverage)
_on_clean("q2_coverage_status", lambda t: coverage.coverage_status(t, CFG))
_on_clean("q3_analysable_status", lambda t: coverage.analysable_status(t, CFG))
_on_clean("q4_usage_coverage", lambda t: coverage.usage_coverage(t, CFG))
_on_clean("q5_silent_rate", lambda t: coverage.silent_rate(t, CFG))
_on_clean("q6_rate_sanity", lambda t: coverage.rate_sanity(t, CFG))
_on_clean("q7_rate_sanity_diagnosis", lambda t: coverage.rate_sanity_diagnosis(t, CFG))
_add("q_population_checks", _population)

# Feature table

_on_features("u1_user_features", lambda df: df)
_add("u1_user_features_prepared", lambda spark, folder: features.user_features(
    prepare(spark, _tables(spark, folder), CFG), CFG))
_add("u1_user_features_by_months", _in_windows(features.user_features))
_add("b4_active_days_by_months", _in_windows(lambda t, cfg: blocks.active_days_clipped(
    t.train, exposed_cohort(t, cfg), user_usage(t, cfg), cfg)))
_add("a13b_engagement_tiers_by_months", _in_windows(usage.engagement_tiers))
_on_features("u1a_total_listen_mins", lambda df: df.select(blocks.USER, "total_listen_mins"))
_on_features("u1b_total_songs", lambda df: df.select(blocks.USER, "total_songs"))
_on_features("u1c_skipped_songs", lambda df: df.select(blocks.USER, "skipped_songs"))
_on_features("u1d_mins_per_active_day",
             lambda df: df.select(blocks.USER, "mins_per_active_day"))
_on_features("u1e_skip_rate", lambda df: df.select(blocks.USER, "skip_rate"))

# Usage against churn

_on_clean("a11_listening_time_by_label", lambda t: usage.listening_time_by_label(t, CFG))
_on_clean("a12_skip_rate_by_label", lambda t: usage.skip_rate_by_label(t, CFG))
_on_clean("a13_active_rate_by_label", lambda t: usage.active_rate_by_label(t, CFG))
_on_clean("a13b_engagement_tiers", lambda t: usage.engagement_tiers(t, CFG))
_on_clean("a14_listening_intensity_by_label",
          lambda t: usage.listening_intensity_by_label(t, CFG))

# Payment and renewal against churn

_on_clean("a21_renewal_churn", lambda t: renewal.renewal_churn(t, CFG))
_on_clean("a22_silent_renewal_churn", lambda t: renewal.silent_renewal_churn(t, CFG))
_on_clean("a23_listener_renewal_churn", lambda t: renewal.listener_renewal_churn(t, CFG))
_on_clean("a24_plan_type_churn", lambda t: renewal.plan_type_churn(t, CFG))
_on_clean("a25_plan_length_adoption", lambda t: renewal.plan_length_adoption(t, CFG))
_on_clean("a25_repeated_plans", lambda t: frequent_groups(
    t.transactions, [blocks.USER, "payment_plan_days"], 2,
    [percent(F.sum("is_auto_renew"), F.count("is_auto_renew")).alias("pct_auto_renew")], "payments"))
_on_clean("a25b_plan_length_all_txn", lambda t: renewal.plan_length_all_txn(t, CFG))
_on_clean("a25c_non_monthly_auto_total", lambda t: renewal.non_monthly_auto_total(t, CFG))
_on_clean("a26_retention_scenario", lambda t: scenario.retention_scenario(t, CFG))
_on_clean("a26t_retention_scenario_total", lambda t: scenario.retention_scenario(t, CFG).filter(
    F.col("plan_type") == scenario.TOTAL))

_on_clean("a26_observed_scenario", lambda t: scenario.retention_scenario(
    t, scenario.observed_rates(t, CFG)))


def _odd_tables(spark: SparkSession, folder: str) -> io.Tables:
    star = _star(spark, folder)
    return io.Tables(lambda name: star.odd_clean(name) if name == "transactions"
                     else star.clean(name))


# Longer plans on auto-renew, which the plain tables lack.
_add("a25c_auto_renew_on_longer_plans", lambda spark, folder: renewal.non_monthly_auto_total(
    _odd_tables(spark, folder), CFG))
_add("r11_kpi_adoption_with_renewals", lambda spark, folder: kpi.kpi_adoption(
    _odd_tables(spark, folder), CFG))

# Figures from the feature table, and indicators

_on_features("r1_features_skip_rate", kpi.features_skip_rate)
_on_features("r2_features_intensity", kpi.features_intensity)
_on_features("r3_features_listen_time", kpi.features_listen_time)
_on_features("r4_features_active_rate", kpi.features_active_rate)
_on_features("r5_features_renewal_churn", kpi.features_renewal_churn)
_on_features("r6_features_active_renewal", kpi.features_active_renewal)
_on_features("r7_features_silent_renewal", kpi.features_silent_renewal)
_on_features("r8_features_plan_churn", lambda df: kpi.features_plan_churn(df, CFG))
_on_features("r9_features_revenue", lambda df: kpi.features_revenue(df, CFG))
_on_features("r10_monthly_conversion_gain", lambda df: kpi.monthly_conversion_gain(df, CFG))
_on_clean("r11_kpi_adoption", lambda t: kpi.kpi_adoption(t, CFG))
_on_clean("r12_kpi_long_plan_churn", lambda t: kpi.kpi_long_plan_churn(t, CFG))
_on_clean("r13_kpi_manual_to_auto", lambda t: kpi.kpi_manual_to_auto(t, CFG))
_on_features("r14_test_vs_control_rate", lambda df: kpi.test_vs_control_rate(
    kpi.longer_plan_arms(df, CFG), "arm"))
_on_features("r14_test_vs_control_interval", lambda df: kpi.test_vs_control_interval(
    kpi.longer_plan_arms(df, CFG), "arm"))
