"""Independent SQL for every query, written for DuckDB over the generated tables.

Shares are rounded on integers here as well: a double that should be a tie rounds either way.
"""

from __future__ import annotations

# The derived tables, as FIXTURES.md defines them.
TABLES = """
train as (
  select cast(c_custkey as varchar) as msno,
         cast(case when c_custkey in (
             select o_custkey from orders
             where cast(o_orderdate as date) > date '2000-12-31'
               and cast(o_orderdate as date) <= date '2001-06-29') then 0 else 1 end
           as integer) as is_churn
  from customer
  union all select 'p' || p_partkey, cast(p_size <= 25 as integer) from part
  union all select 's' || s_suppkey, cast(s_acctbal < 0 as integer) from supplier
  union all select 'n' || n_nationkey, cast(n_regionkey % 2 as integer) from nation),
members_raw as (
  select cast(c_custkey as varchar) as msno,
         cast(c_nationkey as integer) as city,
         cast(floor(c_acctbal / 100) as integer) as bd,
         case when c_mktsegment in ('BUILDING', 'MACHINERY') then ''
              when c_custkey % 2 = 0 then 'male' else 'female' end as gender,
         cast([3, 4, 7, 9, 13][c_nationkey % 5 + 1] as integer) as registered_via,
         date '2000-01-01' + cast(c_custkey * 37 % 400 as integer) as registered
  from customer
  union all
  select 'p' || p_partkey, cast(p_size % 25 as integer),
         cast(floor(p_retailprice / 20) as integer),
         case when p_type = 'PROMO' then '' else 'female' end,
         cast([3, 4, 7, 9, 13][p_size % 5 + 1] as integer),
         date '2000-01-01' + cast(p_partkey * 37 % 400 as integer)
  from part),
members as (
  select msno, city, case when bd >= 13 and bd <= 85 then bd end as bd,
         case when gender <> '' then gender end as gender, registered_via,
         cast(registered as date) as registration_init_time
  from members_raw),
payments as (
  select msno, cast(number % 5 as integer) as payment_method_id,
         cast([0, 7, 30, 30, 30, 90, 180, 410][number % 8 + 1] as integer) as payment_plan_days,
         price as plan_list_price, price as actual_amount_paid, status, transaction_date,
         case when number % 4 = 3 then 60 else 0 end as grace, is_cancel
  from (select cast(o_custkey as varchar) as msno, o_orderkey as number,
               cast(floor(o_totalprice / 250) as integer) as price, o_orderstatus as status,
               cast(o_orderdate as date) as transaction_date,
               cast(o_orderpriority = '5-LOW' as integer) as is_cancel
        from orders
        union all
        select 's' || s_suppkey, s_suppkey, cast(floor(abs(s_acctbal) / 25) as integer), 'F',
               cast(date '2000-01-01' + cast(s_suppkey * 37 % 400 as integer) as date),
               cast(s_nationkey % 5 = 0 as integer)
        from supplier)),
transactions as (
  select msno, payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid,
         cast(payment_plan_days = 30 and status <> 'P' as integer) as is_auto_renew,
         transaction_date,
         cast(transaction_date + cast(case when is_cancel = 1 then payment_plan_days // 2
                                           else payment_plan_days + grace end as integer) as date)
           as membership_expire_date,
         is_cancel
  from payments),
usage_full as (
  select cast(o_custkey as varchar) as msno, cast(l_shipdate as date) as date,
         cast(l_quantity as integer) % 7 as num_25,
         case l_returnflag when 'A' then cast(l_quantity as integer) % 3 else 0 end as num_50,
         case l_returnflag when 'R' then cast(l_quantity as integer) % 2 else 0 end as num_75,
         0 as num_985,
         case when l_returnflag = 'N' and l_linestatus = 'O'
              then cast(l_quantity as integer) % 11 else 0 end as num_100,
         cast(l_linenumber as integer) as num_unq, l_extendedprice / 7 as total_secs
  from lineitem join orders on l_orderkey = o_orderkey),
usage_increment as (
  select cast(user_id as varchar) as msno,
         cast(date '2000-12-01' + cast(cast(ts as date) - date '2024-01-01' as integer) as date)
           as date,
         cast(event_type = 'error' as integer) as num_25,
         cast(event_type = 'view' as integer) as num_50,
         cast(event_type = 'click' as integer) as num_75,
         cast(event_type = 'signup' as integer) as num_985,
         cast(event_type = 'purchase' as integer) as num_100,
         1 as num_unq, value / 7 as total_secs
  from events),
user_logs as (select * from usage_full union all select * from usage_increment)"""

# The same tables with the faults of real deliveries.
ODD = """
odd_train as (
  select * from train union all select * from train where msno like 'n%'
  union all select null, is_churn from train where msno like 'n%'),
odd_members as (
  select * replace (case when registered_via <> 4 or bd > 0 then msno end as msno)
  from (select * replace (case when registered_via <> 13 then gender end as gender)
        from members_raw
        union all
        select * from members_raw where registered_via = 3)),
odd_transactions as (
  select * replace (
    case when payment_method_id <> 3 or is_cancel <> 1 then msno end as msno,
    case when payment_method_id <> 2 or is_cancel <> 1 then membership_expire_date end
      as membership_expire_date,
    cast(case when payment_method_id = 1 and payment_plan_days in (90, 180) then 1
              else is_auto_renew end as integer) as is_auto_renew)
  from transactions),
odd_logs as (
  select * replace (
    case when num_unq <> 7 or num_25 <> 6 then msno end as msno,
    case when date >= date '1997-03-01' and date <= date '1997-03-31'
         then least(cast(date + interval 1 month as date), date '1997-04-30') else date end as date)
  from user_logs)"""

# Intermediate relations of the checks.
BLOCKS = """
latest as (
  select * from transactions where transaction_date <= date '2000-12-31'
  qualify row_number() over (
    partition by msno
    order by transaction_date desc, membership_expire_date desc, payment_plan_days desc,
             plan_list_price desc, actual_amount_paid desc, is_auto_renew desc,
             payment_method_id desc, is_cancel) = 1),
exposed as (
  select l.*, greatest(date '2000-10-01', registration_init_time) as start_date,
         least(date '2000-12-31', membership_expire_date) as end_date,
         cast(least(date '2000-12-31', membership_expire_date)
              - greatest(date '2000-10-01', registration_init_time) + 1 as integer)
           as possible_exposure_days
  from latest l join members using (msno)),
logs as (
  select *, num_50 + num_75 + num_985 + num_100 > 0 as active,
         cast(floor(total_secs) as hugeint) * 1000000000
           + cast(round_even((total_secs - floor(total_secs)) * 1000000000, 0) as bigint) as ns
  from user_logs where date >= date '2000-10-01' and date <= date '2000-12-31'),
heard as (
  select msno, sum(ns) as ns, coalesce(sum(ns) filter (active), 0) as active_ns,
         cast(sum(num_25 + num_50 + num_75 + num_985 + num_100) as bigint) as total_songs,
         cast(sum(num_25) as bigint) as skipped_songs,
         count(distinct date) filter (active) as active_days
  from logs group by msno),
usage as (
  select msno, is_churn, ns, total_songs, skipped_songs,
         coalesce(active_days, 0) as active_days
  from train left join heard using (msno)),
rated as (
  select u.*, e.* exclude (msno),
         (20000 * active_days + possible_exposure_days) // (2 * possible_exposure_days) as rate4
  from usage u join exposed e using (msno) where possible_exposure_days > 0),
clipped as (
  select t.msno, t.is_churn, e.possible_exposure_days,
         count(distinct l.date) filter (l.active) as active_days
  from train t join exposed e on e.msno = t.msno
  left join logs l on l.msno = t.msno and l.date >= e.start_date and l.date <= e.end_date
  group by all),
features as (
  select msno, is_churn, is_auto_renew, transaction_date, payment_plan_days, actual_amount_paid,
         possible_exposure_days, active_days, rate4 / 10000.0 as active_day_rate,
         (200 * ns + 60000000000) // 120000000000 as mins2,
         case when active_days > 0 then (200 * ns + 60000000000 * active_days)
                // (120000000000 * active_days) else 0 end as daily2,
         total_songs, skipped_songs,
         case when total_songs > 0
              then (20000 * skipped_songs + total_songs) // (2 * total_songs) else 0 end as skip2
  from rated),
cohort as (
  select l.*, t.is_churn,
         case when payment_plan_days <= 7 then 'Trial' when payment_plan_days <= 30 then 'Monthly'
              when payment_plan_days <= 90 then 'Quarterly' else 'Long-term' end as plan_type
  from latest l join train t using (msno))"""


def _pct(part: str, whole: str) -> str:
    part, whole = f"cast({part} as bigint)", f"cast({whole} as bigint)"
    return f"cast((20000 * {part} + {whole}) // (2 * {whole}) as double) / 100"


_RATE = _pct("sum(is_churn)", "count(is_churn)")


def _segments(source: str, keys: str, rate: str = "churn_rate") -> str:
    return f"select {keys}, count(*) as users, {_RATE} as {rate} from {source} group by {keys}"


def _feature_mean(column: str, unit: int, name: str) -> str:
    return (f"select is_churn, cast(sum({column}) as double) / {unit} / count({column}) as {name}"
            " from features group by is_churn")


def _yyyymmdd(column: str) -> str:
    return f"cast(strftime({column}, '%Y%m%d') as integer)"


_RAW_LOGS = f"select * replace ({_yyyymmdd('date')} as date) from "
_MEMBERS_RAW = """select msno, city, bd, gender, registered_via,
  cast(registered - date '1970-01-01' as bigint) * 86400000 as registration_init_time
  from members_raw"""
_FEATURES = """select msno, is_churn, is_auto_renew, transaction_date, payment_plan_days,
  actual_amount_paid, possible_exposure_days, active_days, active_day_rate,
  mins2 / 100.0 as total_listen_mins, daily2 / 100.0 as mins_per_active_day, total_songs,
  skipped_songs, skip2 / 100.0 as skip_rate from features"""


def _scenario(source: str, best: str = "0.0383::double", safe: str = "0.1195::double") -> str:
    """Unrounded results per plan type of users on plans longer than a month."""
    return f"""scenario as (
  select plan_type, users, revenue, today,
         churned - users * {best} as kept_best,
         (churned - users * {best}) * revenue as gain_best,
         churned - users * {safe} as kept_safe,
         (churned - users * {safe}) * revenue as gain_safe
  from (select case when payment_plan_days <= 90 then 'Quarterly' else 'Long-term' end
                 as plan_type,
               count(*) as users, sum(is_churn) as churned,
               avg(actual_amount_paid * 365 / (30.0::double * payment_plan_days)) as revenue,
               coalesce(sum(actual_amount_paid * 365 / (30.0::double * payment_plan_days))
                 filter (is_churn = 0), 0) as today
        from {source} where payment_plan_days > 30 group by 1)),
scenario_lines as (
  select * from scenario union all
  select 'TOTAL', cast(sum(users) as bigint), null, sum(today), sum(kept_best), sum(gain_best),
         sum(kept_safe), sum(gain_safe) from scenario)"""


_SCENARIO_LINES = """select plan_type, users, round(revenue, 2) as annual_revenue_per_user_usd,
  round(kept_best) + 0.0::double as users_retained_optimistic, round(gain_best) + 0.0::double as annual_revenue_optimistic_usd,
  round(kept_safe) + 0.0::double as users_retained_conservative,
  round(gain_safe) + 0.0::double as annual_revenue_conservative_usd from scenario_lines"""


def _schema_lines() -> str:
    columns = {
        "train": "msno:string is_churn:int",
        "members": "msno:string city:int bd:int gender:string registered_via:int"
                   " registration_init_time:date",
        "transactions": "msno:string payment_method_id:int payment_plan_days:int"
                        " plan_list_price:int actual_amount_paid:int is_auto_renew:int"
                        " transaction_date:date membership_expire_date:date is_cancel:int",
        "user_logs": "msno:string date:date num_25:int num_50:int num_75:int num_985:int"
                     " num_100:int num_unq:int total_secs:double",
    }
    return " union all ".join(
        f"select '{table}' as table_name, '{name}' as column_name, '{kind}' as data_type,"
        f" count(*) as rows, count({name}) as filled from {table}"
        for table, listed in columns.items()
        for name, kind in (pair.split(":") for pair in listed.split())
    )


def _key_lines() -> str:
    return " union all ".join(
        f"select '{table}' as table_name, count(*) as rows,"
        " count(distinct msno) as distinct_keys,"
        f" (select count(*) from (select msno from {odd} where msno is not null"
        " group by msno having count(*) > 1)) as repeated_keys,"
        f" count(*) filter (msno is null) as null_keys from {odd}"
        for table, odd in (("train", "odd_train"), ("members", "odd_members"),
                           ("transactions", "odd_transactions"), ("user_logs", "odd_logs"))
    )


_TIED = """
newest as (
  select msno, max(transaction_date) as transaction_date from transactions
  where transaction_date <= date '2000-12-31' group by msno)
select msno, transaction_date, count(*) as payments
from transactions join newest using (msno, transaction_date)
group by all
having count(distinct (payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid,
                       is_auto_renew, membership_expire_date, is_cancel)) > 1"""

_INTENSITY = f"""
select is_churn, count(*) as users,
       round(avg(active_ns / (60000000000.0::double * h.active_days)), 2)
         as avg_mins_per_active_day,
       round(quantile_cont(active_ns / (60000000000.0::double * h.active_days), 0.5), 2)
         as median_mins_per_active_day
from train join heard h using (msno) where h.active_days > 0 group by is_churn"""

_TXN_COLUMNS = ("msno", "payment_method_id", "payment_plan_days", "plan_list_price",
                "actual_amount_paid", "is_auto_renew", "transaction_date",
                "membership_expire_date", "is_cancel")
_RANGES = ("plan_list_price", "actual_amount_paid", "payment_plan_days", "transaction_date",
           "membership_expire_date")

_SELECTS: dict[str, str] = {
    # Sources and sinks
    "s1_read_train": "select * from train",
    "s2_read_members": _MEMBERS_RAW,
    "s3_read_transactions": f"""select * replace ({_yyyymmdd('transaction_date')}
        as transaction_date, {_yyyymmdd('membership_expire_date')} as membership_expire_date)
        from transactions""",
    "s4_read_user_logs": _RAW_LOGS + "user_logs",
    "s4_write_usage_by_month": """select cast(date_trunc('month', date) as date) as month,
        count(*) as rows, min(date) as first_day, max(date) as last_day,
        cast(sum(num_100) as bigint) as full_plays from user_logs group by 1""",
    "s5_union_usage": f"({_RAW_LOGS} usage_full) union all ({_RAW_LOGS} usage_increment)",
    "s6_reconcile_month": """select cast(date_trunc('month', date) as date) as month,
        count(*) as combined_rows, count(*) filter (part = 2) as increment_rows,
        count(*) filter (part = 1) as extra_rows
        from (select date, 1 as part from usage_full
              union all select date, 2 from usage_increment) group by 1""",
    "s7_write_features": _FEATURES,
    "s8_schema_report": _schema_lines(),
    # Cleaning
    "c1_int_to_date_transactions": "select * from transactions",
    "c1_int_to_date_user_logs": "select * from user_logs",
    "c1_rejected_dates": """select count(*) as total,
        count(*) - count(transaction_date) as transaction_date_rejected,
        count(*) - count(membership_expire_date) as membership_expire_date_rejected
        from odd_transactions""",
    "c7_rejected_seconds": """select count(*) as total,
        count(*) filter (num_unq in (5, 6)) as total_secs_rejected from user_logs""",
    "c2_epoch_ms_to_date": """select msno, city, bd, gender, registered_via,
        cast(registered as date) as registration_init_time from members_raw""",
    "c3_null_out_of_range":
        f"select * replace (case when bd >= 13 and bd <= 85 then bd end as bd)"
        f" from ({_MEMBERS_RAW})",
    "c4_blank_to_null": f"select * replace (nullif(gender, '') as gender) from ({_MEMBERS_RAW})",
    "c5_keep_zero_day_plans": """select count(*) as rows,
        count(*) filter (payment_plan_days = 0) as zero_day_rows from payments""",
    "c6_never_convert_birth_years": """select count(*) as changed, 0::bigint as converted
        from members_raw where bd < 13 or bd > 85""",
    "c_clean_members": "select * from members",
    # Profiling
    "p1_null_audit": "select " + ", ".join(
        f"count(*) filter ({c} is null) as {c}_nulls" for c in _TXN_COLUMNS
    ) + " from odd_transactions",
    "p2_range_profile": "select " + ", ".join(
        f"min({c}) as min_{c}, max({c}) as max_{c}" for c in _RANGES) + " from transactions",
    "p3_anomaly_rows": """select msno, plan_list_price, is_cancel, actual_amount_paid,
        payment_plan_days from transactions where payment_plan_days = 0""",
    "p4_anomaly_split": """select is_cancel, count(*) as rows from transactions
        where payment_plan_days = 0 group by is_cancel""",
    "p5_date_range": "select min(date) as min_date, max(date) as max_date from user_logs",
    "p6_row_count": "select count(*) as rows from user_logs",
    "p7_monthly_counts": """select cast(date_trunc('month', date) as date) as month,
        count(*) as rows from user_logs group by 1 order by 1""",
    "p8_month_gaps": """select cast(m as date) as month from (
          select unnest(generate_series(date_trunc('month', min(date)),
                 date_trunc('month', max(date)), interval 1 month)) as m from odd_logs)
        where cast(m as date) not in (
          select cast(date_trunc('month', date) as date) from odd_logs)""",
    "p8_month_coverage": """select min(m) as first_month, max(m) as last_month,
        count(*) as months_present,
        date_diff('month', min(m), max(m)) + 1 - count(*) as months_missing
        from (select distinct cast(date_trunc('month', date) as date) as m from odd_logs)""",
    "p9_numeric_summary": """select min(bd) as smallest, max(bd) as largest, avg(bd) as average
        from members_raw""",
    "p10_band_profile": """select count(*) as total,
        count(*) filter (bd between 13 and 85) as plausible, count(*) filter (bd = 0) as zeros,
        count(*) filter (bd < 0) as negative, count(*) filter (bd > 85) as too_high
        from members_raw""",
    "p11_missing_count": "select count(*) filter (bd is null) as missing from members",
    "p12_surviving_mean": "select count(bd) as present, avg(bd) as average from members",
    "p13_category_counts_gender":
        "select gender, count(*) as rows from members_raw group by gender",
    "p14_null_vs_blank": """select count(*) filter (gender is null) as true_null,
        count(*) filter (gender = '') as empty_string from odd_members""",
    "p15_category_counts_city": "select city, count(*) as rows from members_raw group by city",
    "p16_missingness_by": """select registered_via, count(*) as total_users,
        count(*) filter (gender is null) as missing_gender from members group by registered_via
        order by total_users desc, registered_via""",
    "p17_category_counts_label":
        "select is_churn, count(*) as rows from train group by is_churn",
    "p18_base_rate": f"select {_RATE} as churn_rate_pct from train",
    "p19_key_check": _key_lines(),
    "p19_duplicate_keys": """select msno, count(*) as rows from transactions group by msno
        having count(*) > 1""",
    # Building blocks
    "b1_latest_as_of": "select * from latest",
    "b1_tie_report": "",
    "b2_exposure": "select msno, start_date, end_date, possible_exposure_days from exposed",
    "b3_active_days": "select msno, is_churn, active_days from usage",
    "b4_active_days_clipped": "select * from clipped",
    "b5_rate": """select msno, active_days, possible_exposure_days,
        rate4 / 10000.0 as active_day_rate from rated""",
    "b6_silent": "select * from train where msno not in (select msno from logs)",
    "b7_listened": "select distinct msno from logs",
    "b8_segment_rate": _segments("cohort", "payment_plan_days, is_cancel"),
    "b9_bucket": """select case when payment_plan_days <= 7 then 'Trial'
        when payment_plan_days <= 30 then 'Monthly' when payment_plan_days <= 90 then 'Quarterly'
        else 'Long-term' end as plan_type, count(*) as rows from transactions group by 1""",
    # Coverage audit
    "q1_member_coverage": """select count(*) as in_train,
        count(*) filter (msno not in (select msno from members)) as no_member_detail
        from train""",
    "q2_coverage_status": _segments(
        """(select is_churn, case when l and m then 'has both'
              when l then 'missing member row' when m then 'missing transaction'
              else 'missing both' end as status
            from (select is_churn, msno in (select msno from latest) as l,
                         msno in (select msno from members) as m from train))""",
        "status", "churn_rate_pct"),
    "q3_analysable_status": _segments(
        """(select is_churn, case when possible_exposure_days > 0 then 'kept'
              when possible_exposure_days <= 0 then 'dropped: expired before Oct 1'
              else 'dropped: no txn or no member row' end as status
            from train left join exposed using (msno))""",
        "status", "churn_rate_pct"),
    "q4_usage_coverage": """select count(distinct msno) as in_train,
        count(*) filter (msno not in (select msno from logs)) as no_user_log,
        count(distinct msno) filter (msno in (select msno from logs)) as have_user_log
        from train""",
    "q5_silent_rate": f"""select count(*) as no_history, {_RATE} as churn_rate_pct
        from train where msno not in (select msno from logs)""",
    "q6_rate_sanity": """select count(*) as total, count(*) filter (rate4 > 10000) as impossible,
        ((max(rate4) + 50) // 100) / 100.0 as worst from rated""",
    "q7_rate_sanity_diagnosis": """select count(*) as impossible,
        count(*) filter (exists (select 1 from logs l where l.msno = r.msno and l.active
                                 and l.date > r.membership_expire_date)) as active_after_expiry,
        count(*) filter (is_cancel = 1) as latest_is_cancel from rated r where rate4 > 10000""",
    # Feature table
    "u1_user_features": _FEATURES,
    "u1_user_features_prepared": _FEATURES,
    "u1a_total_listen_mins": "select msno, mins2 / 100.0 as total_listen_mins from features",
    "u1b_total_songs": "select msno, total_songs from features",
    "u1c_skipped_songs": "select msno, skipped_songs from features",
    "u1d_mins_per_active_day": "select msno, daily2 / 100.0 as mins_per_active_day from features",
    "u1e_skip_rate": "select msno, skip2 / 100.0 as skip_rate from features",
    # Usage against churn
    "a11_listening_time_by_label": """select is_churn,
        cast(sum(ns) as double) / 60000000000 / count(ns) as avg_listen_time_min
        from usage where ns is not null group by is_churn""",
    "a12_skip_rate_by_label": """select is_churn, count(*) as no_users,
        round(avg(skipped_songs / total_songs) * 100, 2) as avg_skip_rate
        from usage where total_songs > 0 group by is_churn""",
    "a13_active_rate_by_label": """select is_churn, count(*) as users,
        cast(sum(rate4) as double) / 10000 / count(*) as avg_active_day_rate
        from rated group by is_churn""",
    "a13b_engagement_tiers": _segments(
        """(select is_churn, case when rate4 = 0 then 'Dormant' when rate4 < 4900 then 'Light User'
              else 'Regular' end as bucket
            from (select is_churn, (20000 * active_days + possible_exposure_days)
                           // (2 * possible_exposure_days) as rate4
                  from clipped where possible_exposure_days > 0))""",
        "bucket") + " order by bucket",
    "a14_listening_intensity_by_label": _INTENSITY,
    # Payment and renewal against churn
    "a21_renewal_churn": _segments("cohort", "is_auto_renew"),
    "a22_silent_renewal_churn": _segments(
        "(select * from cohort where msno not in (select msno from logs))", "is_auto_renew"),
    "a23_listener_renewal_churn": _segments(
        "(select * from cohort where msno in (select msno from logs))", "is_auto_renew"),
    "a24_plan_type_churn": _segments("cohort", "plan_type, is_auto_renew", "churn_rate_pct"),
    "a25_plan_length_adoption": f"""select payment_plan_days, count(*) as users,
        {_pct('sum(is_auto_renew)', 'count(*)')} as pct_auto_renew, {_RATE} as churn_rate_pct
        from cohort group by payment_plan_days having count(*) > 500""",
    "a25b_plan_length_all_txn": """select payment_plan_days, count(*) as txns,
        cast(sum(is_auto_renew) as bigint) as auto_renew_txns, count(distinct msno) as users
        from transactions where payment_plan_days in (30, 90, 100, 180, 195, 360, 410)
        group by payment_plan_days""",
    "a25c_non_monthly_auto_total": """select count(*) as txns,
        cast(sum(is_auto_renew) as bigint) as auto_renew_txns
        from transactions where payment_plan_days in (90, 100, 180, 195, 360, 410)""",
    "a25c_auto_renew_on_longer_plans": """select count(*) as txns,
        cast(sum(is_auto_renew) as bigint) as auto_renew_txns
        from odd_transactions where payment_plan_days in (90, 100, 180, 195, 360, 410)""",
    "r11_kpi_adoption_with_renewals": f"""select count(*) as users,
        {_pct('sum(is_auto_renew)', 'count(*)')} as pct_auto_renew
        from (select * from odd_transactions
              where transaction_date <= date '2000-12-31' and msno is not null
              qualify row_number() over (
                partition by msno
                order by transaction_date desc, membership_expire_date desc nulls last,
                  payment_plan_days desc, plan_list_price desc, actual_amount_paid desc,
                  is_auto_renew desc, payment_method_id desc, is_cancel) = 1)
        join train using (msno) where payment_plan_days > 30""",
    # Figures from the feature table, and indicators
    "r1_features_skip_rate": _feature_mean("skip2", 100, "avg_skip_rate"),
    "r2_features_intensity": _feature_mean("daily2", 100, "avg_mins_per_active_day"),
    "r3_features_listen_time": _feature_mean("mins2", 100, "avg_total_listen_mins"),
    "r4_features_active_rate": """select is_churn,
        cast(sum(rate4) as double) / 10000 / count(*) as avg_active_day_rate
        from rated group by is_churn""",
    "r5_features_renewal_churn": _segments("features", "is_auto_renew"),
    "r6_features_active_renewal": _segments(
        "(select * from features where active_days > 0)", "is_auto_renew"),
    "r7_features_silent_renewal": _segments(
        "(select * from features where active_days = 0)", "is_auto_renew"),
    "r8_features_plan_churn": _segments(
        "(select f.is_churn, f.is_auto_renew, c.plan_type from features f"
        " join cohort c using (msno))", "plan_type, is_auto_renew"),
    "r10_monthly_conversion_gain": f"""select manual as manual_users,
        {_pct('manual_left', 'manual')} as manual_churn_rate,
        {_pct('auto_left', 'auto')} as auto_churn_rate,
        round(manual_left - manual * auto_left / auto) as users_kept
        from (select count(*) filter (is_auto_renew = 0) as manual,
                     count(*) filter (is_auto_renew = 0 and is_churn = 1) as manual_left,
                     count(*) filter (is_auto_renew = 1) as auto,
                     count(*) filter (is_auto_renew = 1 and is_churn = 1) as auto_left
              from features where payment_plan_days > 7 and payment_plan_days <= 30)""",
    "r11_kpi_adoption": f"""select count(*) as users,
        {_pct('sum(is_auto_renew)', 'count(*)')} as pct_auto_renew
        from cohort where payment_plan_days > 30""",
    "r12_kpi_long_plan_churn": f"""select plan_type, users, churn_rate,
        cast(churn_rate::decimal(9,2) - 11.95 as double) as above_conservative_target,
        cast(churn_rate::decimal(9,2) - 3.83 as double) as above_best_case
        from ({_segments("(select * from cohort where payment_plan_days > 30)", "plan_type")})""",
    "r13_kpi_manual_to_auto": f"""select count(*) as manual_users,
        count(*) filter (converted) as converted,
        {_pct('count(*) filter (converted)', 'count(*)')} as conversion_pct
        from (select m.msno, bool_or(a.transaction_date > m.transaction_date) is true as converted
              from (select msno, min(transaction_date) as transaction_date from transactions
                    where payment_plan_days > 7 and payment_plan_days <= 30 and is_auto_renew = 0
                      and transaction_date <= date '2000-12-31' group by msno) m
              left join (select * from transactions
                    where payment_plan_days > 7 and payment_plan_days <= 30 and is_auto_renew = 1
                      and transaction_date <= date '2000-12-31') a on a.msno = m.msno
              group by m.msno)""",
    "r14_test_vs_control_rate": f"""select test_users, test_rate, control_users, control_rate,
        cast(control_rate::decimal(9,2) - test_rate::decimal(9,2) as double) as gap
        from (select count(*) filter (test) as test_users,
                {_pct('sum(is_churn) filter (test)', 'count(*) filter (test)')} as test_rate,
                count(*) filter (not test) as control_users,
                {_pct('sum(is_churn) filter (not test)', 'count(*) filter (not test)')}
                  as control_rate
              from (select is_churn, md5(msno) < '8' as test from features
                    where payment_plan_days > 30))""",
}


def _landed(table: str) -> str:
    """Rows and rejects of a delivery with faults; the user's last character says which."""
    raw = _SELECTS[{"train": "s1_read_train", "members": "s2_read_members",
                    "transactions": "s3_read_transactions", "user_logs": "s4_read_user_logs"}[table]]
    names = {"train": ("msno", "is_churn"),
             "members": ("msno", "city", "bd", "gender", "registered_via", "registration_init_time"),
             "transactions": _TXN_COLUMNS,
             "user_logs": ("msno", "date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq",
                           "total_secs")}[table]
    texts = [f"coalesce({'cast(floor(total_secs) as bigint)' if c == 'total_secs' else c}::varchar, '')"
             for c in names]
    line = " || ',' || ".join
    kept = ", ".join(f"case when kind < 3 then {c} end as {c}" for c in names[1:])
    return f"""
select case when kind = 2 then '"' || msno || '",' || chr(10) || 'x' when kind < 2 then msno end as msno,
  {kept},
  case when kind = 3 then 'damaged' when kind = 4 then 'headless' end as reject_file,
  case when kind = 3 and msno like '%0' then {line([texts[0], "'n/a'", *texts[2:]])}
       when kind = 3 then {line(texts)} || ',extra'
       when kind = 4 then {line(texts[:-1])} end as reject_text,
  case when kind = 3 then 'line' when kind = 4 then 'header' end as reject_reason
from (select *, ascii(right(msno, 1)) % 5 as kind from ({raw}))"""


#: The windows of the monthly queries.
WINDOWS = {"quarter": ("2000-10-01", "2000-12-31"), "within": ("2000-10-05", "2000-12-20"),
           "year": ("2000-01-15", "2000-12-31")}


def _in_windows(select: str, tables: str) -> str:
    """A statement for each window; the cut date of payments, which ends the test window, stays."""
    def blocks(first: str, last: str) -> str:
        moved = BLOCKS.replace("date '2000-10-01'", f"date '{first}'").replace(
            "date '2000-12-31'", f"date '{last}'")
        return moved.replace(f"transaction_date <= date '{last}'", "transaction_date <= date '2000-12-31'")

    found = [f"(select *, '{name}' as window from (with {tables}{blocks(*ends)}\n{select}))"
             for name, ends in WINDOWS.items()]
    return " union all ".join(found)


def _population() -> str:
    def users(query: str, column: str = "users", where: str = "true") -> str:
        return f"(select coalesce(sum({column}), 0) from ({_SELECTS[query]}) where {where})"

    status, analysable = "q2_coverage_status", "q3_analysable_status"
    cohort = "(select count(*) from train)"
    kept = users(analysable, where="status = 'kept'")
    paying = users(status, where="status in ('has both', 'missing member row')")
    rules = [
        ("coverage statuses make up the cohort", users(status), "=", cohort),
        ("analysable statuses make up the cohort", users(analysable), "=", cohort),
        ("kept and expired users have both rows", users(analysable, where="status not like 'dropped: no%'"),
         "=", users(status, where="status = 'has both'")),
        ("kept users are in the feature table", "(select count(*) from features)", "=", kept),
        ("kept users have a rate", users("q6_rate_sanity", "total"), "=", kept),
        ("kept users are in the rates by label", users("a13_active_rate_by_label"), "=", kept),
        ("kept users are in a tier", users("a13b_engagement_tiers"), "=", kept),
        ("paying users are in the renewal rates", users("a21_renewal_churn"), "=", paying),
        ("paying users have a plan type", users("a24_plan_type_churn"), "=", paying),
        ("paying users are silent or listen", users("a22_silent_renewal_churn") + " + "
         + users("a23_listener_renewal_churn"), "=", paying),
        ("other plans are in the total of other plans",
         users("a25b_plan_length_all_txn", "txns", "payment_plan_days <> 30"), "=",
         users("a25c_non_monthly_auto_total", "txns")),
        ("dormant users include the inactive ones", users("a13b_engagement_tiers", where="bucket = 'Dormant'"),
         ">=", "(select count(*) from features where active_days = 0)"),
    ]
    lines = " union all ".join(
        f"select '{rule}' as rule, '{relation}' as relation, cast({left} as bigint) as left_users,"
        f" cast({right} as bigint) as right_users, {left} {relation} {right} as holds"
        for rule, left, relation, right in rules)
    return lines


_ONE_PASS = " union all ".join([
    "select 'rows' as figure, null::varchar as of, count(*)::bigint as value from members_raw",
    "select 'smallest age', null, min(bd)::bigint from members_raw",
    "select 'largest age', null, max(bd)::bigint from members_raw",
    "select 'zero ages', null, count(*) filter (bd = 0) from members_raw",
    *[f"select 'no {c}', null, count(*) filter ({d} is null) from members_raw"
      for c, d in (("msno", "msno"), ("city", "city"), ("bd", "bd"), ("gender", "gender"),
                   ("registered_via", "registered_via"), ("registration_init_time", "registered"))],
    *[f"select '{c}', {c}::varchar, count(*) from members_raw group by {c}"
      for c in ("gender", "city", "registered_via")],
    "select 'blank by method', registered_via::varchar, count(*) from members_raw where gender = ''"
    " group by registered_via",
])

_LOADS = """loads as (
  select 'full' as load, cast(date_trunc('month', date) as date) as month, 1::integer as held,
    count(*) as rows from usage_full group by all
  union all
  select 'increment', cast(date_trunc('month', date) as date), 2::integer, count(*) from usage_increment
  group by all)"""


def statements(tables: str = TABLES + ",") -> dict[str, str]:
    """Query name to a complete statement.

    With `tables=""` the statements read relations train, members, transactions and user_logs that
    the connection already has.
    """
    shared = f"with {tables}{BLOCKS}"
    result = {
        name: (f"with {tables}{ODD}\n{select}" if "odd_" in select else f"{shared}\n{select}")
        for name, select in _SELECTS.items()
    }
    result["b1_tie_report"] = f"{shared},{_TIED}"
    for number, table in enumerate(("train", "members", "transactions", "user_logs"), 1):
        result[f"s{number}_land_{table}"] = f"{shared}{_landed(table)}"
    result["s5_load_increment_twice"] = (
        f"{shared} select *, cast(date_trunc('month', date) as date) as month from user_logs")
    result["s5_load_manifest"] = f"""{shared}, {_LOADS}
select load, month, held, rows, cast(sum(rows) over (partition by month) as bigint) as stored_rows,
  2::integer as entry from loads"""
    result["s6_reconcile_store"] = f"""{shared}, {_LOADS}
select month, cast(sum(rows) as bigint) as found_rows, cast(sum(rows) as bigint) as wanted_rows, true as same
from loads group by month"""
    result["s6_reconcile_fingerprints"] = f"""{shared}
select cast(date_trunc('month', date) as date) as month, count(*) as found_rows, count(*) as wanted_rows,
  not bool_or(day(date) <= 2) as same from user_logs group by 1"""
    result["b1_latest_at_month_ends"] = f"""{shared}
select cut, t.* from (select cast(unnest(generate_series(date '1999-02-01', date '2001-01-01',
                                           interval 1 month)) - interval 1 day as date) as cut) c
join transactions t on t.transaction_date <= c.cut
qualify row_number() over (
  partition by cut, msno
  order by transaction_date desc, membership_expire_date desc, payment_plan_days desc,
           plan_list_price desc, actual_amount_paid desc, is_auto_renew desc,
           payment_method_id desc, is_cancel) = 1"""
    moved = """cast(strftime(transaction_date, '%Y%m%d') as integer) as raw_transaction_date,
    cast(strftime(membership_expire_date, '%Y%m%d') as integer) + 1300 as raw_membership_expire_date"""
    result["c1_split_transactions"] = f"""with {tables}{ODD},
spoilt as (
  select o.*, t.raw_transaction_date, t.raw_membership_expire_date,
         o.payment_method_id is not distinct from 2 and o.is_cancel = 1 as bad
  from (select *, row_number() over () as n from odd_transactions) o
  positional join (select {moved} from transactions) t)
select msno, payment_method_id, payment_plan_days, plan_list_price, actual_amount_paid, is_auto_renew,
  case when not bad then transaction_date end as transaction_date,
  case when not bad then membership_expire_date end as membership_expire_date, is_cancel,
  case when bad then 'membership_expire_date' end as reasons,
  case when bad then raw_transaction_date end as raw_transaction_date,
  case when bad then raw_membership_expire_date end as raw_membership_expire_date
from spoilt"""
    result["c7_split_user_logs"] = f"""with {tables}{ODD}
select msno, case when num_unq not in (5, 6) then date end as date, num_25, num_50, num_75, num_985, num_100,
  num_unq, case when num_unq in (5, 6) then 'total_secs' end as reasons,
  case when num_unq in (5, 6) then cast(strftime(date, '%Y%m%d') as integer) end as raw_date
from odd_logs"""
    result["a25_repeated_plans"] = f"""{shared}
select msno, payment_plan_days, count(*) as payments,
  {_pct('sum(is_auto_renew)', 'count(*)')} as pct_auto_renew
from transactions group by msno, payment_plan_days having count(*) > 2"""
    result["s7_publish_features"] = " union all ".join(
        f"select * from ({_in_windows(_FEATURES, tables)}) where \"window\" = '{name}'"
        for name in ("quarter", "within"))
    result["r14_test_vs_control_interval"] = f"""{shared},
arms as (
  select count(*) filter (test) as n1, coalesce(sum(is_churn) filter (test), 0) as x1,
         count(*) filter (not test) as n2, coalesce(sum(is_churn) filter (not test), 0) as x2,
         1.959963984540054::double as z
  from (select is_churn, md5(msno) < '8' as test from features where payment_plan_days > 30)),
ends as (
  select *, x1 / n1 as p1, x2 / n2 as p2,
    (2 * x1 + z * z - z * sqrt(z * z + 4 * x1 * (1 - x1 / n1))) / (2 * (n1 + z * z)) as low1,
    (2 * x1 + z * z + z * sqrt(z * z + 4 * x1 * (1 - x1 / n1))) / (2 * (n1 + z * z)) as high1,
    (2 * x2 + z * z - z * sqrt(z * z + 4 * x2 * (1 - x2 / n2))) / (2 * (n2 + z * z)) as low2,
    (2 * x2 + z * z + z * sqrt(z * z + 4 * x2 * (1 - x2 / n2))) / (2 * (n2 + z * z)) as high2
  from (select n1::double as n1, x1::double as x1, n2::double as n2, x2::double as x2, z from arms))
select n1::bigint as test_users, n2::bigint as control_users, round(100 * (p2 - p1), 4) as gap,
  round(100 * (p2 - p1 - sqrt(pow(p2 - low2, 2) + pow(high1 - p1, 2))), 4) as gap_low,
  round(100 * (p2 - p1 + sqrt(pow(high2 - p2, 2) + pow(p1 - low1, 2))), 4) as gap_high
from ends"""
    result["p_members_in_one_pass"] = f"{shared} {_ONE_PASS}"
    result["q_population_checks"] = f"{shared} {_population()}"
    for name, query in (("u1_user_features_by_months", "u1_user_features"),
                        ("b4_active_days_by_months", "b4_active_days_clipped"),
                        ("a13b_engagement_tiers_by_months", "a13b_engagement_tiers")):
        result[name] = _in_windows(_SELECTS[query], tables)
    result["a26_retention_scenario"] = f"{shared},\n{_scenario('cohort')}\n{_SCENARIO_LINES}"
    rate = "(select {} / 100.0::double from cohort where plan_type = 'Monthly' and is_auto_renew = {})"
    best, safe = (rate.format(_RATE, auto) for auto in (1, 0))
    result["a26_observed_scenario"] = f"{shared},\n{_scenario('cohort', best, safe)}\n{_SCENARIO_LINES}"
    result["a26t_retention_scenario_total"] = (
        result["a26_retention_scenario"] + " where plan_type = 'TOTAL'"
    )
    result["r9_features_revenue"] = f"""{shared},\n{_scenario('features')}
select plan_type, users, round(today) as revenue_today_usd,
       round(kept_best) as users_retained_optimistic,
       round(gain_best) as revenue_gain_optimistic_usd,
       round(today + gain_best) as revenue_optimistic_usd,
       round(kept_safe) as users_retained_conservative,
       round(gain_safe) as revenue_gain_conservative_usd,
       round(today + gain_safe) as revenue_conservative_usd
from scenario_lines"""
    return result
