"""The four logical tables derived from the generated star schema.

The mapping (rules and test calendar) is described in FIXTURES.md. It stands in for data that
cannot be shipped: customers become subscribers, orders payments, line items and events usage.
No row is left out. Users for whom something is missing are added: parts have a member row but
no payment, suppliers a payment but no member row, nations neither.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalysisConfig
from ..operators.clean import blank_to_null, clean_table, null_out_of_range
from ..session import scratch_path
from .schemas import CLEAN, DATE_COLUMNS, RAW, conform
from .tables import Tables, union_usage

CONFIG = AnalysisConfig(
    cut=date(2000, 12, 31),
    win_start=date(2000, 10, 1),
    win_end=date(2000, 12, 31),
)

# Fixed values of the mapping.
CHURN_HORIZON = date(2001, 6, 29)
REGISTRATION_EPOCH = date(2000, 1, 1)
EVENTS_EPOCH = date(2024, 1, 1)
EVENTS_SHIFTED_TO = date(2000, 12, 1)
REGISTRATION_METHODS = (3, 4, 7, 9, 13)
PLAN_DAYS = (0, 7, 30, 30, 30, 90, 180, 410)
EVENT_COUNTERS = {
    "num_25": "error", "num_50": "view", "num_75": "click", "num_985": "signup",
    "num_100": "purchase",
}


class StarSchema:
    """Builds the logical tables of one folder of generated Parquet files."""

    def __init__(self, spark: SparkSession, folder: str, cfg: AnalysisConfig = CONFIG):
        self.spark, self.folder, self.cfg = spark, folder, cfg
        self._opened: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    def train(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        returning = (
            self._read("orders")
            .filter((day > F.lit(self.cfg.cut)) & (day <= F.lit(CHURN_HORIZON)))
            .select(F.col("o_custkey").alias("c_custkey"), F.lit(0).alias("stayed"))
            .distinct()
        )
        customers = self._read("customer").join(returning, "c_custkey", "left").select(
            _user("", "c_custkey"), F.coalesce("stayed", F.lit(1)).alias("is_churn"))
        added = [
            self._read(table).select(_user(table[0], key), left.cast("int").alias("is_churn"))
            for table, key, left in (
                ("part", "p_partkey", F.col("p_size") <= 25),
                ("supplier", "s_suppkey", F.col("s_acctbal") < 0),
                ("nation", "n_nationkey", F.col("n_regionkey") % 2 == 1),
            )
        ]
        return reduce(DataFrame.unionByName, added, customers)

    def members(self) -> DataFrame:
        customers = self._read("customer").select(
            _user("", "c_custkey"),
            F.col("c_nationkey").cast("int").alias("city"),
            F.floor(F.col("c_acctbal") / 100).cast("int").alias("bd"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "")
            .when(F.col("c_custkey") % 2 == 0, "male").otherwise("female").alias("gender"),
            _pick(REGISTRATION_METHODS, F.col("c_nationkey") % 5).alias("registered_via"),
            _spread(F.col("c_custkey")).alias("registration_init_time"),
        )
        parts = self._read("part").select(
            _user("p", "p_partkey"),
            F.pmod("p_size", F.lit(25)).cast("int").alias("city"),
            F.floor(F.col("p_retailprice") / 20).cast("int").alias("bd"),
            F.when(F.col("p_type") == "PROMO", "").otherwise("female").alias("gender"),
            _pick(REGISTRATION_METHODS, F.col("p_size") % 5).alias("registered_via"),
            _spread(F.col("p_partkey")).alias("registration_init_time"),
        )
        return customers.unionByName(parts)

    def transactions(self) -> DataFrame:
        orders = self._read("orders").select(
            _user("", "o_custkey"), F.col("o_orderkey").alias("number"),
            F.floor(F.col("o_totalprice") / 250).cast("int").alias("price"),
            F.to_date("o_orderdate").alias("transaction_date"),
            (F.col("o_orderpriority") == "5-LOW").alias("cancelled"),
            (F.col("o_orderstatus") != "P").alias("renewable"),
        )
        suppliers = self._read("supplier").select(
            _user("s", "s_suppkey"), F.col("s_suppkey").alias("number"),
            F.floor(F.abs("s_acctbal") / 25).cast("int").alias("price"),
            _spread(F.col("s_suppkey")).alias("transaction_date"),
            (F.col("s_nationkey") % 5 == 0).alias("cancelled"),
            F.lit(True).alias("renewable"),
        )
        number, plan = F.col("number"), F.col("payment_plan_days")
        paid_days = F.when(F.col("cancelled"), F.floor(plan / 2).cast("int")).otherwise(
            plan + F.when(number % 4 == 3, 60).otherwise(0))
        return orders.unionByName(suppliers).withColumn(
            "payment_plan_days", _pick(PLAN_DAYS, number % 8)
        ).select(
            "msno", (number % 5).cast("int").alias("payment_method_id"), "payment_plan_days",
            F.col("price").alias("plan_list_price"), F.col("price").alias("actual_amount_paid"),
            F.when((plan == 30) & F.col("renewable"), 1).otherwise(0).alias("is_auto_renew"),
            "transaction_date",
            F.date_add("transaction_date", paid_days).alias("membership_expire_date"),
            F.col("cancelled").cast("int").alias("is_cancel"),
        )

    def usage_full(self) -> DataFrame:
        quantity = F.col("l_quantity").cast("int")
        returned, status = F.col("l_returnflag"), F.col("l_linestatus")
        plays = {
            "num_25": quantity % 7,
            "num_50": F.when(returned == "A", quantity % 3).otherwise(0),
            "num_75": F.when(returned == "R", quantity % 2).otherwise(0),
            "num_985": F.lit(0),
            "num_100": F.when((returned == "N") & (status == "O"), quantity % 11).otherwise(0),
        }
        owners = self._read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return self._read("lineitem").join(owners, "l_orderkey").select(
            F.col("o_custkey").cast("string").alias("msno"),
            F.to_date("l_shipdate").alias("date"),
            *[count.alias(name) for name, count in plays.items()],
            F.col("l_linenumber").cast("int").alias("num_unq"),
            (F.col("l_extendedprice") / 7).alias("total_secs"),
        )

    def usage_increment(self) -> DataFrame:
        shift = (EVENTS_SHIFTED_TO - EVENTS_EPOCH).days
        return self._read("events").select(
            F.col("user_id").cast("string").alias("msno"),
            F.date_add(F.to_date("ts"), shift).alias("date"),
            *[
                F.when(F.col("event_type") == kind, 1).otherwise(0).alias(name)
                for name, kind in EVENT_COUNTERS.items()
            ],
            F.lit(1).alias("num_unq"),
            (F.col("value") / 7).alias("total_secs"),
        )

    def user_logs(self) -> DataFrame:
        return union_usage(self.usage_full(), self.usage_increment())

    def _typed(self, table: str) -> DataFrame:
        """The rows before cleaning, dates already as dates."""
        return getattr(self, table)()

    def raw(self, table: str) -> DataFrame:
        """The table as delivered: dates as yyyyMMdd or epoch-millisecond integers."""
        name = _logical(table)
        encode = _as_epoch_ms if name == "members" else _as_yyyymmdd
        df = self._typed(table)
        return conform(
            df.withColumns({c: encode(F.col(c)) for c in DATE_COLUMNS[name]}), RAW[name]
        )

    def clean(self, table: str) -> DataFrame:
        """What cleaning the raw table gives, without the detour over integers: dates stay
        dates, so date filters reach the Parquet scan."""
        name, df = _logical(table), self._typed(table)
        if name == "members":
            df = null_out_of_range(df, "bd", self.cfg.age_min, self.cfg.age_max)
            df = blank_to_null(df, "gender")
        return conform(df, CLEAN[name])


    def deliver(self, table: str, path: str) -> None:
        """Write the raw table as CSV files below `path`, every row once, as deliveries come: plain;
        with columns in another order and one nobody declared; with quotes and line breaks in texts; with
        lines that don't fit; and without the last column. The last character of the user decides. The
        table is stored first, so that its joins run once and not for each kind."""
        stored = scratch_path(self.spark, f"raw-{table}")
        self.raw(table).write.parquet(stored)
        df = self.spark.read.schema(RAW[table]).parquet(stored)
        names = df.columns
        kind = F.ascii(F.substring("msno", -1, 1)) % 5
        text = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
                "ignoreTrailingWhiteSpace": False}

        def part(number: int) -> DataFrame:
            return df.filter(kind == number)

        def lines(columns: list[str]) -> Column:
            """Plain text, seconds as whole numbers: engines write fractions differently."""
            whole = {c: F.floor(c) if c == "total_secs" else F.col(c) for c in columns}
            return F.concat_ws(",", *[F.coalesce(whole[c].cast("string"), F.lit("")) for c in columns])

        def write_lines(line: DataFrame, header: list[str], folder: str) -> None:
            # Named as the header, and with a separator that no line has, lines are written as they are.
            line.toDF(",".join(header)).write.csv(f"{path}/{folder}", header=True, sep="\x01")

        part(0).write.options(**text).csv(f"{path}/plain")
        part(1).select(F.lit('n, "q"').alias("note"), *reversed(names)).write.options(**text).csv(
            f"{path}/reordered")
        part(2).withColumn("msno", F.concat(F.lit('"'), "msno", F.lit('",\nx'))).write.options(
            **text).csv(f"{path}/quoted")
        spoilt = part(3)
        mistyped = F.concat_ws(",", "msno", F.lit("n/a"), *([lines(names[2:])] if names[2:] else []))
        too_long = F.concat(lines(names), F.lit(",extra"))
        write_lines(part(3).select(
            F.when(F.col("msno").endswith("0"), mistyped).otherwise(too_long)), names, "damaged")
        write_lines(part(4).select(lines(names[:-1])), names[:-1], "headless")

    def odd(self, table: str) -> DataFrame:
        """The raw table with what real deliveries have: some users missing or listed twice, days
        that don't exist, genders missing, a month without usage, readings that are not numbers,
        and renewals on longer plans. Values change, and rows are added; none is left out."""
        df = self.raw(table)
        method, cancelled = F.col("payment_method_id"), F.col("is_cancel") == 1
        if table == "transactions":
            expires = F.col("membership_expire_date")
            return df.withColumns({
                "msno": F.when((method != 3) | ~cancelled, F.col("msno")),
                "membership_expire_date": F.when(
                    (method == 2) & cancelled, expires + 1300).otherwise(expires),
                "is_auto_renew": F.when(
                    (method == 1) & F.col("payment_plan_days").isin(90, 180), 1
                ).otherwise(F.col("is_auto_renew")),
            })
        if table == "members":
            via = F.col("registered_via")
            lost = df.withColumn("gender", F.when(via != 13, F.col("gender")))
            return lost.unionByName(lost.filter(via == 3)).withColumn(
                "msno", F.when((via != 4) | (F.col("bd") > 0), F.col("msno")))
        if table == "train":
            nations = F.col("msno").startswith("n")
            return df.unionByName(df.filter(nations)).unionByName(
                df.filter(nations).withColumn("msno", F.lit(None).cast("string")))
        number = F.col("num_unq")
        march = F.col("date").between(19970301, 19970331)
        return df.withColumns({
            "msno": F.when((number != 7) | (F.col("num_25") != 6), F.col("msno")),
            "date": F.when(march, F.least(F.col("date") + 100, F.lit(19970430))).otherwise(F.col("date")),
            "total_secs": F.when(number == 5, F.lit(float("nan")))
            .when(number == 6, F.lit(float("inf"))).otherwise(F.col("total_secs")),
        })

    def odd_clean(self, table: str) -> DataFrame:
        return clean_table(self.odd(table), table, self.cfg)


def _logical(table: str) -> str:
    return "user_logs" if table.startswith("usage_") else table


def _user(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string")).alias("msno")


def _spread(key: Column) -> Column:
    return F.date_add(F.lit(REGISTRATION_EPOCH), (key * 37 % 400).cast("int"))


def star_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(StarSchema(spark, folder).clean)


def _pick(values: tuple[int, ...], position: Column) -> Column:
    cases = enumerate(values[:-1])
    return reduce(
        lambda chain, case: chain.when(position == case[0], case[1]), cases, F
    ).otherwise(values[-1])


def _as_yyyymmdd(day: Column) -> Column:
    return (F.year(day) * 10_000 + F.month(day) * 100 + F.day(day)).cast("int")


def _as_epoch_ms(day: Column) -> Column:
    return F.unix_date(day).cast("bigint") * 86_400_000
