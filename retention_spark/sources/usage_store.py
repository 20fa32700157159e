"""The stored usage: deliveries loaded side by side, and a manifest that says which rows count.

    STORE/rows/month=2017-03-01/load=march/held=2/part-...    cleaned usage
    STORE/months/month=2017-03-01/held=2/part-...             the same per user, see operators.monthly
    STORE/manifest/entry=2/part-...                           every load's months and fingerprints

A load writes folders of its own number for the months that it changes, reads them back, compares
fingerprints with the delivery's, and only then writes its manifest entry. Until then readers see the entry
before, whole; earlier entries stay readable. A delivery loaded again under its name changes nothing where it
is the same, and takes the place of the earlier rows where it isn't. A load that broke off counts for
nothing, and repeating it overwrites what it left. One writer at a time is assumed.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from ..operators import monthly
from ..operators.fingerprint import PARTS, added, compared, fingerprint
from ..session import path_exists
from .schemas import CLEAN, conform
from .tables import MONTH

LOAD, HELD, ENTRY = "load", "held", "entry"
_COLUMNS = CLEAN["user_logs"].fieldNames()
_ROWS = StructType([*CLEAN["user_logs"].fields, StructField(MONTH, DateType()),
                    StructField(LOAD, StringType()), StructField(HELD, IntegerType())])
_STATE = f"{LOAD} string, {MONTH} date, {HELD} int, rows bigint, hash_high bigint, " \
         "hash_low bigint, hash_xor bigint"


class Part(NamedTuple):
    """A load's rows of one month, and the entry whose folders hold them; rows is 0 where the load
    has had rows of that month and has none any more."""

    load: str
    month: date | None
    held: int
    rows: int
    hash_high: int
    hash_low: int
    hash_xor: int

    @property
    def print(self) -> tuple[int, ...]:
        return self[3:]


@dataclass(frozen=True)
class Loaded:
    """The months whose rows a load changed, and the manifest entry, none where nothing did."""

    load: str
    months: list[date | None]
    entry: int | None


class UsageStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Reading

    def manifest(self) -> DataFrame:
        """Every entry: the parts that count from it on, until the next."""
        if not path_exists(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], f"{_STATE}, {ENTRY} int")
        return self.spark.read.schema(f"{_STATE}, {ENTRY} int").parquet(f"{self.path}/manifest")

    def last_entry(self) -> int:
        return self.manifest().agg(F.max(ENTRY)).first()[0] or 0

    def parts(self, as_of: int | None = None) -> list[Part]:
        """What counts, as of an entry or the last: a row for each load and calendar month."""
        entry = self.last_entry() if as_of is None else as_of
        rows = self.manifest().filter(F.col(ENTRY) == entry).drop(ENTRY).collect()
        return sorted((Part(*r) for r in rows), key=lambda p: (p.load, _order(p.month)))

    def usage(self, as_of: int | None = None) -> DataFrame:
        """The rows that count, their month folder as a column. Other folders aren't read."""
        return self._rows(self.parts(as_of))

    def months(self, as_of: int | None = None) -> DataFrame:
        """The same rows per user and month."""
        return monthly.read(self.spark, f"{self.path}/months", _versions(self.parts(as_of)))

    def _rows(self, parts: Iterable[Part]) -> DataFrame:
        folders: dict[tuple[str, int], list[date | None]] = {}
        for p in parts:
            if p.rows:
                folders.setdefault((p.load, p.held), []).append(p.month)
        schema = StructType(_ROWS.fields[:-2])
        if not folders:
            return self.spark.createDataFrame([], schema)
        counts = reduce(lambda a, b: a | b, [
            (F.col(LOAD) == load) & (F.col(HELD) == held) & in_months(months)
            for (load, held), months in sorted(folders.items())])
        return conform(self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows").filter(counts), schema)

    # Writing

    def load(self, name: str, cleaned: DataFrame) -> Loaded:
        """Make the rows of load `name` those of `cleaned`, cleaned usage rows of any months.

        A delivery that holds, month by month, the rows of a load by another name is refused: they
        would count twice. So is one whose rows can't be read back as they were delivered.
        """
        delivered = conform(cleaned, CLEAN["user_logs"]).withColumn(MONTH, F.trunc("date", "MM"))
        wanted = {r[MONTH]: tuple(r[p] for p in PARTS)
                  for r in fingerprint(delivered, [MONTH], _COLUMNS).collect()}
        parts, entry = self.parts(), 1 + self.last_entry()
        self._refuse_twin(name, parts, wanted)
        mine = {p.month: p for p in parts if p.load == name}
        none = (0,) * len(PARTS)
        changed = sorted((m for m in {*mine, *wanted} if (mine[m].print if m in mine else none)
                          != wanted.get(m, none)), key=_order)
        if mine and not changed:
            return Loaded(name, [], None)

        new = {m: Part(name, m, entry, *wanted.get(m, none)) for m in changed}
        # A load without any row is known by a part without rows.
        new = new or {None: Part(name, None, entry, *none)}
        state = [p for p in parts if p.load != name or p.month not in new] + list(new.values())
        filled = [p for p in new.values() if p.rows]
        if filled:
            self._write(delivered.filter(in_months(p.month for p in filled)), name, entry)
            self._require_same(filled)
        monthly.write(self._rows(state).filter(in_months(new)), f"{self.path}/months", entry,
                      sum(p.rows for p in state if p.month in new))
        (self.spark.createDataFrame(state, _STATE).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/manifest/{ENTRY}={entry}"))
        return Loaded(name, changed, entry)

    def _refuse_twin(self, name: str, parts: list[Part], wanted: dict) -> None:
        others: dict[str, dict] = {}
        for p in parts:
            if p.load != name and p.rows:
                others.setdefault(p.load, {})[p.month] = p.print
        for other, prints in others.items():
            if prints == wanted:
                raise ValueError(f"{name} holds the rows of {other}, which is loaded")

    def _write(self, rows: DataFrame, name: str, entry: int) -> None:
        """Write, or after a load that broke off overwrite, the folders of one load and entry."""
        (
            rows.withColumns({LOAD: F.lit(name), HELD: F.lit(entry)})
            .hint("rebalance", F.col(MONTH)).sortWithinPartitions(MONTH, "msno", "date")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(MONTH, LOAD, HELD).parquet(f"{self.path}/rows")
        )

    def _require_same(self, parts: list[Part]) -> None:
        found = {r[MONTH]: tuple(r[p] for p in PARTS)
                 for r in fingerprint(self._rows(parts), [MONTH], _COLUMNS).collect()}
        wrong = [p.month for p in parts if found.get(p.month) != p.print]
        if wrong:
            raise ValueError(f"{parts[0].load}: stored rows differ from those delivered in {wrong}")

    # Checking

    def reconcile(self) -> DataFrame:
        """Per month: found_rows as stored, wanted_rows by the manifest, and whether the bags of
        rows are the same, by one pass over the stored rows."""
        parts = [p for p in self.parts() if p.rows]
        wanted = self.spark.createDataFrame(parts, _STATE)
        return compared(fingerprint(self._rows(parts), [MONTH], _COLUMNS), added(wanted, [MONTH]), MONTH)

    def require_reconciled(self) -> None:
        """Raises when a month's stored rows aren't those that were loaded, even if as many."""
        wrong = self.reconcile().filter("not same").orderBy(MONTH).limit(12).collect()
        if wrong:
            raise ValueError("stored usage differs from what was loaded: " + "; ".join(
                f"{r[MONTH]}: {r.found_rows} rows for {r.wanted_rows}" for r in wrong))


def in_months(months: Iterable[date | None]) -> Column:
    """Whether a row's month folder is one of these."""
    months = list(months)
    known = F.col(MONTH).isin([F.lit(m) for m in months if m is not None])
    return known | F.col(MONTH).isNull() if None in months else known


def _versions(parts: list[Part]) -> dict[date | None, int]:
    """The entry at which each month last changed."""
    found: dict[date | None, int] = {}
    for p in parts:
        found[p.month] = max(p.held, found.get(p.month, 0))
    return found


def _order(month: date | None) -> tuple[bool, date]:
    return month is not None, month or date.min
