"""Landing of delivered CSV files: rows that fit and lines that don't, told apart in one pass.

A line that can't be read under the declared schema is neither dropped nor the end of the job. It is
kept with its file, its text and a reason, beside the rows that fit. Columns are found by the names in
each file's header, so a reordered file, or one with columns nobody declared, is read rightly.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..operators.clean import value_reasons
from .schemas import RAW
from .tables import blank_texts

FILE, TEXT, REASON = "reject_file", "reject_text", "reject_reason"
REJECTED = "rejected"
#: Reasons: a line that doesn't parse under the declared types, a file that lacks a column, and, followed
#: by columns, values that cleaning can't keep.
BAD_LINE, BAD_HEADER, BAD_VALUE = "line", "header", "value"
_REJECT = [StructField(name, StringType()) for name in (FILE, TEXT, REASON)]
_AT_ONCE = 16


def read_delivery(spark: SparkSession, paths: str | Sequence[str], table: str,
                  line_breaks: bool = False) -> DataFrame:
    """The declared columns of CSV files and `reject_file`, `reject_text`, `reject_reason`, which
    are null for a row that fits; for one that doesn't, all else is null.

    Quotes inside a quoted text are doubled. `line_breaks` lets quoted texts hold line breaks;
    files can't be split between tasks then. Without it the first and last line of such a record are rejected, as
    their quotes don't pair up. A line with too few or too many fields, or a field of another type, is rejected. A
    file whose header lacks a declared column, or names one twice, is rejected line by line, its header too.
    Blank lines are no rows, nor is a header that comes again, nor files without a line.

    This is for `land`; the rejects alone can't be selected from files with line breaks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = _read_records if line_breaks else _read_lines
    parts = [
        read(spark, files, header, table) if _fits(header.names, table)
        else _refused(spark, files, table)
        for header, files in _by_header(spark, paths)
    ]
    empty = spark.createDataFrame([], StructType([*RAW[table].fields, *_REJECT]))
    return reduce(DataFrame.unionByName, parts) if parts else empty


class Header(NamedTuple):
    names: tuple[str, ...]
    line: str


def _by_header(spark: SparkSession, paths: list[str]) -> list[tuple[Header, list[str]]]:
    """The files by their header. Of each only the first line is read, without a job: the files of a
    delivery can be many thousands."""
    files = [unquote(file) for file in spark.read.text(paths).inputFiles()]
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    jvm = spark._jvm
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(hadoop)

    def header(file: str) -> Header | None:
        path = jvm.org.apache.hadoop.fs.Path(file)
        stream = path.getFileSystem(hadoop).open(path)
        codec = codecs.getCodec(path)
        stream = stream if codec is None else codec.createInputStream(stream)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if line is None:
            return None
        line = line.removeprefix("\ufeff")  # Spark's readers leave a byte order mark out as well
        return Header(tuple(name.strip() for name in next(csv.reader([line]), [])), line)

    with ThreadPoolExecutor(_AT_ONCE) as pool:
        found = defaultdict(list)
        for file, names in zip(files, pool.map(header, files)):
            if names is not None:
                found[names].append(file)
    return sorted(found.items())


def _fits(names: tuple[str, ...], table: str) -> bool:
    return len(set(names)) == len(names) and set(RAW[table].fieldNames()) <= set(names)


def _schema(header: Header, table: str) -> StructType:
    declared = {field.name: field for field in RAW[table].fields}
    # Columns nobody declared are parsed as texts, so that their content can't reject a line.
    return StructType([declared.get(name, StructField(name, StringType())) for name in header.names]
                      + [StructField(TEXT, StringType())])


_PARSING = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": TEXT, "quote": '"', "escape": '"'}


def _read_lines(spark: SparkSession, files: list[str], header: Header, table: str) -> DataFrame:
    schema = _schema(header, table)
    names = RAW[table].fieldNames()
    lines = spark.read.text(files).filter((F.col("value") != header.line) & (F.trim("value") != ""))
    row = F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), _PARSING)
    paired = F.char_length(F.regexp_replace("value", '[^"]', "")) % 2 == 0
    parsed = lines.select(row.alias("row"), "value", paired.alias("paired"),
                          F.col("_metadata.file_path").alias(FILE))
    fits = F.col("paired") & F.col(f"row.{TEXT}").isNull()
    return _told_apart(blank_texts(parsed.select(
        *[F.col(f"row.{name}").alias(name) for name in names], FILE, F.col("value").alias(TEXT),
        fits.alias("fits"))), names)


def _read_records(spark: SparkSession, files: list[str], header: Header, table: str) -> DataFrame:
    df = spark.read.schema(_schema(header, table)).csv(files, header=True, multiLine=True, **_PARSING)
    names = RAW[table].fieldNames()
    return _told_apart(blank_texts(df.select(
        *names, F.col("_metadata.file_path").alias(FILE), TEXT, F.col(TEXT).isNull().alias("fits"))), names)


def _told_apart(rows: DataFrame, names: list[str]) -> DataFrame:
    """What could be parsed of a rejected line is dropped: it is in its text."""
    fits = F.col("fits")
    return rows.select(
        *[F.when(fits, F.col(name)).alias(name) for name in names],
        *[F.when(~fits, F.col(name)).alias(name) for name in (FILE, TEXT)],
        F.when(~fits, F.lit(BAD_LINE)).alias(REASON))


def _refused(spark: SparkSession, files: list[str], table: str) -> DataFrame:
    lines = spark.read.text(files).filter("value <> ''")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in RAW[table].fields]
    return lines.select(*none, F.col("_metadata.file_path").alias(FILE),
                        F.col("value").alias(TEXT), F.lit(BAD_HEADER).alias(REASON))


def reject_values(delivery: DataFrame, table: str) -> DataFrame:
    """A delivery in which rows with a value that cleaning can't keep are rejected too, with the
    columns as reason and the row as text, instead of losing the value."""
    names = RAW[table].fieldNames()
    reasons = F.when(F.col(REASON).isNull(), value_reasons(table)).otherwise("")
    marked = delivery.withColumn("reasons", reasons)
    bad = F.col("reasons") != ""
    return marked.select(
        *[F.when(~bad, F.col(c)).alias(c) for c in names], FILE,
        F.when(bad, F.to_csv(F.struct(*names), {"escape": '"'})).otherwise(F.col(TEXT)).alias(TEXT),
        F.when(bad, F.concat(F.lit(f"{BAD_VALUE}:"), "reasons")).otherwise(F.col(REASON)).alias(REASON))


@dataclass
class Landed:
    """`rows` of the declared schema, and `rejects`: file, text, reason."""

    table: str
    rows: DataFrame
    rejects: DataFrame

    def rejected_share(self) -> tuple[int, int]:
        """Rejected lines and all lines."""
        rejected, rows = self.rejects.count(), self.rows.count()
        return rejected, rejected + rows

    def require_few_rejects(self, most: float) -> None:
        """Raises, with where they are, when more than the share `most` of all lines is rejected."""
        rejected, lines = self.rejected_share()
        if rejected <= most * lines:
            return
        worst = (self.rejects.groupBy(FILE, REASON).agg(F.count(F.lit(1)).alias("lines"))
                 .orderBy(F.desc("lines"), FILE).limit(5).collect())
        where = "; ".join(f"{r[FILE]}: {r.lines} ({r[REASON]})" for r in worst)
        raise ValueError(f"{self.table}: {rejected} of {lines} lines rejected, most in {where}")


def land(delivery: DataFrame, path: str, table: str) -> Landed:
    """Write a delivery as Parquet, rows and rejects in a folder each, by one job that reads the
    files once, and open both."""
    marked = delivery.withColumn(REJECTED, F.col(REASON).isNotNull())
    marked.write.mode("errorifexists").partitionBy(REJECTED).parquet(path)
    return open_landed(delivery.sparkSession, path, table)


def open_landed(spark: SparkSession, path: str, table: str) -> Landed:
    schema = StructType([*RAW[table].fields, *_REJECT, StructField(REJECTED, BooleanType())])
    both = spark.read.schema(schema).parquet(path)
    return Landed(table, both.filter(~F.col(REJECTED)).select(RAW[table].fieldNames()),
                  both.filter(REJECTED).select(FILE, TEXT, REASON))
