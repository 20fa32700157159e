"""Intermediate tables in the shared folder, and helpers for Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id tables of at most so many bytes are sent to every executor; larger ones are joined by shuffle.
SMALL_BYTES = 16_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text that one step of a task holds as arrays.
SLICE_BYTES = 4 << 20


def workers_import_package(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package when it is not installed; on a
    cluster it comes with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where it is unset, a local session gets one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        folder = Path(tempfile.gettempdir(), "checkpoints").as_uri()
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: lineage ends there, and any
    executor can read it after others are lost."""
    spark, path = df.sparkSession, _fresh_path(df.sparkSession, name)
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save_by_key(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like `save`, in buckets of the key: joins and groups by it shuffle the other side only."""
    spark, path = df.sparkSession, _fresh_path(df.sparkSession, name)
    table = path.rpartition("/")[2].replace("-", "_")
    with _shuffles_deleted(spark):
        (df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path)
         .format("parquet").saveAsTable(table))
    return spark.table(table)


def discard(saved: DataFrame) -> None:
    """Delete a table of `save` that nothing will read again."""
    spark = saved.sparkSession
    for folder in {file.rpartition("/")[0] for file in saved.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """A write's shuffle files have served their purpose when it is done."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def if_small(ids: DataFrame, rows: int | None = None, width: int = 16) -> DataFrame:
    """Mark a narrow, saved table for broadcast if its counted rows, of at most `width` bytes each,
    are few; else leave it."""
    rows = ids.count() if rows is None else rows
    return F.broadcast(ids) if rows * width <= SMALL_BYTES else ids


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Null counts as empty; only A-Z change."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins and the last ends; null is empty."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.binary())
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `limit` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
        ends, low = np.cumsum(sizes.astype(np.int64)), 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(low, high - low)
            low = high
