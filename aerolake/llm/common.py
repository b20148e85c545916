"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``[\x20\x09-\x0D]`` matches, the white space of every word and line rule here.
SPACE = " \t\n\x0b\x0c\r"

#: Rows of (id, small payload) that may be broadcast after they were counted; more rows are joined by shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 8 << 20) -> SparkSession:
    """From now on Python workers of this session get texts in Arrow batches of about ``size`` bytes, which bounds their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return spark


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model here may learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine alone, where it is unset, one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


_collectors: list[list[DataFrame]] = []


@contextmanager
def written_tables() -> Iterator[list[DataFrame]]:
    """A list that gets every table that is materialized inside, so that a caller can ``release`` those it does not need."""
    own: list[DataFrame] = []
    _collectors.append(own)
    try:
        yield own
    finally:
        _collectors.remove(own)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder: lineage ends here, so a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.written_to = path
    for own in _collectors:
        own.append(written)
    return written


def release(*tables: DataFrame | None) -> None:
    """Delete materialized tables that no later job reads."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_key(text: str = "text") -> Column:
    """128-bit hash of a text, null for null: with the doc_id it tells rows apart that differ."""
    return F.md5(F.col(text).cast("binary"))


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` if its counted rows stay within ``limit``; else both sides are shuffled, and skewed partitions split at run time."""
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= limit else right, on, how)


def row_keys(rows: DataFrame, key: str) -> DataFrame:
    """doc_id and ``key`` (the text's hash) of rows, written out, as ``by_row`` takes them."""
    return materialize(rows.select(F.col("doc_id").alias("_row_id"), F.col(key).alias("_row_key")))


def by_row(documents: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents to ``row_keys``: rows with one id, or none, are told apart by their texts."""
    right = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    same = documents["doc_id"].eqNullSafe(right["_row_id"]) & F.md5(documents["text"].cast("binary")).eqNullSafe(right["_row_key"])
    return documents.join(right, same, how)


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
