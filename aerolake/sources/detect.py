"""Format detection and safe-path rules over Spark's ``binaryFile`` rows (path, length, content)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic bytes and lines of the log formats; fixed values.
DATAFLASH_MAGIC = bytes([0xA3, 0x95])
BLACKBOX_MAGIC = b"H Product:Blackbox flight data recorder by Nicholas Sherlock"
ULOG_MAGIC = b"ULog\x01\x12\x35"
TEXT_MARKS = ("FMT", "IMU", "PARM")
#: Microseconds since 1970 of the first days of 2005 and 2100; fixed values.
EARLIEST_US, LATEST_US = 1_104_537_600_000_000, 4_102_444_800_000_000
EXTENSIONS = ("bin", "log", "tlog", "bbl", "bfl", "txt", "ulg", "ulog")
MOST_BYTES = 300 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def log_format(path: Column, content: Column) -> Column:
    """dataflash, dataflash_text, telemetry, blackbox, ulog or null: the first format, in this order, that name and head fit."""
    ext = extension(path)
    head = lambda n: F.substring(content, 1, n)
    text = F.decode(head(1024), "ISO-8859-1")
    stamp = F.conv(F.hex(head(8)), 16, 10).cast("decimal(20,0)")
    marker = F.hex(F.substring(content, 9, 1))
    marked = F.lit(False)
    for mark in TEXT_MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    return (
        F.when((ext == "bin") & (head(2) == F.lit(DATAFLASH_MAGIC)), "dataflash")
        .when((ext == "log") & marked, "dataflash_text")
        .when((ext == "tlog") & marker.isin("FE", "FD") & stamp.between(EARLIEST_US, LATEST_US), "telemetry")
        .when(ext.isin("bbl", "bfl", "txt") & F.contains(F.decode(head(64), "ISO-8859-1"), F.lit(BLACKBOX_MAGIC[:9].decode())), "blackbox")
        .when(ext.isin("ulg", "ulog") & (head(7) == F.lit(ULOG_MAGIC)), "ulog")
    )


def is_safe(path: Column, length: Column, roots: Sequence[str], extensions: Sequence[str] = EXTENSIONS, most_bytes: int = MOST_BYTES) -> Column:
    """A known extension, no parent steps, under an allowed root, not too large. Checked on metadata, before content is read."""
    plain = F.regexp_replace(path, "^file:/*", "/")
    under = F.lit(False)
    for root in roots:
        under = under | F.startswith(plain, F.lit(root.rstrip("/") + "/"))
    return extension(path).isin(*extensions) & ~F.concat(plain, F.lit("/")).contains("/../") & under & (length <= most_bytes)


def detect(spark: SparkSession, pattern: str, roots: Sequence[str], most_bytes: int = MOST_BYTES, head_bytes: int = 1024) -> DataFrame:
    """path, length, format of the files that may be read; others are left out. Only the head of a file on a disk is read; of other file systems Spark brings the content."""
    from aerolake.sources import files

    rows = files.listed(spark, pattern, roots, most_bytes=most_bytes).where("problem is null")
    on_disk = F.col("path").startswith("file:") | F.col("path").startswith("/")

    def head(path: str) -> bytes:
        with open(files.local_path(path), "rb") as file:
            return file.read(head_bytes)

    read = F.udf(head, "binary")  # a row a file
    disk = rows.where(on_disk).select("path", "length", log_format(F.col("path"), read("path")).alias("format"))
    return disk.unionByName(rows.where(~on_disk).select("path", "length", log_format(F.col("path"), F.col("content")).alias("format")))
