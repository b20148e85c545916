"""Log files on any file system that Spark reads: listed by metadata, checked against safe-path rules, decoded in tasks, bad ones as error rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerolake.sources import detect

#: Codes of what can be wrong with a file; fixed values.
ERRORS = {"unsafe_path": "E1001", "too_large": "E1002", "not_readable": "E1003", "unknown_format": "E1004", "no_data": "E1005"}


class UnknownFormat(ValueError):
    """No adapter recognises a file."""


def local_path(path: str) -> str | None:
    """The plain path of a file on this machine's disk, None for other file systems."""
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def resolves_inside(path: str, roots: Sequence[str]) -> bool:
    """Whether a local path, all links followed, is a regular file under one of the roots; other file systems have no links."""
    plain = local_path(path)
    if plain is None:
        return True
    real = os.path.realpath(plain)
    return os.path.isfile(real) and any(real.startswith(os.path.realpath(root).rstrip("/") + "/") for root in roots)


def listed(spark: SparkSession, pattern: str | Sequence[str], roots: Sequence[str] | None = None, extensions: Sequence[str] = detect.EXTENSIONS, most_bytes: int = detect.MOST_BYTES) -> DataFrame:
    """path, length, content, problem (null, unsafe_path or too_large) of the files of a pattern; files without a byte are not listed. Content is read only where a later step asks for it."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length", "content")
    problem = F.when(F.col("length") > most_bytes, "too_large")
    if roots is not None:
        inside = F.udf(lambda path: resolves_inside(path, roots), "boolean")  # a row a file: links can only be followed there
        problem = F.when(~detect.is_safe(F.col("path"), F.col("length"), roots, extensions, 1 << 62) | ~inside("path"), "unsafe_path").otherwise(problem)
    return files.withColumn("problem", problem)


def decoded(files: DataFrame, decode: Callable[..., Iterator[tuple]], schema: StructType, rows: int = 2000, with_path: bool = False) -> DataFrame:
    """Rows (path, those of ``decode``, error) of every file: a file with a problem, or that cannot be decoded, gives one row with nulls and an error
    'code: reason'; what was decoded before is kept. ``schema`` names the columns of ``decode``, which takes a file's bytes, or its path and its bytes.
    """
    names = [f.name for f in schema.fields]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out_schema = f"path string, {kinds}, error string"

    def batch_of(path: str, lot: list[tuple], error: str | None, types: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*lot, strict=True)) if lot else [[] for _ in names]
        if error is not None:
            columns = [[*c, None] for c in columns]
        n = len(lot) + (error is not None)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), *(pa.array(c, types.field(k).type) for c, k in zip(columns, names, strict=True)), pa.array([None] * len(lot) + [error] * (error is not None), pa.string())], ["path", *names, "error"])

    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, problem, content in zip(batch["path"].to_pylist(), batch["problem"].to_pylist(), batch["content"], strict=True):
                if problem is not None:
                    yield batch_of(path, [], f"{ERRORS[problem]}: {problem}", types)
                    continue
                lot: list[tuple] = []
                error, any_rows = None, False
                try:
                    data = content.as_py() or b""
                    for row in decode(path, data) if with_path else decode(data):
                        lot.append(row)
                        any_rows = True
                        if len(lot) == rows:
                            yield batch_of(path, lot, None, types)
                            lot = []
                except UnknownFormat:
                    error = f"{ERRORS['unknown_format']}: unknown_format"
                except Exception as e:  # one bad file must not end the job
                    error = f"{ERRORS['not_readable']}: {type(e).__name__}: {e}"
                if error is None and not any_rows:
                    error = f"{ERRORS['no_data']}: no_data"
                if lot or error is not None:
                    yield batch_of(path, lot, error, types)

    # Content of files that will not be decoded is never read into a task.
    wanted = files.select("path", "problem", F.when(F.col("problem").isNull(), F.col("content")).alias("content"))
    return wanted.mapInArrow(run, out_schema)

