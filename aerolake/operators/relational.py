"""Lookups, layers, unions and text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.operators import series

#: Words that mark a log message as an alert; fixed values.
ALERTS = ("error", "fail", "crash", "watchdog", "reset")


def translate(rows: DataFrame, names: DataFrame, key: str, native: str, rows_in_map: int = 10_000) -> DataFrame:
    """``native`` name of each row's key from a name map of known size; a name without one passes through."""
    right = names.select(F.col(key).alias("_key"), F.col(native).alias("_native"))
    right = F.broadcast(right) if names.count() <= rows_in_map else right
    return rows.join(right, rows[key] == F.col("_key"), "left").withColumn(native, F.coalesce("_native", F.col(key).cast("string"))).drop("_key", "_native")


def merge_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """(path, value) rows of several layers, of which the last to have a path wins: path, value, layer."""
    tagged = [df.select("path", "value", F.lit(k).cast("long").alias("layer")) for k, df in enumerate(layers)]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("path").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))


def merged_maps(base: Column, over: Column) -> Column:
    """Entries of both maps, those of ``over`` where both have a key; a missing map is an empty one."""
    empty = lambda m, other: F.when(m.isNull() & other.isNotNull(), F.map_filter(other, lambda k, v: F.lit(False))).otherwise(m)
    a, b = empty(base, over), empty(over, base)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def membership(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``member``: whether their key is known, by one join."""
    flag = known.select(key).distinct().withColumn("member", F.lit(True))
    return rows.join(flag, key, "left").withColumn("member", F.coalesce("member", F.lit(False)))


def concatenate_segments(segments: Sequence[DataFrame], keys: Sequence[str], order: str) -> DataFrame:
    """Segments one after the other, columns by name; ``segment`` and a running ``idx`` of each key."""
    rows = None
    for k, segment in enumerate(segments):
        tagged = segment.withColumn("segment", F.lit(k).cast("long"))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
    return rows.withColumn("idx", F.row_number().over(series.along(keys, "segment", order)).cast("long") - 1)


def alerts(messages: DataFrame, text: str, words: Sequence[str] = ALERTS, cut: int = 80) -> DataFrame:
    """Messages that hold an alert word, whatever its case: ``word`` (the first in order of position) and the message cut short."""
    word = F.regexp_extract(F.lower(text), f"({'|'.join(words)})", 1)
    return messages.withColumn("word", word).where(F.col("word") != "").withColumn("message", F.substring(text, 1, cut))


def modules_to_run(requested: Column, capable: Column, present: Column) -> Column:
    return F.array_intersect(F.array_intersect(requested, capable), present)
