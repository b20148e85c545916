"""Alignment of series that are sampled at different times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate_at(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], tie: str) -> DataFrame:
    """``left`` with ``values`` of ``right`` interpolated at its times; before the first and after the last they hold.

    Both sides meet in one union sorted by time, in which the nearest right row on either side is carried along: one
    shuffle by key, no join by inequality. ``tie`` orders left rows at the same time. Series without right rows give null.
    """
    point = F.struct(F.col(time).alias("t"), *(F.col(v).alias(v) for v in values))
    own = left.select(*keys, time, tie, F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(point.alias("p")).schema["p"].dataType).alias("_p"))
    order = Window.partitionBy(*keys).orderBy(time)
    back, ahead = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    # Of right rows at one time the one with the largest values stands for all, whatever their order.
    other = right.groupBy(*keys, time).agg(F.max(point).alias("_p")).select(*keys, time, F.lit(None).cast(left.schema[tie].dataType).alias(tie), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), "_p")
    met = own.unionByName(other).withColumns({"_b": F.last("_p", True).over(back), "_a": F.first("_p", True).over(ahead)}).where(F.col("_row").isNotNull())
    share = F.coalesce(F.try_divide(F.col(time) - F.col("_b.t"), F.col("_a.t") - F.col("_b.t")), F.lit(0.0))
    lerp = {v: F.when(F.col("_b").isNull(), F.col(f"_a.{v}")).when(F.col("_a").isNull(), F.col(f"_b.{v}")).otherwise(F.col(f"_b.{v}") + (F.col(f"_a.{v}") - F.col(f"_b.{v}")) * share) for v in values}
    return met.select("_row.*", *(c.alias(v) for v, c in lerp.items()))


def reconcile_clocks(rows: DataFrame, keys: Sequence[str], wall: str, vehicle: str) -> DataFrame:
    """``offset`` = median(wall - vehicle) of a key's rows that have both clocks; ``t``: the vehicle clock, or the wall clock less the offset."""
    offsets = rows.where(F.col(vehicle).isNotNull()).groupBy(*keys).agg(F.median(F.col(wall) - F.col(vehicle)).alias("offset"))
    return rows.join(offsets, list(keys), "left").withColumn("t", F.coalesce(F.col(vehicle), F.col(wall) - F.col("offset"), F.col(wall)))
