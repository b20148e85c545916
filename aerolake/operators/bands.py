"""Bands, levels and rated scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (upper bound, label) of accelerometer vibration in m/s2 RMS, by platform; fixed values. Beyond the last bound: the last label.
VIBRATION = {
    "ardupilot": [(15.0, "EXCELLENT"), (30.0, "GOOD"), (60.0, "MARGINAL"), (100.0, "POOR"), (float("inf"), "UNUSABLE")],
    "betaflight": [(3.0, "EXCELLENT"), (8.0, "GOOD"), (15.0, "MARGINAL"), (30.0, "POOR"), (float("inf"), "UNUSABLE")],
    "other": [(0.5, "EXCELLENT"), (1.0, "GOOD"), (3.0, "MARGINAL"), (10.0, "POOR"), (float("inf"), "UNUSABLE")],
}
#: (lower bound, label) of a quality score; fixed values.
RATINGS = [(90.0, "EXCELLENT"), (75.0, "GOOD"), (55.0, "MARGINAL"), (float("-inf"), "POOR")]
#: (upper bound, label) of the residual of a magnetometer calibration in mGauss; fixed values.
FITNESS = [(5.0, "EXCELLENT"), (15.0, "GOOD"), (30.0, "ACCEPTABLE"), (50.0, "MARGINAL"), (100.0, "POOR"), (float("inf"), "BAD")]
#: From worst to best; fixed values.
ASSESSMENTS = ["UNUSABLE", "POOR", "MARGINAL", "GOOD", "EXCELLENT"]


def level_below(value: Column, bounds: Sequence[tuple[float, str]]) -> Column:
    """Label of the first band whose upper bound ``value`` stays under; past them all the last one."""
    out = F.lit(bounds[-1][1])
    for upper, label in reversed(bounds[:-1]):
        out = F.when(value < upper, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def level_from(value: Column, bounds: Sequence[tuple[float, str]]) -> Column:
    """Label of the first band whose lower bound ``value`` reaches."""
    out = F.lit(bounds[-1][1])
    for lower, label in reversed(bounds[:-1]):
        out = F.when(value >= lower, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def rank_of(label: Column) -> Column:
    """0 for the worst assessment."""
    return F.array_position(F.array(*map(F.lit, ASSESSMENTS)), label) - 1
