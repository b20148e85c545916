"""Step responses: window metrics, their assessment against axis limits, and rule-based recommendations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators import series

METRICS = ("rise_time_ms", "overshoot_percent", "settling_time_ms", "oscillation_count", "ss_error_percent")
#: axis: (min, max, ideal) of each of METRICS; fixed values.
LIMITS = {
    "roll": [(40, 120, 80), (0, 15, 5), (100, 350, 200), (0, 2, 0), (0, 5, 0)],
    "pitch": [(40, 150, 90), (0, 20, 8), (100, 400, 250), (0, 2, 0), (0, 5, 0)],
    "yaw": [(40, 200, 120), (0, 25, 10), (150, 600, 350), (0, 3, 1), (0, 8, 0)],
}
#: (share of the possible points, assessment); fixed values.
CUTS = [(0.85, "EXCELLENT"), (0.70, "GOOD"), (0.50, "MARGINAL"), (float("-inf"), "POOR")]
#: (symptom, its metric, gain, factor); fixed values.
RULES = [
    ("overshoot", "overshoot_percent", "p", 0.85),
    ("overshoot", "overshoot_percent", "d", 0.90),
    ("rise_time", "rise_time_ms", "p", 1.15),
    ("rise_time", "rise_time_ms", "d", 0.95),
    ("oscillation", "oscillation_count", "p", 0.90),
    ("oscillation", "oscillation_count", "d", 1.10),
    ("settling", "settling_time_ms", "i", 1.20),
    ("steady_state", "ss_error_percent", "i", 1.25),
]
#: gain: (lowest, highest) by platform; fixed values.
BOUNDS = {
    "ardupilot": {"p": (0.01, 0.5), "i": (0.001, 0.2), "d": (0.001, 0.05), "ff": (0.0, 0.2)},
    "betaflight": {"p": (10.0, 150.0), "i": (20.0, 220.0), "d": (0.0, 100.0), "ff": (0.0, 300.0)},
    "px4": {"p": (0.01, 0.5), "i": (0.01, 0.6), "d": (0.0, 0.01), "ff": (0.0, 1.0)},
}


def window_metrics(rows: DataFrame, keys: Sequence[str], after_step: Column, value: str = "value", order: str = "idx", dt_ms: float | Column = 10.0) -> DataFrame:
    """METRICS of each window (the rows of a key); -1 where unknown. ``after_step`` marks rows past the step; ``dt_ms``, the gap of samples, may be one of the keys."""
    w, whole = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    x = F.col(value)
    numbered = rows.withColumns({"pos": F.row_number().over(w).cast("long") - 1, "n": F.count("*").over(whole), "late": after_step})
    edge, tail = F.least(F.lit(5), F.floor(F.col("n") / 4)), F.greatest(F.lit(5), F.floor(F.col("n") / 4))
    mean = lambda where: F.avg(F.when(where, x)).over(whole)
    known = numbered.withColumns({"base": mean(F.col("pos") < edge), "final": mean(F.col("pos") >= F.col("n") - tail), "size": F.abs(mean(F.col("late")) - mean(~F.col("late")))})
    span = F.col("final") - F.col("base")
    # Windows without a step of their own go before anything is divided by its size: by zero, that is an error.
    shifted = known.where("size >= 1e-6").withColumns({
        "norm": F.least(F.greatest((x - F.col("base")) / F.col("size"), F.lit(-0.5)), F.lit(2.0)),
        "out": F.abs(x - (F.col("base") + F.when(span >= 0, F.col("size")).otherwise(-F.col("size")))) > 0.10 * F.col("size"),
        "side": F.when(F.col("pos") >= edge, F.signum(x - F.col("final"))),
    }).withColumn("crossed", F.col("side") != F.lag("side").over(w))
    first = lambda level: F.min(F.when(F.col("norm") >= level, F.col("pos")))
    got = shifted.groupBy(*keys, "n", "base", "final", "size").agg(
        first(0.9).alias("p90"), first(0.1).alias("p10"), F.max(x).alias("top"), F.min(x).alias("bottom"),
        (F.coalesce(F.max(F.when(F.col("out"), F.col("pos"))), F.lit(-1)) + 1).alias("settled"), F.count_if("crossed").alias("crossings"),
    )
    valid = (F.col("n") >= 5) & (F.abs(span) >= 1e-6)
    known_or = lambda c: F.coalesce(F.when(valid, c), F.lit(-1.0))
    return got.select(
        *keys, "n",
        known_or((F.col("p90") - F.col("p10")) * dt_ms).alias("rise_time_ms"),
        known_or(F.greatest(F.lit(0.0), F.when(span >= 0, F.col("top") - F.col("final")).otherwise(F.col("final") - F.col("bottom")) / F.col("size") * 100)).alias("overshoot_percent"),
        known_or(F.when(F.col("settled") < F.col("n"), F.col("settled") * dt_ms)).alias("settling_time_ms"),
        known_or(F.floor(F.col("crossings") / 2).cast("double")).alias("oscillation_count"),
        known_or(F.abs(F.abs(span) - F.col("size")) / F.col("size") * 100).alias("ss_error_percent"),
    )


def mean_metrics(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """METRICS averaged over windows, unknown ones left out; -1 if all are unknown."""
    return windows.groupBy(*keys).agg(F.count("*").alias("windows"), *(F.coalesce(F.avg(F.when(F.col(m) >= 0, F.col(m))), F.lit(-1.0)).alias(m) for m in METRICS))


def by_axis(axis: Column, pick, limits_of: dict[str, list[tuple]] = LIMITS) -> Column:
    """An expression that depends on the axis through its limits."""
    out = F.lit(None).cast("double")
    for name, limits in limits_of.items():
        out = F.when(axis == name, pick(limits)).otherwise(out)
    return out


def points(value: Column, low: float, high: float, ideal: float) -> Column:
    """Up to two points: full at the ideal, falling inside the limits, decaying outside; 1 for an unknown value."""
    width = high - low + 1e-9

    def outside(bound: float, away: Column) -> Column:
        return F.greatest(F.lit(0.0), (2 - abs(bound - ideal) / width) * (1 - away))

    below = outside(low, (low - value) / max(abs(low), abs(high), 1e-9))
    above = outside(high, (value - high) / max(abs(high), 1e-9))
    return F.when(value < 0, 1.0).when(value < low, below).when(value > high, above).otherwise(2 - F.abs(value - ideal) / width)


def score(axis: Column, limits_of: dict[str, list[tuple]] = LIMITS) -> Column:
    """Share of the possible points that the METRICS columns reach."""
    return by_axis(axis, lambda limits: sum((points(F.col(m), *map(float, lim)) for m, lim in zip(METRICS, limits, strict=True)), F.lit(0.0)) / (2 * len(METRICS)), limits_of)


def severity(value: Column, limit: Column, mild: bool) -> Column:
    """high, medium, low (only where ``mild``) or null of a metric against its upper limit."""
    found = F.when(value < 0, None).when(value > 1.5 * limit, "high").when(value > limit, "medium")
    return found.when(F.lit(mild) & (value > 0.8 * limit), "low")


def symptoms(metrics: DataFrame, keys: Sequence[str], axis: str = "axis", limits_of: dict[str, list[tuple]] = LIMITS, rules: Sequence[tuple] = RULES) -> DataFrame:
    """keys, symptom, value, severity: one row for each symptom that a series shows."""
    named = dict.fromkeys((s, m) for s, m, _, _ in rules)
    upper = lambda k: by_axis(F.col(axis), lambda limits: F.lit(float(limits[k][1])), limits_of)
    each = [F.struct(F.lit(s).alias("symptom"), F.col(m).alias("value"), severity(F.col(m), upper(METRICS.index(m)), s == "overshoot").alias("severity")) for s, m in named]
    return metrics.select(*keys, F.explode(F.array(*each)).alias("s")).select(*keys, "s.*").where("severity is not null")


def recommend(found: DataFrame, gains: DataFrame, keys: Sequence[str], platform: str = "ardupilot", rules: Sequence[tuple] = RULES, bounds_of: dict[str, dict[str, tuple]] = BOUNDS) -> DataFrame:
    """A row for each rule that a symptom triggers on a gain in use: current, suggested (within a quarter and the platform's bounds), change_percent.

    The rules are a handful of rows, so the join to them is an array lookup by symptom.
    """
    spark = found.sparkSession
    rules = spark.createDataFrame([(s, g, float(f)) for s, _, g, f in rules], "symptom string, gain string, factor double")
    bounds = spark.createDataFrame([(g, *b) for g, b in bounds_of[platform].items()], "gain string, lowest double, highest double")
    rows = found.join(F.broadcast(rules.join(bounds, "gain")), "symptom").join(gains.where("current > 0"), [*keys, "gain"])
    factor = F.least(F.greatest("factor", F.lit(0.75)), F.lit(1.25))
    rows = rows.withColumn("suggested", F.round(F.least(F.greatest(F.col("current") * factor, "lowest"), "highest"), 6))
    return rows.select(*keys, "symptom", "severity", "gain", "current", "suggested", ((F.col("suggested") - F.col("current")) / F.col("current") * 100).alias("change_percent"))


def padded(values: Column, size: int) -> Column:
    """``values`` cut to ``size``, or filled up to it with the last one."""
    cut = F.slice(values, 1, size)
    return F.when(F.size(cut) > 0, F.concat(cut, F.array_repeat(F.element_at(cut, -1), F.lit(size) - F.size(cut)))).otherwise(cut)


def first_reason(rules: Sequence[tuple[Column, str]], otherwise: str = "ok") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for found, name in reversed(rules):
        out = F.when(F.coalesce(found, F.lit(False)), name).otherwise(out)
    return out


def step_window_reasons(rows: DataFrame, keys: Sequence[str], before: int = 5) -> DataFrame:
    """``rows`` (desired, actual, idx, step) of step windows with ``reason``: why a window is rejected, or ok. The seven gates hold in this order; the one
    on overshoot looks upwards alone.
    """
    whole = Window.partitionBy(*keys)
    desired, actual, late = F.col("desired"), F.col("actual"), F.col("idx") >= F.col("step")
    when = lambda where, x: F.when(where, x)
    jump = F.abs(desired - F.lag("desired").over(whole.orderBy("idx")))
    rows = rows.withColumn("_jump", jump).withColumns({
        "_n": F.count("*").over(whole), "_bad": F.count_if(actual.isNull() | F.isnan(actual) | (F.abs(actual) == float("inf"))).over(whole), "_top": F.max(F.abs(actual)).over(whole), "_asked": F.max(F.abs(desired)).over(whole),
        "_amp": F.abs(F.avg(when(late & (F.col("idx") < F.col("step") + 30), desired)).over(whole) - F.avg(when(~late, desired)).over(whole)),
        "_base": F.avg(when(~late, actual)).over(whole), "_rough": F.stddev_pop(when(~late, actual)).over(whole), "_early": F.count_if(~late).over(whole),
        "_post": F.count_if(F.col("idx") >= F.col("step") + 2).over(whole), "_last": F.max("idx").over(whole), "_peak": F.max(when(F.col("idx") >= F.col("step") + 2, actual)).over(whole),
    })
    tail = F.greatest(F.lit(5), F.floor(F.col("_post") / 4))
    rows = rows.withColumns({"_final": F.avg(when(F.col("idx") > F.col("_last") - tail, actual)).over(whole), "_steps": F.count_if(F.col("_jump") >= 0.4 * F.col("_amp")).over(whole)})
    span = F.abs(F.col("_final") - F.col("_base"))
    reason = first_reason([
        (F.col("_n") < 20, "window_too_short"), (F.col("_bad") > 0, "not_finite"), (F.col("_top") > 2000, "extreme_value"), ((F.col("_asked") > 1e-3) & (F.col("_top") > 5 * F.col("_asked")), "ratio"),
        ((F.col("_amp") > 0.5) & (F.col("_post") > 5) & (span > 0.1) & ((F.col("_peak") - F.col("_final")) / span > 3), "overshoot"),
        ((F.col("_amp") > 0.3) & (F.lit(before) >= 3) & (F.col("_early") >= 3) & (F.col("_rough") > 0.5 * F.col("_amp")), "baseline_unstable"), ((F.col("_amp") > 0.3) & (F.col("_steps") >= 2), "several_steps"),
    ])
    return rows.withColumn("reason", reason).drop(*(c for c in rows.columns if c.startswith("_")))


def time_domain_reason(n: Column, expected: int, holes: Column, top: Column, spread: Column, amplitude: Column) -> Column:
    """Why a window is left out of a mean step response, or ok."""
    return first_reason([(n < expected, "length"), (holes, "not_finite"), (top > 1500, "extreme_value"), (spread < 3, "flat"), (F.abs(amplitude) < 5, "small_step")])


#: Of a mean step response: seconds before and after a step, samples that a series needs; fixed values.
BEFORE_S, AFTER_S, LEAST_SAMPLES = 0.1, 1.5, 20


def mean_in_order(x: np.ndarray) -> float:
    """The mean by one sum from first to last, as SQL adds a list up; pairwise sums differ in the last bits, which puts steps on a threshold to its other side."""
    return np.add.accumulate(x)[-1] / len(x)


def window_response(desired: Sequence[float | None], actual: Sequence[float | None], place: int, before: int, after: int) -> np.ndarray | None:
    """``after`` values of the response to a step, from its baseline and in units of the step, which is ``place`` samples into its window; None if the window is not usable."""
    d, a = np.array(desired, float), np.array(actual, float)
    few = max(2, before // 2)
    head, late = min(place, few), d[place + 1 : place + 1 + few]
    if len(a) < before + 5 or head < 1 or not len(late) or not (np.isfinite(a).all() and np.isfinite(d).all()):
        return None
    jump, base = mean_in_order(late) - mean_in_order(d[:head]), mean_in_order(a[:head])
    if np.abs(a).max() > 1500 or a.std() < 3 or abs(jump) < 5:
        return None
    own = np.clip((a - base) / jump, -0.5, 2.0)[:after]
    return np.concatenate([own, np.full(after - len(own), own[-1])])


def time_domain_response(samples: DataFrame, keys: Sequence[str], desired: str = "desired", actual: str = "actual") -> DataFrame:
    """keys, rate_hz, lag, lag_s, response, windows: the mean of the responses to all usable steps, each from its baseline and in units of its step, meant for series
    (idx from 0, ``rate_hz``) too slow for a deconvolution, right for those of any rate. A window is one array: it holds ``AFTER_S`` and ``BEFORE_S`` of samples.
    """
    before, after = (F.greatest(F.lit(least), F.floor(seconds * F.col("rate_hz"))) for least, seconds in ((2, BEFORE_S), (5, AFTER_S)))
    rows = samples.select(*keys, "idx", "rate_hz", F.col(desired).alias("desired"), F.col(actual).alias("actual"), before.alias("_before"), after.alias("_after"))
    rows = series.long_enough(rows, keys, LEAST_SAMPLES)
    rates = rows.groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("rate_hz", "_before", "_after")))
    steps = series.time_domain_steps(rows.withColumn("value", F.col("desired")), keys, rates)
    near = series.windows_around(rows, series.join_keys(steps, rates.drop("rate_hz"), keys), keys, "_before", "_after")
    held = F.array_sort(F.collect_list(F.struct("idx", "desired", "actual")))
    windows = near.groupBy(*keys, "rate_hz", "step", "_before", "_after").agg(held.alias("w"))
    windows = windows.select(*keys, "rate_hz", (F.col("step") - F.col("w")[0]["idx"]).alias("_place"), "_before", "_after", F.col("w.desired").alias("_d"), F.col("w.actual").alias("_a"))
    kinds = ", ".join(f"{k} {windows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, (d, a, *sizes) in enumerate(zip(batch["_d"], batch["_a"], *(batch[c].to_pylist() for c in ("_place", "_before", "_after")), strict=True)):
                if (response := window_response(d.values.to_numpy(zero_copy_only=False), a.values.to_numpy(zero_copy_only=False), *sizes)) is not None:
                    rows.append(row)
                    found.append(response)
            yield pa.RecordBatch.from_arrays([*(batch[k].take(pa.array(rows, pa.int64())) for k in (*keys, "rate_hz")), pa.array(found, pa.list_(pa.float64()))], [*keys, "rate_hz", "_own"])

    each = windows.mapInArrow(run, f"{kinds}, rate_hz double, _own array<double>").select(*keys, "rate_hz", F.posexplode("_own").alias("lag", "v"))
    found = each.groupBy(*keys, "rate_hz", F.col("lag").cast("long").alias("lag")).agg(F.avg("v").alias("response"), F.count("*").alias("windows"))
    return found.withColumn("lag_s", F.col("lag") / F.col("rate_hz"))
