"""Ordered-sequence operators over sampled signals; every one takes the key columns of a series, so a job covers a fleet."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def along(keys: Keys, *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def sample_rate(samples: DataFrame, keys: Keys, dt: str = "dt", shortest: float = 1e-6, longest: float = float("inf")) -> DataFrame:
    """n_dt, median_dt, rate_hz from the gaps within (shortest, longest)."""
    gaps = samples.where((F.col(dt) > shortest) & (F.col(dt) < longest))
    return gaps.groupBy(*keys).agg(F.count("*").alias("n_dt"), F.median(dt).alias("median_dt")).withColumn("rate_hz", 1 / F.col("median_dt"))


def numbered(samples: DataFrame, keys: Keys, idx: str = "idx") -> DataFrame:
    """``samples`` with ``idx`` counted anew from 0 within each series: messages of a log are numbered across all its series, samples are not."""
    return samples.withColumn(idx, F.row_number().over(along(keys, idx)).cast("long") - 1)


def measured_rate(samples: DataFrame, keys: Keys, t: str = "t", idx: str = "idx", longest: float = 1.0) -> DataFrame:
    """keys, n (samples) and rate_hz (of the median gap under ``longest`` seconds, null without any) of each series."""
    gap = F.col(t) - F.lag(t).over(along(keys, idx))
    gaps = samples.select(*keys, gap.alias("_gap"))
    usable = F.when((F.col("_gap") > 0) & (F.col("_gap") < longest), F.col("_gap"))
    return gaps.groupBy(*keys).agg(F.count("*").alias("n"), (1 / F.median(usable)).alias("rate_hz"))


def with_rate(samples: DataFrame, keys: Keys, rate: float | DataFrame | None = None, t: str = "t", idx: str = "idx", otherwise: float | None = None) -> DataFrame:
    """``samples`` with ``rate_hz``: a given one, one for each series (keys, rate_hz), or what is measured; without any, ``otherwise``; series left without one go."""
    if isinstance(rate, int | float):
        return samples.withColumn("rate_hz", F.lit(float(rate)))
    found = (measured_rate(samples, keys, t, idx) if rate is None else rate).select(*keys, "rate_hz")
    joined = join_keys(samples, found, keys)
    if otherwise is not None:
        joined = joined.withColumn("rate_hz", F.coalesce("rate_hz", F.lit(float(otherwise))))
    return joined.where("rate_hz > 0")


def rate_consistency(samples: DataFrame, keys: Keys, dt: str = "dt", late: float = 1.5) -> DataFrame:
    """median_dt, jitter_pct (population deviation over the median), drops (gaps over ``late`` medians) and their rate."""
    gaps = samples.where(F.col(dt) > 0).withColumn("_m", F.median(dt).over(Window.partitionBy(*keys)))
    counted = gaps.groupBy(*keys).agg(F.count("*").alias("n_dt"), F.first("_m").alias("median_dt"), F.stddev_pop(dt).alias("spread"), F.count_if(F.col(dt) > late * F.col("_m")).alias("drops"))
    return counted.select(*keys, "n_dt", "median_dt", (100 * F.col("spread") / F.col("median_dt")).alias("jitter_pct"), "drops", (F.col("drops") / F.col("n_dt")).alias("drop_rate"))


def step_threshold(largest: Column, share: float = 0.3, floor: float = 0.5) -> Column:
    """What a jump must reach: a share of the largest amplitude, or ``floor`` for a flat signal."""
    return F.when(largest < 1e-9, F.lit(floor)).otherwise(share * largest)


def step_candidates(samples: DataFrame, keys: Keys, value: str = "value", idx: str = "idx", share: float = 0.3, floor: float = 0.5) -> DataFrame:
    """keys, step (index of the sample before the jump), jump."""
    w = along(keys, idx)
    jumps = samples.select(*keys, (F.col(idx) - 1).alias("step"), (F.col(value) - F.lag(value).over(w)).alias("jump"), F.max(F.abs(value)).over(Window.partitionBy(*keys)).alias("largest"))
    return jumps.where(F.abs("jump") >= step_threshold(F.col("largest"), share, floor)).select(*keys, "step", "jump")


def keep_spaced(candidates: DataFrame, keys: Keys, spacing: int | Column, step: str = "step", block: int = 1 << 13) -> DataFrame:
    """Of the candidates in order, each that is at least ``spacing`` (a column: the series' own) after the last kept one. What a block of indexes keeps hangs only
    on the first index that may be kept in it, one of ``spacing``: so blocks are mapped from it to the next one's apart, a scan of these maps
    gives each block its own, and blocks are read again from there. A task holds a block, or a map of at most ``spacing`` numbers for each block of a series.
    """
    kinds = ", ".join(f"{k} {candidates.schema[k].dataType.simpleString()}" for k in keys)
    at = F.col(step).cast("long")
    own = F.greatest(spacing.cast("long") if isinstance(spacing, Column) else F.lit(spacing).cast("long"), F.lit(1).cast("long"))
    rows = candidates.select(*keys, at.alias("_at"), own.alias("_spacing"), F.greatest(F.lit(block).cast("long"), 64 * own).alias("_long")).where("_at is not null")
    blocks = rows.groupBy(*keys, F.floor(F.col("_at") / F.col("_long")).alias("_block")).agg(F.array_sort(F.collect_set("_at")).alias("_steps"), F.first("_spacing").alias("_spacing"), F.first("_long").alias("_long"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, steps, spacing, long in zip(batch["_block"].to_pylist(), batch["_steps"], batch["_spacing"].to_pylist(), batch["_long"].to_pylist(), strict=True):
                steps = steps.values.to_numpy()
                after = np.searchsorted(steps, steps + spacing)
                end = np.append(steps + spacing, 0)
                for i in range(len(steps) - 1, -1, -1):
                    if after[i] < len(steps):
                        end[i] = end[after[i]]
                starts = number * long + np.arange(spacing)
                found = np.searchsorted(steps, starts)
                own = np.where(found < len(steps), end[found], starts)
                out.append(own[:1] if (own == own[0]).all() else own)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), batch["_block"], batch["_long"], pa.array(out, pa.list_(pa.int64()))], [*keys, "_block", "_long", "_ends"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, numbers, starts = [], [], []
            for row, maps in enumerate(batch["_maps"].to_pylist()):
                start = None
                for m in maps:
                    first = m["_block"] * m["_long"]
                    start = first if start is None else max(first, start)
                    rows.append(row)
                    numbers.append(m["_block"])
                    starts.append(start)
                    start = m["_ends"][min(start - first, len(m["_ends"]) - 1)]
            yield pa.RecordBatch.from_arrays([*(batch[k].take(pa.array(rows, pa.int64())) for k in keys), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64())], [*keys, "_block", "_start"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for row, (start, steps, spacing) in enumerate(zip(batch["_start"].to_pylist(), batch["_steps"].to_pylist(), batch["_spacing"].to_pylist(), strict=True)):
                for i in steps:
                    if i >= start:
                        rows.append(row)
                        kept.append(i)
                        start = i + spacing
            yield pa.RecordBatch.from_arrays([*(batch[k].take(pa.array(rows, pa.int64())) for k in keys), pa.array(kept, pa.int64())], [*keys, step])

    mapped = blocks.mapInArrow(ends, f"{kinds}, _block long, _long long, _ends array<long>")
    maps = mapped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "_long", "_ends"))).alias("_maps"))
    starts = maps.mapInArrow(scan, f"{kinds}, _block long, _start long")
    return join_keys(blocks, starts, [*keys, "_block"]).mapInArrow(keep, f"{kinds}, {step} long")


def spacing_of(rate_hz: Column, milliseconds: float = 200.0) -> Column:
    """Samples that ``milliseconds`` hold at a rate, one at least."""
    return F.greatest(F.bround(rate_hz * milliseconds / 1000).cast("long"), F.lit(1).cast("long"))


def time_domain_steps(samples: DataFrame, keys: Keys, rate_hz: float | DataFrame, value: str = "value", idx: str = "idx") -> DataFrame:
    """Steps of a mean step response: at least half a second apart by the rate of all series, or of each (keys, rate_hz); jumps of 5 or more where a signal is flat."""
    found = step_candidates(samples, keys, value, idx, floor=5.0)
    if isinstance(rate_hz, DataFrame):
        return keep_spaced(join_keys(found, rate_hz.select(*keys, "rate_hz"), keys), keys, F.floor(0.5 * F.col("rate_hz")))
    return keep_spaced(found, keys, max(1, int(0.5 * rate_hz)))


def join_keys(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Inner join in which null keys meet."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    both = [left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys]
    return left.join(right, both).drop(*(f"_right_{k}" for k in keys))


def repair_outliers(samples: DataFrame, keys: Keys, limit: float, value: str = "value", idx: str = "idx") -> DataFrame:
    """``repaired``: values beyond ``limit`` are interpolated between good neighbours by row index; at the ends the nearest holds; fewer than two good: 0."""
    good = F.abs(F.col(value)) <= limit
    back = along(keys, idx).rowsBetween(Window.unboundedPreceding, 0)
    ahead = along(keys, idx).rowsBetween(0, Window.unboundedFollowing)
    point = F.when(good, F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))
    rows = samples.withColumns({"_b": F.last(point, True).over(back), "_a": F.first(point, True).over(ahead), "_n": F.count_if(good).over(Window.partitionBy(*keys))})
    between = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col(idx) - F.col("_b.i")) / (F.col("_a.i") - F.col("_b.i"))
    fixed = F.when(good, F.col(value)).when(F.col("_n") < 2, 0.0).otherwise(F.coalesce(between, F.col("_b.v"), F.col("_a.v")))
    return rows.withColumn("repaired", fixed).drop("_b", "_a", "_n")


def unwrap_degrees(samples: DataFrame, keys: Keys, angle: str, idx: str = "idx") -> DataFrame:
    """``unwrapped``: jumps brought into (-180, 180] and summed; ``biased``: 360 off after jumps of 315 up, 360 on after 45 down."""
    w = along(keys, idx)
    jump = F.col(angle) - F.lag(angle).over(w)
    turn = F.when(jump > 180, -360.0).when(jump < -180, 360.0).otherwise(0.0)
    bias = F.when(jump >= 315, -360.0).when(jump <= -45, 360.0).otherwise(0.0)
    rows = samples.withColumns({"_t": turn, "_b": bias})
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"unwrapped": F.col(angle) + F.sum("_t").over(total), "biased": F.col(angle) + F.sum("_b").over(total)}).drop("_t", "_b")


def sequence_drops(frames: DataFrame, keys: Keys, seq: str, *order: str, modulus: int = 256) -> DataFrame:
    """frames, dropped (numbers skipped in a counter that wraps), drop_pct."""
    gap = F.pmod(F.col(seq) - (F.lag(seq).over(along(keys, *order)) + 1), F.lit(modulus))
    out = frames.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.count("*").alias("frames"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("dropped"))
    return out.withColumn("drop_pct", 100 * F.col("dropped") / (F.col("frames") + F.col("dropped")))


def changes(samples: DataFrame, keys: Keys, state: str, *order: str) -> DataFrame:
    """Rows at which ``state`` differs from the row before; the first row counts."""
    w = along(keys, *order)
    rows = samples.withColumns({"_before": F.lag(state).over(w), "_n": F.row_number().over(w)})
    return rows.where((F.col("_n") == 1) | ~F.col(state).eqNullSafe(F.col("_before"))).drop("_before", "_n")


def long_gaps(samples: DataFrame, keys: Keys, longest: float, dt: str = "dt") -> DataFrame:
    """gaps, worst_gap, total_gap over gaps longer than ``longest`` seconds, in tenths."""
    return samples.where(F.col(dt) > longest).groupBy(*keys).agg(F.count("*").alias("gaps"), F.round(F.max(dt), 1).alias("worst_gap"), F.round(F.sum(F.round(dt, 1)), 1).alias("total_gap"))


def frames(samples: DataFrame, keys: Keys, size: int, hop: int, idx: str = "idx") -> DataFrame:
    """Each sample once for every complete frame that holds it: frame number and ``place`` in it. Frame k begins at k * hop."""
    n = F.count("*").over(Window.partitionBy(*keys))
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - size + 1) / hop))
    last = F.least(F.floor(F.col(idx) / hop), F.floor((F.col("_n") - size) / hop))
    rows = samples.withColumn("_n", n).where(F.col("_n") >= size)
    rows = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    return rows.withColumn("frame", F.explode(F.sequence("_first", "_last"))).withColumn("place", F.col(idx) - F.col("frame") * hop).drop("_n", "_first", "_last")


def windows_around(samples: DataFrame, steps: DataFrame, keys: Keys, before: int | str = 5, after: int | str = 200, idx: str = "idx", step: str = "step") -> DataFrame:
    """Samples of rows [step - before, step + after) of each step, joined by blocks of a window's rows rather than by range alone. ``before`` and ``after`` may name
    columns of both tables, each series' own.
    """
    own = [c for c in (before, after) if isinstance(c, str)]
    before, after = (F.col(c) if isinstance(c, str) else F.lit(c) for c in (before, after))
    block = before + after
    ends = steps.withColumns({"_from": F.col(step) - before, "_to": F.col(step) + after})
    blocks = ends.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block)))).drop(*own)
    rows = samples.withColumn("_block", F.floor(F.col(idx) / block))
    joined = rows.join(blocks, [*keys, "_block"])
    return joined.where((F.col(idx) >= F.col("_from")) & (F.col(idx) < F.col("_to"))).drop("_block", "_from", "_to")


def by_priority(rows: DataFrame, keys: Keys, priority: Column) -> DataFrame:
    """The rows of the best (smallest) priority that each key has."""
    best = F.min("_p").over(Window.partitionBy(*keys))
    return rows.withColumn("_p", priority).withColumn("_best", best).where("_p = _best").drop("_p", "_best")


def primary_instance(rows: DataFrame, keys: Keys, instance: str, primary: int, least: int) -> DataFrame:
    """Rows of the primary instance where it has at least ``least`` of them; all rows of other keys."""
    n = F.count_if(F.col(instance) == primary).over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where((F.col("_n") < least) | (F.col(instance) == primary)).drop("_n")


def only_axes(rows: DataFrame, axes: Sequence[str], axis: str = "axis") -> DataFrame:
    """Rows of the named axes, whatever their case; ``all`` keeps every axis, names that do not occur keep nothing."""
    wanted = [a.lower() for a in axes]
    lowered = rows.withColumn(axis, F.lower(axis))
    return lowered if "all" in wanted else lowered.where(F.col(axis).isin(*wanted))


def long_enough(rows: DataFrame, keys: Keys, least: int = 10) -> DataFrame:
    """Rows of the keys that have at least ``least`` of them."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def rate_limited(rows: DataFrame, headers: DataFrame, keys: Keys, rate: str, otherwise: float = 2000.0, margin: float = 1.1) -> DataFrame:
    """``rate`` held within the header's ``limit`` and a margin, or within ``otherwise`` where a key has no header."""
    top = F.coalesce(F.col("limit") * margin, F.lit(otherwise))
    joined = rows.join(headers.select(*keys, "limit"), list(keys), "left")
    return joined.withColumn(rate, F.least(F.greatest(rate, -top), top)).drop("limit")


def wrapped_together(rows: DataFrame, keys: Keys, phases: Sequence[str], idx: str = "idx") -> DataFrame:
    """Phases of a key with a turn taken off, or put on, wherever the first of them leaves (-180, 180]; the first row stays as it is."""
    lead = F.col(phases[0])
    first = F.min(idx).over(Window.partitionBy(*keys))
    shift = F.when(F.col(idx) == first, 0.0).when(lead > 180, -360.0).when(lead < -180, 360.0).otherwise(0.0)
    return rows.withColumn("_shift", shift).withColumns({p: F.col(p) + F.col("_shift") for p in phases}).drop("_shift")


def kind_counts(rows: DataFrame, keys: Keys, kind: str, names: dict[str, str]) -> DataFrame:
    """keys and, for each kind, how many rows are of it."""
    return rows.groupBy(*keys).agg(*(F.count_if(F.col(kind) == k).alias(n) for k, n in names.items()))
