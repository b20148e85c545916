"""Assessments and notes that rules draw from measured values: message codes, never prose, so that callers render their own text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators import series


def codes(*conditions: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in order."""
    return F.filter(F.array(*(F.when(c, code) for c, code in conditions)), lambda x: x.isNotNull())


def feed_forward(rows: DataFrame, keys: Sequence[str], desired: str, actual: str, ff_percent: str | None = None, order: str = "idx") -> DataFrame:
    """keys, steps, overshoots, tracking_rms, overshoot_detected, assessment, factor (of the feed-forward gain).

    A step is a jump over 0.3 of the range; it overshoots if within 20 samples the response passes 1.15 of the new target.
    """
    w, whole = series.along(keys, order), Window.partitionBy(*keys)
    ahead = w.rowsBetween(0, 19)
    x = rows.withColumns({
        "_target": F.lead(desired).over(w), "_range": F.max(desired).over(whole) - F.min(desired).over(whole),
        "_peak": F.max(F.abs(actual)).over(ahead), "_seen": F.count("*").over(ahead),
    })
    step = (F.col("_range") > 1e-6) & (F.abs(F.col("_target") - F.col(desired)) > 0.3 * F.col("_range"))
    over = step & (F.col("_seen") > 2) & (F.col("_target") != 0) & (F.col("_peak") > 1.15 * F.abs("_target"))
    error = F.col(actual) - F.col(desired)
    ratio = F.avg(F.lit(None).cast("double") if ff_percent is None else F.col(ff_percent))
    out = x.groupBy(*keys).agg(F.count_if(step).alias("steps"), F.count_if(over).alias("overshoots"), F.sqrt(F.avg(error * error)).alias("tracking_rms"), ratio.alias("ff_percent"))
    detected = F.col("overshoots") > 0.3 * F.col("steps")
    factor = F.when(detected, 0.85).when(F.col("ff_percent") < 10, 1.2).when(F.col("ff_percent") > 50, 0.8)
    return out.withColumns({"overshoot_detected": detected, "factor": factor, "assessment": F.when(factor.isNotNull(), "MARGINAL").otherwise("GOOD")})


def motor_noise(above_floor: Column, rpm_filter: Column) -> Column:
    """Assessment of the largest motor peak over the floor (null: no peak)."""
    filtered = F.when(above_floor < 15, "EXCELLENT").when(above_floor < 25, "GOOD").otherwise("MARGINAL")
    return F.when(above_floor.isNull(), "EXCELLENT").when(rpm_filter, filtered).when(above_floor > 20, "MARGINAL").otherwise("GOOD")


def gyro_lowpass(above_floor: Column, rpm_filter: Column, current: Column) -> Column:
    """Suggested cutoff where motor noise calls for one, else null."""
    return F.when(rpm_filter & (above_floor >= 25), F.greatest(F.lit(100.0), current - 50)).when(~rpm_filter & (above_floor > 20), F.greatest(F.lit(80.0), current * 0.7))


def d_term(d_to_p: Column, high_share: Column) -> tuple[Column, Column]:
    """Assessment, and the factor of d_min (over 0.5) or of the D low-pass."""
    level = F.when(d_to_p > 0.5, "POOR").when((d_to_p > 0.3) | (high_share > 0.3), "MARGINAL").otherwise("GOOD")
    return level, F.when(d_to_p > 0.5, 0.7).when(d_to_p > 0.3, 0.8).when(high_share > 0.3, 0.85)


#: (warning, critical) of the largest offset, the smaller and larger deviation of a diagonal term from one, the largest
#: off-diagonal and motor term; coverage in degrees and samples; fixed values.
FIELD_LIMITS = {"offset": (400.0, 850.0), "diagonal": (0.1, 0.2), "off_diagonal": (0.05, 0.2), "motor": (10.0, 30.0)}


def field_notes(offset: Column, diagonal: Column, off_diagonal: Column, motor: Column, enough: Column) -> Column:
    """Codes for a magnetometer calibration, severe ones first within each kind."""
    largest = lambda a: F.array_max(F.transform(a, F.abs))
    out = []
    for name, value in (("offset", largest(offset)), ("diagonal", F.array_max(F.transform(diagonal, lambda d: F.abs(d - 1)))), ("off_diagonal", largest(off_diagonal)), ("motor", largest(motor))):
        warn, critical = FIELD_LIMITS[name]
        out += [(value > critical, f"{name}_critical"), ((value > warn) & (value <= critical), f"{name}_warning")]
    return codes(*out, (~enough, "coverage_short"))


def dip_field(latitude: Column, altitude_m: Column) -> list[Column]:
    """North, east, down in microtesla of a field whose dip follows latitude piece by piece: the fallback without a grid."""
    strength = 50.0 - 0.015 * altitude_m / 1000
    dip = F.radians(F.when(latitude >= 30, 45.0 + 0.55 * F.least(latitude - 30, F.lit(40.0))).otherwise(35.0 + 0.33 * latitude))
    return [strength * F.cos(dip), F.lit(0.0), strength * F.sin(dip)]


def own_system(frames: DataFrame, keys: Sequence[str], system: str, is_vehicle: Column, *order: str) -> DataFrame:
    """Frames of the system that the first vehicle heartbeat names; what came before that heartbeat is kept."""
    place = F.struct(*order)
    rows = frames.withColumns({"_at": place, "_hit": F.when(is_vehicle, F.struct(place.alias("at"), F.col(system).alias("s")))})
    rows = rows.withColumn("_lock", F.min("_hit").over(Window.partitionBy(*keys)))
    return rows.where(F.col("_lock").isNull() | (F.col("_at") < F.col("_lock.at")) | (F.col(system) == F.col("_lock.s"))).drop("_at", "_hit", "_lock")


def categorize(name: Column, rules: Sequence[tuple[str, str]], otherwise: str | Column = "other") -> Column:
    """Category of the first pattern that a name matches."""
    out = F.lit(otherwise)
    for pattern, category in reversed(rules):
        out = F.when(name.rlike(pattern), category).otherwise(out)
    return out


def capped_across(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key, counted across its axes in order."""
    return rows.withColumn("_k", F.row_number().over(series.along(keys, *order))).where(F.col("_k") <= most).drop("_k")


def last_fix(rows: DataFrame, keys: Sequence[str], good: Column, order: str) -> DataFrame:
    """The last good row of each key."""
    return rows.where(good).groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), order).alias("_r")).select(*keys, "_r.*")


def middle_row(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row in the middle of each key, the later one of two."""
    w = series.along(keys, *order)
    return rows.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys))}).where(F.col("_k") == F.floor(F.col("_n") / 2) + 1).drop("_k", "_n")


def parameters_wide(params: DataFrame, keys: Sequence[str], defaults: dict[str, float], order: str | None = None) -> DataFrame:
    """One row a key with a column for each parameter of ``defaults``; the last value of a name counts, a missing one is the default."""
    at = F.col(order) if order else F.lit(0)

    def value(name: str) -> Column:
        own = F.upper("name") == name.upper()
        return F.coalesce(F.max_by(F.when(own, F.col("value")), F.when(own, at)), F.lit(float(defaults[name])))

    return params.groupBy(*keys).agg(*(value(n).alias(n) for n in defaults))


#: Parameters, with their defaults, from which each platform's filter chain follows; fixed values.
FILTER_PARAMS = {
    "ardupilot": {"INS_GYRO_FILTER": 20, **{f"INS_{p}_{k}": v for p in ("HNTCH", "HNTC2") for k, v in {"ENABLE": 0, "FREQ": 80, "BW": 40, "ATT": 40, "HMNCS": 3, "OPTS": 0}.items()}},
    "betaflight": {"gyro_lpf1_static_hz": 250, "gyro_lpf2_static_hz": 500, "gyro_lpf1_dyn_min_hz": 0, "gyro_notch1_hz": 0, "gyro_notch1_cutoff": 0},
    "px4": {"IMU_GYRO_CUTOFF": 30, "IMU_GYRO_NF0_FRQ": 0, "IMU_GYRO_NF0_BW": 20, "IMU_GYRO_NF1_FRQ": 0, "IMU_GYRO_NF1_BW": 20},
}


def filter_chain(wide: DataFrame, platform: str) -> DataFrame:
    """``cutoff`` of the low-pass and ``notches`` (center, bandwidth, attenuation, harmonics) from wide parameters."""
    kind = "array<struct<center:double,bandwidth:double,attenuation:double,harmonics:bigint,count:bigint>>"
    if platform == "px4":
        two = [F.when(F.col(f"{p}FRQ") > 0, F.struct(F.col(f"{p}FRQ").alias("center"), F.col(f"{p}BW").alias("bandwidth"), F.lit(40.0).alias("attenuation"), F.lit(1).cast("bigint").alias("harmonics"), F.lit(1).cast("bigint").alias("count"))) for p in ("IMU_GYRO_NF0_", "IMU_GYRO_NF1_")]
        return wide.withColumns({"cutoff": F.col("IMU_GYRO_CUTOFF"), "notches": F.filter(F.array(*two), lambda n: n.isNotNull())})
    if platform == "betaflight":
        # A dynamic low-pass is at its lowest with the throttle down.
        first = F.when(F.col("gyro_lpf1_dyn_min_hz") > 0, F.col("gyro_lpf1_dyn_min_hz")).otherwise(F.col("gyro_lpf1_static_hz"))
        low = [F.when(c > 0, c) for c in (first, F.col("gyro_lpf2_static_hz"))]
        f, cut = F.col("gyro_notch1_hz"), F.col("gyro_notch1_cutoff")
        one = F.struct(f.alias("center"), (2 * F.abs(f - cut)).alias("bandwidth"), F.lit(40.0).alias("attenuation"), F.lit(1).cast("bigint").alias("harmonics"), F.lit(1).cast("bigint").alias("count"))
        return wide.withColumns({"cutoff": F.least(*low), "notches": F.when((f > 0) & (cut > 0), F.array(one)).otherwise(F.array().cast(kind)).cast(kind)})
    each = []
    for p in ("INS_HNTCH_", "INS_HNTC2_"):
        option = lambda bit: F.getbit(F.col(f"{p}OPTS").cast("bigint"), F.lit(bit)) == 1  # noqa: B023, E731
        count = F.when(option(4), 3).when(option(0), 2).otherwise(1)  # triple and double notches
        one = F.struct(F.col(f"{p}FREQ").alias("center"), F.col(f"{p}BW").alias("bandwidth"), F.col(f"{p}ATT").alias("attenuation"), F.col(f"{p}HMNCS").cast("bigint").alias("harmonics"), count.cast("bigint").alias("count"))
        each.append(F.when(F.col(f"{p}ENABLE") > 0, one))
    return wide.withColumns({"cutoff": F.col("INS_GYRO_FILTER"), "notches": F.filter(F.array(*each), lambda n: n.isNotNull())})


def fallback_cutoff(wide: DataFrame, platform: str) -> DataFrame:
    """``cutoff`` and ``notch_width`` that a manual filter analysis takes where it is given none, from wide parameters."""
    chain = filter_chain(wide, platform)
    return chain.withColumn("notch_width", F.coalesce(F.get("notches", F.lit(0))["bandwidth"], F.lit(40.0)))


def chain_text(cutoff: Column, notches: Column) -> Column:
    """Lines that name the parts of a filter chain."""
    low = F.when(cutoff > 0, F.format_string("low-pass %.0f Hz", cutoff))
    each = F.transform(notches, lambda n: F.format_string("notch %.1f Hz, width %.1f Hz, %.0f dB, harmonics %d", n["center"], n["bandwidth"], n["attenuation"], n["harmonics"]))
    return F.concat(F.filter(F.array(low), lambda x: x.isNotNull()), each)


def filtered_spectrum(spectrum: DataFrame, response: DataFrame, on: Sequence[str]) -> DataFrame:
    """The spectrum after a filter, on one frequency grid: decibels add."""
    return spectrum.join(response.select(*on, "magnitude_db"), list(on)).withColumn("filtered", F.col("magnitude") + F.col("magnitude_db"))


#: Vehicle types that the limits of this library are meant for; fixed values.
MULTIROTORS = (2, 3, 4, 13, 14, 15, 29)


def telemetry_notes(
    clocked: Column, attitudes: Column, targets: Column, rate_hz: Column, raw_imu: Column, gyro_hz: Column, accel: Column, params: Column, gaps: Column, dropped_percent: Column, systems: Column, vehicle: Column,
) -> Column:
    """Codes that say how far a log recorded over a radio link can be trusted, from counts of its messages, rates and losses."""
    rates = (attitudes >= 10) & (targets >= 10)
    return codes(
        (~clocked, "receive_clock"), (rates, "terms_missing"), (rates & (rate_hz < 50), "telemetry_rate"), ((attitudes >= 10) & (targets < 10), "no_desired_rates"), (attitudes < 10, "no_attitude"),
        (raw_imu == 0, "gyro_from_attitude"), (gyro_hz.between(1e-9, 240), "fft_limited"), (accel == 0, "no_accelerometer"), (params == 0, "no_parameters"), (gaps > 0, "link_gaps"), (dropped_percent >= 5, "dropped_frames"),
        (systems > 1, "other_vehicles"), (~vehicle.isin(*MULTIROTORS), "no_multirotor"),
    )


def telemetry_penalty(targets: Column) -> Column:
    """What such a log loses of its quality score."""
    return F.when(targets > 0, 15).otherwise(30)


def current_vector(raw: DataFrame, params: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys, names: the median that a log recorded of each, else the parameter, else 0; a row for each key of ``params``."""
    middle = raw.groupBy(*keys).agg(*(F.median(n).alias(f"_{n}") for n in names))
    rows = params.join(middle, list(keys), "left")
    return rows.select(*keys, *(F.coalesce(f"_{n}", n, F.lit(0.0)).alias(n) for n in names))


def by_severity(rows: DataFrame, keys: Sequence[str], severity: str, *order: str) -> DataFrame:
    """``place`` of each row of a key: severe ones first, in the given order among equals."""
    level = F.when(F.col(severity) == "high", 0).when(F.col(severity) == "medium", 1).otherwise(2)
    return rows.withColumn("_s", level).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_s", *order)).cast("long")).drop("_s")


def log_issues(axes: Sequence[Column], has_pid: Column, gyro: Column, accel: Column | None, least: int = 100) -> Column:
    """Codes of what a log lacks, from its sample counts: no_pid, pid_short (an axis that is there has too few), gyro_short, accel_short."""
    short = F.lit(False)
    for n in axes:
        short = short | ((n > 0) & (n < least))
    found = [(~has_pid, "no_pid"), (short, "pid_short"), (F.coalesce(gyro, F.lit(0)) < least, "gyro_short")]
    return codes(*found, *([] if accel is None else [(F.coalesce(accel, F.lit(0)) < least, "accel_short")]))
