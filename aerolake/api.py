"""What a user calls: one function for each analysis, from DataFrames of many flights to a DataFrame of results, and all of them at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import errors
from aerolake.operators import align, attitude, bands, catalog, diagnosis, filters, ingest, models, responses, series, spectral, tables, vibration
from aerolake.sources.rules import Rules

#: Modules that a platform's logs can support; fixed values.
CAPABILITIES = {
    "ardupilot": ("quality", "pid", "fft", "filter", "magfit", "sysid", "hardware"),
    "betaflight": ("quality", "pid", "fft", "filter", "hardware"),
    "px4": ("quality", "pid", "fft", "filter", "sysid"),
}
KEYS = ["flight_id", "axis"]


#: Codes of failing modules; fixed values.
FAILURES = {"pid": "E5010", "fft": "E5020", "filter": "E5051", "magfit": "E5030", "sysid": "E5040", "hardware": "E5060", "quality": "E5070"}
NOTHING_RAN, ALL_FAILED = "E5098", "E5099"


class AnalysisError(ValueError):
    """No module could run: ``code`` and a ``hint`` at what is missing."""

    def __init__(self, code: str, message: str, hint: str = ""):
        super().__init__(f"{code}: {message}" + (f" ({hint})" if hint else ""))
        self.code, self.hint = code, hint


@dataclass
class Flights:
    """Tables of a fleet, keyed by flight_id; those that logs do not have are None.

    pid: flight_id, axis, idx, t, desired, actual. imu: flight_id, idx, t, gx, gy, gz, ax, ay, az. mag: flight_id, idx, t, mx, my, mz
    and the field bx, by, bz and throttle aligned to it. attitude: flight_id, idx, t, roll, pitch, yaw. battery: flight_id, idx, t, volt, curr.
    params: flight_id, name, value. The others are as ``operators.tables`` gives them.
    """

    platform: str
    pid: DataFrame | None = None
    imu: DataFrame | None = None
    mag: DataFrame | None = None
    params: DataFrame | None = None
    attitude: DataFrame | None = None
    battery: DataFrame | None = None
    motors: DataFrame | None = None
    modes: DataFrame | None = None
    position: DataFrame | None = None
    versions: DataFrame | None = None
    texts: DataFrame | None = None
    autotune: DataFrame | None = None
    health: DataFrame | None = None
    extra: dict[str, Callable[[Flights], DataFrame]] = field(default_factory=dict)

    @classmethod
    def from_messages(cls, messages: DataFrame, kind: str) -> Flights:
        """All tables that messages of dataflash, ulog or telemetry logs hold."""
        own = lambda name: getattr(tables, f"{kind}_{name}", None) or getattr(ingest, f"{kind}_{name}", None)
        found = {name: make(messages) for name in TABLES if (make := own(name))}
        platform = "px4" if kind == "ulog" else "ardupilot"
        if "params" in found:
            found["params"] = tables.mirrored(found["params"], platform, overwrite=platform == "px4")
        return cls(platform, **found)

    @classmethod
    def from_blackbox(cls, frames: DataFrame, headers: DataFrame) -> Flights:
        """All tables that decoded blackbox logs hold; every segment of a file is a flight."""
        found = {name: make(frames, headers) for name in TABLES if (make := getattr(ingest, f"blackbox_{name}", None))}
        found["params"] = tables.mirrored(found["params"], "betaflight")
        return cls("betaflight", **found)


#: Tables of ``Flights`` that a log format can fill.
TABLES = ("pid", "imu", "mag", "params", "attitude", "battery", "motors", "modes", "position", "versions", "texts", "autotune", "health")


def sampled(samples: DataFrame, keys: Sequence[str], rate_hz: float | DataFrame | None = None, otherwise: float | None = None) -> DataFrame:
    """A table of ``Flights`` with its samples numbered series by series, and the rate of each series: given, or measured."""
    return series.with_rate(series.numbered(samples, keys), keys, rate_hz, otherwise=otherwise)


def spaced_steps(signals: DataFrame, spacing: int | None = None) -> DataFrame:
    """Steps (KEYS, step) of ``sampled`` signals with their ``value``: at least a fifth of a second apart by the rate of each series, or ``spacing`` samples."""
    found = series.step_candidates(signals, KEYS)
    if spacing is not None:
        return series.keep_spaced(found, KEYS, spacing)
    rates_of = signals.groupBy(*KEYS).agg(F.first("rate_hz").alias("rate_hz"))
    return series.keep_spaced(series.join_keys(found, rates_of, KEYS), KEYS, series.spacing_of(F.col("rate_hz")))


def with_gaps(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.withColumn("dt", F.col("t") - F.lag("t").over(series.along(keys, "t", "idx")))


#: Points that a quality score loses; fixed values.
PENALTY = {"required": 20, "optional": 5, "very_short": 30, "short": 10, "no_steps": 25, "few_steps": 8, "drops": 8, "jitter": 5}


def quality(flights: Flights, spacing: int | None = None) -> DataFrame:
    """flight_id, duration, n_steps, fewest_steps (of an axis), rate_hz, jitter_pct, drop_rate (of the first axis), missing (tables), issues (codes), score, rating."""
    rows = with_gaps(flights.pid, KEYS)
    axes = rows.groupBy(*KEYS).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    steps = spaced_steps(sampled(flights.pid, KEYS, otherwise=250.0).withColumn("value", F.col("desired")), spacing).groupBy(*KEYS).agg(F.count("*").alias("steps"))
    clock = series.rate_consistency(rows.where("dt < 1"), KEYS).withColumn("rate_hz", 1 / F.col("median_dt"))
    order = F.when(F.col("axis") == "roll", 0).when(F.col("axis") == "pitch", 1).otherwise(2)
    first = lambda c: F.min_by(c, order)
    whole = axes.join(steps, KEYS, "left").join(clock, KEYS, "left").groupBy("flight_id").agg(
        (F.max("last") - F.min("first")).alias("duration"), F.sum(F.coalesce("steps", F.lit(0))).alias("n_steps"), F.min(F.coalesce("steps", F.lit(0))).alias("fewest_steps"), *(first(c).alias(c) for c in ("rate_hz", "jitter_pct", "drop_rate")),
    )
    parts = {"imu": "required", "mag": "optional", "motors": "optional", "battery": "optional"}
    for name in parts:
        table = getattr(flights, name)
        known = whole.select("flight_id").limit(0) if table is None else table.select("flight_id").distinct()
        whole = whole.join(known.withColumn(f"_{name}", F.lit(True)), "flight_id", "left")
    gone = {name: F.col(f"_{name}").isNull() for name in parts}
    found = [
        *((gone[name], f"{name}_missing", PENALTY[kind]) for name, kind in parts.items()),
        (F.col("duration") < 30, "very_short", PENALTY["very_short"]), (F.col("duration").between(30, 120) & (F.col("duration") < 120), "short", PENALTY["short"]), (F.col("duration").between(120, 300) & (F.col("duration") < 300), "adequate", 0),
        (F.col("n_steps") < 3, "no_steps", PENALTY["no_steps"]), ((F.col("n_steps") >= 3) & (F.col("fewest_steps") < 3), "few_steps", PENALTY["few_steps"]),
        (F.col("drop_rate") > 0.05, "drops", PENALTY["drops"]), (F.col("jitter_pct") > 20, "jitter", PENALTY["jitter"]),
    ]
    lost = sum((F.when(holds, points).otherwise(0) for holds, _, points in found), F.lit(0))
    issues = diagnosis.codes(*((holds, code) for holds, code, _ in found))
    if flights.health is not None:  # a recorded link says how far it can be trusted
        whole = whole.join(flights.health.select("flight_id", F.col("notes").alias("_notes"), F.col("penalty").alias("_penalty")), "flight_id", "left")
        lost, issues = lost + F.coalesce("_penalty", F.lit(0)), F.concat(issues, F.coalesce("_notes", F.array().cast("array<string>")))
    out = whole.withColumns({"issues": issues, "score": F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("double")}).drop("_notes", "_penalty")
    return out.drop(*(f"_{name}" for name in parts)).withColumn("rating", bands.level_from(F.col("score"), bands.RATINGS))


def rates(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, rate_hz: of the median gap between samples."""
    return series.sample_rate(with_gaps(samples, keys), keys).select(*keys, "rate_hz")


def step_windows(flights: Flights, spacing: int | None = None) -> DataFrame:
    """Samples around each step that passes all seven gates, numbered by their series, with its rate."""
    signals = sampled(series.long_enough(flights.pid, KEYS), KEYS).withColumn("value", F.col("desired"))
    steps = spaced_steps(signals, spacing)
    windows = responses.step_window_reasons(series.windows_around(signals, steps, KEYS), [*KEYS, "step"])
    return windows.where("reason = 'ok'").drop("reason", "value")


def pid(flights: Flights, gains: DataFrame | None = None, most: int = 20, rules: Rules | None = None) -> DataFrame:
    """flight_id, axis, windows, the mean step metrics, score, assessment; and with ``gains`` (flight_id, axis, gain, current) the recommendations as an array, the
    most severe first and at most ``most`` a flight. Times are measured by each series' own rate. ``rules`` (``sources.rules.load``) puts a user's layers over the limits.
    """
    rules = rules or Rules()
    timed = step_windows(flights).withColumn("dt_ms", 1000 / F.col("rate_hz"))
    windows = responses.window_metrics(timed, [*KEYS, "step", "dt_ms"], F.col("idx") > F.col("step"), "actual", dt_ms=F.col("dt_ms"))
    metrics = responses.mean_metrics(windows, KEYS)
    out = metrics.withColumn("score", responses.score(F.col("axis"), rules.limits)).withColumn("assessment", bands.level_from(F.col("score"), responses.CUTS))
    if gains is None:
        return out
    found = responses.recommend(responses.symptoms(metrics, KEYS, limits_of=rules.limits, rules=rules.rules), gains, KEYS, flights.platform, rules.rules, rules.bounds)
    placed = diagnosis.by_severity(found, ["flight_id"], "severity", "axis", "symptom", "gain").where(F.col("place") <= most)
    each = F.struct("place", *(c for c in found.columns if c not in KEYS))
    return out.join(placed.groupBy(*KEYS).agg(F.array_sort(F.collect_list(each)).alias("recommendations")), KEYS, "left")


def on_imu_grid(flights: Flights, rate_hz: float | DataFrame | None = None) -> DataFrame:
    """flight_id, axis, idx, t, desired, actual on an even grid at each flight's own IMU rate: the wanted rates and the gyro's measured ones, both interpolated to it, from
    where both begin to where both end. For logs whose PID messages are slower than the gyro.
    """
    rated = sampled(flights.imu, ["flight_id"], rate_hz)
    spans = rated.groupBy("flight_id").agg(F.first("rate_hz").alias("rate_hz"), F.min("t").alias("a0"), F.max("t").alias("a1"))
    asked = flights.pid.groupBy(*KEYS).agg(F.min("t").alias("b0"), F.max("t").alias("b1"))
    both = asked.join(spans, "flight_id").withColumns({"t0": F.greatest("a0", "b0"), "t1": F.least("a1", "b1")}).where("t1 > t0")
    steps = F.floor((F.col("t1") - F.col("t0")) * F.col("rate_hz") + 1e-6)
    grid = both.select(*KEYS, "t0", "rate_hz", F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("idx"))
    grid = grid.select(*KEYS, "idx", (F.col("t0") + F.col("idx") / F.col("rate_hz")).alias("t"))
    met = align.interpolate_at(grid, flights.pid.select(*KEYS, "t", "desired").where("desired is not null"), KEYS, "t", ["desired"], "idx")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(g).alias("actual")) for a, g in (("roll", "gx"), ("pitch", "gy"), ("yaw", "gz")))))
    gyro = flights.imu.select("flight_id", "t", each.alias("s")).select("flight_id", "t", "s.*").where("actual is not null")
    return align.interpolate_at(met, gyro, KEYS, "t", ["actual"], "idx").where("desired is not null and actual is not null")


#: Series slower than this are averaged step by step instead of deconvolved; a fixed value.
SLOW_HZ = 20.0


def step_response(flights: Flights, rate_hz: float | DataFrame | None = None, prefer_imu: bool = False) -> DataFrame:
    """flight_id, axis, method, rate_hz, lag, lag_s, response, windows; steady_state, its mean from 0.2 s on, and steady_ok, whether that is within 0.5 and 3.
    The method follows the rate of each series: wiener (deconvolution), or under ``SLOW_HZ`` time_domain (mean of the steps). ``prefer_imu`` takes
    the gyro's measured rates on its own even grid instead of those among the PID samples.
    """
    rows = sampled(on_imu_grid(flights) if prefer_imu else flights.pid, KEYS, rate_hz)
    gates = {"lowest": 20.0, "highest": 500.0} if flights.platform == "betaflight" else {}
    fast = spectral.wiener_step(rows.where(F.col("rate_hz") >= SLOW_HZ), KEYS, F.col("rate_hz"), **gates).withColumn("method", F.lit("wiener"))
    slow = responses.time_domain_response(rows.where(F.col("rate_hz") < SLOW_HZ), KEYS).withColumn("method", F.lit("time_domain"))
    found = fast.unionByName(slow).select(*KEYS, "method", "rate_hz", "lag", "lag_s", "response", "windows")
    steady = F.avg(F.when(F.col("lag_s") >= 0.2, F.col("response"))).over(Window.partitionBy(*KEYS))
    return found.withColumn("steady_state", steady).withColumn("steady_ok", (F.col("steady_state") > 0.5) & (F.col("steady_state") < 3))


def coverage(flights: Flights) -> DataFrame:
    """flight_id, samples, ranges of the attitude, coverage_ok, quality: whether a flight turned enough for a calibration, without one."""
    return attitude.flight_coverage(flights.attitude, ["flight_id"])


def gyro_spectrum(flights: Flights, rate_hz: float | DataFrame | None = None) -> DataFrame:
    """flight_id, rate_hz, bin, freq, magnitude (dB): the largest of the three axes in every bin, each flight by its own rate."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("gyro"), F.col(a).alias("value")) for a in ("gx", "gy", "gz"))))
    rated = sampled(flights.imu, ["flight_id"], rate_hz)
    axes = rated.select("flight_id", "idx", "t", "rate_hz", each.alias("s")).select("flight_id", "idx", "t", "rate_hz", "s.*")
    n = F.count("*").over(Window.partitionBy("flight_id", "gyro"))
    spectra = spectral.framed_spectra(axes.withColumn("_n", n), ["flight_id", "gyro"], spectral.window_column(F.col("rate_hz"), F.col("_n")), 0.5, F.col("rate_hz"), scaling="dbfs")
    bins = spectra.select("flight_id", "gyro", "rate_hz", "size", F.posexplode("spectrum").alias("bin", "m"))
    means = bins.groupBy("flight_id", "gyro", "rate_hz", "size", F.col("bin").cast("long").alias("bin")).agg(F.avg("m").alias("magnitude"))
    return means.groupBy("flight_id", "rate_hz", "bin", (F.col("bin") * F.col("rate_hz") / F.col("size")).alias("freq")).agg(F.max("magnitude").alias("magnitude"))


def fft(flights: Flights, rate_hz: float | DataFrame | None = None, over: float = 30.0) -> DataFrame:
    """flight_id, rms, level; rate_hz; peaks (freq, magnitude, source, harmonic) of the three gyro axes together; settings that follow, their native form, warnings, checks."""
    rms = F.sqrt(F.var_pop("ax") + F.var_pop("ay") + F.var_pop("az"))
    level = flights.imu.groupBy("flight_id").agg(rms.alias("rms")).withColumn("level", bands.level_below(F.col("rms"), bands.VIBRATION.get(flights.platform, bands.VIBRATION["other"])))
    bins = gyro_spectrum(flights, rate_hz)
    found = spectral.local_peaks(bins.where(F.col("freq") <= F.col("rate_hz") / 2), ["flight_id"], over, 5.0, float("inf"), 20)
    peaks = found.groupBy("flight_id").agg(spectral.with_harmonics(F.collect_list(F.struct("freq", "magnitude"))).alias("peaks"))
    clock = bins.groupBy("flight_id").agg(F.first("rate_hz").alias("rate_hz"))
    rows = level.join(clock, "flight_id", "left").join(peaks, "flight_id", "left").withColumn("settings", vibration.notch_settings(F.col("peaks"), F.col("level")))
    native = vibration.native(F.col("settings"), flights.platform)
    told = vibration.warnings(F.col("settings"), F.col("peaks"), F.col("level"), flights.platform)
    rows = rows.withColumns({"native": native, "warnings": told, "checks": vibration.checks(F.col("level"))})
    return rows.withColumn("settings", vibration.static_notches(F.col("settings"), F.col("peaks"))) if flights.platform == "px4" else rows


def filter_rates(flights: Flights, rate_hz: float | DataFrame | None = None, otherwise: float = 400.0) -> DataFrame:
    """flight_id, rate_hz of every flight that has parameters: given, else measured on its gyro, else on its PID samples, else ``otherwise``."""
    every = flights.params.select("flight_id").distinct()
    if isinstance(rate_hz, int | float):
        return every.withColumn("rate_hz", F.lit(float(rate_hz)))
    if rate_hz is None:
        found = [series.measured_rate(flights.imu, ["flight_id"]).withColumn("_k", F.lit(0))] if flights.imu is not None else []
        if flights.pid is not None:
            found.append(series.measured_rate(flights.pid, KEYS).groupBy("flight_id").agg(F.max("rate_hz").alias("rate_hz")).withColumn("_k", F.lit(1)))
        if not found:
            return every.withColumn("rate_hz", F.lit(float(otherwise)))
        each = reduce(DataFrame.unionByName, (f.select("flight_id", "rate_hz", "_k") for f in found))
        rate_hz = each.where("rate_hz is not null").groupBy("flight_id").agg(F.min_by("rate_hz", "_k").alias("rate_hz"))
    return every.join(rate_hz.select("flight_id", "rate_hz"), "flight_id", "left").withColumn("rate_hz", F.coalesce("rate_hz", F.lit(float(otherwise))))


def filter(flights: Flights, rate_hz: float | DataFrame | None = None, gyro_filter_hz: float | None = None, notch_hz: float | None = None, points: int = 500) -> DataFrame:  # noqa: A001
    """flight_id, mode (auto: the chain of the parameters; manual: what is given), rate_hz, cutoff_3db_hz, key_points, chain (its parts as text), curve, on ``points`` frequencies from 1 Hz to half the flight's rate."""
    wide = diagnosis.parameters_wide(flights.params, ["flight_id"], diagnosis.FILTER_PARAMS[flights.platform])
    rows = diagnosis.fallback_cutoff(wide, flights.platform)
    manual = gyro_filter_hz is not None or notch_hz is not None
    if manual:
        kind = rows.schema["notches"].dataType
        one = F.array(F.struct(F.lit(float(notch_hz or 0)).alias("center"), F.col("notch_width").alias("bandwidth"), F.lit(30.0).alias("attenuation"), F.lit(3).cast("bigint").alias("harmonics"), F.lit(1).cast("bigint").alias("count")))
        given = F.col("cutoff") if gyro_filter_hz is None else F.lit(float(gyro_filter_hz))
        rows = rows.withColumns({"cutoff": given, "notches": (one if notch_hz else F.array()).cast(kind)})
    rows = rows.join(filter_rates(flights, rate_hz), "flight_id")
    return filter_curve(rows, points).select("flight_id", F.lit("manual" if manual else "auto").alias("mode"), "rate_hz", "cutoff_3db_hz", "key_points", "chain", "curve")


def filter_curve(rows: DataFrame, points: int = 500) -> DataFrame:
    """``rows`` (cutoff, notches, rate_hz) with cutoff_3db_hz, key_points, chain and curve."""
    rate, half = F.col("rate_hz"), F.col("rate_hz") / 2
    spread = F.flatten(F.transform("notches", lambda n: filters.spread_notches(n["center"], n["bandwidth"], n["attenuation"], n["harmonics"], n["count"], rate)))
    # The last point lies on half the rate, where a low-pass has no defined gain; it takes that of a little below.
    freqs = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.least(1 + k * ((half - 1) / (points - 1)), half - 1e-6))
    curve = filters.unwrapped(filters.chain_curve(freqs, rate, F.when((F.col("cutoff") > 0) & (F.col("cutoff") < half), F.col("cutoff")), F.col("spread")))
    rows = rows.withColumn("spread", spread).withColumn("curve", curve)
    point = lambda hz: F.when(half > hz, F.struct(F.lit(hz).alias("hz"), F.round(filters.at_hz(F.col("curve"), hz)["magnitude_db"], 1).alias("magnitude_db"), F.round(filters.at_hz(F.col("curve"), hz)["phase_deg"], 1).alias("phase_deg")))
    key_points = F.filter(F.array(*(point(hz) for hz in filters.KEY_HZ)), lambda p: p.isNotNull())
    return rows.withColumns({"cutoff_3db_hz": F.round(filters.cut_hz(F.col("curve")), 1), "key_points": key_points, "chain": diagnosis.chain_text(F.col("cutoff"), F.col("notches"))}).drop("spread")


def compare_filters(flights: Flights, changed: dict[str, float], rate_hz: float | DataFrame | None = None, points: int = 500) -> DataFrame:
    """flight_id, rate_hz, chain_before, chain_after, cutoff_before, cutoff_after and difference: at each key frequency what the parameters in ``changed``, put
    in place of the flight's own, add to magnitude (dB) and delay (degrees of phase).
    """
    names = {n.upper() for n in changed}
    own = flights.params.select("flight_id", "name", "value")
    given = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(v)).alias("value")) for n, v in changed.items())))
    new = own.where(~F.upper("name").isin(*names)).unionByName(own.select("flight_id").distinct().select("flight_id", given.alias("g")).select("flight_id", "g.*"))
    rates_of = filter_rates(flights, rate_hz)
    chains = []
    for params in (own, new):
        wide = diagnosis.parameters_wide(params, ["flight_id"], diagnosis.FILTER_PARAMS[flights.platform])
        chains.append(filter_curve(diagnosis.filter_chain(wide, flights.platform).join(rates_of, "flight_id"), points).select("flight_id", "rate_hz", "chain", F.col("cutoff_3db_hz").alias("cutoff"), "key_points"))
    before, after = (c.select("flight_id", *([] if k else ["rate_hz"]), *(F.col(n).alias(f"{n}_{side}") for n in ("chain", "cutoff", "key_points"))) for k, (c, side) in enumerate(zip(chains, ("before", "after"), strict=True)))
    both = before.join(after, "flight_id")
    added = F.zip_with("key_points_before", "key_points_after", lambda a, b: F.struct(a["hz"].alias("hz"), F.round(b["magnitude_db"] - a["magnitude_db"], 1).alias("magnitude_db"), F.round(b["phase_deg"] - a["phase_deg"], 1).alias("phase_deg")))
    return both.select("flight_id", "rate_hz", "chain_before", "chain_after", "cutoff_before", "cutoff_after", added.alias("difference"))


def sysid(flights: Flights, rate_hz: float | DataFrame | None = None, na: int = 2, nb: int = 2, delay: int = 1) -> DataFrame:
    """flight_id, axis, theta, fit_percent, reliable, omega, zeta, gain, bandwidth_hz, p_gain."""
    first = F.when(F.row_number().over(series.along(KEYS, "idx")) <= 10, 1)
    level = lambda c: F.avg(F.when(F.col("_first") == 1, F.col(c))).over(Window.partitionBy(*KEYS))
    rated = sampled(flights.pid, KEYS, rate_hz)
    rested = rated.withColumn("_first", first).withColumns({c: F.col(c) - level(c) for c in ("desired", "actual")})  # less the mean of the first ten samples
    rows, names = models.lagged(rested, KEYS, "actual", "desired", na, nb, delay)
    fits = models.solve(models.gram(rows, KEYS, names, "y0"), KEYS, na + nb)
    fits = series.join_keys(fits, rated.groupBy(*KEYS).agg(F.first("rate_hz").alias("rate_hz")), KEYS)
    return fits.join(models.poles_to_dynamics(fits, KEYS, na, nb, F.col("rate_hz")), KEYS)


def model_step(flights: Flights, rate_hz: float | DataFrame | None = None, seconds: float = 2.0, oversample: int = 10, na: int = 2, nb: int = 2, delay: int = 1) -> DataFrame:
    """flight_id, axis, rate_hz, t, response: what the fitted model of each series does after a unit step, for ``seconds`` at its own rate and at most half its samples, with
    ``oversample`` values a sample by a cubic spline. Series whose fit is not reliable have none.
    """
    fits = sysid(flights, rate_hz, na, nb, delay).where("reliable")
    steps = F.least(F.floor(seconds * F.col("rate_hz")), F.floor(F.col("n") / 2))
    fine = models.smoothed(models.step_responses(fits, KEYS, na, nb, delay, steps), KEYS, oversample)
    rated = series.join_keys(fine, fits.select(*KEYS, "rate_hz", steps.alias("_steps")), KEYS)
    each = rated.select(*KEYS, "rate_hz", "_steps", F.posexplode("response").alias("_k", "response"))
    place = F.col("_k") * (F.col("_steps") - 1) / F.greatest(F.col("_steps") * oversample - 1, F.lit(1))
    return each.select(*KEYS, "rate_hz", (place / F.col("rate_hz")).alias("t"), "response")


def spectrogram(flights: Flights, size: int = 256, overlap: float = 0.5, gyro: str = "gx", rate_hz: float | DataFrame | None = None) -> DataFrame:
    """flight_id, frame, t, bin, freq, magnitude_db of one gyro axis, its frames over both ends of the flight."""
    return spectral.padded_spectrogram(sampled(flights.imu, ["flight_id"], rate_hz), ["flight_id"], size, overlap, F.col("rate_hz"), gyro)


#: Samples of a magnetometer and of its attitudes that a calibration needs; batteries with fewer rows do not count; fixed values.
LEAST_FIELD, LEAST_BATTERY = 50, 50
#: mGauss under which an expected field cannot be right; a fixed value.
LEAST_EXPECTED = 100.0


def field_samples(flights: Flights, year: float = 2020.0, grid: DataFrame | None = None) -> DataFrame:
    """flight_id, idx, t, mx, my, mz, the expected field in the body's axes bx, by, bz (mGauss), throttle and has_position: from the magnetometer, the position, the
    attitudes and the battery of a flight, each brought to the magnetometer's clock. Flights with too few samples or attitudes have none.
    """
    key = ["flight_id"]
    mag = series.long_enough(flights.mag.select("flight_id", "idx", "t", "mx", "my", "mz"), key, LEAST_FIELD)
    if flights.attitude is None:
        raise AnalysisError(FAILURES["magfit"], "there are no attitudes", "a calibration turns the expected field by them")
    turns = series.long_enough(flights.attitude.where("roll is not null and pitch is not null and yaw is not null"), key, LEAST_FIELD)
    every = mag.select("flight_id").distinct()
    places = every.withColumns({n: F.lit(None).cast("double") for n in ("lat", "lon", "alt")}) if flights.position is None else every.join(flights.position.select("flight_id", "lat", "lon", "alt"), "flight_id", "left")
    field_of = attitude.expected_field(places, grid, year=year).select("flight_id", F.col("lat").isNotNull().alias("has_position"), *(F.col(n).alias(f"_{n}") for n in ("north", "east", "down")))
    rows = mag.join(field_of, "flight_id").join(turns.select("flight_id").distinct(), "flight_id", "left_semi")
    rows = tables.with_field(rows, turns, [F.col(f"_{n}") for n in ("north", "east", "down")])
    size = lambda *names: F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    middle = rows.groupBy("flight_id").agg(F.median(size("mx", "my", "mz")).alias("_measured"), F.first(size("_north", "_east", "_down")).alias("_expected"))
    scale = F.when(F.col("_expected") < LEAST_EXPECTED, F.col("_measured") / (F.col("_expected") + 1e-9)).otherwise(1.0)
    rows = rows.join(middle.select("flight_id", scale.alias("_scale")), "flight_id").withColumns({n: F.col(n) * F.col("_scale") for n in ("bx", "by", "bz")})
    powered = None if flights.battery is None else series.long_enough(flights.battery.where("curr is not null"), key, LEAST_BATTERY + 1)
    rows = rows.withColumn("throttle", F.lit(0.0)) if powered is None else tables.with_current(rows, powered).withColumn("throttle", F.coalesce("throttle", F.lit(0.0)))
    return rows.select("flight_id", "idx", "t", "mx", "my", "mz", "bx", "by", "bz", "throttle", "has_position")


def magfit(flights: Flights, year: float = 2020.0, grid: DataFrame | None = None) -> DataFrame:
    """flight_id, n, offset, diagonal, off_diagonal, motor, rmse, in_bounds, fitness, coverage (of attitude bins, each weighing alike), has_position, notes (codes).
    ``flights.mag`` may bring bx, by, bz and throttle along; else ``field_samples`` finds them. The field is the model's of ``year``, or of a ``grid``.
    """
    ready = {"bx", "by", "bz", "throttle"} <= set(flights.mag.columns)
    rows = flights.mag if ready else field_samples(flights, year, grid)
    placed = F.max("has_position") if "has_position" in rows.columns else F.lit(None).cast("boolean")
    binned = rows.withColumn("bin", attitude.nearest_bin([F.col(c) for c in ("bx", "by", "bz")]))
    weighted = attitude.coverage(binned, ["flight_id"])
    fit = models.calibrate(models.field_gram(weighted, ["flight_id"], ("mx", "my", "mz"), ("bx", "by", "bz"), "throttle", F.col("weight")), ["flight_id"])
    fit = fit.withColumn("fitness", bands.level_below(F.col("rmse"), bands.FITNESS))
    fit = fit.join(weighted.groupBy("flight_id").agg(F.max("coverage").alias("coverage"), placed.alias("has_position")), "flight_id")
    enough = F.lit(True)
    if flights.attitude is not None:
        fit = fit.join(coverage(flights).select("flight_id", "coverage_ok"), "flight_id", "left")
        enough = F.coalesce("coverage_ok", F.lit(False))
    notes = diagnosis.field_notes(F.col("offset"), F.col("diagonal"), F.col("off_diagonal"), F.col("motor"), enough)
    unplaced = F.when(F.col("has_position") == F.lit(False), F.array(F.lit("no_position"))).otherwise(F.array().cast("array<string>"))
    return fit.withColumn("notes", F.concat(notes, unplaced)).drop("coverage_ok")


def hardware(flights: Flights) -> DataFrame:
    """flight_id; devices (the packed ids among the parameters, decoded); imus and compasses in use with their offsets; gains by axis; the filter chain as text; voltage and current."""
    ids = flights.params.where(F.col("name").rlike("_ID[0-9]*$|DEV_ID") & (F.col("value") > 0)).withColumn("id", F.col("value").cast("long"))
    decoded = ids.select("flight_id", "name", *(c.alias(n) for n, c in attitude.decode_device(F.col("id")).items()))
    devices = decoded.groupBy("flight_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in decoded.columns if c != "flight_id")))).alias("devices"))
    last = flights.params.groupBy("flight_id", "name").agg(F.max("value").alias("value"))
    named = last.groupBy("flight_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("p"))
    get = lambda name: F.coalesce(F.try_element_at("p", F.lit(name)), F.lit(0.0))
    used = lambda each, *ids: F.filter(F.array(*each), lambda x: reduce(lambda a, b: a | b, (x[i] > 0 for i in ids)))
    three = lambda name: F.array(*(get(f"{name}_{a}") for a in "XYZ"))
    tail = lambda k: "" if k == 0 else str(k + 1)
    imus = [F.struct(F.lit(k).alias("index"), get(f"INS_GYR{tail(k)}_ID").alias("gyro_id"), get(f"INS_ACC{tail(k)}_ID").alias("accel_id"), three(f"INS_GYR{tail(k)}OFFS").alias("gyro_offset"), three(f"INS_ACC{tail(k)}OFFS").alias("accel_offset")) for k in range(5)]
    compasses = [F.struct(F.lit(k).alias("index"), get(f"COMPASS_DEV_ID{tail(k)}").alias("dev_id"), three(f"COMPASS_OFS{tail(k)}").alias("offset"), three(f"COMPASS_DIA{tail(k)}").alias("diagonal"), get(f"COMPASS_USE{tail(k)}").alias("use")) for k in range(3)]
    gains = [F.struct(F.lit(axis).alias("axis"), *(get(f"pid.{axis}.{g}").alias(g) for g in ("p", "i", "d", "ff"))) for axis in ("roll", "pitch", "yaw")]
    report = named.select("flight_id", used(imus, "gyro_id", "accel_id").alias("imus"), used(compasses, "dev_id").alias("compasses"), F.array(*gains).alias("gains"))
    wide = diagnosis.filter_chain(diagnosis.parameters_wide(flights.params, ["flight_id"], diagnosis.FILTER_PARAMS[flights.platform]), flights.platform)
    report = report.join(wide.select("flight_id", diagnosis.chain_text(F.col("cutoff"), F.col("notches")).alias("filters")), "flight_id").join(devices, "flight_id", "left")
    report = report.join(platform_settings(flights.params, flights.platform), "flight_id")
    if flights.versions is not None:
        said = [c for c in ("firmware", "kind", "board", "craft") if c in flights.versions.columns]
        report = report.join(flights.versions.select("flight_id", *(F.col(c).cast("string").alias(c) for c in said)), "flight_id", "left")
    if flights.pid is not None or flights.imu is not None:
        report = report.join(validation(flights).select("flight_id", "issues"), "flight_id", "left")
    if flights.battery is None:
        return report
    power = flights.battery.groupBy("flight_id").agg(F.min("volt").alias("volt_min"), F.max("volt").alias("volt_max"), F.avg("volt").alias("volt_mean"), F.max("curr").alias("curr_max"))
    return report.join(power, "flight_id", "left")


#: Filter settings that a report lists, by platform; fixed values.
FILTER_SETTINGS = {
    "ardupilot": ("INS_GYRO_FILTER", "INS_ACCEL_FILTER", "INS_HNTCH_ENABLE", "INS_HNTCH_FREQ", "INS_HNTCH_BW", "INS_HNTC2_ENABLE", "INS_HNTC2_FREQ", "INS_HNTC2_BW"),
    "betaflight": ("gyro_lowpass_hz", "gyro_lowpass2_hz", "dterm_lowpass_hz", "dterm_lowpass2_hz", "gyro_lpf1_static_hz", "gyro_lpf2_static_hz", "dterm_lpf1_static_hz", "dterm_lpf2_static_hz", "gyro_notch1_hz", "gyro_notch1_cutoff", "gyro_notch2_hz", "gyro_notch2_cutoff", "rpm_filter_min_hz"),
    "px4": ("IMU_GYRO_CUTOFF", "IMU_DGYRO_CUTOFF", "IMU_GYRO_NF0_FRQ", "IMU_GYRO_NF0_BW", "IMU_GYRO_NF1_FRQ", "IMU_GYRO_NF1_BW"),
}


def platform_settings(params: DataFrame, platform: str) -> DataFrame:
    """flight_id, total_params, loop_rate_hz and pid_rate_hz (null where the platform's parameters do not say), filter_settings (a map of those that are in use)."""
    last = params.groupBy("flight_id", "name").agg(F.max("value").alias("value"))
    get = lambda *names: F.coalesce(*(F.max(F.when(F.col("name") == n, F.col("value"))) for n in names))
    own = F.col("name").isin(*FILTER_SETTINGS[platform]) & (F.col("value") > 0)
    # Generic names stand for native ones, which are counted already.
    native = F.count_if(~F.col("name").rlike(r"^(pid|filter|mag)\.")).alias("total_params")
    loop, every = {"betaflight": (get("looptime"), get("pid_process_denom", "P interval")), "ardupilot": (get("SCHED_LOOP_RATE"), F.lit(None).cast("double")), "px4": (get("IMU_GYRO_RATEMAX"), F.lit(None).cast("double"))}[platform]
    rows = last.groupBy("flight_id").agg(native, loop.alias("_loop"), every.alias("_every"), F.map_from_entries(F.array_sort(F.collect_list(F.when(own, F.struct("name", "value"))))).alias("filter_settings"))
    # A loop time in microseconds; small numbers are rates already.
    rate = F.round(F.when(F.col("_loop") > 100, 1e6 / F.col("_loop")).otherwise(F.col("_loop"))) if platform == "betaflight" else F.col("_loop")
    pid_rate = F.when(rate > 0, F.round(rate / F.greatest(F.coalesce("_every", F.lit(1.0)), F.lit(1.0)))) if platform == "betaflight" else F.lit(None).cast("double")
    return rows.select("flight_id", "total_params", F.when(rate > 0, rate).alias("loop_rate_hz"), pid_rate.alias("pid_rate_hz"), "filter_settings")


def feed_forward(flights: Flights) -> DataFrame:
    """flight_id, axis, steps, overshoots, tracking_rms, ff_percent, overshoot_detected, factor, assessment of Betaflight logs."""
    parts = {c: F.abs(F.coalesce(c, F.lit(0.0))) for c in ("p", "i", "d", "ff")}
    total = sum(parts.values(), F.lit(0.0))
    rows = flights.pid.withColumn("ff_share", F.when(total > 1e-6, 100 * parts["ff"] / total))
    return diagnosis.feed_forward(rows, KEYS, "desired", "actual", "ff_share")


def rpm_filter(flights: Flights, rate_hz: float | DataFrame | None = None) -> DataFrame:
    """flight_id, rpm_filter (in use), above_floor (the largest motor peak), residual, assessment, lowpass (a cutoff to try, null: keep)."""
    bins = gyro_spectrum(flights, rate_hz)
    floor = spectral.noise_floor(bins, ["flight_id"]).select("flight_id", "floor")
    bins = bins.drop("rate_hz")
    peaks = spectral.local_peaks(bins, ["flight_id"], 10.0, 80.0, 400.0, 5).join(floor, "flight_id").groupBy("flight_id").agg(F.max(F.col("magnitude") - F.col("floor")).alias("above_floor"))
    wide = diagnosis.parameters_wide(flights.params, ["flight_id"], {"rpm_filter": 0, "dshot_bidir": 0, "gyro_lowpass_hz": 200})
    used = wide.select("flight_id", ((F.col("rpm_filter") > 0) & (F.col("dshot_bidir") > 0)).alias("rpm_filter"), F.col("gyro_lowpass_hz").alias("current"))
    rows = used.join(floor, "flight_id").drop("floor").join(peaks, "flight_id", "left")
    above, on = F.col("above_floor"), F.col("rpm_filter")
    return rows.select("flight_id", "rpm_filter", "above_floor", diagnosis.motor_noise(above, on).alias("assessment"), diagnosis.gyro_lowpass(above, on, F.col("current")).alias("lowpass"))


def d_term(flights: Flights, rate_hz: float | DataFrame | None = None) -> DataFrame:
    """flight_id, axis, d_to_p (of their RMS), high_share (of the D term's energy, from an eighth of the series' rate on), d_min_active_percent, assessment, factor."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    ratio = flights.pid.groupBy(*KEYS).agg((rms("d") / F.nullif(rms("p"), F.lit(0.0))).alias("d_to_p"))
    middle = flights.pid.withColumn("_m", F.median(F.abs("d")).over(Window.partitionBy(*KEYS)))
    active = middle.groupBy(*KEYS).agg((100 * F.count_if(F.abs("d") < 0.6 * F.col("_m")) / F.count("*")).alias("d_min_active_percent"))
    bins = spectral.measured_spectrum(flights.pid, KEYS, 0.5, rate_hz, value="d")
    power = F.col("magnitude") * F.col("magnitude")
    high = bins.groupBy(*KEYS).agg((F.sum(F.when(F.col("freq") >= F.col("rate_hz") / 8, power)) / F.nullif(F.sum(power), F.lit(0.0))).alias("high_share"))
    level, factor = diagnosis.d_term(F.col("d_to_p"), F.coalesce("high_share", F.lit(0.0)))
    return ratio.join(active, KEYS).join(high, KEYS, "left").withColumns({"assessment": level, "factor": factor})


def validated(recommendations: DataFrame, definitions: DataFrame, name: str = "param", value: str = "suggested") -> DataFrame:
    """Recommendations with the catalog's verdict on what they suggest; nothing unknown passes."""
    entries = recommendations.withColumns({"entry": F.col(name), "value": F.col(value)})
    return catalog.validate(entries, definitions)


def validation(flights: Flights, least: int = 100) -> DataFrame:
    """flight_id, issues: codes of what the tables of a flight lack; flights without any rows do not occur."""
    count = lambda df, name: df.groupBy("flight_id").agg(F.count("*").alias(name))
    parts = []
    if flights.pid is not None:
        by_axis = flights.pid.groupBy("flight_id", "axis").agg(F.count("*").alias("n"))
        parts.append(by_axis.groupBy("flight_id").agg(F.min("n").alias("pid")))
    if flights.imu is not None:
        parts.append(count(flights.imu, "imu"))
    if not parts:
        raise AnalysisError(NOTHING_RAN, "there are no tables")
    rows = parts[0]
    for other in parts[1:]:
        rows = rows.join(other, "flight_id", "full")
    for name in {"pid", "imu"} - set(rows.columns):
        rows = rows.withColumn(name, F.lit(None).cast("long"))
    return rows.select("flight_id", diagnosis.log_issues([F.coalesce("pid", F.lit(0))], F.col("pid").isNotNull(), F.col("imu"), F.col("imu"), least).alias("issues"))


@dataclass
class Analysis:
    """results: a lazy DataFrame for each module that could be planned. failures: (module, code, error) of those that could not."""

    results: dict[str, DataFrame]
    failures: list[tuple[str, str, str]]

    def written(self, folder: str) -> Analysis:
        """Every result written under ``folder`` and read back; a module that fails in its run joins the failures, the others go on."""
        results, failures = {}, list(self.failures)
        for name, df in self.results.items():
            try:
                df.write.mode("overwrite").parquet(f"{folder}/{name}")
                results[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
            except Exception as e:  # whatever ends a module's job must not end the others'
                failures.append((name, FAILURES.get(name, "E5000"), f"{type(e).__name__}: {e}"))
        if not results:
            raise AnalysisError(ALL_FAILED, "every module failed", "; ".join(f"{m}: {e[:200]}" for m, _, e in failures))
        return Analysis(results, failures)


def analyze(flights: Flights, rate_hz: float | DataFrame | None = None, modules: Sequence[str] | None = None) -> Analysis:
    """All modules that are asked for, that the platform supports and that have their tables, and extra analyses by their names. One that fails is
    recorded; if none is left, AnalysisError says why. Rates are each series' own unless ``rate_hz`` gives one for all, or for each flight (flight_id, rate_hz).
    """
    needs = {"quality": flights.pid, "pid": flights.pid, "fft": flights.imu, "filter": flights.params, "sysid": flights.pid, "magfit": flights.mag, "hardware": flights.params}
    run = {"quality": quality, "pid": pid, "fft": lambda f: fft(f, rate_hz), "filter": lambda f: filter(f, rate_hz), "sysid": lambda f: sysid(f, rate_hz), "magfit": magfit, "hardware": hardware}
    # On any platform, for those who name them.
    named = {"validation": (validation, flights.pid if flights.imu is None else flights.imu), "coverage": (coverage, flights.attitude), "notes": (lambda f: f.health, flights.health), "step_response": (lambda f: step_response(f, rate_hz), flights.pid), "model_step": (lambda f: model_step(f, rate_hz), flights.pid)}
    unknown = set(modules or ()) - set(run) - set(named) - set(flights.extra)
    if unknown:
        raise ValueError(f"no such modules: {', '.join(sorted(unknown))}")
    wanted = {m: run[m] for m in CAPABILITIES[flights.platform] if (modules is None or m in modules) and needs[m] is not None}
    wanted |= {m: make for m, (make, table) in named.items() if m in (modules or ()) and table is not None}
    if flights.platform == "betaflight" and modules is None:
        wanted |= {"feed_forward": feed_forward, "d_term": lambda f: d_term(f, rate_hz)} if flights.pid is not None and {"p", "d", "ff"} <= set(flights.pid.columns) else {}
        wanted |= {"rpm_filter": lambda f: rpm_filter(f, rate_hz)} if flights.imu is not None and flights.params is not None else {}
    wanted |= {n: f for n, f in flights.extra.items() if modules is None or n in modules}
    results = {}
    # Modules that were asked for by name and whose table is missing are told, not passed over.
    failures = [(m, errors.MISSING[m], f"the flights have no table for {m}") for m in modules or () if m in errors.MISSING and m not in wanted and (needs.get(m) is None and m in needs or m in named and named[m][1] is None)]
    for name, make in wanted.items():
        try:
            results[name] = make(flights)
        except Exception as e:  # a module that cannot be planned, for want of a column say
            failures.append((name, FAILURES.get(name, "E5000"), f"{type(e).__name__}: {e}"))
    if not results:
        hint = "; ".join(f"{m}: {e[:200]}" for m, _, e in failures) or "the tables that these modules need are missing"
        raise AnalysisError(ALL_FAILED if failures else NOTHING_RAN, "no module could run", hint)
    return Analysis(results, failures)


def recommendations(analysis: Analysis) -> DataFrame:
    """flight_id, module, param, current, suggested, action: what all modules of an analysis suggest, one under the other."""
    found = {}
    if "pid" in analysis.results and "recommendations" in analysis.results["pid"].columns:
        rows = analysis.results["pid"].select("flight_id", "axis", F.explode("recommendations").alias("r"))
        found["pid"] = rows.select("flight_id", F.concat_ws(".", F.lit("pid"), "axis", "r.gain").alias("param"), "r.current", "r.suggested")
    if "fft" in analysis.results:
        found["fft"] = analysis.results["fft"].select("flight_id", F.explode("native").alias("r")).select("flight_id", "r.param", F.col("r.value").alias("suggested"))
    if not found:
        raise AnalysisError(NOTHING_RAN, "no module with recommendations ran")
    return vibration.all_recommendations(found, ["flight_id"])
