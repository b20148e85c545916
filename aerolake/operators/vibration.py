"""What follows from vibration peaks: filter settings, their names on each platform, warnings. Codes and numbers, never prose.

Peaks are an array of structs (freq, magnitude in dB, source, harmonic), as ``spectral.with_harmonics`` gives them; a level is a label of ``bands``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.operators.diagnosis import codes

TRACKED = ("motor", "blade")
#: Cutoff (Hz) of the gyro low-pass by level, others as the best; fixed values.
GYRO_LOWPASS = {"MARGINAL": 40.0, "POOR": 20.0, "UNUSABLE": 10.0}
BEST_LOWPASS, ACCEL_LOWPASS = 60.0, 10.0
#: Generic settings by their names on a platform; fixed values.
NATIVE = {
    "ardupilot": {
        "enable": "INS_HNTCH_ENABLE", "mode": "INS_HNTCH_MODE", "freq": "INS_HNTCH_FREQ", "bw": "INS_HNTCH_BW", "att": "INS_HNTCH_ATT", "ref": "INS_HNTCH_REF", "hmc": "INS_HNTCH_HMNCS",
        "gyro_lpf": "INS_GYRO_FILTER", "accel_lpf": "INS_ACCEL_FILTER",
    },
    "betaflight": {"enable": "gyro_notch1_enabled", "freq": "gyro_notch1_hz", "bw": "gyro_notch1_cutoff", "gyro_lpf": "gyro_lowpass_hz"},
    "px4": {"gyro_lpf": "IMU_GYRO_CUTOFF"},
}
#: What to look at before such a vehicle flies again; fixed values.
CHECKS = ("propeller_balance", "motor_mounts", "frame_cracks", "imu_damping", "payload_mounting")


def ranked(peaks: Column) -> Column:
    """Peaks from the loudest down, the lower frequency first among equals."""
    by = F.array_sort(F.transform(peaks, lambda p: F.struct((-p["magnitude"]).alias("m"), p["freq"].alias("f"), p.alias("p"))))
    return F.transform(by, lambda x: x["p"])


def second_peak(peaks: Column) -> Column:
    """The loudest peak but one that is no harmonic, null if there is none."""
    return F.get(F.filter(F.slice(ranked(peaks), F.lit(2), F.greatest(F.size(peaks) - 1, F.lit(0))), lambda p: ~p["harmonic"]), F.lit(0))


def tenths(x: Column) -> Column:
    """Rounded to tenths, halves to even."""
    return F.rint(x * 10) / 10


def notch_settings(peaks: Column, level: Column) -> Column:
    """Struct enable, mode (1 fixed, 2 throttle, 4 spectrum), freq, bw, att, ref, hmc, gyro_lpf, accel_lpf."""
    peaks = F.coalesce(peaks, F.array().cast("array<struct<freq:double,magnitude:double,source:string,harmonic:boolean>>"))
    n, top = F.size(peaks), F.get(ranked(peaks), F.lit(0))
    quiet, tracked, rough = level.isin("EXCELLENT", "GOOD"), top["source"].isin(*TRACKED), level.isin("MARGINAL", "POOR")
    low = F.lit(BEST_LOWPASS)
    for label, hz in GYRO_LOWPASS.items():
        low = F.when(level == label, hz).otherwise(low)
    width = F.greatest(F.lit(5.0), F.when(top["source"] == "structural", 0.8 * top["freq"]).otherwise(top["freq"] / 2))

    def pick(found: Column, off: float, guessed: float | Column) -> Column:
        """With peaks; without any on a quiet vehicle; without any on a shaking one."""
        return F.when(n > 0, found).when(quiet, off).otherwise(guessed)

    mode = F.when(n >= 3, 4).when((n == 2) | tracked, 2).otherwise(1)
    return F.struct(
        pick(F.lit(1), 0, 1).alias("enable"),
        pick(mode, 0, 1).alias("mode"),
        pick(tenths(top["freq"]), 0.0, 80.0).alias("freq"),
        pick(tenths(width), 0.0, 40.0).alias("bw"),
        pick(F.when(rough | (level == "UNUSABLE"), 60.0).otherwise(40.0), 0.0, F.when(rough, 60.0).otherwise(40.0)).alias("att"),
        pick(F.when(n >= 3, 1.0).otherwise(0.0), 0.0, 0.0).alias("ref"),
        pick(F.when(tracked, 1).otherwise(0), 0, 1).alias("hmc"),
        F.when(n > 0, low).otherwise(BEST_LOWPASS).alias("gyro_lpf"),
        F.lit(ACCEL_LOWPASS).alias("accel_lpf"),
    )


def static_notches(settings: Column, peaks: Column) -> Column:
    """What a platform with static notches alone can express: enable, freq, bw, low-passes, and a second notch (nulls without one)."""
    second = second_peak(peaks)
    keep = [settings[c].alias(c) for c in ("enable", "freq", "bw", "gyro_lpf", "accel_lpf")]
    return F.struct(*keep, F.when(second.isNotNull(), 1).alias("enable2"), tenths(second["freq"]).alias("freq2"), tenths(F.greatest(F.lit(5.0), second["freq"] / 2)).alias("bw2"))


def warnings(settings: Column, peaks: Column, level: Column, platform: str) -> Column:
    """Codes: ground_until_checked; throttle_reference (its value cannot follow from a spectrum); static_notch_motor; several_peaks."""
    n = F.coalesce(F.size(peaks), F.lit(0))
    on = settings["enable"] == 1
    tracked = F.exists(peaks, lambda p: p["source"].isin(*TRACKED))
    own = (tracked & on, "static_notch_motor") if platform == "px4" else ((settings["mode"] == 2) & on, "throttle_reference")
    return codes((level.isin("POOR", "UNUSABLE"), "ground_until_checked"), own, ((n >= 2) & ~level.isin("EXCELLENT", "GOOD"), "several_peaks"))


def checks(level: Column) -> Column:
    return F.when(level.isin("POOR", "UNUSABLE"), F.array(*map(F.lit, CHECKS))).otherwise(F.array().cast("array<string>"))


def native(settings: Column, platform: str) -> Column:
    """Array of (param, value) in a platform's own names; Betaflight's second notch number is a cutoff, not a width."""
    own = []
    for generic, name in NATIVE[platform].items():
        value = settings[generic].cast("double")
        if platform == "betaflight" and generic == "bw":
            value = F.when((settings["freq"] > 0) & (settings["bw"] > 0), tenths(F.greatest(settings["freq"] - settings["bw"] / 2, F.lit(1.0)))).otherwise(value)
        own.append(F.struct(F.lit(name).alias("param"), value.alias("value")))
    return F.array(*own)


def one_line(settings: Column, platform: str) -> Column:
    """The native settings as ``set name = value`` (``param set name value`` on PX4) commands."""
    form = {"betaflight": "set %s = %s", "px4": "param set %s %s"}.get(platform, "%s=%s")
    return F.array_join(F.transform(native(settings, platform), lambda p: F.format_string(form, p["param"], p["value"].cast("string"))), "; ")


def all_recommendations(modules: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys, module, param, current, suggested, action: of every module's rows (param, suggested, and current if they have one), one under the other."""
    out = None
    for name, rows in modules.items():
        current = F.col("current").cast("double") if "current" in rows.columns else F.lit(0.0)
        own = rows.select(*keys, F.lit(name).alias("module"), "param", current.alias("current"), F.col("suggested").cast("double").alias("suggested"), F.lit("adjust" if "current" in rows.columns else "set").alias("action"))
        out = own if out is None else out.unionByName(own)
    return out
