"""Column expressions that bring raw log values to the library's units: deg, deg/s, m/s2, mGauss, V, A, motors 0 to 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAVITY = 9.80665
#: Battery voltages that mean "not measured"; fixed values.
NO_VOLTAGE = (0.0, 65535.0)
#: Fields that high-resolution logs hold in tenths; fixed values.
TENTHS = ("gyroADC", "gyroUnfilt", "gyroData", "rcCommand", "setpoint")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def degrees_if_radians(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], below: float = 6.5) -> DataFrame:
    """``columns`` times 180/pi for a series none of whose values reaches ``below``: it was logged in radians."""
    top = F.max(F.greatest(*(F.abs(c) for c in columns))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_top", top)
    return rows.withColumns({c: F.when((F.col("_top") > 0) & (F.col("_top") < below), F.degrees(c)).otherwise(F.col(c)) for c in columns}).drop("_top")


def acceleration_from_mg(x: Column) -> Column:
    return x * (GRAVITY / 1000)


def acceleration_from_adc(x: Column, one_g: Column) -> Column:
    return x * GRAVITY / F.coalesce(one_g, F.lit(256.0))


def rate_from_mrad(x: Column) -> Column:
    return F.degrees(x / 1000)


def milligauss(gauss: Column) -> Column:
    return gauss * 1000


def tenths(name: str, x: Column, high_resolution: Column) -> Column:
    """A field's value, which high-resolution logs hold in tenths for the families in TENTHS."""
    return F.when(high_resolution, x / 10).otherwise(x) if name.split("[")[0] in TENTHS else x


def motor_share(raw: Column, low: Column, high: Column) -> Column:
    return clip((raw - low) / (high - low), 0.0, 1.0)


def pwm_share(pwm: Column) -> Column:
    return clip((pwm - 1000) / 1000, 0.0, 1.0)


def coordinate(v: Column) -> Column:
    """Degrees of a latitude or longitude that may be in ten-millionths."""
    return F.when(F.abs(v) > 1000, v * 1e-7).otherwise(v)


def altitude(v: Column) -> Column:
    """Metres of an altitude that may be in millimetres."""
    return F.when(F.abs(v) > 100_000, v * 1e-3).otherwise(v)


def measured_voltage(v: Column) -> Column:
    return F.when(~v.isin(*NO_VOLTAGE), v)


def drawn_current(i: Column) -> Column:
    return F.greatest(i, F.lit(0.0))


def not_all_zero(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(c) != 0)
    return out


def active_channels(rows: DataFrame, keys: Sequence[str], channel: str, value: str, above: float = 800.0) -> DataFrame:
    """Rows of the output channels whose largest value passes ``above``."""
    return rows.withColumn("_m", F.max(value).over(Window.partitionBy(*keys, channel))).where(F.col("_m") > above).drop("_m")


def throttle_share(rows: DataFrame, keys: Sequence[str], current: str, sticks: Sequence[str] = ()) -> DataFrame:
    """``throttle``: the absolute current over its largest; of a flight without current the summed absolute stick inputs over their largest; without either 0."""
    whole = Window.partitionBy(*keys)
    share = lambda x: F.try_divide(x, F.nullif(F.max(x).over(whole), F.lit(0.0)))
    moved = sum((F.coalesce(F.abs(s), F.lit(0.0)) for s in sticks), F.lit(0.0))
    return rows.withColumn("throttle", F.coalesce(share(F.abs(current)), share(moved), F.lit(0.0)))


def change_percent(old: Column, new: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise((new - old) / old * 100)


def compensated(raw: Sequence[Column], offset: Sequence[float], diagonal: Sequence[float], off_diagonal: Sequence[float], motor: Sequence[float] = (0, 0, 0), throttle: Column | None = None) -> list[Column]:
    """Soft-iron compensation M (raw + offset) + motor * throttle with symmetric M."""
    x, y, z = (r + o for r, o in zip(raw, offset, strict=True))
    (a, b, c), (d, e, f) = diagonal, off_diagonal
    t = F.lit(0.0) if throttle is None else throttle
    return [a * x + d * y + e * z + motor[0] * t, d * x + b * y + f * z + motor[1] * t, e * x + f * y + c * z + motor[2] * t]


def version_text(packed: Column) -> Column:
    part = lambda shift: F.shiftright(packed, shift).bitwiseAND(255).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8))


def frame_kind(motors: Column) -> Column:
    return F.when(motors <= 4, "quad").when(motors <= 6, "hex").otherwise("octo")


def null_if_odd(x: Column) -> Column:
    """Null for NaN and the infinities, which JSON cannot hold."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


#: Names by which platforms are known; fixed values.
PLATFORMS = {"ap": "ardupilot", "apm": "ardupilot", "arducopter": "ardupilot", "ardupilot": "ardupilot", "bf": "betaflight", "betaflight": "betaflight", "px4": "px4", "pixhawk": "px4"}


def platform_name(text: str) -> str:
    key = text.strip().lower()
    if key not in PLATFORMS:
        raise ValueError(f"{text!r} is no platform; known are {', '.join(sorted(set(PLATFORMS.values())))}")
    return PLATFORMS[key]
