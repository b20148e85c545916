"""Frequency responses of low-pass and notch chains as column expressions over (filter, frequency) rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequencies (Hz) at which a response is reported; fixed values.
KEY_HZ = (1.0, 5.0, 10.0, 20.0, 40.0, 80.0, 120.0, 200.0)


def biquad_gain(b: tuple[Column, Column, Column], a: tuple[Column, Column, Column], freq: Column, rate: Column) -> tuple[Column, Column]:
    """(log magnitude, phase) at ``freq`` of (b0 + b1/z + b2/z2) / (a0 + a1/z + a2/z2)."""
    w = 2 * math.pi * freq / rate
    real = lambda c: c[0] + c[1] * F.cos(w) + c[2] * F.cos(2 * w)
    imag = lambda c: -(c[1] * F.sin(w) + c[2] * F.sin(2 * w))
    log_size = lambda c: 0.5 * F.log(F.greatest(real(c) * real(c) + imag(c) * imag(c), F.lit(1e-300)))
    return log_size(b) - log_size(a), F.atan2(imag(b), real(b)) - F.atan2(imag(a), real(a))


def lowpass(cutoff: Column, rate: Column) -> tuple[tuple[Column, Column, Column], tuple[Column, Column, Column]]:
    """Coefficients of a second-order Butterworth low-pass."""
    w = F.tan(math.pi * cutoff / rate)
    lean = 2 * math.cos(math.pi / 4) * w
    c = 1 + lean + w * w
    b0 = w * w / c
    return (b0, 2 * b0, b0), (F.lit(1.0), 2 * (w * w - 1) / c, (1 - lean + w * w) / c)


def notch(center: Column, bandwidth: Column, amp: Column, rate: Column) -> tuple[tuple[Column, Column, Column], tuple[Column, Column, Column]]:
    """Coefficients of a notch whose depth is the square of ``amp``."""
    octaves = 2 * F.log2(center / (center - bandwidth / 2))
    q = F.when(octaves > 0, F.sqrt(F.pow(F.lit(2.0), octaves)) / (F.pow(F.lit(2.0), octaves) - 1)).otherwise(10.0)
    w = 2 * math.pi * center / rate
    alpha = F.sin(w) / (2 * q)
    return (1 + alpha * amp * amp, -2 * F.cos(w), 1 - alpha * amp * amp), (1 + alpha, -2 * F.cos(w), 1 - alpha)


def grid(step: float, points: int) -> Column:
    """Frequencies step, 2 step, ... as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(points)), lambda k: k * F.lit(step))


def spread_notches(center: Column, bandwidth: Column, attenuation: Column, harmonics: Column, count: Column, rate: Column, least: Column | None = None) -> Column:
    """Array of (at, wide, amp): the notches of each harmonic under half the rate. Bit n of ``harmonics`` stands for harmonic n + 1; two or three notches of
    a harmonic (``count``) are spread to either side of it. Under ``least`` Hz a notch stays there and fades, and is gone at a quarter of it.
    """
    spread = bandwidth / (32 * center)
    least = F.lit(0.0) if least is None else least
    places = F.when(count == 3, F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0))).when(count == 2, F.array(F.lit(-1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0)))
    chosen = F.filter(F.sequence(F.lit(1), F.lit(16)), lambda h: F.getbit(harmonics.cast("long"), h - 1) == 1)
    full = F.pow(F.lit(10.0), -attenuation / 40)

    def of(h: Column, place: Column) -> Column:
        own, wide = center * h, bandwidth * h / count
        amp = F.when(own < least, 1 + (full - 1) * (own - 0.25 * least) / (0.75 * least)).otherwise(full)
        inside = (own > wide / 2) & (own < rate / 2) & (own >= 0.25 * least)
        return F.when(inside, F.struct((F.greatest(own, least) * (1 + place * spread)).alias("at"), wide.alias("wide"), amp.alias("amp")))

    return F.filter(F.flatten(F.transform(chosen, lambda h: F.transform(places, lambda place: of(h, place)))), lambda n: n.isNotNull())


def summed_response(notches: DataFrame, keys: list[str], step: float, points: int) -> DataFrame:
    """keys, freq, magnitude_db, phase_deg of rows (keys, at, wide, amp, rate), all notches of a key together, on a grid. Generated code, and sums that combine
    before the shuffle: cheaper than ``chain_curve`` for many keys, which needs no shuffle.
    """
    gain, phase = biquad_gain(*notch(F.col("at"), F.col("wide"), F.col("amp"), F.col("rate")), F.col("freq"), F.col("rate"))
    rows = notches.withColumn("freq", F.explode(grid(step, points))).select(*keys, "freq", gain.alias("g"), phase.alias("p"))
    out = rows.groupBy(*keys, "freq").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return out.select(*keys, "freq", (20 / math.log(10) * F.greatest("g", F.lit(math.log(1e-12)))).alias("magnitude_db"), F.degrees("p").alias("phase_deg"))


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often, or in whatever loop, ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def section(b: tuple[Column, Column, Column], a: tuple[Column, Column, Column]) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in zip(("b0", "b1", "b2", "a0", "a1", "a2"), (*b, *a), strict=True)))


def chain_curve(freqs: Column, rate: Column, cutoff: Column | None, notches: Column | None) -> Column:
    """Array of (freq, magnitude_db, phase_deg) of a low-pass (none where the cutoff is null) and all notches of a row together. Their complex product
    is a sum of logarithms and of phases, taken inside the row: nothing is exploded or shuffled, and coefficients are found once.
    """
    sections = []
    if cutoff is not None:
        sections.append(F.filter(F.array(F.when(cutoff.isNotNull(), section(*lowpass(cutoff, rate)))), lambda x: x.isNotNull()))
    if notches is not None:
        sections.append(F.transform(notches, lambda n: section(*notch(n["at"], n["wide"], n["amp"], rate))))

    def point(freq: Column, own: Column) -> Column:
        w = 2 * math.pi * freq / rate

        def product(t: Column) -> Column:
            def add(sums: Column, x: Column) -> Column:
                real = lambda k: x[f"{k}0"] + x[f"{k}1"] * t["c1"] + x[f"{k}2"] * t["c2"]
                imag = lambda k: -(x[f"{k}1"] * t["s1"] + x[f"{k}2"] * t["s2"])
                size = lambda k: 0.5 * F.log(F.greatest(real(k) * real(k) + imag(k) * imag(k), F.lit(1e-300)))
                turn = F.atan2(imag("b"), real("b")) - F.atan2(imag("a"), real("a"))
                return F.struct((sums["g"] + size("b") - size("a")).alias("g"), (sums["p"] + turn).alias("p"))

            return F.aggregate(own, F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("p")), add)

        turns = F.struct(F.cos(w).alias("c1"), F.cos(2 * w).alias("c2"), F.sin(w).alias("s1"), F.sin(2 * w).alias("s2"))
        sums = lambda x: F.struct(freq.alias("freq"), (20 / math.log(10) * F.greatest(x["g"], F.lit(math.log(1e-12)))).alias("magnitude_db"), F.degrees(x["p"]).alias("phase_deg"))
        return held(held(turns, product), sums)

    return held(F.concat(*sections), lambda own: F.transform(freqs, lambda freq: point(freq, own)))


def unwrapped(curve: Column) -> Column:
    """The curve with its phase unwrapped from one frequency to the next: 360 off after jumps of 315 up, 360 on after 45 down."""

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        jump = x["phase_deg"] - last["raw"]
        turned = F.when(jump >= 315, jump - 360).when(jump <= -45, jump + 360).otherwise(jump)
        return F.array_append(out, F.struct(x["freq"].alias("freq"), x["magnitude_db"].alias("magnitude_db"), F.coalesce(last["phase_deg"] + turned, x["phase_deg"]).alias("phase_deg"), x["phase_deg"].alias("raw")))

    found = F.aggregate(curve, F.array().cast("array<struct<freq:double,magnitude_db:double,phase_deg:double,raw:double>>"), add)
    return F.transform(found, lambda x: F.struct(x["freq"].alias("freq"), x["magnitude_db"].alias("magnitude_db"), x["phase_deg"].alias("phase_deg")))


def lowpass_response(rows: DataFrame) -> DataFrame:
    """``rows`` (cutoff, rate, freq) with magnitude_db and phase_deg."""
    gain, phase = biquad_gain(*lowpass(F.col("cutoff"), F.col("rate")), F.col("freq"), F.col("rate"))
    return rows.withColumns({"magnitude_db": 20 / math.log(10) * F.greatest(gain, F.lit(math.log(1e-12))), "phase_deg": F.degrees(phase)})


def key_points(response: DataFrame, keys: list[str], step: float, points: int) -> DataFrame:
    """keys, cut_hz (first frequency under -3 dB), and the magnitude at the grid point nearest to each of KEY_HZ, the lower of two; ``response`` has rate, freq and
    magnitude_db on a grid of ``points`` steps under half the rate. Plain minima and maxima: a key's rows combine before the shuffle, and nothing is sorted.
    """
    last = F.least(F.lit(points), F.ceil(F.col("rate") / (2 * step)) - 1)
    near = lambda hz: F.least(F.greatest(F.ceil(F.lit(hz / step - 0.5)), F.lit(1)), last) * step
    at = [F.max(F.when(F.col("freq") == near(hz), F.col("magnitude_db"))).alias(f"db_at_{int(hz)}") for hz in KEY_HZ]
    return response.groupBy(*keys).agg(F.min(F.when(F.col("magnitude_db") < -3, F.col("freq"))).alias("cut_hz"), *at)


def cut_hz(curve: Column) -> Column:
    """The first frequency under -3 dB."""
    return F.array_min(F.transform(F.filter(curve, lambda x: x["magnitude_db"] < -3), lambda x: x["freq"]))


def at_hz(curve: Column, hz: float) -> Column:
    """The point of the curve nearest to a frequency, the lower of two."""
    return F.array_min(F.transform(curve, lambda x: F.struct(F.abs(x["freq"] - hz).alias("away"), x["freq"].alias("freq"), x["magnitude_db"].alias("magnitude_db"), x["phase_deg"].alias("phase_deg"))))
