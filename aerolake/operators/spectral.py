"""Spectra: Arrow kernels where a transform is needed, expressions for what is read off them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators import series

#: (lowest, highest, source) of a peak's frequency in Hz; gaps between bands are unknown; fixed values.
SOURCES = [(30.0, 60.0, "motor"), (60.0, 250.0, "motor"), (251.0, 400.0, "blade"), (401.0, 500.0, "structural")]
HIGH_HZ = 500.0


def window_size(rate_hz: float, samples: int) -> int:
    """Smallest power of two that holds a second, 64 at least, and no more than there are samples."""
    size = 64
    while size < int(rate_hz):
        size *= 2
    return min(size, samples)


def amplitude_spectra(frames: np.ndarray, rate_hz: float, scaling: str) -> np.ndarray:
    """One-sided Hann spectra of (n, size) frames: ``linear`` amplitude, ``psd``, or ``dbfs`` against the RMS of the demeaned frame."""
    size = frames.shape[1]
    hann = np.hanning(size)
    if scaling == "dbfs":
        frames = frames - frames.mean(axis=1, keepdims=True)
    bins = np.abs(np.fft.rfft(frames * hann, axis=1))
    if scaling == "linear":
        return bins * (2 / hann.sum())
    if scaling == "psd":
        return bins**2 / (rate_hz * (hann**2).sum())
    rms = np.sqrt((frames**2).mean(axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(rms < 1e-12, -120.0, 20 * np.log10(bins / (size * rms) + 1e-12))


def frame_spectra(rows: DataFrame, keys: Sequence[str], samples: str, rate_hz: float, scaling: str = "linear") -> DataFrame:
    """keys, spectrum (array): of rows that hold a frame of samples each; frames of one batch and length are transformed together."""
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "spectrum array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.nan_to_num(np.asarray(x, float)) if x else np.zeros(0) for x in batch[samples].to_pylist()]
            found: list = [None] * len(arrays)
            for size in {len(a) for a in arrays} - {0}:
                at = [i for i, a in enumerate(arrays) if len(a) == size]
                for i, s in zip(at, amplitude_spectra(np.stack([arrays[i] for i in at]), rate_hz, scaling), strict=True):
                    found[i] = s.tolist()
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(found, pa.list_(pa.float64()))], [*keys, "spectrum"])

    return rows.select(*keys, samples).mapInArrow(run, schema)


def window_column(rate_hz: Column, samples: Column) -> Column:
    """``window_size`` of each row."""
    second = F.greatest(F.floor(rate_hz), F.lit(64))
    return F.least(F.pow(F.lit(2), F.ceil(F.log2(second))).cast("long"), samples.cast("long"))


def framed_spectra(samples: DataFrame, keys: Sequence[str], size: Column, overlap: float, rate_hz: Column, value: str = "value", scaling: str = "linear", order: str = "idx", segment: int = 1 << 16) -> DataFrame:
    """keys, size, rate_hz, frame, spectrum: of the complete overlapping frames of each series; ``size`` and ``rate_hz`` are the same in all rows of a series.
    A task holds ``segment`` samples and those that frames starting in them need from the next ones, and cuts its frames there: samples move
    about once, however much the frames overlap.
    """
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    rows = samples.select(*keys, F.col(order).cast("long").alias("_at"), F.col(value).cast("double").alias("_v"), size.cast("long").alias("_size"), rate_hz.cast("double").alias("_rate")).where("_size > 0")
    hop = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_size") * F.lit(1 - overlap)))
    rows = rows.withColumn("_hop", hop).withColumn("_long", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(segment) / F.col("_hop"))) * F.col("_hop"))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_at") - F.col("_size") + 1) / F.col("_long")))
    parts = rows.withColumn("_segment", F.explode(F.sequence(first, F.floor(F.col("_at") / F.col("_long")))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        size, hop, long, rate = (table[c][0].as_py() for c in ("_size", "_hop", "_long", "_rate"))
        at, values = table["_at"].to_numpy(), np.nan_to_num(table["_v"].to_numpy(zero_copy_only=False).astype(float))
        first = table["_segment"][0].as_py() * long
        starts = np.arange(first, min(first + long, int(at[-1]) - size + 2), hop)
        places = np.searchsorted(at, starts)
        whole = (places + size <= len(at)) & (at[np.minimum(places, len(at) - 1)] == starts) & (at[np.minimum(places + size, len(at)) - 1] == starts + size - 1)
        starts, places = starts[whole], places[whole]
        spectra = amplitude_spectra(values[places[:, None] + np.arange(size)], rate, scaling) if len(starts) else np.zeros((0, size // 2 + 1))
        bins = pa.ListArray.from_arrays(pa.array(np.arange(0, spectra.size + 1, size // 2 + 1), pa.int32()), pa.array(spectra.ravel()))
        n = len(starts)
        return pa.table({**{k: pa.array([table[k][0].as_py()] * n, table.schema.field(k).type) for k in keys}, "size": np.full(n, size, np.int64), "rate_hz": np.full(n, rate, np.float64), "frame": pa.array(starts // hop, pa.int64()), "spectrum": bins})

    return parts.groupBy(*keys, "_segment").applyInArrow(run, f"{kinds}, size long, rate_hz double, frame long, spectrum array<double>")


def series_spectra(samples: DataFrame, keys: Sequence[str], size: int, overlap: float, rate_hz: float, value: str = "value", scaling: str = "linear", order: str = "idx", segment: int = 1 << 16) -> DataFrame:
    """keys, frame, spectrum of the frames of each series, all of one size and rate."""
    return framed_spectra(samples, keys, F.lit(size), overlap, F.lit(rate_hz), value, scaling, order, segment).drop("size", "rate_hz")


def measured_spectrum(samples: DataFrame, keys: Sequence[str], overlap: float = 0.5, rate_hz: float | DataFrame | None = None, value: str = "value", scaling: str = "linear", t: str = "t") -> DataFrame:
    """keys, rate_hz, size, bin, freq, magnitude, frames: the mean spectrum of each series by its own rate (``series.with_rate``), in frames that hold about a second
    of it, whatever numbers its samples have. Series of all rates are in one plan.
    """
    rows = series.with_rate(series.numbered(samples.select(*keys, "idx", t, value), keys), keys, rate_hz, t)
    n = F.count("*").over(Window.partitionBy(*keys))
    found = framed_spectra(rows.withColumn("_n", n), keys, window_column(F.col("rate_hz"), F.col("_n")), overlap, F.col("rate_hz"), value, scaling)
    bins = found.select(*keys, "rate_hz", "size", F.posexplode("spectrum").alias("bin", "m"))
    means = bins.groupBy(*keys, "rate_hz", "size", F.col("bin").cast("long").alias("bin")).agg(F.avg("m").alias("magnitude"), F.count("*").alias("frames"))
    return means.withColumn("freq", F.col("bin") * F.col("rate_hz") / F.col("size"))


def spectrogram(samples: DataFrame, keys: Sequence[str], size: int, overlap: float, rate_hz: float, value: str = "value") -> DataFrame:
    """keys, frame, t (of its middle), bin, freq, magnitude_db: frames side by side, without padding at the ends."""
    hop = max(1, int(size * (1 - overlap)))
    bins = series_spectra(samples, keys, size, overlap, rate_hz, value).select(*keys, "frame", F.posexplode("spectrum").alias("bin", "m"))
    return bins.select(*keys, "frame", ((F.col("frame") * hop + size / 2) / rate_hz).alias("t"), F.col("bin").cast("long").alias("bin"), (F.col("bin") * rate_hz / size).alias("freq"), (20 * F.log10(F.col("m") + 1e-9)).alias("magnitude_db"))


def padded_spectrogram(samples: DataFrame, keys: Sequence[str], size: int, overlap: float, rate_hz: float | Column, value: str = "value", order: str = "idx", segment: int = 1 << 16) -> DataFrame:
    """keys, frame, t, bin, freq, magnitude_db of frames that also cover both ends: half a frame of zeros stands before the series (numbered from 0) and after it, and as many
    more as fill the last hop. The window is periodic and of unit gain. Segments know the whole number of frames, so the first and last of a series hold its edges.
    """
    hop, half = max(1, int(size * (1 - overlap))), size // 2
    long = max(1, segment // hop) * hop
    rate = rate_hz if isinstance(rate_hz, Column) else F.lit(float(rate_hz))
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = samples.select(*keys, (F.col(order).cast("long") + half).alias("_at"), F.col(value).cast("double").alias("_v"), rate.cast("double").alias("_rate"), n.alias("_n"))
    whole = F.col("_n") + 2 * half
    rows = rows.withColumn("_frames", F.greatest(F.ceil((whole - size) / hop), F.lit(0).cast("long")) + 1)
    last = F.when(F.col("_at") == F.col("_n") + half - 1, F.floor((F.col("_frames") - 1) * hop / long)).otherwise(F.lit(0))
    parts = rows.withColumn("_segment", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("_at") - size + 1) / long)), F.greatest(F.floor(F.col("_at") / long), last.cast("long")))))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def run(table: pa.Table) -> pa.Table:
        first, frames = table["_segment"][0].as_py() * long, table["_frames"][0].as_py()
        dense = np.zeros(long + size)
        at = table["_at"].to_numpy() - first
        inside = (at >= 0) & (at < len(dense))
        dense[at[inside]] = np.nan_to_num(table["_v"].to_numpy(zero_copy_only=False).astype(float))[inside]
        starts = np.arange(0, min(long, frames * hop - first), hop)
        spectra = np.abs(np.fft.rfft(dense[starts[:, None] + np.arange(size)] * window, axis=1)) / window.sum()
        n = len(starts)
        bins = pa.ListArray.from_arrays(pa.array(np.arange(0, spectra.size + 1, size // 2 + 1), pa.int32()), pa.array(spectra.ravel()))
        return pa.table({**{k: pa.array([table[k][0].as_py()] * n, table.schema.field(k).type) for k in keys}, "frame": pa.array((first + starts) // hop, pa.int64()), "_rate": np.full(n, table["_rate"][0].as_py(), np.float64), "spectrum": bins})

    found = parts.groupBy(*keys, "_segment").applyInArrow(run, f"{kinds}, frame long, _rate double, spectrum array<double>")
    bins = found.select(*keys, "frame", "_rate", F.posexplode("spectrum").alias("bin", "m"))
    return bins.select(*keys, "frame", (F.col("frame") * hop / F.col("_rate")).alias("t"), F.col("bin").cast("long").alias("bin"), (F.col("bin") * F.col("_rate") / size).alias("freq"), (20 * F.log10(F.col("m") + 1e-9)).alias("magnitude_db"))


def averaged_spectrum(samples: DataFrame, keys: Sequence[str], size: int, overlap: float, rate_hz: float, value: str = "value", scaling: str = "linear") -> DataFrame:
    """keys, bin, freq, magnitude, frames: mean over the frames of a series."""
    bins = series_spectra(samples, keys, size, overlap, rate_hz, value, scaling).select(*keys, F.posexplode("spectrum").alias("bin", "m"))
    return bins.groupBy(*keys, "bin").agg(F.avg("m").alias("magnitude"), F.count("*").alias("frames")).withColumn("freq", F.col("bin") * rate_hz / size)


def explode_bins(spectra: DataFrame, keys: Sequence[str], rate_hz: float, size: int | Column) -> DataFrame:
    """keys, bin, freq, magnitude."""
    return spectra.select(*keys, F.posexplode("spectrum").alias("bin", "magnitude")).withColumn("bin", F.col("bin").cast("long")).withColumn("freq", F.col("bin") * (F.lit(rate_hz) / size))


def noise_floor(bins: DataFrame, keys: Sequence[str], low: float = 20.0, high: float = 50.0) -> DataFrame:
    """floor (median of all bins) and quiet_floor (median of low..high Hz; the 25th percentile where there is no such bin)."""
    quiet = F.median(F.when(F.col("freq").between(low, high), F.col("magnitude")))
    return bins.groupBy(*keys).agg(F.median("magnitude").alias("floor"), F.coalesce(quiet, F.percentile("magnitude", 0.25)).alias("quiet_floor"))


def residual_noise(bins: DataFrame, keys: Sequence[str], rate_hz: float, low: float = 100.0, margin: float = 10.0) -> DataFrame:
    """residual: root of the mean power from ``low`` to ``margin`` under half the rate."""
    power = F.when(F.col("freq").between(low, rate_hz / 2 - margin), F.col("magnitude") * F.col("magnitude"))
    return bins.groupBy(*keys).agg(F.sqrt(F.avg(power)).alias("residual"))


def local_peaks(bins: DataFrame, keys: Sequence[str], over: float, low: float, high: float, top: int) -> DataFrame:
    """keys, bin, freq, magnitude, rank: up to ``top`` bins of low..high Hz above both neighbours and ``over`` above the median."""
    from pyspark.sql import Window

    w, whole = series.along(keys, "bin"), Window.partitionBy(*keys)
    m = F.col("magnitude")
    rows = bins.withColumns({"_floor": F.median("magnitude").over(whole), "_left": F.lag("magnitude").over(w), "_right": F.lead("magnitude").over(w)})
    peaks = rows.where((m > F.col("_left")) & (m > F.col("_right")) & (m > F.col("_floor") + over) & F.col("freq").between(low, high))
    return peaks.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("magnitude"), "bin")).cast("long")).where(F.col("rank") <= top).select(*keys, "bin", "freq", "magnitude", "rank")


def find_peaks(spectrum: np.ndarray, height: float, prominence: float, distance: int) -> list[tuple[int, float]]:
    """(bin, prominence) of strict local maxima: by height, then thinned so that higher ones keep ``distance``, then by prominence."""
    y = np.asarray(spectrum, float)
    at = [i for i in range(1, len(y) - 1) if y[i] > y[i - 1] and y[i] > y[i + 1] and y[i] >= height]
    kept: list[int] = []
    for i in sorted(at, key=lambda i: (-y[i], i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        higher_left = [k for k in range(i) if y[k] > y[i]]
        higher_right = [k for k in range(i + 1, len(y)) if y[k] > y[i]]
        left = y[higher_left[-1] + 1 if higher_left else 0 : i + 1].min()
        right = y[i : higher_right[0] if higher_right else len(y)].min()
        if (rise := y[i] - max(left, right)) >= prominence:
            out.append((i, float(rise)))
    return out


def prominent_peaks(spectra: DataFrame, keys: Sequence[str], over: float, prominence: float, distance: int = 3) -> DataFrame:
    """keys, bin, prominence, of spectra that hold one array a row."""
    schema = ", ".join([*(f"{k} {spectra.schema[k].dataType.simpleString()}" for k in keys), "bin long", "prominence double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bins, rises = [], [], []
            for i, s in enumerate(batch["spectrum"].to_pylist()):
                for k, rise in find_peaks(s, float(np.median(s)) + over, prominence, distance) if s else ():
                    at.append(i)
                    bins.append(k)
                    rises.append(rise)
            yield pa.RecordBatch.from_arrays([*(batch[k].take(pa.array(at, pa.int64())) for k in keys), pa.array(bins, pa.int64()), pa.array(rises, pa.float64())], [*keys, "bin", "prominence"])

    return spectra.select(*keys, "spectrum").mapInArrow(run, schema)


def source_band(freq: Column) -> Column:
    out = F.when(freq > HIGH_HZ, "high").otherwise("unknown")
    for low, high, source in reversed(SOURCES):
        out = F.when((freq >= low) & (freq <= high), source).otherwise(out)
    return out


def with_harmonics(peaks: Column) -> Column:
    """Structs (freq, magnitude, source, harmonic) of an array of (freq, magnitude), by frequency; near twice the peak before, or three times the
    one before that, a peak is a harmonic and takes its motor or blade source.
    """

    def add(out: Column, p: Column) -> Column:
        f, last, before = p["freq"], F.try_element_at(out, F.lit(-1)), F.try_element_at(out, F.lit(-2))
        named = lambda q: q["source"].isin("motor", "blade")
        second, third = F.coalesce(named(last) & (f / last["freq"]).between(1.9, 2.1), F.lit(False)), F.coalesce(named(before) & (f / before["freq"]).between(2.9, 3.1), F.lit(False))
        source = F.when(second, last["source"]).when(third, before["source"]).otherwise(source_band(f))
        return F.array_append(out, F.struct(f.alias("freq"), p["magnitude"].alias("magnitude"), source.alias("source"), (second | third).alias("harmonic")))

    return F.aggregate(F.array_sort(peaks), F.array().cast("array<struct<freq:double,magnitude:double,source:string,harmonic:boolean>>"), add)


def recommend_notch(peaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """freq, bandwidth, attenuation and harmonics of a notch for the largest peak, from keys, freq, magnitude (dB over the floor), source."""
    rows = peaks.groupBy(*keys).agg(F.max_by(F.struct("freq", "magnitude", "source"), F.struct("magnitude", -F.col("freq"))).alias("p"), F.count("*").alias("n"))
    f, n = F.col("p.freq"), F.col("n")
    return rows.select(
        *keys, n.alias("peaks"), f.alias("freq"),
        F.when(n >= 5, 0.8 * f).otherwise(0.5 * f).alias("bandwidth"),
        F.when(F.col("p.magnitude") > 40, 60.0).otherwise(40.0).alias("attenuation"),
        F.when(n >= 3, 4).when(n == 2, 2).when(F.col("p.source") == "motor", 2).otherwise(1).cast("long").alias("mode"),
    )


def response_window(rate_hz: float) -> int:
    """Samples of a window of ``step_response`` in a long series: the smallest power of two that holds a second."""
    size = 1
    while size < int(rate_hz):
        size *= 2
    return size


def step_response(
    setpoint: np.ndarray, measured: np.ndarray, rate_hz: float, cut_hz: float = 25.0, seconds: float = 0.5, lowest: float = 20.0, highest: float = float("inf"),
    whole: int | None = None, offset: int = 0, past: int | None = None,
) -> tuple[np.ndarray, int]:
    """Wiener-deconvolved step response averaged over overlapping windows, and the number of windows that counted. Of a part of a series:
    ``whole`` is the count of all its samples, ``offset`` the place of the part's first; windows start on the hop grid of the series, before ``past`` in the part.
    """
    n = len(setpoint)
    size = max(64, min(response_window(rate_hz), (n if whole is None else whole) // 2))
    steps = min(int(np.ceil(seconds * rate_hz)), size)
    if n < size:
        return np.zeros(steps), 0
    hop, hann = max(1, round(size / 16)), np.hanning(size)
    freqs = np.fft.rfftfreq(size, 1 / rate_hz)
    cut = 2 * int(np.argmax(freqs >= min(cut_hz, 0.8 * rate_hz / 2))) - 2
    length = max(1, cut)
    radius, sigma = int(np.ceil(length / 2)), length / 6
    bell = np.exp(-0.5 * ((np.arange(-radius, radius + 1)) / sigma) ** 2)
    half = np.ones(len(freqs))
    rise = np.cumsum(bell) / bell.sum()
    half[: min(len(rise), len(half))] = rise[: len(half)]
    noise = 1 / (10 * (1 - half + 1e-9))
    scale = np.full(len(freqs), 2 / size)
    scale[0] = 1 / size
    if size % 2 == 0:
        scale[-1] = 1 / size
    total, counted = np.zeros(steps), 0
    for at in range(-offset % hop, n - size + 1 if past is None else min(n - size + 1, past), hop):
        target, actual = setpoint[at : at + size], measured[at : at + size]
        if not (np.isfinite(target).all() and np.isfinite(actual).all()):
            continue
        top = np.abs(target * hann).max()
        if top < lowest or top > highest or np.abs(actual).max() > 1500 or np.abs(actual).max() > 4 * np.abs(target).max() + 1e-9 or target.std() < 5:
            continue
        x, y = np.fft.rfft(target * hann) * scale, np.fft.rfft(actual * hann) * scale
        impulse = np.fft.irfft(y * np.conj(x) / (np.abs(x) ** 2 + noise), size)
        response = np.cumsum(impulse)[:steps]
        if response.max(initial=0) <= 4.0:
            total += response
            counted += 1
    return total / max(1, counted), counted


def wiener_step(samples: DataFrame, keys: Sequence[str], rate_hz: float | Column, desired: str = "desired", actual: str = "actual", order: str = "idx", segment: int = 1 << 16, **gates: float) -> DataFrame:
    """keys, rate_hz, lag, lag_s, response, windows of each series; ``rate_hz`` may be a column, the same in all rows of a series. A task holds ``segment`` samples, with
    those that windows starting in them need from the next ones; window size and hop grid are the whole series', so segments change nothing and no kernel holds a whole flight.
    """
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    n, at = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(series.along(keys, order)) - 1
    rate = rate_hz if isinstance(rate_hz, Column) else F.lit(float(rate_hz))
    second = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.floor("_rate"), F.lit(1))))).cast("long")
    size = F.greatest(F.lit(64), F.least(second, F.floor(F.col("_n") / 2)))
    rows = samples.select(*keys, desired, actual, n.alias("_n"), at.cast("long").alias("_at"), rate.cast("double").alias("_rate"))
    parts = rows.withColumn("_segment", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - size + 1) / segment)), F.floor(F.col("_at") / segment))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        offset, rate = table["_segment"][0].as_py() * segment, table["_rate"][0].as_py()
        response, windows = step_response(table[desired].to_numpy().astype(float), table[actual].to_numpy().astype(float), rate, whole=table["_n"][0].as_py(), offset=offset, past=segment, **gates)
        n = len(response)
        return pa.table({**{k: pa.array([table[k][0].as_py()] * n, table.schema.field(k).type) for k in keys}, "rate_hz": np.full(n, rate), "lag": np.arange(n), "response": response, "windows": np.full(n, windows)})

    found = parts.groupBy(*keys, "_segment").applyInArrow(run, f"{kinds}, rate_hz double, lag long, response double, windows long")
    weighted = F.try_divide(F.sum(F.col("response") * F.col("windows")), F.sum("windows"))
    return found.groupBy(*keys, "rate_hz", "lag").agg(weighted.alias("response"), F.sum("windows").alias("windows")).withColumn("lag_s", F.col("lag") / F.col("rate_hz"))
