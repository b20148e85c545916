"""Queries over spectra of 64-sample frames (``embeddings``) and of resampled signals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators import series, spectral
from aerolake.plans.registry import SIGNALS, Tables, query

#: Nominal rate of the frames; one of 64 samples resolves 15.625 Hz. A frame may have any length from two samples on.
RATE, KEY = 1000.0, ["vec_id"]


def twin(demean: bool) -> str:
    """bins (vec_id, n, bin, freq, a = |rfft|, rms) by a plain discrete transform; a Hann window of n samples sums to (n - 1) / 2, its squares to 3 (n - 1) / 8."""
    return f"""samples as (
        select vec_id, len(embedding) as n, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings where len(embedding) >= 2),
    centred as (select vec_id, n, i, x - {"avg(x) over (partition by vec_id)" if demean else "0"} as x from samples),
    tapered as (select vec_id, n, i, x, x * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) as h from centred),
    bins as (
        select vec_id, n, k as bin, k * ({RATE}::double / n) as freq, sqrt(sum(h * cos(2 * pi() * k * i / n)) ** 2 + sum(h * sin(2 * pi() * k * i / n)) ** 2) as a, sqrt(avg(x * x)) as rms
        from (select *, unnest(range(n // 2 + 1)) as k from tapered) x group by vec_id, n, k)"""


DB = f"{twin(True)}, db as (select vec_id, bin, freq, case when rms < 1e-12 then -120 else 20 * log10(a / (n * rms) + 1e-12) end as magnitude from bins)"
PEAKS = f"""{DB},
    around as (
        select *, median(magnitude) over (partition by vec_id) as floor, lag(magnitude) over w as l, lead(magnitude) over w as r from db window w as (partition by vec_id order by bin)),
    ranked as (
        select vec_id, bin, freq, magnitude, magnitude - floor as rise, row_number() over (partition by vec_id order by magnitude desc, bin) as rank
        from around where magnitude > l and magnitude > r and magnitude > floor + 3 and freq between 30 and 600),
    peaks as (select * from ranked where rank <= 5)"""


def frames(t: Tables) -> DataFrame:
    return t.embeddings.where(F.size("embedding") >= 2).withColumn("size", F.size("embedding"))


def spectra(t: Tables, scaling: str, keys: list[str] = KEY) -> DataFrame:
    return spectral.frame_spectra(frames(t), [*keys, "size"], "embedding", RATE, scaling)


def bins(t: Tables, scaling: str = "dbfs", keys: list[str] = KEY) -> DataFrame:
    return spectral.explode_bins(spectra(t, scaling, keys), [*keys, "size"], RATE, F.col("size"))


def peaks(t: Tables) -> DataFrame:
    return spectral.local_peaks(bins(t), KEY, 3.0, 30.0, 600.0, 5)


@query(f"""with {twin(False)} select vec_id, bin, round(freq, 4) as freq, round(a * 4 / (n - 1), 6) as linear, round(a * a / ({RATE} * 3 * (n - 1) / 8), 9) as psd from bins""")
def dft_spectrum(t: Tables) -> DataFrame:
    width = F.col("size") - 1
    a = F.col("magnitude") * width / 4  # of the plain transform, from which both scalings follow
    return bins(t, "linear").select("vec_id", "bin", F.round("freq", 4).alias("freq"), F.round("magnitude", 6).alias("linear"), F.round(a * a / (RATE * 3 * width / 8), 9).alias("psd"))


@query(f"with {DB} select vec_id, round(median(magnitude), 4) as floor, round(coalesce(median(magnitude) filter (where freq between 20 and 50), quantile_cont(magnitude, 0.25)), 4) as quiet_floor from db group by vec_id")
def noise_floor(t: Tables) -> DataFrame:
    return spectral.noise_floor(bins(t), KEY).select("vec_id", F.round("floor", 4).alias("floor"), F.round("quiet_floor", 4).alias("quiet_floor"))


@query(f"with {PEAKS} select vec_id, bin, freq, round(magnitude, 4) as magnitude, rank from peaks")
def local_peaks(t: Tables) -> DataFrame:
    return peaks(t).withColumn("magnitude", F.round("magnitude", 4))


@query(f"""with recursive {DB},
    around as (select *, median(magnitude) over (partition by vec_id) as floor, lag(magnitude) over w as l, lead(magnitude) over w as r from db window w as (partition by vec_id order by bin)),
    tops as (select vec_id, bin, magnitude, row_number() over (partition by vec_id order by magnitude desc, bin) as k from around where magnitude > l and magnitude > r and magnitude >= floor + 3),
    thinned as (
        select vec_id, k, [bin] as kept from tops where k = 1
        union all
        select t.vec_id, t.k, case when list_bool_or(list_transform(h.kept, lambda b: abs(b - t.bin) < 3)) then h.kept else list_append(h.kept, t.bin) end from thinned h join tops t on t.vec_id = h.vec_id and t.k = h.k + 1),
    chosen as (select vec_id, unnest(arg_max(kept, k)) as bin from thinned group by vec_id),
    p as (select c.vec_id, c.bin, t.magnitude from chosen c join tops t on t.vec_id = c.vec_id and t.bin = c.bin),
    walls as (
        select p.vec_id, p.bin, p.magnitude, max(d.bin) filter (where d.bin < p.bin and d.magnitude > p.magnitude) as lo, min(d.bin) filter (where d.bin > p.bin and d.magnitude > p.magnitude) as hi
        from p join db d on d.vec_id = p.vec_id group by p.vec_id, p.bin, p.magnitude),
    rises as (
        select w.vec_id, w.bin, w.magnitude - greatest(min(d.magnitude) filter (where d.bin <= w.bin and d.bin > coalesce(lo, -1)), min(d.magnitude) filter (where d.bin >= w.bin and d.bin < coalesce(hi, 1000000000))) as rise
        from walls w join db d on d.vec_id = w.vec_id group by w.vec_id, w.bin, w.magnitude)
    select vec_id, bin::bigint as bin, round(rise, 4) as prominence from rises where rise >= 6""")
def peak_prominence(t: Tables) -> DataFrame:
    return spectral.prominent_peaks(spectra(t, "dbfs"), KEY, 3.0, 6.0).withColumn("prominence", F.round("prominence", 4))


@query(f"with {twin(False)} select vec_id, round(sum(a * a) filter (where freq >= {RATE / 8}) / sum(a * a), 6) as high_share from bins group by vec_id")
def band_energy_ratio(t: Tables) -> DataFrame:
    power = F.col("magnitude") * F.col("magnitude")
    return bins(t, "linear").groupBy("vec_id").agg(F.round(F.sum(F.when(F.col("freq") >= RATE / 8, power)) / F.sum(power), 6).alias("high_share"))


BAND = "case when freq >= 30 and freq <= 60 then 'motor' when freq >= 60 and freq <= 250 then 'motor' when freq >= 251 and freq <= 400 then 'blade' when freq >= 401 and freq <= 500 then 'structural' when freq > 500 then 'high' else 'unknown' end"


#: Needs a recursive with. ``named``: peaks with their source and whether they are harmonics.
NAMED = f"""{PEAKS},
    ordered as (select vec_id, freq, magnitude, {BAND} as band, row_number() over (partition by vec_id order by freq) as k from peaks),
    named as (
        select vec_id, k, freq, magnitude, band as source, false as harmonic, null::double as f1, null::varchar as s1 from ordered where k = 1
        union all
        select o.vec_id, o.k, o.freq, o.magnitude,
            case when n.source in ('motor', 'blade') and o.freq / n.freq between 1.9 and 2.1 then n.source when n.s1 in ('motor', 'blade') and o.freq / n.f1 between 2.9 and 3.1 then n.s1 else o.band end,
            coalesce((n.source in ('motor', 'blade') and o.freq / n.freq between 1.9 and 2.1) or (n.s1 in ('motor', 'blade') and o.freq / n.f1 between 2.9 and 3.1), false), n.freq, n.source
        from named n join ordered o on o.vec_id = n.vec_id and o.k = n.k + 1)"""


def named_peaks(t: Tables) -> DataFrame:
    """vec_id, peaks (freq, magnitude, source, harmonic) of the vectors that have any."""
    return peaks(t).groupBy("vec_id").agg(spectral.with_harmonics(F.collect_list(F.struct("freq", "magnitude"))).alias("peaks"))


@query(f"with recursive {NAMED} select vec_id, freq, source, harmonic from named")
def peak_source_bands(t: Tables) -> DataFrame:
    return named_peaks(t).select("vec_id", F.explode("peaks").alias("p")).select("vec_id", "p.freq", "p.source", "p.harmonic")


@query(f"""with {PEAKS}, p as (select vec_id, max_by(freq, (magnitude, -freq)) as freq, max_by(rise, (magnitude, -freq)) as rise, count(*) as n from peaks group by vec_id)
    select vec_id, n as peaks, freq, case when n >= 5 then 0.8::double * freq else 0.5::double * freq end as bandwidth, case when rise > 40 then 60.0::double else 40.0::double end as attenuation,
        (case when n >= 3 then 4 when n = 2 then 2 when {BAND} = 'motor' then 2 else 1 end)::bigint as mode from p""")
def notch_recommend(t: Tables) -> DataFrame:
    floor = spectral.noise_floor(bins(t), KEY).select("vec_id", "floor")
    rows = peaks(t).join(floor, "vec_id").select("vec_id", "freq", (F.col("magnitude") - F.col("floor")).alias("magnitude"), spectral.source_band(F.col("freq")).alias("source"))
    return spectral.recommend_notch(rows, KEY)


@query(f"with {twin(False)} select e.label, bin, round(max(a * 4 / (n - 1)), 6) as envelope from bins b join embeddings e on e.vec_id = b.vec_id group by e.label, bin")
def axis_max_envelope(t: Tables) -> DataFrame:
    return bins(t, "linear", ["vec_id", "label"]).groupBy("label", "bin").agg(F.round(F.max("magnitude"), 6).alias("envelope"))


@query("""with x as (select vec_id, len(embedding) as n, list_transform(embedding, lambda v: v::double) as e from embeddings)
    select vec_id, n::bigint as n, round(list_min(e), 6) as lowest, round(list_max(e), 6) as highest, round(list_avg(e), 6) as mean, round(list_stddev_pop(e), 6) as deviation from x""")
def array_summary(t: Tables) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = t.embeddings.select("vec_id", F.size("embedding").cast("long").alias("n"), e.alias("e"))
    mean = F.aggregate("e", F.lit(0.0), lambda s, v: s + v) / F.col("n")
    rows = rows.withColumn("m", mean).withColumn("deviation", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, v: s + (v - F.col("m")) * (v - F.col("m"))) / F.col("n")))
    return rows.select("vec_id", "n", F.round(F.array_min("e"), 6).alias("lowest"), F.round(F.array_max("e"), 6).alias("highest"), F.round("m", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(f"""with {SIGNALS},
    xy as (select user_id, idx, value as d, 0.7::double * value + 0.3::double * coalesce(lag(value) over (partition by user_id order by idx), 0) as a from signals),
    c as (select user_id, count(*) as n, greatest(64, least(128, count(*) // 2)) as size from xy group by user_id),
    cuts as (select size, greatest(1, 2 * ceil(size / 4)::bigint - 2) as length from (select distinct size from c) x),
    bell as (select size, j, exp(-0.5::double * ((j - ceil(length / 2)) / (length / 6)) ** 2) as b from (select *, unnest(range(2 * ceil(length / 2)::bigint + 1)) as j from cuts) x),
    rise as (select size, j, sum(b) over (partition by size order by j) / sum(b) over (partition by size) as r from bell),
    noise as (
        select k.size, k.k, 1 / (10 * (1 - coalesce(r, 1) + 1e-9)) as z, case when k.k = 0 or (k.size % 2 = 0 and k.k = k.size // 2) then 1 else 2 end / k.size as scale
        from (select size, unnest(range(size // 2 + 1)) as k from cuts) k left join rise on rise.size = k.size and rise.j = k.k),
    win as (select user_id, size, unnest(range(0, n - size + 1, greatest(1, round_even(size / 16, 0)::bigint))) as at_idx from c where n >= size),
    taken as (
        select w.user_id, w.at_idx, w.size, x.idx - w.at_idx as i, d, a, 0.5 - 0.5 * cos(2 * pi() * (x.idx - w.at_idx) / (w.size - 1)) as h
        from win w join xy x on x.user_id = w.user_id and x.idx >= w.at_idx and x.idx < w.at_idx + w.size),
    gate as (select user_id, at_idx from taken group by 1, 2 having max(abs(d * h)) >= 20 and max(abs(a)) <= 1500 and max(abs(a)) <= 4 * max(abs(d)) + 1e-9 and stddev_pop(d) >= 5),
    ft as (
        select t.user_id, t.at_idx, t.size, k, z, sum(d * h * cos(2 * pi() * k * i / t.size)) * scale as xr, -sum(d * h * sin(2 * pi() * k * i / t.size)) * scale as xi,
            sum(a * h * cos(2 * pi() * k * i / t.size)) * scale as yr, -sum(a * h * sin(2 * pi() * k * i / t.size)) * scale as yi
        from taken t join gate g on g.user_id = t.user_id and g.at_idx = t.at_idx join noise n on n.size = t.size group by t.user_id, t.at_idx, t.size, k, z, scale),
    hh as (select user_id, at_idx, size, k, (yr * xr + yi * xi) / (xr * xr + xi * xi + z) as hr, (yi * xr - yr * xi) / (xr * xr + xi * xi + z) as hi from ft),
    impulse as (
        select user_id, at_idx, i, sum(case when k = 0 or (size % 2 = 0 and k = size // 2) then hr * cos(2 * pi() * k * i / size) else 2 * (hr * cos(2 * pi() * k * i / size) - hi * sin(2 * pi() * k * i / size)) end) / any_value(size) as v
        from (select *, unnest(range(50)) as i from hh) x group by 1, 2, 3),
    resp as (select user_id, at_idx, i, sum(v) over (partition by user_id, at_idx order by i) as r from impulse),
    good as (select user_id, at_idx from resp group by 1, 2 having max(r) <= 4),
    mean as (select r.user_id, i, avg(r) as r, count(*) as n from resp r join good g on g.user_id = r.user_id and g.at_idx = r.at_idx group by 1, 2)
    select c.user_id, l.i / 100 as lag_s, round(m.r, 6) as response, coalesce(m.n, 0)::bigint as windows from c cross join range(50) l(i) left join mean m on m.user_id = c.user_id and m.i = l.i""")
def wiener_step(t: Tables) -> DataFrame:
    lag = F.coalesce(F.lag("value").over(series.along(["user_id"], "idx")), F.lit(0.0))
    rows = t.signals.withColumns({"desired": F.col("value"), "actual": 0.7 * F.col("value") + 0.3 * lag})
    return spectral.wiener_step(rows.select("user_id", "idx", "desired", "actual"), ["user_id"], 100.0).select("user_id", "lag_s", F.round("response", 6).alias("response"), "windows")


FRAMES = f"""{SIGNALS}, counted as (select user_id, count(*) as n from signals group by user_id),
    f as (select user_id, unnest(range(0, 1 + ((n - 16) // 8)::bigint)) as frame from counted where n >= 16),
    tapered as (
        select f.user_id, f.frame, s.idx - f.frame * 8 as i, s.value * (0.5 - 0.5 * cos(2 * pi() * (s.idx - f.frame * 8) / 15)) as h
        from f join signals s on s.user_id = f.user_id and s.idx >= f.frame * 8 and s.idx < f.frame * 8 + 16),
    bins as (
        select user_id, frame, k as bin, sqrt(sum(h * cos(2 * pi() * k * i / 16)) ** 2 + sum(h * sin(2 * pi() * k * i / 16)) ** 2) * {2 / sum(0.5 - 0.5 * math.cos(2 * math.pi * i / 15) for i in range(16))!r} as m
        from tapered cross join range(9) r(k) group by user_id, frame, k)"""


@query(f"with {FRAMES} select user_id, bin, bin * 6.25::double as freq, round(avg(m), 4) as magnitude, count(*) as frames from bins group by user_id, bin")
def averaged_spectrum(t: Tables) -> DataFrame:
    rows = spectral.averaged_spectrum(t.signals, ["user_id"], 16, 0.5, 100.0)
    return rows.select("user_id", F.col("bin").cast("long").alias("bin"), "freq", F.round("magnitude", 4).alias("magnitude"), "frames")


@query(f"with {FRAMES} select user_id, frame, (frame * 8 + 8) / 100 as t, bin, bin * 6.25::double as freq, round(greatest(20 * log10(m + 1e-9), -120), 4) as magnitude_db from bins")
def spectrogram(t: Tables) -> DataFrame:
    # Bins that hold rounding errors alone are as low as the floor.
    return spectral.spectrogram(t.signals, ["user_id"], 16, 0.5, 100.0).withColumn("magnitude_db", F.round(F.greatest("magnitude_db", F.lit(-120.0)), 4))


@query(f"""with {SIGNALS}, counted as (select user_id, count(*) as n from signals group by user_id),
    f as (select user_id, unnest(range(0, 1 + ceil((n + 16 - 16) / 8)::bigint)) as frame from counted),
    tapered as (select f.user_id, f.frame, s.idx + 8 - f.frame * 8 as i, s.value * (0.5 - 0.5 * cos(2 * pi() * (s.idx + 8 - f.frame * 8) / 16)) as h from f left join signals s on s.user_id = f.user_id and s.idx + 8 >= f.frame * 8 and s.idx + 8 < f.frame * 8 + 16),
    bins as (select user_id, frame, k as bin, coalesce(sqrt(sum(h * cos(2 * pi() * k * i / 16)) ** 2 + sum(h * sin(2 * pi() * k * i / 16)) ** 2) / 8, 0) as m from tapered cross join range(9) r(k) group by user_id, frame, k)
    select user_id, frame, frame * 8 / 100 as t, bin, bin * 6.25::double as freq, round(greatest(20 * log10(m + 1e-9), -120), 4) as magnitude_db from bins""")
def spectrogram_padded(t: Tables) -> DataFrame:
    return spectral.padded_spectrogram(t.signals, ["user_id"], 16, 0.5, 100.0).withColumn("magnitude_db", F.round(F.greatest("magnitude_db", F.lit(-120.0)), 4))
