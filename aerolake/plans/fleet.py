"""Queries over a fleet whose series have rates of their own: ``events`` as interleaved signals of twenty sources, numbered by the clock of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators import responses, series, spectral
from aerolake.plans.registry import Tables, query

KEY = ["source"]


def samples(t: Tables, slow: int) -> DataFrame:
    """source, idx (microseconds: with gaps in every source), t (each source's clock runs at a pace of its own), value."""
    rows = t.events.select((F.col("user_id") % 20).alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("idx"), "value")
    return rows.select("source", "idx", (F.col("idx") / 518400e6 * (slow + F.col("source") % 3)).alias("t"), "value")


def rated(slow: int) -> str:
    """numbered (source, idx, n, t, value) and rates (source, n, rate_hz)."""
    return f"""raw as (select user_id % 20 as source, epoch_us(ts) as us, value, epoch_us(ts) / 518400e6 * ({slow} + user_id % 20 % 3) as t from events),
    numbered as (select *, row_number() over (partition by source order by us) - 1 as idx, count(*) over (partition by source) as n from raw),
    gaps as (select source, n, t - lag(t) over (partition by source order by idx) as gap from numbered),
    rates as (select source, any_value(n) as n, 1 / median(gap) filter (where gap > 0 and gap < 1) as rate_hz from gaps group by source)"""


@query(f"""with {rated(1)},
    sized as (select *, least(pow(2, ceil(log2(greatest(floor(rate_hz), 64))))::bigint, n) as size from rates where rate_hz > 0),
    hops as (select *, greatest(1, size // 2) as hop from sized),
    f as (select *, unnest(range(0, 1 + (n - size) // hop)) as frame from hops),
    tapered as (
        select f.source, f.rate_hz, f.size, f.frame, s.idx - f.frame * f.hop as i, s.value * (0.5 - 0.5 * cos(2 * pi() * (s.idx - f.frame * f.hop) / (f.size - 1))) as h
        from f join numbered s on s.source = f.source and s.idx >= f.frame * f.hop and s.idx < f.frame * f.hop + f.size),
    bins as (
        select source, rate_hz, size, frame, k, sqrt(sum(h * cos(2 * pi() * (k * i % size) / size)) ** 2 + sum(h * sin(2 * pi() * (k * i % size) / size)) ** 2) * 4 / (size - 1) as m
        from (select *, unnest(range(size // 2 + 1)) as k from tapered) x group by source, rate_hz, size, frame, k)
    select source, round(rate_hz, 6) as rate_hz, size, k as bin, round(k * rate_hz / size, 6) as freq, round(avg(m), 4) as magnitude, count(*) as frames from bins group by source, rate_hz, size, k""")
def fleet_spectrum(t: Tables) -> DataFrame:
    found = spectral.measured_spectrum(samples(t, 1), KEY)
    return found.select("source", F.round("rate_hz", 6).alias("rate_hz"), "size", "bin", F.round("freq", 6).alias("freq"), F.round("magnitude", 4).alias("magnitude"), "frames")


@query(f"""with recursive {rated(20)},
    made as (select source, n, idx, value as desired, 0.7 * value + 0.3 * coalesce(lag(value) over (partition by source order by idx), 0) as actual, value - lag(value) over (partition by source order by idx) as jump, max(abs(value)) over (partition by source) as largest from numbered where n >= 20),
    candidates as (select source, idx - 1 as step from made where abs(jump) >= case when largest < 1e-9 then 5.0 else 0.3 * largest end),
    paced as (select *, greatest(2, floor(0.1 * rate_hz))::bigint as before, greatest(5, floor(1.5 * rate_hz))::bigint as after, greatest(1, floor(0.5 * rate_hz))::bigint as spacing from rates where rate_hz > 0),
    spaced as (
        select source, min(step) as step from candidates group by source
        union all
        select s.source, (select min(c.step) from candidates c join paced p on p.source = c.source where c.source = s.source and c.step >= s.step + p.spacing) from spaced s where s.step is not null),
    win as (
        select p.source, p.rate_hz, p.before, p.after, s.step, list(m.desired order by m.idx) as d, list(m.actual order by m.idx) as a, s.step - min(m.idx) as place
        from spaced s join paced p on p.source = s.source join made m on m.source = s.source and m.idx >= s.step - p.before and m.idx < s.step + p.after where s.step is not null group by 1, 2, 3, 4, 5),
    parts as (
        select *, list_avg(list_slice(a, 1, least(place, greatest(2, before // 2)))) as base, list_avg(list_slice(d, place + 2, place + 1 + greatest(2, before // 2))) - list_avg(list_slice(d, 1, least(place, greatest(2, before // 2)))) as jump
        from win where len(a) >= before + 5 and place >= 1 and len(d) >= place + 2 and list_max(list_transform(a, lambda v: abs(v))) <= 1500 and list_stddev_pop(a) >= 3),
    lined as (select source, rate_hz, after, unnest(list_resize(list_slice(list_transform(a, lambda v: least(greatest((v - base) / jump, -0.5), 2.0)), 1, after), after, least(greatest((a[least(len(a), after)] - base) / jump, -0.5), 2.0))) as v, unnest(range(after)) as lag from parts where abs(jump) >= 5)
    select source, round(rate_hz, 6) as rate_hz, lag, round(lag / rate_hz, 6) as lag_s, round(avg(v), 6) as response, count(*) as windows from lined group by source, rate_hz, lag""")
def time_domain_response(t: Tables) -> DataFrame:
    """The mean response of each source to its steps, at whatever rate it has."""
    rows = series.with_rate(series.numbered(samples(t, 20), KEY), KEY)
    before = F.coalesce(F.lag("value").over(series.along(KEY, "idx")), F.lit(0.0))
    rows = rows.withColumns({"desired": F.col("value"), "actual": 0.7 * F.col("value") + 0.3 * before})
    found = responses.time_domain_response(rows, KEY)
    return found.select("source", F.round("rate_hz", 6).alias("rate_hz"), "lag", F.round("lag_s", 6).alias("lag_s"), F.round("response", 6).alias("response"), "windows")
