"""Queries over identified models, filter chains, attitude and field."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators import attitude, filters, geomagnetic, models, series
from aerolake.plans.registry import SIGNALS, Tables, query

USER = ["user_id"]
NA, NB, DELAY = 2, 1, 1
NAMES = ["y1", "y2", "u0"]
#: Frequency grid (Hz) of the filter responses.
STEP, POINTS = 5.0, 40
LAGGED = f"""{SIGNALS},
    xy as (select user_id, idx, value as u, 0.6 * value + 0.4 * coalesce(lag(value) over (partition by user_id order by idx), 0) as y from signals),
    lagged as (
        select * from (select user_id, y as y0, -lag(y, 1) over w as y1, -lag(y, 2) over w as y2, lag(u, 1) over w as u0 from xy window w as (partition by user_id order by idx)) x
        where y1 is not null and y2 is not null and u0 is not null)"""


def pairs(t: Tables) -> DataFrame:
    """Each user's signal as an input u with an output y that follows it."""
    from aerolake.operators import series

    before = F.coalesce(F.lag("value").over(series.along(USER, "idx")), F.lit(0.0))
    return t.signals.select("user_id", "idx", F.col("value").alias("u"), (0.6 * F.col("value") + 0.4 * before).alias("y"))


def arx(t: Tables) -> DataFrame:
    rows, names = models.lagged(pairs(t), USER, "y", "u", NA, NB, DELAY)
    return models.gram(rows, USER, names, "y0")


TRIANGLE = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]


@query(f"""with {LAGGED} select user_id, count(*) as n, {", ".join(f"round(sum({a} * {b}), 2) as {a}_{b}" for a, b in TRIANGLE)}, {", ".join(f"round(sum({a} * y0), 2) as {a}_y0" for a in NAMES)} from lagged group by user_id""")
def arx_gram(t: Tables) -> DataFrame:
    rows = arx(t)
    return rows.select("user_id", "n", *(F.round(F.col("xx")[i], 2).alias(f"{a}_{b}") for i, (a, b) in enumerate(TRIANGLE)), *(F.round(F.col("xy")[i], 2).alias(f"{a}_y0") for i, a in enumerate(NAMES)))


#: theta of the three unknowns by Cramer's rule, for users with more rows than unknowns.
FITTED = f"""{LAGGED},
    g as (select user_id, count(*) as n, {", ".join(f"sum({a} * {b}) as {a}_{b}" for a, b in TRIANGLE)}, {", ".join(f"sum({a} * y0) as {a}_b" for a in NAMES)}, sum(y0 * y0) as yy, sum(y0) as ys from lagged group by user_id having count(*) > 3),
    d as (
        select *, y1_y1 * (y2_y2 * u0_u0 - y2_u0 * y2_u0) - y1_y2 * (y1_y2 * u0_u0 - y2_u0 * y1_u0) + y1_u0 * (y1_y2 * y2_u0 - y2_y2 * y1_u0) as det,
            y1_b * (y2_y2 * u0_u0 - y2_u0 * y2_u0) - y1_y2 * (y2_b * u0_u0 - y2_u0 * u0_b) + y1_u0 * (y2_b * y2_u0 - y2_y2 * u0_b) as d1,
            y1_y1 * (y2_b * u0_u0 - y2_u0 * u0_b) - y1_b * (y1_y2 * u0_u0 - y2_u0 * y1_u0) + y1_u0 * (y1_y2 * u0_b - y2_b * y1_u0) as d2,
            y1_y1 * (y2_y2 * u0_b - y2_b * y2_u0) - y1_y2 * (y1_y2 * u0_b - y2_b * y1_u0) + y1_b * (y1_y2 * y2_u0 - y2_y2 * y1_u0) as d3 from g),
    fits as (
        select user_id, n, a1, a2, b1, case when yy - ys * ys / n < 1e-10 then 0 else least(greatest(100 * (1 - (yy - (a1 * y1_b + a2 * y2_b + b1 * u0_b)) / (yy - ys * ys / n)), 0), 100) end as fit
        from (select *, d1 / det as a1, d2 / det as a2, d3 / det as b1 from d) x)"""


def fits(t: Tables) -> DataFrame:
    """Fits of the users with more rows than unknowns."""
    return models.solve(arx(t), USER, NA + NB).where("reliable")


@query(f"""with {FITTED},
    z as (select *, a1 * a1 - 4 * a2 as disc, case when abs(1 + a1 + a2) > 1e-12 then b1 / (1 + a1 + a2) else 0 end as gain from fits),
    p as (
        select *, 200 * ((-a1 / 2 - 1) * (-a1 / 2 + 1) + (-disc) / 4) / ((1 - a1 / 2) ** 2 - disc / 4) as re, 200 * sqrt(greatest(-disc, 0)) / ((1 - a1 / 2) ** 2 - disc / 4) as im,
            (-a1 + sqrt(greatest(disc, 0))) / 2 as z1, (-a1 - sqrt(greatest(disc, 0))) / 2 as z2 from z),
    q as (
        select *, case when abs(z1) > 0.01 and abs(z1) < 1 then abs(200 * (z1 - 1) / (z1 + 1)) end as s1, case when abs(z2) > 0.01 and abs(z2) < 1 then abs(200 * (z2 - 1) / (z2 + 1)) end as s2 from p),
    o as (
        select *, case when disc < 0 then case when sqrt(a2) > 0.01 and sqrt(a2) < 1 then sqrt(re * re + im * im) end when s1 is not null and s2 is not null then sqrt(s1 * s2) else coalesce(s1, s2) end as w from q),
    e as (
        select *, case when w is null then null when disc < 0 then -re / w when s1 is not null and s2 is not null then (s1 + s2) / (2 * w) else 1 end as ze from o),
    c as (select *, least(greatest(w, 1), 500) as omega, least(greatest(ze, 0.05), 2) as zeta from e),
    h as (select *, case when omega is not null then least(case when zeta < 0.5 then 0.3 when zeta < 0.8 then 0.5 else 0.7 end * omega / (2 * pi()), 10) end as bandwidth from c)
    select user_id, n, [round(a1, 5), round(a2, 5), round(b1, 5)] as theta, round(fit, 3) as fit_percent, round(omega, 3) as omega, round(zeta, 3) as zeta, round(gain, 4) as gain, round(bandwidth, 3) as bandwidth_hz,
        round(least(greatest(2 * pi() * bandwidth / 10, 0.01), 0.5), 4) as p_gain from h""")
def arx_fit(t: Tables) -> DataFrame:
    found = fits(t)
    dynamics = models.poles_to_dynamics(found, USER, NA, NB, 100.0)
    short = {"fit_percent": 3, "omega": 3, "zeta": 3, "gain": 4, "bandwidth_hz": 3, "p_gain": 4}
    return found.join(dynamics, "user_id").select("user_id", "n", F.transform("theta", lambda x: F.round(x, 5)).alias("theta"), *(F.round(c, d).alias(c) for c, d in short.items()))


@query(f"""with recursive {FITTED},
    r as (
        select user_id, 0 as k, a1, a2, b1, 0.0::double as y, 0.0::double as y_1 from fits
        union all
        select user_id, k + 1, a1, a2, b1, b1 - a1 * y - a2 * y_1, y from r where k < 49),
    s as (select *, case when abs(1 + a1 + a2) > 1e-9 then b1 / (1 + a1 + a2) else 0 end as gain from r)
    select user_id, k, round(case when abs(gain) > 1e-9 then least(greatest(y / gain, -0.5), 2) else y end, 4) as response from s""")
def arx_step(t: Tables) -> DataFrame:
    rows = models.step_responses(fits(t), USER, NA, NB, DELAY, 50)
    return rows.select("user_id", F.posexplode("response").alias("k", "response")).withColumn("response", F.round("response", 4))


@query("""with s as (select user_id, event_type as channel, value as u, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as idx from events where event_id % 3 = 0),
    xy as (select *, 0.6 * u + 0.4 * coalesce(lag(u) over (partition by user_id, channel order by idx), 0) as y from s),
    l as (select user_id, channel, lag(y, 2) over w as y2, lag(u, 1) over w as u0 from xy window w as (partition by user_id, channel order by idx))
    select user_id, channel, count(*) as n, count(*) > 3 as reliable from l where y2 is not null and u0 is not null group by 1, 2""")
def arx_flagged(t: Tables) -> DataFrame:
    """Fits of short series: those with no more rows than unknowns are flagged, not dropped."""
    keys = ["user_id", "channel"]
    rows = t.events.where("event_id % 3 = 0").select("user_id", F.col("event_type").alias("channel"), F.col("value").alias("u"), F.struct(F.col("ts").cast("timestamp"), "event_id").alias("at"))
    rows = rows.withColumn("idx", F.row_number().over(series.along(keys, "at")).cast("long") - 1).drop("at")
    rows = rows.withColumn("y", 0.6 * F.col("u") + 0.4 * F.coalesce(F.lag("u").over(series.along(keys, "idx")), F.lit(0.0)))
    lagged, names = models.lagged(rows, keys, "y", "u", NA, NB, DELAY)
    return models.solve(models.gram(lagged, keys, names, "y0"), keys, NA + NB).select(*keys, "n", "reliable")


SMOOTH, OVER = 50, 4


@query(f"""with recursive {FITTED},
    r as (
        select user_id, 0 as k, a1, a2, b1, 0.0::double as y, 0.0::double as y_1 from fits
        union all
        select user_id, k + 1, a1, a2, b1, b1 - a1 * y - a2 * y_1, y from r where k < {SMOOTH - 1}),
    v as (select user_id, k, case when abs(1 + a1 + a2) > 1e-9 and abs(b1 / (1 + a1 + a2)) > 1e-9 then least(greatest(y * (1 + a1 + a2) / b1, -0.5), 2) else y end as y from r),
    curve as (select user_id, k, y, lead(y) over w as y1, 6 * (lead(y) over w - 2 * y + lag(y) over w) as rhs from v window w as (partition by user_id order by k)),
    ends as (select user_id, max(rhs) filter (where k = 1) / 6 as first, max(rhs) filter (where k = {SMOOTH - 2}) / 6 as last from curve group by user_id),
    down as (
        select user_id, 1 as k, 0.0::double as c, first as h from ends
        union all
        select t.user_id, t.k + 1, 1 / (4 - c), (curve.rhs - h) / (4 - c) from down t join curve on curve.user_id = t.user_id and curve.k = t.k + 1 where t.k < {SMOOTH - 3}),
    up as (
        select user_id, {SMOOTH - 2} as k, last as m from ends
        union all
        select u.user_id, u.k - 1, t.h - t.c * u.m from up u join down t on t.user_id = u.user_id and t.k = u.k - 1 where u.k > 2),
    inner_m as (select user_id, k, m from up union all select user_id, 1, first from ends),
    bend as (
        select user_id, k, m from inner_m union all
        select a.user_id, 0, 2 * a.m - b.m from inner_m a join inner_m b on b.user_id = a.user_id and b.k = 2 where a.k = 1 union all
        select a.user_id, {SMOOTH - 1}, 2 * a.m - b.m from inner_m a join inner_m b on b.user_id = a.user_id and b.k = {SMOOTH - 3} where a.k = {SMOOTH - 2}),
    spans as (select d.user_id, d.k, d.y, d.y1, a.m as m0, b.m as m1 from curve d join bend a on a.user_id = d.user_id and a.k = d.k join bend b on b.user_id = d.user_id and b.k = d.k + 1 where d.k < {SMOOTH - 1}),
    places as (select j, {SMOOTH - 1}::double * j / ({SMOOTH * OVER - 1}) as x from range({SMOOTH * OVER}) r(j)),
    cut as (select j, least(floor(x)::int, {SMOOTH - 2}) as k, x - least(floor(x)::int, {SMOOTH - 2}) as t from places)
    select user_id, j as k, round(least(greatest(y + t * (y1 - y - (2 * m0 + m1) / 6) + t * t * m0 / 2 + t * t * t * (m1 - m0) / 6, -0.5), 2), 4) as response from cut join spans using (k)""")
def arx_step_smooth(t: Tables) -> DataFrame:
    rows = models.smoothed(models.step_responses(fits(t), USER, NA, NB, DELAY, SMOOTH), USER, OVER)
    return rows.select("user_id", F.posexplode("response").alias("k", "response")).withColumns({"k": F.col("k").cast("long"), "response": F.round("response", 4)})


@query(f"""with recursive {LAGGED}, sim as (
        select user_id, idx, u, 0.0::double as s from xy where idx = 0
        union all
        select x.user_id, x.idx, x.u, 0.5::double * sim.u + 0.3::double * sim.s from sim join xy x on x.user_id = sim.user_id and x.idx = sim.idx + 1)
    select user_id, idx, round(s, 6) as simulated from sim""")
def arx_simulate(t: Tables) -> DataFrame:
    rows = pairs(t)
    model = rows.select("user_id").distinct().withColumn("theta", F.array(F.lit(-0.3), F.lit(0.5)))
    return models.simulate(rows, model, USER, "u", 1, 1, 1).withColumn("simulated", F.round("simulated", 6))


@query(f"""with {LAGGED}, m as (select user_id, idx, y - avg(y) over (partition by user_id) as y, u - avg(u) over (partition by user_id) as u from xy),
    l as (select user_id, y, {", ".join(f"lag(u, {k}) over w as u{k}" for k in range(21))} from m window w as (partition by user_id order by idx)),
    s as (select user_id, k, c from (select user_id, {", ".join(f"coalesce(sum(y * u{k}), 0) as c{k}" for k in range(21))} from l group by user_id) x, lateral (values {", ".join(f"({k}, c{k})" for k in range(21))}) v(k, c)),
    r as (select *, row_number() over (partition by user_id order by c desc, k) as place from s)
    select user_id, k::bigint as lag, round(c, 2) as correlation from r where place = 1""")
def xcorr_delay(t: Tables) -> DataFrame:
    return models.delay_by_correlation(pairs(t), USER, "y", "u").withColumn("correlation", F.round("correlation", 2))


@query(f"""with {LAGGED}, e as (select user_id, y0 as y, y0 - (0.5 * u0 - 0.2 * y1) as e from lagged)
    select user_id, count(*) as n, round(case when count(*) * var_pop(y) < 1e-10 then 0 else least(greatest(100 * (1 - sum(e * e) / (count(*) * var_pop(y))), 0), 100) end, 6) as fit_percent from e group by user_id""")
def fit_quality(t: Tables) -> DataFrame:
    rows, _ = models.lagged(pairs(t), USER, "y", "u", NA, NB, DELAY)
    rows = rows.withColumn("e", F.col("y0") - (0.5 * F.col("u0") - 0.2 * F.col("y1")))
    spread = F.count("*") * F.var_pop("y0")
    fit = F.when(spread < 1e-10, 0.0).otherwise(F.least(F.greatest(100 * (1 - F.sum(F.col("e") * F.col("e")) / spread), F.lit(0.0)), F.lit(100.0)))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(fit, 6).alias("fit_percent"))


LOWPASS = """with f as (select p_partkey, 20.0::double + p_size * 2.0::double as cutoff, 400.0::double + (p_partkey % 5) * 200.0::double as rate from part),
    g as (select *, unnest(range(1, 41)) * 5.0::double as freq from f),
    c as (select *, tan(pi() * cutoff / rate) as w, 2 * pi() * freq / rate as o from g),
    k as (select *, w * w / (1 + 2 * cos(pi() / 4) * w + w * w) as b0, 2 * (w * w - 1) / (1 + 2 * cos(pi() / 4) * w + w * w) as a1, (1 - 2 * cos(pi() / 4) * w + w * w) / (1 + 2 * cos(pi() / 4) * w + w * w) as a2 from c where freq < rate / 2),
    r as (
        select p_partkey, freq, b0 * (1 + 2 * cos(o) + cos(2 * o)) as br, -b0 * (2 * sin(o) + sin(2 * o)) as bi, 1 + a1 * cos(o) + a2 * cos(2 * o) as ar, -(a1 * sin(o) + a2 * sin(2 * o)) as ai from k),
    bode as (select p_partkey, freq, 20 * log10(sqrt(greatest(br * br + bi * bi, 1e-300) / (ar * ar + ai * ai))) as db, degrees(atan2(bi, br) - atan2(ai, ar)) as deg from r)"""


def lowpass(t: Tables) -> DataFrame:
    settings = t.part.select("p_partkey", (20.0 + F.col("p_size") * 2.0).alias("cutoff"), (400.0 + (F.col("p_partkey") % 5) * 200.0).alias("rate"))
    rows = settings.withColumn("freq", F.explode(filters.grid(STEP, POINTS))).where("freq < rate / 2")
    return filters.lowpass_response(rows)


@query(f"{LOWPASS} select p_partkey, freq, round(db, 4) as magnitude_db, round(deg, 4) as phase_deg from bode")
def biquad_bode(t: Tables) -> DataFrame:
    return lowpass(t).select("p_partkey", "freq", F.round("magnitude_db", 4).alias("magnitude_db"), F.round("phase_deg", 4).alias("phase_deg"))


@query(f"""{LOWPASS} select p_partkey, min(freq) filter (where db < -3) as cut_hz, {", ".join(f"round(min_by(db, (abs(freq - {k}), freq)), 4) as db_at_{int(k)}" for k in filters.KEY_HZ)} from bode group by p_partkey""")
def key_frequencies(t: Tables) -> DataFrame:
    rows = filters.key_points(lowpass(t), ["p_partkey"], STEP, POINTS)
    return rows.select("p_partkey", "cut_hz", *(F.round(c, 4).alias(c) for c in rows.columns if c.startswith("db_at_")))


@query("""with f as (select p_partkey, 40.0::double + p_size as center, 10.0::double + p_size / 2.0::double as bandwidth, 30.0::double as attenuation, 1 + p_partkey % 7 as harmonics, 1 + p_partkey % 3 as notches, 1000.0::double as rate from part),
    h as (select *, unnest(range(1, 17)) as h from f),
    s as (select *, unnest(case notches when 3 then [-1.0, 0.0, 1.0] when 2 then [-1.0, 1.0] else [0.0] end)::double as place from h where (harmonics >> (h - 1)::bigint) & 1 = 1),
    n as (select *, center * h as own, greatest(center * h, 70) * (1 + place * bandwidth / (32 * center)) as at_hz, bandwidth * h / notches as wide from s),
    q as (
        select *, case when own < 70 then 1 + (pow(10, -attenuation / 40) - 1) * (own - 17.5) / 52.5 else pow(10, -attenuation / 40) end as amp, 2 * log2(at_hz / (at_hz - wide / 2)) as oct, 2 * pi() * at_hz / rate as w
        from n where own > wide / 2 and own < rate / 2 and own >= 17.5),
    a as (select *, sin(w) / (2 * case when oct > 0 then sqrt(pow(2, oct)) / (pow(2, oct) - 1) else 10 end) as alpha from q),
    g as (select *, unnest(range(1, 41)) * 5.0::double as freq from a),
    z as (
        select p_partkey, freq, 2 * pi() * freq / rate as o, 1 + alpha * amp * amp as b0, -2 * cos(w) as b1, 1 - alpha * amp * amp as b2, 1 + alpha as a0, 1 - alpha as a2 from g),
    r as (
        select p_partkey, freq, b0 + b1 * cos(o) + b2 * cos(2 * o) as br, -(b1 * sin(o) + b2 * sin(2 * o)) as bi, a0 + b1 * cos(o) + a2 * cos(2 * o) as ar, -(b1 * sin(o) + a2 * sin(2 * o)) as ai from z)
    select p_partkey, freq, round(sum(10 * log10(greatest(br * br + bi * bi, 1e-300) / greatest(ar * ar + ai * ai, 1e-300))), 4) as magnitude_db, round(degrees(sum(atan2(bi, br) - atan2(ai, ar))), 4) as phase_deg from r group by p_partkey, freq""")
def harmonic_notch_bode(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    notches = filters.spread_notches(40.0 + F.col("p_size"), 10.0 + F.col("p_size") / 2.0, F.lit(30.0), 1 + key % 7, 1 + key % 3, F.lit(1000.0), F.lit(70.0))
    rows = t.part.select("p_partkey", F.lit(1000.0).alias("rate"), F.inline(notches))
    rows = filters.summed_response(rows, ["p_partkey"], STEP, POINTS)
    return rows.select("p_partkey", "freq", F.round("magnitude_db", 4).alias("magnitude_db"), F.round("phase_deg", 4).alias("phase_deg"))


QUAT = """v as (select vec_id, list_transform(embedding[1:7], lambda u: u::double) as e from embeddings where len(embedding) >= 7),
    q as (select vec_id, e[1] / s as w, e[2] / s as x, e[3] / s as y, e[4] / s as z, e[5] as a, e[6] as b, e[7] as c from (select *, sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4]) as s from v) u)"""


@query(f"""with {QUAT}
    select vec_id, round((1 - 2 * (y * y + z * z)) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c, 6) as rx, round(2 * (x * y + w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - w * x) * c, 6) as ry,
        round(2 * (x * z - w * y) * a + 2 * (y * z + w * x) * b + (1 - 2 * (x * x + y * y)) * c, 6) as rz,
        round(degrees(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), 4) as roll, round(degrees(asin(least(greatest(2 * (w * y - z * x), -1), 1))), 4) as pitch, round(degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))), 4) as yaw from q""")
def quat_rotate(t: Tables) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(7)]
    q = attitude.normalized(e[:4])
    rows = t.embeddings.where(F.size("embedding") >= 7).select("vec_id", *(c.alias(n) for n, c in zip("wxyz", q, strict=True)), *(c.alias(n) for n, c in zip("abc", e[4:], strict=True)))
    q, v = [F.col(n) for n in "wxyz"], [F.col(n) for n in "abc"]
    return rows.select("vec_id", *(F.round(c, 6).alias(n) for n, c in zip(("rx", "ry", "rz"), attitude.rotate(q, v), strict=True)), *(F.round(c, 4).alias(n) for n, c in zip(("roll", "pitch", "yaw"), attitude.to_euler(q), strict=True)))


@query("""with l as (select i, 1 - 2 * (i + 0.5::double) / 80 as z, pi() * (3 - sqrt(5)) * i as a from range(80) r(i)),
    p as (select i, sqrt(1 - z * z) * cos(a) as x, sqrt(1 - z * z) * sin(a) as y, z from l),
    d as (select vec_id, label, i, p.x * embedding[1]::double + p.y * embedding[2]::double + p.z * embedding[3]::double as d from embeddings cross join p),
    b as (select vec_id, label, arg_max(i, (d, -i)) as bin from d group by vec_id, label),
    n as (select label, count(*) as n, count(distinct bin) as bins from b group by label)
    select b.vec_id, b.label, bin, round(n / bins / count(*) over (partition by b.label, bin), 6) as weight, round(bins / 80, 6) as coverage from b join n on n.label = b.label""")
def attitude_bins(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", attitude.nearest_bin([F.col("embedding")[i].cast("double") for i in range(3)]).alias("bin"))
    return attitude.coverage(rows, ["label"]).select("vec_id", "label", "bin", F.round("weight", 6).alias("weight"), F.round("coverage", 6).alias("coverage"))


def distorted(t: Tables) -> DataFrame:
    """Field vectors (three components of each vector, in mGauss) with the raw readings of a distorted magnetometer."""
    b = [450.0 * F.col("embedding")[i].cast("double") for i in range(3)]
    rows = t.embeddings.select("label", (0.5 + 0.5 * F.sin(F.col("vec_id").cast("double"))).alias("throttle"), *(c.alias(n) for n, c in zip(("bx", "by", "bz"), b, strict=True)))
    return rows.select("label", "throttle", "bx", "by", "bz", ((F.col("bx") - 20 * F.col("throttle")) / 0.98 - 120).alias("rx"), (F.col("by") / 1.03 + 80).alias("ry"), (F.col("bz") / 0.95 - 45).alias("rz"))


def field_gram(t: Tables) -> DataFrame:
    return models.field_gram(distorted(t), ["label"], ("rx", "ry", "rz"), ("bx", "by", "bz"), "throttle")


@query("""with b as (select label, 0.5 + 0.5 * sin(vec_id::double) as th, 450 * embedding[1]::double as fx, 450 * embedding[2]::double as fy, 450 * embedding[3]::double as fz from embeddings),
    r as (select *, (fx - 20 * th) / 0.98 - 120 as rx, fy / 1.03 + 80 as ry, fz / 0.95 - 45 as rz from b)
    select label, 3 * count(*) as n, round(sum(rx * rx), 1) as m11_m11, round(sum(ry * ry), 1) as m22_m22, round(sum(rx * rx + ry * ry), 1) as m12_m12, round(sum(rx), 3) as m11_cx, round(sum(th * rx), 3) as m11_tx, round(sum(rx * fx), 1) as m11_b, round(sum(ry * fx + rx * fy), 1) as m12_b, round(sum(fx * fx + fy * fy + fz * fz), 1) as b_b
    from r group by label""")
def magfit_gram(t: Tables) -> DataFrame:
    names = models.FIELD_UNKNOWNS
    at = {(a, b): k for k, (a, b) in enumerate((a, b) for i, a in enumerate(names) for b in names[i:])}
    xx = lambda a, b, d: F.round(F.col("xx")[at[a, b]], d).alias(f"{a}_{b}")
    xy = lambda a, d: F.round(F.col("xy")[names.index(a)], d).alias(f"{a}_b")
    return field_gram(t).select("label", "n", xx("m11", "m11", 1), xx("m22", "m22", 1), xx("m12", "m12", 1), xx("m11", "cx", 3), xx("m11", "tx", 3), xy("m11", 1), xy("m12", 1), F.round("yy", 1).alias("b_b"))


#: The distortion is planted, so the twin states what a fit must find.
@query("""select label, count(*) as n, [120.0::double, -80.0, 45.0] as offset, [0.98::double, 1.03, 0.95] as diagonal, [0.0::double, 0.0, 0.0] as off_diagonal, [20.0::double, 0.0, 0.0] as motor, 0.0::double as rmse, true as in_bounds from embeddings group by label""")
def magfit_fit(t: Tables) -> DataFrame:
    fit = models.calibrate(field_gram(t), ["label"])
    cut = lambda c: F.transform(c, lambda x: F.round(x, 3) + 0.0).alias(c)
    return fit.select("label", "n", *map(cut, ("offset", "diagonal", "off_diagonal", "motor")), (F.round("rmse", 2) + 0.0).alias("rmse"), "in_bounds")


@query("""with g as (select la * 10 as lat, lo * 10 as lon from range(-9, 10) a(la), range(-18, 19) b(lo)),
    m as (select *, radians(80.7) as p, radians(lat) as a, radians(lon + 72.7) as d from g),
    s as (select *, greatest(-1, least(1, sin(a) * sin(p) + cos(a) * cos(p) * cos(d))) as s from m),
    t as (select lat, lon, degrees(atan2(-cos(p) * sin(d), sin(p) * cos(a) - cos(p) * sin(a) * cos(d))) as de, degrees(atan2(2 * s, cos(asin(s)))) as inc, 298 * sqrt(1 + 3 * s * s) as f from s),
    c as (select c_custkey, (c_custkey * 37 % 1600) / 10.0::double - 80 as lat, (c_custkey * 91 % 3400) / 10.0::double - 170 as lon from customer),
    k as (select *, floor(lat / 10)::int * 10 as cla, floor(lon / 10)::int * 10 as clo from c),
    x as (
        select c_custkey, (k.lat - cla) / 10 as x, (k.lon - clo) / 10 as y, a.de as de00, b.de as de01, e.de as de10, h.de as de11, a.inc as i00, b.inc as i01, e.inc as i10, h.inc as i11, a.f as f00, b.f as f01, e.f as f10, h.f as f11
        from k join t a on a.lat = cla and a.lon = clo join t b on b.lat = cla and b.lon = clo + 10 join t e on e.lat = cla + 10 and e.lon = clo join t h on h.lat = cla + 10 and h.lon = clo + 10)
    select c_custkey, round((1 - x) * ((1 - y) * de00 + y * de01) + x * ((1 - y) * de10 + y * de11), 4) as declination, round((1 - x) * ((1 - y) * i00 + y * i01) + x * ((1 - y) * i10 + y * i11), 4) as inclination,
        round((1 - x) * ((1 - y) * f00 + y * f01) + x * ((1 - y) * f10 + y * f11), 4) as intensity from x""")
def wmm_bilinear(t: Tables) -> DataFrame:
    places = t.customer.select("c_custkey", ((F.col("c_custkey") * 37 % 1600) / 10.0 - 80).alias("lat"), ((F.col("c_custkey") * 91 % 3400) / 10.0 - 170).alias("lon"))
    rows = attitude.field_at(places, attitude.dipole_grid(t.spark))
    return rows.select("c_custkey", *(F.round(c, 4).alias(c) for c in ("declination", "inclination", "intensity")))


def harmonic_twin() -> str:
    """CTEs over places (id, lat, lon, alt) to field (id, north, east, down in nT): each degree's functions from those of the two before it."""
    model = geomagnetic.terms()
    top = max(n for n, *_ in model)
    squeeze = geomagnetic.FLATTENING * (2 - geomagnetic.FLATTENING)
    ctes = [f"""bent as (select *, radians(lat) as phi, radians(lon) as lam, {geomagnetic.AXIS_KM} / sqrt(1 - {squeeze!r} * sin(radians(lat)) ** 2) as bend from places),
        seen as (select *, (bend + alt / 1000) * cos(phi) as flat, (bend * (1 - {squeeze!r}) + alt / 1000) * sin(phi) as up from bent),
        d0 as (select *, sqrt(flat * flat + up * up) as r, asin(up / sqrt(flat * flat + up * up)) as gc, up / sqrt(flat * flat + up * up) as c, greatest(cos(asin(up / sqrt(flat * flat + up * up))), 1e-9) as s, 1::double as p0_0, 0::double as q0_0 from seen)"""]
    for n in range(1, top + 1):
        own = []
        for m in range(n + 1):
            if m == n:
                k = math.sqrt((2 * n - 1) / (2 * n)) if n > 1 else 1.0
                own += [f"{k!r} * s * p{n - 1}_{m - 1} as p{n}_{m}", f"{k!r} * (s * q{n - 1}_{m - 1} + c * p{n - 1}_{m - 1}) as q{n}_{m}"]
            else:
                root = math.sqrt(n * n - m * m)
                less = lambda f, n=n, m=m: f" - {math.sqrt((n - 1) ** 2 - m * m)!r} * {f}{n - 2}_{m}" if m < n - 1 else ""
                own += [f"({2 * n - 1} * c * p{n - 1}_{m}{less('p')}) / {root!r} as p{n}_{m}", f"({2 * n - 1} * (c * q{n - 1}_{m} - s * p{n - 1}_{m}){less('q')}) / {root!r} as q{n}_{m}"]
        ctes.append(f"d{n} as (select *, {', '.join(own)} from d{n - 1})")
    part = lambda g, h, m: f"({g!r} * cos({m} * lam) + {h!r} * sin({m} * lam))"
    scale = lambda n: f"({geomagnetic.RADIUS_KM} / r) ** {n + 2}"
    x = " + ".join(f"{scale(n)} * {part(g, h, m)} * q{n}_{m}" for n, m, g, h, *_ in model)
    y = " + ".join(f"{scale(n)} * {m} * {part(-h, g, m)} * p{n}_{m} / s" for n, m, g, h, *_ in model)
    z = " - ".join(["0", *(f"{scale(n)} * {n + 1} * {part(g, h, m)} * p{n}_{m}" for n, m, g, h, *_ in model)])
    return f"{', '.join(ctes)}, sums as (select id, gc - phi as lean, {x} as x, {y} as y, {z} as z from d{top}), field as (select id, x * cos(lean) - z * sin(lean) as north, y as east, x * sin(lean) + z * cos(lean) as down from sums)"


@query(f"""with places as (select c_custkey as id, (c_custkey * 37 % 1780) / 10.0::double - 89 as lat, (c_custkey * 91 % 7200) / 10.0::double - 360 as lon, (c_custkey * 7 % 9000)::double as alt from customer),
    {harmonic_twin()}
    select id as c_custkey, round(north / 100, 4) as north, round(east / 100, 4) as east, round(down / 100, 4) as down, round(degrees(atan2(east, north)), 4) as declination,
        round(degrees(atan2(down, sqrt(north ** 2 + east ** 2))), 4) as inclination, round(sqrt(north ** 2 + east ** 2 + down ** 2) / 100, 4) as intensity from field""")
def field_model(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    places = t.customer.select("c_custkey", ((key * 37 % 1780) / 10.0 - 89).alias("lat"), ((key * 91 % 7200) / 10.0 - 360).alias("lon"), (key * 7 % 9000).cast("double").alias("alt"))
    return geomagnetic.model_field(places).select("c_custkey", *(F.round(c, 4).alias(c) for c in geomagnetic.FIELD))


@query(f"""with d as (select o_orderkey, o_orderkey * 2654435 % 16777216 as id from orders)
    select o_orderkey, id & 7 as bus_type, (id >> 3) & 31 as bus, (id >> 8) & 255 as address, (id >> 16) & 255 as device, case id & 7 {" ".join(f"when {k} then '{v}'" for k, v in attitude.BUSES.items())} else 'unknown' end as bus_name from d""")
def devid_decode(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") * 2654435 % 16777216).alias("id"))
    return rows.select("o_orderkey", *(c.alias(n) for n, c in attitude.decode_device(F.col("id")).items()))


