"""Queries over assessments, notes and derived settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions import units
from aerolake.operators import diagnosis, filters, series, spectral
from aerolake.plans import spectra
from aerolake.plans.registry import SIGNALS, Tables, query

USER = ["user_id"]


@query(f"""with {SIGNALS},
    xy as (select user_id, idx, value as d, 1.3::double * value - 0.1::double * coalesce(lag(value) over (partition by user_id order by idx), 0) as a from signals),
    w as (
        select *, lead(d) over (partition by user_id order by idx) as target, max(d) over (partition by user_id) - min(d) over (partition by user_id) as rng,
            max(abs(a)) over (partition by user_id order by idx rows between current row and 19 following) as peak, count(*) over (partition by user_id order by idx rows between current row and 19 following) as seen from xy),
    g as (
        select user_id, count(*) filter (where rng > 1e-6 and abs(target - d) > 0.3 * rng) as steps,
            count(*) filter (where rng > 1e-6 and abs(target - d) > 0.3 * rng and seen > 2 and target <> 0 and peak > 1.15 * abs(target)) as overshoots, sqrt(avg((a - d) * (a - d))) as rms from w group by user_id)
    select user_id, steps, overshoots, round(rms, 6) as tracking_rms, overshoots > 0.3 * steps as overshoot_detected, case when overshoots > 0.3 * steps then 'MARGINAL' else 'GOOD' end as assessment from g""")
def ff_assessment(t: Tables) -> DataFrame:
    before = F.coalesce(F.lag("value").over(series.along(USER, "idx")), F.lit(0.0))
    rows = t.signals.select("user_id", "idx", F.col("value").alias("desired"), (1.3 * F.col("value") - 0.1 * before).alias("actual"))
    return diagnosis.feed_forward(rows, USER, "desired", "actual").select("user_id", "steps", "overshoots", F.round("tracking_rms", 6).alias("tracking_rms"), "overshoot_detected", "assessment")


@query(f"""with {spectra.PEAKS.replace("floor + 3 and freq between 30 and 600", "floor + 10 and freq between 80 and 400")},
    m as (select e.vec_id, e.label % 2 = 0 as rpm, max(rise) as above from embeddings e left join peaks p on p.vec_id = e.vec_id where len(e.embedding) >= 2 group by e.vec_id, e.label)
    select vec_id, rpm, round(above, 4) as above_floor, case when above is null then 'EXCELLENT' when rpm then case when above < 15 then 'EXCELLENT' when above < 25 then 'GOOD' else 'MARGINAL' end when above > 20 then 'MARGINAL' else 'GOOD' end as assessment,
        case when rpm and above >= 25 then greatest(100.0::double, 200.0::double - 50) when not rpm and above > 20 then greatest(80.0::double, 200.0::double * 0.7) end as lowpass from m""")
def rpm_filter_assessment(t: Tables) -> DataFrame:
    bins = spectra.bins(t)
    floor = spectral.noise_floor(bins, spectra.KEY).select("vec_id", "floor")
    peaks = spectral.local_peaks(bins, spectra.KEY, 10.0, 80.0, 400.0, 5).join(floor, "vec_id").groupBy("vec_id").agg(F.max(F.col("magnitude") - F.col("floor")).alias("above"))
    rows = spectra.frames(t).select("vec_id", (F.col("label") % 2 == 0).alias("rpm")).join(peaks, "vec_id", "left")
    return rows.select("vec_id", "rpm", F.round("above", 4).alias("above_floor"), diagnosis.motor_noise(F.col("above"), F.col("rpm")).alias("assessment"), diagnosis.gyro_lowpass(F.col("above"), F.col("rpm"), F.lit(200.0)).alias("lowpass"))


@query(f"""with {spectra.twin(False)}, h as (select vec_id, sum(a * a) filter (where freq >= {spectra.RATE / 8}) / sum(a * a) as high from bins group by vec_id),
    r as (select vec_id, sqrt(avg(x * x) filter (where i < n // 2)) / sqrt(avg(x * x) filter (where i >= n // 2)) - 0.6 as dp from samples group by vec_id)
    select h.vec_id, round(dp, 6) as d_to_p, round(high, 6) as high_share, case when dp > 0.5 then 'POOR' when dp > 0.3 or high > 0.3 then 'MARGINAL' else 'GOOD' end as assessment,
        (case when dp > 0.5 then 0.7 when dp > 0.3 then 0.8 when high > 0.3 then 0.85 end)::double as factor from h join r on r.vec_id = h.vec_id""")
def dterm_assessment(t: Tables) -> DataFrame:
    power = F.col("magnitude") * F.col("magnitude")
    high = spectra.bins(t, "linear").groupBy("vec_id").agg((F.sum(F.when(F.col("freq") >= spectra.RATE / 8, power)) / F.sum(power)).alias("high"))
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    half = F.floor(F.col("size") / 2).cast("int")
    rows = spectra.frames(t).select("vec_id", (F.sqrt(square(F.slice("embedding", F.lit(1), half)) / half) / F.sqrt(square(F.slice("embedding", half + 1, F.col("size") - half)) / (F.col("size") - half)) - 0.6).alias("dp")).join(high, "vec_id")
    level, factor = diagnosis.d_term(F.col("dp"), F.col("high"))
    return rows.select("vec_id", F.round("dp", 6).alias("d_to_p"), F.round("high", 6).alias("high_share"), level.alias("assessment"), factor.alias("factor"))


@query("""with c as (select c_custkey, (c_custkey * 37 % 1800) / 10.0::double - 90 as lat, c_acctbal as alt from customer),
    d as (select *, 50 - 0.015::double * alt / 1000 as f, radians(case when lat >= 30 then 45 + 0.55::double * least(lat - 30, 40) else 35 + 0.33::double * lat end) as dip from c)
    select c_custkey, round(f * cos(dip), 6) as north, 0.0::double as east, round(f * sin(dip), 6) as down from d""")
def dip_field(t: Tables) -> DataFrame:
    parts = diagnosis.dip_field((F.col("c_custkey") * 37 % 1800) / 10.0 - 90, F.col("c_acctbal"))
    return t.customer.select("c_custkey", *(F.round(c, 6).alias(n) for n, c in zip(("north", "east", "down"), parts, strict=True)))


@query("""with f as (select user_id % 10 as flight, user_id as system, event_id, event_type from events),
    l as (select flight, min_by(system, event_id) as s, min(event_id) as at_id from f where event_type = 'signup' group by flight)
    select f.flight, system, count(*) as frames from f left join l on l.flight = f.flight where l.s is null or event_id < at_id or system = l.s group by f.flight, system""")
def foreign_systems(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 10).alias("flight"), F.col("user_id").alias("system"), "event_id", "event_type")
    return diagnosis.own_system(rows, ["flight"], "system", F.col("event_type") == "signup", "event_id").groupBy("flight", "system").agg(F.count("*").alias("frames"))


CATEGORIES = [("^(cold|hot)", "thermal"), ("small|large", "size"), ("(red|blue|green|steel)", "finish")]


@query("""select case when regexp_matches(p_name, '^(cold|hot)') then 'thermal' when regexp_matches(p_name, 'small|large') then 'size' when regexp_matches(p_name, '(red|blue|green|steel)') then 'finish' else 'other' end as category, count(*) as n, min(p_name) as first from part group by 1""")
def categorize_regex(t: Tables) -> DataFrame:
    return t.part.groupBy(diagnosis.categorize(F.col("p_name"), CATEGORIES).alias("category")).agg(F.count("*").alias("n"), F.min("p_name").alias("first"))


@query("""select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem) x where k <= 3""")
def recommendation_cap(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return diagnosis.capped_across(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""with m as (select user_id, event_id, value, row_number() over w as k, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by ts, event_id)),
    l as (select user_id, max_by(event_id, event_id) as last_fix, max_by(value, event_id) as last_value from events where value >= 50 group by user_id)
    select m.user_id, m.event_id as middle, m.value as middle_value, last_fix, last_value from m left join l on l.user_id = m.user_id where k = n // 2 + 1""")
def position_pick(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "ts", "value")
    middle = diagnosis.middle_row(rows, USER, "ts", "event_id").select("user_id", F.col("event_id").alias("middle"), F.col("value").alias("middle_value"))
    last = diagnosis.last_fix(rows.drop("ts"), USER, F.col("value") >= 50, "event_id").select("user_id", F.col("event_id").alias("last_fix"), F.col("value").alias("last_value"))
    return middle.join(last, "user_id", "left")


@query("""with p as (select l_suppkey, max_by(l_quantity, (epoch_us(l_shipdate), l_orderkey, l_linenumber, l_extendedprice)) filter (where l_linenumber = 1) as g, max_by(l_quantity, (epoch_us(l_shipdate), l_orderkey, l_linenumber, l_extendedprice)) filter (where l_linenumber = 7) as f from lineitem group by l_suppkey)
    select l_suppkey, coalesce(g, 20) as cutoff, case when coalesce(f, 0) > 25 then 1 else 0 end::bigint as notches, case when coalesce(f, 0) > 25 then 80.0::double end as center from p""")
def filter_derive(t: Tables) -> DataFrame:
    line, key = F.col("l_linenumber"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    name = F.when(line == 1, "INS_GYRO_FILTER").when(line == 7, "INS_HNTCH_ENABLE")
    value = F.when(line == 7, F.greatest(F.col("l_quantity") - 25, F.lit(0.0))).otherwise(F.col("l_quantity"))
    rows = t.lineitem.select("l_suppkey", F.coalesce(name, F.lit("OTHER")).alias("name"), value.alias("value"), key.alias("at"))
    chain = diagnosis.filter_chain(diagnosis.parameters_wide(rows, ["l_suppkey"], diagnosis.FILTER_PARAMS["ardupilot"], "at"), "ardupilot")
    return chain.select("l_suppkey", "cutoff", F.size("notches").cast("long").alias("notches"), F.try_element_at("notches", F.lit(1))["center"].alias("center"))


@query(f"""with {spectra.DB},
    g as (select vec_id, bin, freq, magnitude, tan(pi() * 80 / {spectra.RATE}::double) as w, 2 * pi() * freq / {spectra.RATE}::double as o from db where freq < {spectra.RATE / 2}),
    k as (select *, 1 + 2 * cos(pi() / 4) * w + w * w as c from g),
    r as (
        select vec_id, bin, magnitude, w * w / c * (1 + 2 * cos(o) + cos(2 * o)) as br, -w * w / c * (2 * sin(o) + sin(2 * o)) as bi,
            1 + 2 * (w * w - 1) / c * cos(o) + (1 - 2 * cos(pi() / 4) * w + w * w) / c * cos(2 * o) as ar, -(2 * (w * w - 1) / c * sin(o) + (1 - 2 * cos(pi() / 4) * w + w * w) / c * sin(2 * o)) as ai from k)
    select vec_id, bin, round(magnitude, 4) as magnitude, round(magnitude + greatest(10 * log10(greatest(br * br + bi * bi, 1e-300) / (ar * ar + ai * ai)), -240), 4) as filtered from r""")
def filtered_spectrum(t: Tables) -> DataFrame:
    rows = spectra.bins(t).where(F.col("freq") < spectra.RATE / 2).withColumns({"cutoff": F.lit(80.0), "rate": F.lit(spectra.RATE)})
    rows = filters.lowpass_response(rows).withColumn("filtered", F.col("magnitude") + F.col("magnitude_db"))
    return rows.select("vec_id", "bin", F.round("magnitude", 4).alias("magnitude"), F.round("filtered", 4).alias("filtered"))


@query("""with x as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount * 40 as d, l_tax * (1 + l_suppkey % 90) as a from lineitem),
    m as (select *, max(greatest(abs(d), abs(a))) over (partition by l_suppkey) as top from x)
    select l_suppkey, count(*) as n, round(sum(case when top > 0 and top < 6.5 then degrees(d) else d end), 4) as desired, round(sum(case when top > 0 and top < 6.5 then degrees(a) else a end), 4) as actual from m group by l_suppkey""")
def radians_auto(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", (F.col("l_discount") * 40).alias("desired"), (F.col("l_tax") * (1 + F.col("l_suppkey") % 90)).alias("actual"))
    found = units.degrees_if_radians(rows, ["l_suppkey"], ["desired", "actual"])
    return found.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("desired"), 4).alias("desired"), F.round(F.sum("actual"), 4).alias("actual"))


@query(f"""with {SIGNALS},
    m as (
        select user_id, 3600 / median(dt) as rate, count(*) filter (where dt > 10800) as gaps, count(*) filter (where channel = 'click') as att, count(*) filter (where channel = 'view') as tgt, count(*) filter (where channel = 'purchase') as imu,
            count(*) filter (where channel = 'signup') as par, bool_or(channel = 'error') as clocked, count(distinct channel) as systems, user_id % 16 as kind from signals group by user_id)
    select user_id, case when tgt > 0 then 15 else 30 end as penalty, array_to_string(list_filter([
        case when not clocked then 'receive_clock' end, case when att >= 10 and tgt >= 10 then 'terms_missing' end, case when att >= 10 and tgt >= 10 and rate < 50 then 'telemetry_rate' end, case when att >= 10 and tgt < 10 then 'no_desired_rates' end, case when att < 10 then 'no_attitude' end,
        case when imu = 0 then 'gyro_from_attitude' end, case when rate between 1e-9 and 240 then 'fft_limited' end, case when imu = 0 then 'no_accelerometer' end, case when par = 0 then 'no_parameters' end, case when gaps > 0 then 'link_gaps' end,
        case when gaps / 4 >= 5 then 'dropped_frames' end, case when systems > 1 then 'other_vehicles' end, case when kind not in (2, 3, 4, 13, 14, 15, 29) then 'no_multirotor' end], lambda x: x is not null), ',') as notes from m""")
def telemetry_notes(t: Tables) -> DataFrame:
    of = lambda channel: F.count_if(F.col("channel") == channel)
    facts = {"rate": 3600 / F.median("dt"), "gaps": F.count_if(F.col("dt") > 10800), "att": of("click"), "tgt": of("view"), "imu": of("purchase"), "par": of("signup"), "clocked": F.bool_or(F.col("channel") == "error"), "systems": F.countDistinct("channel")}
    rows = t.signals.groupBy("user_id").agg(*(c.alias(n) for n, c in facts.items()))
    c = {n: F.col(n) for n in facts}
    notes = diagnosis.telemetry_notes(c["clocked"], c["att"], c["tgt"], c["rate"], c["imu"], c["rate"], c["imu"], c["par"], c["gaps"], c["gaps"] / 4, c["systems"], F.col("user_id") % 16)
    return rows.select("user_id", diagnosis.telemetry_penalty(c["tgt"]).alias("penalty"), F.array_join(notes, ",").alias("notes"))


@query("""with p as (select l_suppkey, l_linenumber, max(l_quantity) as top, count(*) as n from lineitem group by 1, 2) select l_suppkey, l_linenumber, n, round(top, 4) as top from p where top > 49""")
def active_channels(t: Tables) -> DataFrame:
    rows = units.active_channels(t.lineitem.select("l_suppkey", "l_linenumber", "l_quantity"), ["l_suppkey"], "l_linenumber", "l_quantity", 49.0)
    return rows.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.max("l_quantity"), 4).alias("top"))
