"""Queries over unit conversions, guards, names, attitudes and texts that the tables of logs are made with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.functions import errors, units
from aerolake.operators import attitude, bands, diagnosis, relational, spectral, tables
from aerolake.plans.catalog import CATALOG, definitions
from aerolake.plans.registry import Tables, query
from aerolake.sources import params, sinks

LINE = ["l_orderkey", "l_linenumber"]


@query("""select l_orderkey, l_linenumber, case when v not in (0, 65535) then round(v / 1000, 6) end as volt, greatest(c, 0) as curr
    from (select *, case l_linenumber when 1 then 65535.0::double when 2 then 0.0::double else l_extendedprice::double end as v, case when l_linenumber = 3 then -0.01::double else l_quantity / 100::double end as c from lineitem) x""")
def sentinel_values(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    volt = units.measured_voltage(F.when(number == 1, 65535.0).when(number == 2, 0.0).otherwise(F.col("l_extendedprice").cast("double")))
    drawn = units.drawn_current(F.when(number == 3, -0.01).otherwise(F.col("l_quantity") / 100))
    return t.lineitem.select(*LINE, F.round(volt / 1000, 6).alias("volt"), drawn.alias("curr"))


@query("select l_orderkey, l_linenumber from lineitem where l_discount <> 0 or l_tax <> 0")
def all_zero_rows(t: Tables) -> DataFrame:
    return t.lineitem.where(units.not_all_zero("l_discount", "l_tax")).select(*LINE)


@query("""select l_orderkey, l_linenumber, round(l_quantity * 9.80665 / 1000, 9) as from_mg, round(l_extendedprice * 9.80665 / (case when l_linenumber > 1 then 2048.0::double else 256.0::double end), 6) as from_adc, round(degrees(l_quantity / 1000), 9) as from_mrad, l_tax * 1000 as milligauss,
        case when l_linenumber = 1 then l_quantity / 10 else l_quantity end as tenths, l_quantity as whole, round(least(greatest((l_extendedprice - 1070) / (2000 - 1070), 0), 1), 9) as motor, round(least(greatest((l_extendedprice - 1000) / 1000, 0), 1), 9) as pulse,
        round(case when abs(l_extendedprice) > 1000 then l_extendedprice * 1e-7 else l_extendedprice end, 12) as place, case when abs(l_extendedprice * 10) > 100000 then round(l_extendedprice / 100, 6) else round(l_extendedprice * 10, 6) end as altitude from lineitem""")
def unit_conversions(t: Tables) -> DataFrame:
    price, quantity, first = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber") == 1
    return t.lineitem.select(
        *LINE, F.round(units.acceleration_from_mg(quantity), 9).alias("from_mg"), F.round(units.acceleration_from_adc(price, F.when(~first, 2048.0)), 6).alias("from_adc"), F.round(units.rate_from_mrad(quantity), 9).alias("from_mrad"),
        units.milligauss(F.col("l_tax")).alias("milligauss"), units.tenths("gyroADC[0]", quantity, first).alias("tenths"), units.tenths("axisP[0]", quantity, first).alias("whole"),
        F.round(units.motor_share(price, F.lit(1070.0), F.lit(2000.0)), 9).alias("motor"), F.round(units.pwm_share(price), 9).alias("pulse"), F.round(units.coordinate(price), 12).alias("place"), F.round(units.altitude(price * 10), 6).alias("altitude"),
    )


NATIVE = {"ATC_RAT_RLL_P": "pid.roll.p", "ATC_RAT_PIT_D": "pid.pitch.d", "INS_GYRO_FILTER": "filter.gyro_lpf", "BATT_MONITOR": None}


@query(f"""with p as (select distinct o_custkey as c, (case o_orderkey % 5 {" ".join(f"when {k} then '{n}'" for k, n in enumerate(NATIVE))} else 'pid.roll.p' end) as name from orders),
    v as (select c, name, (c % 90 + length(name))::double as value from p),
    g as (select c, case name {" ".join(f"when '{n}' then '{g}'" for n, g in NATIVE.items() if g)} end as name, value from v)
    select c as flight_id, name, value from v union all select g.c, g.name, g.value from g where g.name is not null and not exists (select 1 from v where v.c = g.c and v.name = g.name)""")
def generic_names(t: Tables) -> DataFrame:
    name = F.lit("pid.roll.p")
    for k, native in enumerate(NATIVE):
        name = F.when(F.col("o_orderkey") % 5 == k, native).otherwise(name)
    rows = t.orders.select(F.col("o_custkey").alias("flight_id"), name.alias("name")).distinct()
    return tables.mirrored(rows.withColumn("value", (F.col("flight_id") % 90 + F.length("name")).cast("double")), "ardupilot")


@query("""with a as (select l_orderkey, l_linenumber, l_quantity * 7 - 175 as roll, l_discount * 800 - 40 as pitch, (l_extendedprice::double % 360) - 180 as yaw from lineitem),
    q as (select *, cos(radians(roll) / 2) as cr, sin(radians(roll) / 2) as sr, cos(radians(pitch) / 2) as cp, sin(radians(pitch) / 2) as sp, cos(radians(yaw) / 2) as cy, sin(radians(yaw) / 2) as sy from a),
    w as (select *, cr * cp * cy + sr * sp * sy as w, sr * cp * cy - cr * sp * sy as x, cr * sp * cy + sr * cp * sy as y, cr * cp * sy - sr * sp * cy as z from q)
    select l_orderkey, l_linenumber, round(w, 9) as w, round(x, 9) as x, round(y, 9) as y, round(z, 9) as z, round(degrees(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), 6) as roll, round(degrees(asin(least(greatest(2 * (w * y - z * x), -1), 1))), 6) as pitch,
        round(cos(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))), 6) as heading from w""")
def euler_quaternions(t: Tables) -> DataFrame:
    angles = t.lineitem.select(*LINE, (F.col("l_quantity") * 7 - 175).alias("r"), (F.col("l_discount") * 800 - 40).alias("p"), (F.col("l_extendedprice").cast("double") % 360 - 180).alias("h"))
    rows = angles.select(*LINE, *(c.alias(n) for n, c in zip("wxyz", attitude.from_euler(F.col("r"), F.col("p"), F.col("h")), strict=True)))
    roll, pitch, yaw = attitude.to_euler([F.col(c) for c in "wxyz"])
    return rows.select(*LINE, *(F.round(c, 9).alias(c) for c in "wxyz"), F.round(roll, 6).alias("roll"), F.round(pitch, 6).alias("pitch"), F.round(F.cos(F.radians(yaw)), 6).alias("heading"))


@query("""with m as (select l_orderkey, l_linenumber, l_quantity + 12 as x, l_discount * 100 - 8 as y, l_tax * 100 + 5 as z, l_linenumber / 7::double as t from lineitem)
    select l_orderkey, l_linenumber, round(1.1::double * x + 0.02::double * y - 0.03::double * z + 4 * t, 6) as mx, round(0.02::double * x + 0.95::double * y + 0.01::double * z - 2 * t, 6) as my, round(-0.03::double * x + 0.01::double * y + 1.02::double * z + t, 6) as mz from m""")
def soft_iron(t: Tables) -> DataFrame:
    raw = [F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100]
    found = units.compensated(raw, (12.0, -8.0, 5.0), (1.1, 0.95, 1.02), (0.02, -0.03, 0.01), (4.0, -2.0, 1.0), F.col("l_linenumber") / 7)
    return t.lineitem.select(*LINE, *(F.round(c, 6).alias(n) for c, n in zip(found, ("mx", "my", "mz"), strict=True)))


@query("""with b as (select l_suppkey, l_orderkey, l_linenumber, case when l_suppkey % 3 > 0 then l_quantity - 20 end as c, case when l_suppkey % 3 < 2 then l_discount - 0.05 end as s from lineitem),
    m as (select *, max(abs(c)) over (partition by l_suppkey) as mc, max(coalesce(abs(s), 0)) over (partition by l_suppkey) as ms from b)
    select l_orderkey, l_linenumber, round(coalesce(case when mc > 0 then abs(c) / mc end, case when ms > 0 then coalesce(abs(s), 0) / ms end, 0), 9) as throttle from m""")
def throttle_shares(t: Tables) -> DataFrame:
    supplier = F.col("l_suppkey")
    rows = t.lineitem.select("l_suppkey", *LINE, F.when(supplier % 3 > 0, F.col("l_quantity") - 20).alias("curr"), F.when(supplier % 3 < 2, F.col("l_discount") - 0.05).alias("stick"))
    return units.throttle_share(rows, ["l_suppkey"], "curr", ["stick"]).select(*LINE, F.round("throttle", 9).alias("throttle"))


@query("""with m as (select user_id as f, event_id as idx, epoch_us(ts) / 1e6 as t from events where event_type = 'click'),
    b as (select user_id as f, epoch_us(ts) / 1e6 as t, max(value) as c from events where event_type = 'view' group by 1, 2),
    p as (select m.*, b.t as t0, b.c as c0 from m asof left join b on b.f = m.f and m.t >= b.t),
    n as (select p.*, b.t as t1, b.c as c1 from p asof left join b on b.f = p.f and p.t <= b.t),
    v as (select *, case when c0 is null then c1 when c1 is null then c0 when t1 = t0 then c0 else c0 + (c1 - c0) * (t - t0) / (t1 - t0) end as curr from n),
    w as (select *, max(abs(curr)) over (partition by f) as top from v)
    select f as flight_id, idx, round(curr, 6) as curr, round(coalesce(case when top > 0 then abs(curr) / top end, 0), 9) as throttle from w""")
def mag_current(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("flight_id"), F.col("event_id").alias("idx"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type", "value")
    mag, battery = rows.where("event_type = 'click'").select("flight_id", "idx", "t"), rows.where("event_type = 'view'").select("flight_id", "idx", "t", F.col("value").alias("curr"))
    return tables.with_current(mag, battery).select("flight_id", "idx", F.round("curr", 6).alias("curr"), F.round("throttle", 9).alias("throttle"))


NOTE_SQL = ", ".join(f"case when {v} > {c} then '{n}_critical' end, case when {v} > {w} and {v} <= {c} then '{n}_warning' end" for n, (v, (w, c)) in {n: (v, diagnosis.FIELD_LIMITS[n]) for n, v in (("offset", "o"), ("diagonal", "d"), ("off_diagonal", "od"), ("motor", "m"))}.items())


@query(f"""with p as (select p_partkey, greatest(abs(p_size * 20 - 400), abs(p_partkey % 1000)) as o, greatest(abs(0.021 * (p_size % 15)), 0) as d, greatest(abs(p_partkey % 30 / 100::double), 0.01) as od, abs(p_size - 10)::double as m from part)
    select p_partkey, array_to_string(list_filter([{NOTE_SQL}, case when p_partkey % 2 = 0 then 'coverage_short' end], lambda x: x is not null), ',') as notes from p""")
def calibration_notes(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    three = lambda *c: F.array(*(x.cast("double") for x in c))
    notes = diagnosis.field_notes(three(size * 20 - 400, key % 1000, F.lit(0)), three(F.lit(1), 1 + 0.021 * (size % 15), F.lit(1)), three(key % 30 / 100, F.lit(0.01), F.lit(0)), three(size - 10, F.lit(0), F.lit(0)), key % 2 == 1)
    return t.part.select("p_partkey", F.array_join(notes, ",").alias("notes"))


@query("""select p_partkey, case when p_retailprice % 120 < 5 then 'EXCELLENT' when p_retailprice % 120 < 15 then 'GOOD' when p_retailprice % 120 < 30 then 'ACCEPTABLE' when p_retailprice % 120 < 50 then 'MARGINAL' when p_retailprice % 120 < 100 then 'POOR' else 'BAD' end as fitness from part""")
def fitness_levels(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", bands.level_below(F.col("p_retailprice") % 120, bands.FITNESS).alias("fitness"))


@query("""select o_orderkey, least(pow(2, ceil(log2(greatest(floor(r), 64))))::bigint, n) as size from (select o_orderkey, o_totalprice::double % 4500 as r, 40 + o_orderkey % 5000 as n from orders) x""")
def window_sizes(t: Tables) -> DataFrame:
    rate, n = F.col("o_totalprice").cast("double") % 4500, (40 + F.col("o_orderkey") % 5000).cast("long")
    return t.orders.select("o_orderkey", spectral.window_column(rate, n).alias("size"))


@query("""with k as (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as k, count(*) over (partition by l_suppkey) as n from lineitem)
    select l_suppkey, l_orderkey, l_linenumber, least(n, 25) as returned, n > 25 as truncated from k where k <= 25""")
def capped_rows(t: Tables) -> DataFrame:
    return sinks.capped(t.lineitem.select("l_suppkey", *LINE), ["l_suppkey"], LINE, 25).withColumn("returned", F.col("returned").cast("long"))


@query(f"""with {CATALOG}, s as (select *, rtrim(split_part(description, '. ', 1), '.') as first from catalog)
    select pos, case when low is not null and high is not null then 1 else 0 end as bounded, case when length(first) > 30 then rtrim(first[1:27]) || '...' else first end as summary from s""")
def catalog_summaries(t: Tables) -> DataFrame:
    rows = definitions(t)
    text = params.range_text(F.col("min"), F.col("max"))
    return rows.select("pos", F.when(text.startswith("["), 1).otherwise(0).alias("bounded"), params.summary(F.col("description"), 30).alias("summary"))


@query("""with c as (select p_partkey, p_name as name, case p_size % 3 when 1 then 'v1-beta' end as fw, case when p_partkey % 2 = 0 then 'px4' else 'ardupilot' end as platform from part)
    select p_partkey, name, platform from c where platform = 'px4' and fw = 'v1-beta' union all select p_partkey, name, platform || ' default' from c where platform = 'ardupilot' and fw is null""")
def catalog_versions(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 1, "v1-beta").alias("fw_version"), F.when(F.col("p_partkey") % 2 == 0, "px4").otherwise("ardupilot").alias("platform"))
    own = params.of_version(rows, "px4", "V1 Beta").select("p_partkey", "name", "platform")
    # A version that no table has falls back to the default table.
    other = params.of_version(rows, "ardupilot", "v9").select("p_partkey", "name", F.concat("platform", F.lit(" default")).alias("platform"))
    return own.unionByName(other)


@query("""select p_partkey, array_to_string(list_filter([case when p_size > 10 then 'low-pass ' || p_size::varchar || ' Hz' end, case when p_partkey % 3 = 0 then 'notch ' || (p_size + 50)::varchar || '.0 Hz, width 40.0 Hz, 40 dB, harmonics ' || (p_partkey % 7)::varchar end], lambda x: x is not null), '; ') as chain from part""")
def filter_texts(t: Tables) -> DataFrame:
    size, key = F.col("p_size").cast("double"), F.col("p_partkey")
    notch = F.struct((size + 50).alias("center"), F.lit(40.0).alias("bandwidth"), F.lit(40.0).alias("attenuation"), (key % 7).cast("bigint").alias("harmonics"))
    notches = F.filter(F.array(F.when(key % 3 == 0, notch)), lambda n: n.isNotNull())
    return t.part.select("p_partkey", F.array_join(diagnosis.chain_text(F.when(size > 10, size), notches), "; ").alias("chain"))


@query(f"""select o_orderkey, case when o_custkey % 15 <= 4 then 'quad' when o_custkey % 15 <= 6 then 'hex' else 'octo' end as frame, (o_orderkey >> 24 & 255)::varchar || '.' || (o_orderkey >> 16 & 255)::varchar || '.' || (o_orderkey >> 8 & 255)::varchar as version,
        case when o_custkey % 30 in {tables.COPTER_TYPES} then coalesce(case o_orderkey % 30 {" ".join(f"when {k} then '{v}'" for k, v in tables.COPTER_MODES.items())} end, 'MODE' || (o_orderkey % 30)::varchar) else 'MODE' || (o_orderkey % 30)::varchar end as mode,
        case when o_orderkey & 1 = 0 then 'disarmed' when o_orderkey & 2 > 0 then 'stabilize' when o_orderkey & 4 > 0 then 'horizon' when o_orderkey & 32768 > 0 then 'failsafe' else 'acro' end as flag_mode from orders""")
def frame_and_mode_names(t: Tables) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", units.frame_kind(customer % 15).alias("frame"), units.version_text(key).alias("version"), tables.mode_name(key % 30, customer % 30).alias("mode"), tables.betaflight_mode(key).alias("flag_mode"))


@query("""with r as (select s_nationkey, s_suppkey, '| ' || s_suppkey::varchar || ' | ' || s_name || ' |' as line from supplier)
    select s_nationkey, '## Suppliers' || chr(10) || chr(10) || '| s_suppkey | s_name |' || chr(10) || '|---|---|' || chr(10) || string_agg(line, chr(10) order by s_suppkey) as report from r group by s_nationkey""")
def markdown_tables(t: Tables) -> DataFrame:
    return sinks.markdown(t.supplier.select("s_nationkey", "s_suppkey", "s_name"), ["s_nationkey"], "Suppliers", ["s_suppkey", "s_name"], "s_suppkey")


ERROR_NAMES = " ".join(f"when '{c}' then '{n}'" for c, (n, _) in errors.CODES.items())


@query(f"""with e as (select o_orderkey, case o_orderkey % 4 when 0 then 'E1004: unknown_format' when 1 then 'E5030: ' || o_orderpriority when 2 then o_comment_like else null end as text from (select *, 'no code ' || o_orderpriority as o_comment_like from orders) x),
    c as (select *, nullif(regexp_extract(text, '^(E[0-9]{{4}})', 1), '') as code from e)
    select o_orderkey, code, case code {ERROR_NAMES} end as name, case left(code, 2) {" ".join(f"when '{k}' then '{v}'" for k, v in errors.FAMILIES.items())} end as family, regexp_replace(text, '^E[0-9]{{4}}:? *', '') as message from c""")
def error_rows(t: Tables) -> DataFrame:
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    text = F.when(key % 4 == 0, "E1004: unknown_format").when(key % 4 == 1, F.concat(F.lit("E5030: "), priority)).when(key % 4 == 2, F.concat(F.lit("no code "), priority))
    rows = errors.with_errors(t.orders.select("o_orderkey", text.alias("error")))
    return rows.select("o_orderkey", "error.code", "error.name", "error.family", "error.message")


@query("""with p as (select c_custkey as flight_id, 'INS_GYRO_FILTER' as name, (c_custkey % 60)::double as value from customer where c_custkey % 4 > 0 union all select c_custkey, 'INS_HNTCH_ENABLE', (c_custkey % 2)::double from customer union all select c_custkey, 'INS_HNTCH_BW', (10 + c_custkey % 30)::double from customer where c_custkey % 3 = 0
        union all select c_custkey, 'INS_HNTCH_OPTS', case c_custkey % 5 when 0 then 16 when 1 then 1 when 2 then 17 else 4 end::double from customer)
    select flight_id, coalesce(max(value) filter (where name = 'INS_GYRO_FILTER'), 20) as cutoff, case when max(value) filter (where name = 'INS_HNTCH_ENABLE') > 0 then coalesce(max(value) filter (where name = 'INS_HNTCH_BW'), 40) else 40 end as notch_width,
        case when max(value) filter (where name = 'INS_HNTCH_ENABLE') > 0 then case max(value) filter (where name = 'INS_HNTCH_OPTS')::int when 16 then 3 when 17 then 3 when 1 then 2 else 1 end end::bigint as notches from p group by flight_id""")
def fallback_filters(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    part = lambda name, value, where="true": t.customer.where(where).select(key.alias("flight_id"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    option = F.when(key % 5 == 0, 16).when(key % 5 == 1, 1).when(key % 5 == 2, 17).otherwise(4)
    rows = part("INS_GYRO_FILTER", key % 60, "c_custkey % 4 > 0").unionByName(part("INS_HNTCH_ENABLE", key % 2)).unionByName(part("INS_HNTCH_BW", 10 + key % 30, "c_custkey % 3 = 0")).unionByName(part("INS_HNTCH_OPTS", option))
    wide = diagnosis.parameters_wide(rows, ["flight_id"], diagnosis.FILTER_PARAMS["ardupilot"])
    return diagnosis.fallback_cutoff(wide, "ardupilot").select("flight_id", "cutoff", "notch_width", F.get("notches", F.lit(0))["count"].alias("notches"))


@query("""select user_id, event_type as name, value, case when event_type in ('click', 'view') then 'pid.' || event_type else event_type end as native from events where event_id % 7 = 0""")
def native_names(t: Tables) -> DataFrame:
    """Names through a map of known size; one without an entry passes through."""
    names = t.events.where("event_type in ('click', 'view')").select(F.col("event_type").alias("name")).distinct().withColumn("native", F.concat(F.lit("pid."), "name"))
    return relational.translate(t.events.where("event_id % 7 = 0").select("user_id", F.col("event_type").alias("name"), "value"), names, "name", "native")
