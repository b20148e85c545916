"""Queries over filter settings that follow from peaks, and over checks of logs, catalogs and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators import attitude, catalog, diagnosis, responses, series, spectral, vibration
from aerolake.plans import spectra
from aerolake.plans.catalog import CATALOG, FOUND, definitions
from aerolake.plans.registry import SIGNALS, Tables, query

LEVELS = ("EXCELLENT", "GOOD", "MARGINAL", "POOR", "UNUSABLE")
SETTINGS = f"""{spectra.NAMED},
    loud as (select *, row_number() over (partition by vec_id order by magnitude desc, freq) as place, count(*) over (partition by vec_id) as n from named),
    base as (
        select e.vec_id, case e.label % 5 {" ".join(f"when {k} then '{v}'" for k, v in enumerate(LEVELS))} end as level, coalesce(l.n, 0) as n, l.freq as f, l.source in ('motor', 'blade') as tracked, l.source as source
        from embeddings e left join loud l on l.vec_id = e.vec_id and l.place = 1 where len(e.embedding) >= 2),
    settings as (
        select vec_id, level, n, level in ('EXCELLENT', 'GOOD') as quiet,
            case when n > 0 or level not in ('EXCELLENT', 'GOOD') then 1 else 0 end as enable,
            case when n >= 3 then 4 when n = 2 or (n = 1 and tracked) then 2 when n = 1 then 1 when level in ('EXCELLENT', 'GOOD') then 0 else 1 end as mode,
            case when n > 0 then round_even(f * 10, 0) / 10 when level in ('EXCELLENT', 'GOOD') then 0 else 80 end::double as freq,
            case when n > 0 then round_even(greatest(5, case when source = 'structural' then 0.8::double * f else f / 2 end) * 10, 0) / 10 when level in ('EXCELLENT', 'GOOD') then 0 else 40 end::double as bw,
            case when n = 0 and level in ('EXCELLENT', 'GOOD') then 0 when level in ('MARGINAL', 'POOR') or (n > 0 and level = 'UNUSABLE') then 60 else 40 end::double as att,
            case when n >= 3 then 1 else 0 end::double as ref, case when n > 0 then tracked::int when level in ('EXCELLENT', 'GOOD') then 0 else 1 end as hmc,
            case when n = 0 then 60 when level = 'MARGINAL' then 40 when level = 'POOR' then 20 when level = 'UNUSABLE' then 10 else 60 end::double as gyro_lpf, 10.0::double as accel_lpf
        from base)"""


def settings(t: Tables) -> DataFrame:
    """vec_id, level, peaks (null: none), s (the settings)."""
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("label") % 5 + 1).cast("int"))
    rows = spectra.frames(t).select("vec_id", level.alias("level")).join(spectra.named_peaks(t), "vec_id", "left")
    return rows.withColumn("s", vibration.notch_settings(F.col("peaks"), F.col("level")))


@query(f"with recursive {SETTINGS} select vec_id, level, enable, mode, freq, bw, att, ref, hmc, gyro_lpf, accel_lpf from settings")
def notch_settings(t: Tables) -> DataFrame:
    return settings(t).select("vec_id", "level", "s.*")


@query(f"""with recursive {SETTINGS}, second as (select vec_id, min_by(freq, place) as f2 from loud where place > 1 and not harmonic group by vec_id)
    select s.vec_id, enable, freq, bw, gyro_lpf, accel_lpf, case when f2 is not null then 1 end as enable2, round_even(f2 * 10, 0) / 10 as freq2, round_even(greatest(5, f2 / 2) * 10, 0) / 10 as bw2 from settings s left join second x on x.vec_id = s.vec_id""")
def static_notches(t: Tables) -> DataFrame:
    return settings(t).select("vec_id", vibration.static_notches(F.col("s"), F.col("peaks")).alias("x")).select("vec_id", "x.*")


@query(f"""with recursive {SETTINGS}, m as (select vec_id, bool_or(source in ('motor', 'blade')) as motor from named group by vec_id)
    select s.vec_id, array_to_string(list_filter([case when level in ('POOR', 'UNUSABLE') then 'ground_until_checked' end, case when mode = 2 and enable = 1 then 'throttle_reference' end, case when n >= 2 and not quiet then 'several_peaks' end], lambda x: x is not null), ',') as warnings,
        array_to_string(list_filter([case when level in ('POOR', 'UNUSABLE') then 'ground_until_checked' end, case when motor and enable = 1 then 'static_notch_motor' end, case when n >= 2 and not quiet then 'several_peaks' end], lambda x: x is not null), ',') as px4_warnings,
        case when level in ('POOR', 'UNUSABLE') then 5 else 0 end as checks from settings s left join m on m.vec_id = s.vec_id""")
def vibration_warnings(t: Tables) -> DataFrame:
    text = lambda platform: F.array_join(vibration.warnings(F.col("s"), F.col("peaks"), F.col("level"), platform), ",")
    return settings(t).select("vec_id", text("ardupilot").alias("warnings"), text("px4").alias("px4_warnings"), F.size(vibration.checks(F.col("level"))).alias("checks"))


def _native(platform: str, generic: str, name: str) -> str:
    value = "case when freq > 0 and bw > 0 then round_even(greatest(freq - bw / 2, 1) * 10, 0) / 10 else bw end" if (platform, generic) == ("betaflight", "bw") else generic
    return f"select vec_id, '{platform}' as platform, '{name}' as param, ({value})::double as value from settings"


@query(f"with recursive {SETTINGS} {' union all '.join(_native(p, g, n) for p, names in vibration.NATIVE.items() for g, n in names.items())}")
def native_settings(t: Tables) -> DataFrame:
    rows = settings(t)
    each = [F.struct(F.lit(p).alias("platform"), vibration.native(F.col("s"), p).alias("own")) for p in vibration.NATIVE]
    return rows.select("vec_id", F.explode(F.array(*each)).alias("x")).select("vec_id", "x.platform", F.explode("x.own").alias("o")).select("vec_id", "platform", "o.*")


@query(f"""with recursive {SETTINGS}, u as (
        select vec_id, 'fft' as module, 'INS_HNTCH_FREQ' as param, 0.0::double as cur, freq as suggested, 'set' as action from settings
        union all select vec_id, 'fft', 'INS_GYRO_FILTER', 0, gyro_lpf, 'set' from settings
        union all select vec_id, 'pid', 'P', 0.1, 0.085, 'adjust' from embeddings where label % 2 = 1)
    select module, param, action, count(*) as n, round(sum(cur), 6) as current, round(sum(suggested), 6) as suggested from u group by 1, 2, 3""")
def recommendation_union(t: Tables) -> DataFrame:
    own = settings(t).select("vec_id", F.explode(vibration.native(F.col("s"), "ardupilot")).alias("o")).where(F.col("o.param").isin("INS_HNTCH_FREQ", "INS_GYRO_FILTER"))
    pid = t.embeddings.where("label % 2 = 1").select("vec_id", F.lit("P").alias("param"), F.lit(0.1).alias("current"), F.lit(0.085).alias("suggested"))
    rows = vibration.all_recommendations({"fft": own.select("vec_id", "o.param", F.col("o.value").alias("suggested")), "pid": pid}, ["vec_id"])
    return rows.groupBy("module", "param", "action").agg(F.count("*").alias("n"), F.round(F.sum("current"), 6).alias("current"), F.round(F.sum("suggested"), 6).alias("suggested"))


@query(f"with {spectra.twin(False)} select vec_id, round(sqrt(avg(a * a) filter (where freq between 100 and {spectra.RATE / 2 - 10})), 6) as residual from bins group by vec_id")
def residual_noise(t: Tables) -> DataFrame:
    rows = spectra.bins(t, "linear").withColumn("magnitude", F.col("magnitude") * (F.col("size") - 1) / 4)
    return spectral.residual_noise(rows, ["vec_id"], spectra.RATE).withColumn("residual", F.round("residual", 6))


@query(f"""with {SIGNALS}, a as (select user_id, idx, value % 360 as yaw, value % 30 as pitch, value % 25 as roll from signals),
    j as (select *, yaw - lag(yaw) over (partition by user_id order by idx) as d from a),
    u as (select *, yaw + sum(case when d > 180 then -360.0 when d < -180 then 360.0 else 0.0 end) over (partition by user_id order by idx rows unbounded preceding) as u from j),
    g as (select user_id, count(*) as samples, max(u) - min(u) as yaw_range, max(pitch) - min(pitch) as pitch_range, max(roll) - min(roll) as roll_range from u group by user_id)
    select user_id, samples, round(yaw_range, 6) as yaw_range, round(pitch_range, 6) as pitch_range, round(roll_range, 6) as roll_range,
        case when samples >= 60 and yaw_range >= 450 then 'good' when samples >= 40 and yaw_range >= 300 and pitch_range >= 10 and roll_range >= 10 then 'acceptable' else 'poor' end as quality from g""")
def flight_coverage(t: Tables) -> DataFrame:
    value = F.col("value")
    rows = t.signals.select("user_id", "idx", (value % 360).alias("yaw"), (value % 30).alias("pitch"), (value % 25).alias("roll"))
    found = attitude.flight_coverage(rows, ["user_id"], {"samples": 40, "yaw": 300.0, "pitch": 10.0, "roll": 10.0, "good_samples": 60, "good_yaw": 450.0})
    return found.select("user_id", "samples", *(F.round(c, 6).alias(c) for c in ("yaw_range", "pitch_range", "roll_range")), "quality")


@query("""with d as (select l_suppkey, median(l_quantity) filter (where l_linenumber < 3) as m from lineitem group by l_suppkey)
    select s_suppkey, coalesce(m, case when s_suppkey % 2 = 0 then s_acctbal end, 0) as offset_x from supplier left join d on l_suppkey = s_suppkey""")
def current_offsets(t: Tables) -> DataFrame:
    raw = t.lineitem.where("l_linenumber < 3").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").alias("offset_x"))
    params = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("offset_x"))
    return diagnosis.current_vector(raw, params, ["s_suppkey"], ["offset_x"])


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, case when l_quantity > 40 then 'high' when l_quantity > 20 then 'medium' else 'low' end as severity from lineitem)
    select l_orderkey, l_linenumber, l_partkey, severity, row_number() over (partition by l_orderkey order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, l_linenumber, l_partkey) as place from r""")
def rules_by_severity(t: Tables) -> DataFrame:
    level = F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low")
    return diagnosis.by_severity(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", level.alias("severity")), ["l_orderkey"], "severity", "l_linenumber", "l_partkey")


@query(f"""with {CATALOG} select pos, name, type, grp as "group", category, case when low is not null and high is not null then '[' || low::varchar || ', ' || high::varchar || ']' end as range,
        case when type = 'enum' and len(keys) > 0 then len(keys) end as enum_count, case when type = 'bitmask' then len(keys) end as bit_count, case when description <> '' then substring(description, 1, 20) end as summary from catalog""")
def slim_entries(t: Tables) -> DataFrame:
    return catalog.slim(definitions(t), 20, "pos")


@query(f"""with {FOUND} select "check", severity, count(*) as n from found group by 1, 2""")
def lint_counts(t: Tables) -> DataFrame:
    return catalog.lint_counts(catalog.lint(definitions(t)))


@query("""with c as (select user_id, event_type, count(*) as n from events group by 1, 2),
    u as (select user_id, array_to_string(list_filter([case when max(n) filter (where event_type = 'click') is null then 'no_pid' end, case when min(n) filter (where event_type in ('click', 'view')) < 15 then 'pid_short' end,
        case when coalesce(max(n) filter (where event_type = 'purchase'), 0) < 15 then 'gyro_short' end], lambda x: x is not null), ',') as issues from c group by user_id) select * from u""")
def log_validation(t: Tables) -> DataFrame:
    rows = t.events.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == c).alias(c) for c in ("click", "view", "purchase")))
    issues = diagnosis.log_issues([F.col("click"), F.col("view")], F.col("click") > 0, F.col("purchase"), None, 15)
    return rows.select("user_id", F.array_join(issues, ",").alias("issues"))


@query(f"""with {SIGNALS}, p as (select user_id, idx, (value * 3) % 720 - 360 as a, value % 360 as b from signals),
    w as (select *, sum(case when idx = 0 then 0 when a > 180 then -360.0 when a < -180 then 360.0 else 0 end) over (partition by user_id order by idx rows between current row and current row) as shift from p)
    select user_id, idx, round(a + shift, 6) as first, round(b + shift, 6) as second from w""")
def phase_sync(t: Tables) -> DataFrame:
    rows = t.signals.select("user_id", "idx", ((F.col("value") * 3) % 720 - 360).alias("first"), (F.col("value") % 360).alias("second"))
    return series.wrapped_together(rows, ["user_id"], ["first", "second"]).select("user_id", "idx", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


@query("""with x as (select user_id, list(value order by ts, event_id) as v from events group by user_id)
    select user_id, least(len(v), 90)::bigint as own, round(list_sum(list_resize(v[1:90], 90, v[least(len(v), 90)])), 4) as total from x""")
def pad_last(t: Tables) -> DataFrame:
    first = t.events.withColumn("k", F.row_number().over(series.along(["user_id"], "ts", "event_id"))).where("k <= 90")
    rows = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("v"))
    padded = responses.padded(F.col("v"), 90)
    return rows.select("user_id", F.least(F.size("v"), F.lit(90)).cast("long").alias("own"), F.round(F.aggregate(padded, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""select lower(event_type) as axis, user_id, count(*) as n from events where lower(event_type) in ('click', 'view') group by 1, 2 having count(*) >= 10""")
def axis_filter(t: Tables) -> DataFrame:
    rows = series.only_axes(t.events.withColumn("axis", F.col("event_type")), ["Click", "VIEW", "absent"])
    return series.long_enough(rows, ["axis", "user_id"], 10).groupBy("axis", "user_id").agg(F.count("*").alias("n"))


@query("""with h as (select s_suppkey as user_id, s_acctbal / 20 as rate from supplier where s_acctbal > 0),
    r as (select e.user_id, e.value, coalesce(h.rate * 1.1, 400) as top from events e left join h on h.user_id = e.user_id)
    select user_id, count(*) as n, round(sum(least(greatest(value * 2 - 300, -top), top)), 4) as total from r group by user_id""")
def rate_limit(t: Tables) -> DataFrame:
    head = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("user_id"), (F.col("s_acctbal") / 20).alias("limit"))
    rows = series.rate_limited(t.events.select("user_id", (F.col("value") * 2 - 300).alias("rate")), head, ["user_id"], "rate", 400.0)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("rate"), 4).alias("total"))


@query(f"""with {SIGNALS}, w as (
        select user_id, idx // 20 as win, count(*) as n, bool_or(value is null) as holes, max(abs(value)) as top, max(abs(value * 0.4)) as asked, stddev_pop(value) as spread, avg(value) as mean from signals group by 1, 2)
    select user_id, win, case when n < 20 then 'window_too_short' when holes then 'not_finite' when top > 480 then 'extreme_value' when top > 5 * asked then 'ratio' when spread < 3 then 'flat' else 'ok' end as reason from w""")
def window_gates(t: Tables) -> DataFrame:
    rows = t.signals.withColumn("win", F.floor(F.col("idx") / 20))
    facts = rows.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.bool_or(F.col("value").isNull()).alias("holes"), F.max(F.abs("value")).alias("top"), F.max(F.abs(F.col("value") * 0.4)).alias("asked"), F.stddev_pop("value").alias("spread"))
    reason = responses.first_reason([(F.col("n") < 20, "window_too_short"), (F.col("holes"), "not_finite"), (F.col("top") > 480, "extreme_value"), (F.col("top") > 5 * F.col("asked"), "ratio"), (F.col("spread") < 3, "flat")])
    return facts.select("user_id", "win", reason.alias("reason"))


@query(f"""with {SIGNALS}, g as (select user_id, 25 * ((max(us) - min(us)) // 25) as span, min(us) as first from signals group by user_id),
    k as (select user_id, first + k * (span // 25) as us, k from g, range(26) r(k)),
    b as (select k.user_id, k.k, k.us, max(s.idx) as i from k join signals s on s.user_id = k.user_id and s.us <= k.us group by 1, 2, 3),
    v as (select b.user_id, b.k, x.value as v0, x.us as u0, y.value as v1, y.us as u1, b.us from b join signals x on x.user_id = b.user_id and x.idx = b.i left join signals y on y.user_id = b.user_id and y.idx = b.i + 1)
    select user_id, k, round(case when v1 is null or u1 = u0 then v0 else v0 + (v1 - v0) * ((us - u0)::double / (u1 - u0)) end, 4) as value from v""")
def uniform_grid(t: Tables) -> DataFrame:
    from aerolake.operators import align

    span = t.signals.groupBy("user_id").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    each = F.floor((F.col("last") - F.col("first")) / 25)
    grid = span.select("user_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda k: F.col("first") + k * each)).alias("k", "us"))
    found = align.interpolate_at(grid.withColumn("k", F.col("k").cast("long")), t.signals.select("user_id", "us", "value"), ["user_id"], "us", ["value"], "k")
    return found.select("user_id", "k", F.round("value", 4).alias("value"))


@query("""select l_suppkey, count(*) filter (where l_linestatus = 'O') as keys, count(*) filter (where l_linestatus = 'F') as differences, count(*) filter (where l_returnflag = 'R') as events from lineitem group by l_suppkey""")
def frame_counts(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "O", "I").otherwise("P")
    rows = t.lineitem.select("l_suppkey", F.explode(F.when(F.col("l_returnflag") == "R", F.array(kind, F.lit("E"))).otherwise(F.array(kind))).alias("kind"))
    return series.kind_counts(rows, ["l_suppkey"], "kind", {"I": "keys", "P": "differences", "E": "events"})

