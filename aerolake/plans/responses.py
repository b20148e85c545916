"""Queries over step responses, term statistics and their assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators import bands, responses, series
from aerolake.plans.registry import SIGNALS, Tables, query
from aerolake.plans.series import AFTER, BEFORE, GREEDY, SPACING, USER

KEYS = ["user_id", "step"]
WINDOWS = f"""{GREEDY},
    win as (
        select s.user_id, s.step, x.idx, x.value, x.idx > s.step as late,
            row_number() over (partition by s.user_id, s.step order by x.idx) - 1 as pos, count(*) over (partition by s.user_id, s.step) as n
        from steps s join signals x on x.user_id = s.user_id and x.idx >= s.step - {BEFORE} and x.idx < s.step + {AFTER} where s.step is not null)"""
MEASURED = f"""{WINDOWS},
    known as (
        select *, avg(value) filter (where pos < least(5, n // 4)) over w as base, avg(value) filter (where pos >= n - greatest(5, n // 4)) over w as final,
            abs(avg(value) filter (where late) over w - avg(value) filter (where not late) over w) as size
        from win window w as (partition by user_id, step)),
    shifted as (
        select *, least(greatest((value - base) / size, -0.5), 2.0) as norm, abs(value - (base + case when final - base >= 0 then size else -size end)) > 0.10 * size as outside,
            case when pos >= least(5, n // 4) then sign(value - final) end as side
        from known where size >= 1e-6),
    crossed as (select *, side <> lag(side) over (partition by user_id, step order by idx) as flipped from shifted),
    got as (
        select user_id, step, n, base, final, size, final - base as span, min(pos) filter (where norm >= 0.9) as p90, min(pos) filter (where norm >= 0.1) as p10, max(value) as top, min(value) as bottom,
            coalesce(max(pos) filter (where outside), -1) + 1 as settled, count(*) filter (where flipped) as crossings
        from crossed group by user_id, step, n, base, final, size),
    measured as (
        select user_id, step, n,
            coalesce(case when n >= 5 and abs(span) >= 1e-6 then ((p90 - p10) * 10)::double end, -1) as rise_time_ms,
            coalesce(case when n >= 5 and abs(span) >= 1e-6 then greatest(0, case when span >= 0 then top - final else (final - bottom) end / size * 100) end, -1) as overshoot_percent,
            coalesce(case when n >= 5 and abs(span) >= 1e-6 and settled < n then (settled * 10)::double end, -1) as settling_time_ms,
            coalesce(case when n >= 5 and abs(span) >= 1e-6 then (crossings // 2)::double end, -1) as oscillation_count,
            coalesce(case when n >= 5 and abs(span) >= 1e-6 then abs(abs(span) - size) / size * 100 end, -1) as ss_error_percent
        from got),
    mean_metrics as (
        select user_id, case user_id % 3 when 0 then 'roll' when 1 then 'pitch' else 'yaw' end as axis, count(*) as windows,
            {", ".join(f"coalesce(avg({m}) filter (where {m} >= 0), -1) as {m}" for m in responses.METRICS)}
        from measured group by user_id)"""


def measured(t: Tables) -> DataFrame:
    signals = t.signals
    steps = series.keep_spaced(series.step_candidates(signals, USER), USER, SPACING)
    return responses.window_metrics(series.windows_around(signals, steps, USER, BEFORE, AFTER), KEYS, F.col("idx") > F.col("step"))


def mean_metrics(t: Tables) -> DataFrame:
    axis = F.when(F.col("user_id") % 3 == 0, "roll").when(F.col("user_id") % 3 == 1, "pitch").otherwise("yaw")
    return responses.mean_metrics(measured(t), USER).withColumn("axis", axis)


def rounded(columns, places: int = 6) -> list[Column]:
    return [F.round(c, places).alias(c) for c in columns]


@query(f"with recursive {MEASURED} select user_id, step, n, {', '.join(f'round({m}, 4) as {m}' for m in responses.METRICS)} from measured")
def rise_settle_metrics(t: Tables) -> DataFrame:
    return measured(t).select("user_id", "step", "n", *rounded(responses.METRICS, 4))


@query(f"""with {SIGNALS},
    n as (select *, count(*) over (partition by user_id) as n from signals),
    f as (select *, avg(value) filter (where idx >= n - greatest(5, n // 4)) over (partition by user_id) as final from n),
    s as (select user_id, idx, sign(value - final) as side from f where idx >= least(5, n // 4)),
    c as (select user_id, side <> lag(side) over (partition by user_id order by idx) as flipped from s)
    select user_id, count(*) filter (where flipped) // 2 as oscillations from c group by user_id""")
def zero_crossings(t: Tables) -> DataFrame:
    whole, w = Window.partitionBy("user_id"), series.along(USER, "idx")
    rows = t.signals.withColumn("n", F.count("*").over(whole))
    rows = rows.withColumn("final", F.avg(F.when(F.col("idx") >= F.col("n") - F.greatest(F.lit(5), F.floor(F.col("n") / 4)), F.col("value"))).over(whole))
    sides = rows.where(F.col("idx") >= F.least(F.lit(5), F.floor(F.col("n") / 4))).withColumn("side", F.signum(F.col("value") - F.col("final")))
    return sides.withColumn("cross", F.col("side") != F.lag("side").over(w)).groupBy("user_id").agg(F.floor(F.count_if("cross") / 2).alias("oscillations"))


POINTS = {
    axis: " + ".join(
        f"case when {m} < 0 then 1 when {m} < {lo} then greatest(0, (2 - {abs(lo - ideal) / (hi - lo + 1e-9)}) * (1 - ({lo} - {m}) / {max(abs(lo), abs(hi), 1e-9)}))"
        f" when {m} > {hi} then greatest(0, (2 - {abs(hi - ideal) / (hi - lo + 1e-9)}) * (1 - ({m} - {hi}) / {max(abs(hi), 1e-9)})) else 2 - abs({m} - {ideal}) / {hi - lo + 1e-9} end"
        for m, (lo, hi, ideal) in zip(responses.METRICS, limits, strict=True)
    )
    for axis, limits in responses.LIMITS.items()
}


@query(f"""with recursive {MEASURED},
    scored as (select user_id, axis, windows, case axis when 'roll' then ({POINTS["roll"]}) when 'pitch' then ({POINTS["pitch"]}) else ({POINTS["yaw"]}) end / 10 as score from mean_metrics)
    select user_id, axis, windows, round(score, 6) as score, case when score >= 0.85 then 'EXCELLENT' when score >= 0.7 then 'GOOD' when score >= 0.5 then 'MARGINAL' else 'POOR' end as assessment from scored""")
def assess_metrics(t: Tables) -> DataFrame:
    rows = mean_metrics(t).withColumn("score", responses.score(F.col("axis")))
    return rows.select("user_id", "axis", "windows", F.round("score", 6).alias("score"), bands.level_from(F.col("score"), responses.CUTS).alias("assessment"))


def _case(metric: str) -> str:
    k = responses.METRICS.index(metric)
    return " ".join(f"when '{axis}' then {limits[k][1]}" for axis, limits in responses.LIMITS.items())


@query(f"""with recursive {MEASURED},
    symptoms as ({" union all ".join(f"select user_id, '{s}' as symptom, {m} as value, case axis {_case(m)} end as th from mean_metrics" for s, m in dict.fromkeys((r[0], r[1]) for r in responses.RULES))}),
    judged as (select *, case when value < 0 then null when value > 1.5 * th then 'high' when value > th then 'medium' when symptom = 'overshoot' and value > 0.8 * th then 'low' end as severity from symptoms),
    rules(symptom, gain, factor) as (values {", ".join(f"('{s}', '{g}', {f})" for s, _, g, f in responses.RULES)}),
    bounds(gain, lowest, highest) as (values {", ".join(f"('{g}', {a}, {b})" for g, (a, b) in responses.BOUNDS["ardupilot"].items())}),
    gains as (select distinct user_id, 'p' as gain, 0.05::double + (user_id % 10) * 0.05::double as cur from events union all select distinct user_id, 'i', (user_id % 7) * 0.03::double from events union all select distinct user_id, 'd', 0.002::double * (1 + user_id % 5) from events),
    made as (select j.user_id, j.symptom, severity, r.gain, cur::double as cur, round(least(greatest(cur::double * least(greatest(factor, 0.75), 1.25), lowest), highest), 6) as suggested
        from judged j join rules r on r.symptom = j.symptom join bounds b on b.gain = r.gain join gains g on g.user_id = j.user_id and g.gain = r.gain where severity is not null and cur > 0)
    select user_id, symptom, severity, gain, round(cur, 6) as current_value, suggested, round((suggested - cur) / cur * 100, 4) as change_percent from made""")
def pid_recommend(t: Tables) -> DataFrame:
    user = F.col("user_id")
    each = {"p": 0.05 + (user % 10) * 0.05, "i": (user % 7) * 0.03, "d": 0.002 * (1 + user % 5)}
    gains = t.events.select("user_id").distinct().select("user_id", F.explode(F.array(*(F.struct(F.lit(g).alias("gain"), c.alias("current")) for g, c in each.items()))).alias("g")).select("user_id", "g.*")
    rows = responses.recommend(responses.symptoms(mean_metrics(t), USER), gains, USER)
    return rows.select("user_id", "symptom", "severity", "gain", F.round("current", 6).alias("current_value"), "suggested", F.round("change_percent", 4).alias("change_percent"))


@query("""with v as (select l_suppkey, sqrt(var_pop(l_quantity) + var_pop(l_discount * 100) + var_pop(l_tax * 100)) as rms from lineitem group by l_suppkey)
    select l_suppkey, round(rms, 6) as rms, case when rms < 15 then 'EXCELLENT' when rms < 30 then 'GOOD' when rms < 60 then 'MARGINAL' when rms < 100 then 'POOR' else 'UNUSABLE' end as level from v""")
def rms_vibration(t: Tables) -> DataFrame:
    rms = F.sqrt(F.var_pop("l_quantity") + F.var_pop(F.col("l_discount") * 100) + F.var_pop(F.col("l_tax") * 100))
    rows = t.lineitem.groupBy("l_suppkey").agg(rms.alias("rms"))
    return rows.select("l_suppkey", F.round("rms", 6).alias("rms"), bands.level_below(F.col("rms"), bands.VIBRATION["ardupilot"]).alias("level"))


@query("""with x as (select l_suppkey, abs(l_extendedprice / 10000) as ff, abs(l_quantity) as p, abs(l_discount) as i, abs(l_tax) as d from lineitem)
    select l_suppkey, round(100 * avg(ff / (ff + p + i + d)) filter (where ff + p + i + d > 1e-6), 6) as ff_percent, round(sqrt(avg(p * p)), 6) as p_rms, round(sqrt(avg(d * d)) / sqrt(avg(p * p)), 9) as d_p_ratio from x group by l_suppkey""")
def ff_ratio_masked(t: Tables) -> DataFrame:
    ff, p, i, d = F.abs(F.col("l_extendedprice") / 10000), F.abs("l_quantity"), F.abs("l_discount"), F.abs("l_tax")
    total = ff + p + i + d
    rms = lambda x: F.sqrt(F.avg(x * x))
    return t.lineitem.groupBy("l_suppkey").agg(F.round(100 * F.avg(F.when(total > 1e-6, ff / total)), 6).alias("ff_percent"), F.round(rms(p), 6).alias("p_rms"), F.round(rms(d) / rms(p), 9).alias("d_p_ratio"))


@query("""with m as (select user_id, median(abs(value)) as m from events group by user_id)
    select e.user_id, count(*) as n, round(100.0 * count(*) filter (where abs(value) < 0.6 * m) / count(*), 6) as active_percent from events e join m on m.user_id = e.user_id group by e.user_id""")
def dmin_active(t: Tables) -> DataFrame:
    middle = t.events.groupBy("user_id").agg(F.median(F.abs("value")).alias("m"))
    return t.events.join(middle, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.round(100 * F.count_if(F.abs("value") < 0.6 * F.col("m")) / F.count("*"), 6).alias("active_percent"))


@query("""select o_custkey, count(*) as n, min(o_totalprice) as lowest, max(o_totalprice) as highest, round(avg(o_totalprice), 6) as mean, max_by(o_totalprice, (epoch_us(o_orderdate), o_orderkey)) as last from orders group by o_custkey""")
def battery_stats(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min(price).alias("lowest"), F.max(price).alias("highest"), F.round(F.avg(price), 6).alias("mean"), F.max_by(price, F.struct("o_orderdate", "o_orderkey")).alias("last"))


@query("""with a as (select user_id, event_type, avg(value) as m from events group by user_id, event_type),
    r as (select user_id, case when m < 30 then 4 when m < 80 then 3 when m < 120 then 2 when m < 200 then 1 else 0 end as r from a)
    select user_id, case min(r) when 4 then 'EXCELLENT' when 3 then 'GOOD' when 2 then 'MARGINAL' when 1 then 'POOR' else 'UNUSABLE' end as worst from r group by user_id""")
def worst_assessment(t: Tables) -> DataFrame:
    levels = [(30.0, "EXCELLENT"), (80.0, "GOOD"), (120.0, "MARGINAL"), (200.0, "POOR"), (float("inf"), "UNUSABLE")]
    rows = t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("m")).withColumn("level", bands.level_below(F.col("m"), levels))
    return rows.groupBy("user_id").agg(F.min_by("level", bands.rank_of(F.col("level"))).alias("worst"))


@query(f"""with recursive {WINDOWS},
    a as (select *, avg(value) filter (where late) over w - avg(value) filter (where not late) over w as amp, avg(value) filter (where not late) over w as base from win window w as (partition by user_id, step))
    select user_id, pos, count(*) as n, round(avg(least(greatest((value - base) / amp, -0.5), 2)), 6) as response from a where abs(amp) >= 5 and n = {BEFORE + AFTER} group by user_id, pos""")
def step_response_mean(t: Tables) -> DataFrame:
    signals = t.signals
    steps = series.keep_spaced(series.step_candidates(signals, USER), USER, SPACING)
    whole = Window.partitionBy(*KEYS)
    rows = series.windows_around(signals, steps, USER, BEFORE, AFTER).withColumns({"pos": F.row_number().over(series.along(KEYS, "idx")).cast("long") - 1, "n": F.count("*").over(whole)})
    late = F.col("idx") > F.col("step")
    mean = lambda where: F.avg(F.when(where, F.col("value"))).over(whole)
    rows = rows.withColumns({"base": mean(~late), "amp": mean(late) - mean(~late)}).where(f"abs(amp) >= 5 and n = {BEFORE + AFTER}")
    response = F.least(F.greatest((F.col("value") - F.col("base")) / F.col("amp"), F.lit(-0.5)), F.lit(2.0))
    return rows.groupBy("user_id", "pos").agg(F.count("*").alias("n"), F.round(F.avg(response), 6).alias("response"))
