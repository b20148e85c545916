"""Queries over sampled signals: rates, quality, steps, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators import align, bands, series
from aerolake.plans.registry import SIGNALS, Tables, query

USER = ["user_id"]
#: Samples between two steps, rows before and after a step in its window, and the share of the largest amplitude that a step takes.
SPACING, BEFORE, AFTER, SHARE = 5, 5, 20, 0.3
CANDIDATES = f"""{SIGNALS},
    jumps as (select user_id, idx - 1 as step, value - lag(value) over (partition by user_id order by idx) as jump, max(abs(value)) over (partition by user_id) as largest from signals),
    candidates as (select user_id, step, jump from jumps where abs(jump) >= case when largest < 1e-9 then 0.5 else 0.3 * largest end)"""
GREEDY = f"""{CANDIDATES},
    steps as (
        select user_id, min(step) as step from candidates group by user_id
        union all
        select s.user_id, (select min(c.step) from candidates c where c.user_id = s.user_id and c.step >= s.step + {SPACING})
        from steps s where s.step is not null)"""


@query(f"with {SIGNALS} select user_id, count(*) as n_dt, round(median(dt), 6) as median_dt, round(1 / median(dt), 9) as rate_hz from signals where dt > 1e-6 group by user_id")
def sample_rate(t: Tables) -> DataFrame:
    return series.sample_rate(t.signals, USER).select("user_id", "n_dt", F.round("median_dt", 6).alias("median_dt"), F.round("rate_hz", 9).alias("rate_hz"))


@query(f"""with {SIGNALS}, gaps as (select user_id, dt from signals where dt > 0),
    middle as (select user_id, median(dt) as m, stddev_pop(dt) as s from gaps group by user_id)
    select g.user_id, count(*) as n_dt, round(m, 6) as median_dt, round(100 * s / m, 6) as jitter_pct, count(*) filter (where dt > 1.5 * m) as drops,
        round(count(*) filter (where dt > 1.5 * m) / count(*), 6) as drop_rate
    from gaps g join middle using (user_id) group by g.user_id, m, s""")
def rate_consistency(t: Tables) -> DataFrame:
    return series.rate_consistency(t.signals, USER).select("user_id", "n_dt", *(F.round(c, 6).alias(c) for c in ("median_dt", "jitter_pct")), "drops", F.round("drop_rate", 6).alias("drop_rate"))


@query("""with c as (select user_id, event_type, count(*) as n from events group by user_id, event_type)
    select user_id, max(n) as most, sum(n)::bigint as total, count(*) as channels, bool_or(event_type = 'purchase') as has_purchase, bool_or(event_type = 'error') as has_error from c group by user_id""")
def completeness(t: Tables) -> DataFrame:
    by_channel = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    has = lambda kind: F.bool_or(F.col("event_type") == kind).alias(f"has_{kind}")
    return by_channel.groupBy("user_id").agg(F.max("n").alias("most"), F.sum("n").alias("total"), F.count("*").alias("channels"), has("purchase"), has("error"))


@query(f"with {CANDIDATES} select user_id, step, round(jump, 6) as jump from candidates")
def step_candidates(t: Tables) -> DataFrame:
    return series.step_candidates(t.signals, USER).withColumn("jump", F.round("jump", 6))


@query(f"with recursive {GREEDY} select user_id, step from steps where step is not null")
def step_detect_greedy(t: Tables) -> DataFrame:
    return series.keep_spaced(series.step_candidates(t.signals, USER), USER, SPACING)


#: Penalties of the quality score; fixed values.
PENALTY = {"required": 20, "optional": 5, "very_short": 30, "short": 10, "no_steps": 25, "few_steps": 8, "drops": 8, "jitter": 5}


def score_quality(signals: DataFrame, required: list[str], optional: list[str], first: str, shortest: float = 30.0, short: float = 120.0) -> DataFrame:
    """user_id, duration, n_steps, score, rating: 100 less penalties for missing series, short logs, few steps, an uneven clock."""
    has = lambda c: F.bool_or(F.col("channel") == c)
    keys = ["user_id", "channel"]
    w = Window.partitionBy(*keys).orderBy("idx")
    gap = (F.col("us") - F.lag("us").over(w)) / 1e6
    by_channel = signals.withColumns({"pos": F.row_number().over(w).cast("long") - 1, "gap": gap})
    # One pass for all but the steps: windows and the aggregate keep the signals' partitions.
    late = F.when((F.col("channel") == first) & (F.col("gap") > 0), F.col("gap"))
    timed = by_channel.withColumn("late", late).withColumn("middle", F.median("late").over(Window.partitionBy("user_id")))
    facts = timed.groupBy("user_id").agg(
        ((F.max("us") - F.min("us")) / 1e6).alias("duration"), sum((F.when(has(c), 0).otherwise(n) for cs, n in ((required, PENALTY["required"]), (optional, PENALTY["optional"])) for c in cs), F.lit(0)).alias("missing"),
        sum((has(c).cast("int") for c in required), F.lit(0)).alias("present"), (100 * F.stddev_pop("late") / F.first("middle")).alias("jitter_pct"), (F.count_if(F.col("late") > 1.5 * F.col("middle")) / F.nullif(F.count("late"), F.lit(0))).alias("drop_rate"),
    )
    found = series.keep_spaced(series.step_candidates(by_channel.where(F.col("channel").isin(required)), keys, idx="pos", share=SHARE), keys, SPACING).groupBy(*keys).agg(F.count("*").alias("steps"))
    steps = found.groupBy("user_id").agg(F.sum("steps").alias("n_steps"), F.min("steps").alias("least"), F.count("*").alias("stepped"))
    rows = facts.join(steps, "user_id", "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0)).cast("long"))
    rows = rows.withColumn("fewest", F.when(F.col("stepped") == F.col("present"), F.col("least")).when(F.col("present") > 0, 0))
    penalty = (
        F.col("missing")
        + F.when(F.col("duration") < shortest, PENALTY["very_short"]).when(F.col("duration") < short, PENALTY["short"]).otherwise(0)
        + F.when(F.col("n_steps") < 3, PENALTY["no_steps"]).when(F.col("fewest") < 3, PENALTY["few_steps"]).otherwise(0)
        + F.when(F.col("drop_rate") > 0.05, PENALTY["drops"]).otherwise(0)
        + F.when(F.col("jitter_pct") > 20, PENALTY["jitter"]).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("long")
    return rows.select("user_id", "duration", "n_steps", score.alias("score")).withColumn("rating", bands.level_from(F.col("score").cast("double"), bands.RATINGS))


@query(f"""with recursive {SIGNALS},
    part as (
        select user_id, channel, value, us, row_number() over (partition by user_id, channel order by idx) - 1 as pos,
            (us - lag(us) over (partition by user_id, channel order by idx)) / 1e6 as gap
        from signals where channel in ('click', 'view')),
    jumps as (select user_id, channel, pos - 1 as step, value - lag(value) over (partition by user_id, channel order by pos) as jump, max(abs(value)) over (partition by user_id, channel) as largest from part),
    candidates as (select user_id, channel, step from jumps where abs(jump) >= case when largest < 1e-9 then 0.5 else 0.3 * largest end),
    spaced as (
        select user_id, channel, min(step) as step from candidates group by user_id, channel
        union all
        select s.user_id, s.channel, (select min(c.step) from candidates c where c.user_id = s.user_id and c.channel = s.channel and c.step >= s.step + {SPACING})
        from spaced s where s.step is not null),
    found as (select user_id, channel, count(*) as n from spaced where step is not null group by user_id, channel),
    steps as (select c.user_id, sum(coalesce(n, 0)) as n_steps, min(coalesce(n, 0)) as fewest from (select distinct user_id, channel from part) c left join found f on f.user_id = c.user_id and f.channel = c.channel group by c.user_id),
    middle as (select user_id, median(gap) as m, stddev_pop(gap) as s from part where channel = 'click' and gap > 0 group by user_id),
    clock as (select p.user_id, 100 * s / m as jitter, count(*) filter (where gap > 1.5 * m) / count(*) as rate from part p join middle using (user_id) where channel = 'click' and gap > 0 group by p.user_id, s, m),
    base as (
        select user_id, (max(us) - min(us)) / 1e6 as duration,
            case when bool_or(channel = 'click') then 0 else 20 end + case when bool_or(channel = 'view') then 0 else 20 end + case when bool_or(channel = 'purchase') then 0 else 5 end
            + case when bool_or(channel = 'signup') then 0 else 5 end + case when bool_or(channel = 'error') then 0 else 5 end as missing
        from signals group by user_id),
    scored as (
        select b.user_id, duration, coalesce(n_steps, 0) as n_steps,
            greatest(0, least(100, 100 - missing - case when duration < 30 then 30 when duration < 120 then 10 else 0 end
                - case when coalesce(n_steps, 0) < 3 then 25 when fewest < 3 then 8 else 0 end - case when rate > 0.05 then 8 else 0 end - case when jitter > 20 then 5 else 0 end)) as score
        from base b left join steps s on s.user_id = b.user_id left join clock c on c.user_id = b.user_id)
    select user_id, round(duration, 6) as duration, n_steps::bigint as n_steps, score::bigint as score,
        case when score >= 90 then 'EXCELLENT' when score >= 75 then 'GOOD' when score >= 55 then 'MARGINAL' else 'POOR' end as rating
    from scored""")
def quality_score(t: Tables) -> DataFrame:
    return score_quality(t.signals, ["click", "view"], ["purchase", "signup", "error"], "click").withColumn("duration", F.round("duration", 6))


@query(f"""with recursive {GREEDY}
    select s.user_id, s.step, count(*) as n, round(avg(value) filter (where idx <= s.step), 6) as before_mean, round(avg(value) filter (where idx > s.step), 6) as after_mean,
        case when count(*) < 20 then 'short' when max(abs(value)) > 2000 then 'range' when max(value) > 5 * min(abs(value)) and count(*) filter (where idx <= s.step) < 3 then 'baseline' end as rejected
    from steps s join signals x on x.user_id = s.user_id and x.idx >= s.step - {BEFORE} and x.idx < s.step + {AFTER}
    where s.step is not null group by s.user_id, s.step""")
def step_windows(t: Tables) -> DataFrame:
    signals = t.signals
    steps = series.keep_spaced(series.step_candidates(signals, USER), USER, SPACING)
    rows = series.windows_around(signals, steps, USER, BEFORE, AFTER)
    mean = lambda where: F.round(F.avg(F.when(where, F.col("value"))), 6)
    early = F.col("idx") <= F.col("step")
    reason = F.when(F.count("*") < 20, "short").when(F.max(F.abs("value")) > 2000, "range").when((F.max("value") > 5 * F.min(F.abs("value"))) & (F.count_if(early) < 3), "baseline")
    return rows.groupBy("user_id", "step").agg(F.count("*").alias("n"), mean(early).alias("before_mean"), mean(~early).alias("after_mean"), reason.alias("rejected"))


@query("""with c as (select user_id, event_id, epoch_us(ts) / 1e6 as t from events where event_type = 'click'),
    v as (select user_id, epoch_us(ts) / 1e6 as t, max(value) as value from events where event_type = 'view' group by user_id, epoch_us(ts)),
    b as (select c.user_id, c.event_id, c.t, v.t as t0, v.value as v0 from c asof left join v on v.user_id = c.user_id and c.t >= v.t),
    a as (select c.event_id, v.t as t1, v.value as v1 from c asof left join v on v.user_id = c.user_id and c.t <= v.t)
    select b.user_id, b.event_id, round(case when v0 is null then v1 when v1 is null then v0 when t1 = t0 then v0 else v0 + (v1 - v0) * (b.t - t0) / (t1 - t0) end, 4) as view_value
    from b join a on a.event_id = b.event_id""")
def asof_interp(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    clicks, views = rows.where("event_type = 'click'").select("user_id", "event_id", "t"), rows.where("event_type = 'view'").select("user_id", "t", "value")
    return align.interpolate_at(clicks, views, USER, "t", ["value"], "event_id").select("user_id", "event_id", F.round("value", 4).alias("view_value"))


@query("""with r as (select user_id, event_id, epoch_us(ts) / 1e6 as wall, case when event_type <> 'error' then event_id * 25.0 + 7 end as vehicle from events),
    o as (select user_id, median(wall - vehicle) as o from r where vehicle is not null group by user_id)
    select r.user_id, event_id, round(o, 4) as clock_offset, round(coalesce(vehicle, wall - o, wall), 4) as t from r left join o on o.user_id = r.user_id""")
def clock_offset(t: Tables) -> DataFrame:
    vehicle = F.when(F.col("event_type") != "error", F.col("event_id") * 25.0 + 7)
    rows = t.events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("wall"), vehicle.alias("vehicle"))
    return align.reconcile_clocks(rows, USER, "wall", "vehicle").select("user_id", "event_id", F.round("offset", 4).alias("clock_offset"), F.round("t", 4).alias("t"))


@query("""with s as (select conv_id, turn, (conv_id * 31 + turn * turn) % 256 as seq from conversations),
    g as (select conv_id, ((seq - (lag(seq) over (partition by conv_id order by turn) + 1)) % 256 + 256) % 256 as gap from s)
    select conv_id, count(*) as frames, coalesce(sum(gap), 0)::bigint as dropped, round(100 * coalesce(sum(gap), 0) / (count(*) + coalesce(sum(gap), 0)), 6) as drop_pct from g group by conv_id""")
def seq_gap_mod256(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.pmod(F.col("conv_id") * 31 + F.col("turn") * F.col("turn"), F.lit(256)).alias("seq"))
    return series.sequence_drops(rows, ["conv_id"], "seq", "turn").withColumn("drop_pct", F.round("drop_pct", 6))


@query(f"with {SIGNALS} select user_id, count(*) as gaps, round(max(dt), 1) as worst_gap, round(sum(round(dt, 1)), 1) as total_gap from signals where dt > 10800 group by user_id")
def link_gaps(t: Tables) -> DataFrame:
    return series.long_gaps(t.signals, USER, 10800.0)


@query(f"with {SIGNALS}, x as (select *, lag(channel) over (partition by user_id order by idx) as b from signals) select user_id, event_id, idx, channel from x where idx = 0 or channel is distinct from b")
def mode_change(t: Tables) -> DataFrame:
    return series.changes(t.signals, USER, "channel", "idx").select("user_id", "event_id", "idx", "channel")


@query(f"""with {SIGNALS}, a as (select user_id, idx, value % 360 as angle from signals),
    j as (select *, angle - lag(angle) over (partition by user_id order by idx) as d from a)
    select user_id, idx, round(angle + sum(case when d > 180 then -360 when d < -180 then 360 else 0 end) over w, 6) as unwrapped,
        round(angle + sum(case when d >= 315 then -360 when d <= -45 then 360 else 0 end) over w, 6) as biased
    from j window w as (partition by user_id order by idx rows unbounded preceding)""")
def unwrap_phase(t: Tables) -> DataFrame:
    rows = series.unwrap_degrees(t.signals.withColumn("angle", F.col("value") % 360), USER, "angle")
    return rows.select("user_id", "idx", F.round("unwrapped", 6).alias("unwrapped"), F.round("biased", 6).alias("biased"))


@query(f"""with {SIGNALS},
    x as (
        select *, count(*) filter (where abs(value) <= 150) over (partition by user_id) as n, case when abs(value) <= 150 then idx end as gi, case when abs(value) <= 150 then value end as gv from signals),
    y as (
        select *, last_value(gi ignore nulls) over b as i0, last_value(gv ignore nulls) over b as v0, first_value(gi ignore nulls) over f as i1, first_value(gv ignore nulls) over f as v1
        from x window b as (partition by user_id order by idx rows between unbounded preceding and current row), f as (partition by user_id order by idx rows between current row and unbounded following))
    select user_id, event_id, round(case when gv is not null then gv when n < 2 then 0 when v0 is null then v1 when v1 is null then v0 else v0 + (v1 - v0) * (idx - i0) / (i1 - i0) end, 6) as repaired from y""")
def sanitize_outliers(t: Tables) -> DataFrame:
    return series.repair_outliers(t.signals, USER, 150.0).select("user_id", "event_id", F.round("repaired", 6).alias("repaired"))


@query("""with p as (select user_id, event_id, event_type, case event_type when 'purchase' then 0 when 'signup' then 1 when 'view' then 2 else 3 end as p from events)
    select user_id, event_id, event_type from (select *, min(p) over (partition by user_id) as best from p) x where p = best""")
def source_priority(t: Tables) -> DataFrame:
    order = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return series.by_priority(t.events.select("user_id", "event_id", "event_type"), USER, order)


@query("""select l_suppkey, l_linenumber, count(*) as n from (select *, count(*) filter (where l_linenumber = 1) over (partition by l_suppkey) as c from lineitem) x
    where c < 85 or l_linenumber = 1 group by l_suppkey, l_linenumber""")
def primary_instance(t: Tables) -> DataFrame:
    return series.primary_instance(t.lineitem.select("l_suppkey", "l_linenumber"), ["l_suppkey"], "l_linenumber", 1, 85).groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(f"""with {SIGNALS}, n as (select user_id, count(*) as n from signals group by user_id),
    f as (select s.user_id, unnest(range(0, 1 + ((n - 16) // 8)::bigint)) as frame from (select distinct user_id from signals) s join n on n.user_id = s.user_id where n >= 16)
    select f.user_id, f.frame, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation
    from f join signals s on s.user_id = f.user_id and s.idx >= f.frame * 8 and s.idx < f.frame * 8 + 16 group by f.user_id, f.frame""")
def frames_overlap(t: Tables) -> DataFrame:
    return series.frames(t.signals, USER, 16, 8).groupBy("user_id", "frame").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"))
