"""Queries over lookups, layers, sets and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators import relational
from aerolake.plans.registry import Tables, query


@query("""select c.c_custkey, n.n_name, coalesce(case when r.r_regionkey < 3 then r.r_name end, n.n_regionkey::varchar) as region from customer c join nation n on n.n_nationkey = c.c_nationkey left join region r on r.r_regionkey = n.n_regionkey""")
def name_map_left(t: Tables) -> DataFrame:
    names = t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    rows = relational.translate(t.nation, names, "n_regionkey", "region")
    return t.customer.join(rows, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "region")


@query("""with l as (
        select n_name as path, n_regionkey::double as value, 0 as layer from nation
        union all select n_name, max(s_acctbal), 1 from supplier join nation on n_nationkey = s_nationkey group by n_name
        union all select n_name, max(c_acctbal), 2 from customer join nation on n_nationkey = c_nationkey group by n_name having max(c_acctbal) filter (where c_mktsegment = 'BUILDING') > 5000)
    select path, max_by(value, layer) as value, max(layer)::bigint as layer from l group by path""")
def layer_merge(t: Tables) -> DataFrame:
    nation = t.nation
    most = lambda df, key, value: df.groupBy(key).agg(F.max(value).alias("value")).join(nation, F.col(key) == F.col("n_nationkey")).select(F.col("n_name").alias("path"), "value")
    base = nation.select(F.col("n_name").alias("path"), F.col("n_regionkey").cast("double").alias("value"))
    # The third layer is sparse: nations with a rich customer of one segment.
    rich = t.customer.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("c_acctbal"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))).alias("own")).where("own > 5000")
    return relational.merge_layers([base, most(t.supplier, "s_nationkey", "s_acctbal"), most(rich, "c_nationkey", "c_acctbal")])


@query("""select d.lang, l.doc_id is not null as member, count(*) as n, sum(d.n_chars)::bigint as chars from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id group by 1, 2""")
def membership_semi_anti(t: Tables) -> DataFrame:
    rows = relational.membership(t.documents.select("doc_id", "lang", "n_chars"), t.labels, "doc_id")
    return rows.groupBy("lang", "member").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""with u as (select user_id, event_id, epoch_us(ts) as us, value, null::varchar as event_type, 0 as segment from events where event_id % 2 = 0
        union all select user_id, event_id, epoch_us(ts), value, event_type, 1 from events where event_id % 2 = 1)
    select user_id, event_id, us, value, event_type, segment::bigint as segment, row_number() over (partition by user_id order by segment, us, event_id) - 1 as idx from u""")
def segments_union(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value", "event_type")
    first, second = rows.where("event_id % 2 = 0").drop("event_type"), rows.where("event_id % 2 = 1")
    order = lambda df: df.withColumn("at", F.struct("us", "event_id"))
    return relational.concatenate_segments([order(first), order(second)], ["user_id"], "at").drop("at")


@query("""with p as (select user_id, list_sort(list_distinct(list(event_type))) as present from events group by user_id)
    select user_id, array_to_string(list_sort(list_intersect(present, ['click', 'purchase', 'view'])), ',') as both, array_to_string(list_sort(list_filter(['click', 'purchase', 'refund', 'view'], lambda x: not list_contains(present, x))), ',') as missing,
        array_to_string(list_sort(list_distinct(list_concat(present, ['refund']))), ',') as either, len(present)::bigint as kinds from p""")
def set_ops(t: Tables) -> DataFrame:
    present = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("present"))
    names = lambda *x: F.array(*map(F.lit, x))
    flat = lambda c: F.array_join(F.array_sort(c), ",")
    return present.select(
        "user_id", flat(relational.modules_to_run(names("click", "purchase", "view"), F.col("present"), F.col("present"))).alias("both"),
        flat(F.array_except(names("click", "purchase", "refund", "view"), "present")).alias("missing"), flat(F.array_union("present", names("refund"))).alias("either"), F.size("present").cast("long").alias("kinds"),
    )


@query("""select doc_id, regexp_extract(lower(text), '(error|fail|crash|watchdog|reset|token|licensed)', 1) as word, substring(text, 1, 80) as message from documents where regexp_matches(lower(text), 'error|fail|crash|watchdog|reset|token|licensed')""")
def msg_alert_scan(t: Tables) -> DataFrame:
    return relational.alerts(t.documents.select("doc_id", "text"), "text", [*relational.ALERTS, "token", "licensed"]).select("doc_id", "word", "message")


@query("""select event_type, count(*) as n, count(k) as parsed, sum(k)::bigint as total, max(k) as most, round(avg(k), 6) as mean from (select event_type, json_extract_string(props, '$.k')::bigint as k from events) x group by event_type""")
def json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("parsed"), F.sum("k").alias("total"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))


@query("""with own as (select user_id, event_type as k, max(value) as v from events where event_id % 3 > 0 group by 1, 2), late as (select user_id, event_type as k, min(value) as v from events where event_id % 3 = 0 group by 1, 2),
    u as (select coalesce(l.user_id, o.user_id) as user_id, coalesce(l.k, o.k) as k, coalesce(l.v, o.v) as v from own o full join late l on l.user_id = o.user_id and l.k = o.k)
    select user_id, count(*) as n, array_to_string(list(k || '=' || round(v, 4)::varchar order by k), ',') as entries from u group by user_id""")
def map_union(t: Tables) -> DataFrame:
    """Maps of two sources for each key, the second one's entries over the first one's."""
    entries = lambda rows, pick: rows.groupBy("user_id", "event_type").agg(pick("value").alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    own, late = entries(t.events.where("event_id % 3 > 0"), F.max), entries(t.events.where("event_id % 3 = 0"), F.min)
    both = own.withColumnRenamed("m", "a").join(late.withColumnRenamed("m", "b"), "user_id", "full").withColumn("m", relational.merged_maps(F.col("a"), F.col("b")))
    text = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 4).cast("string")))
    return both.select("user_id", F.size("m").cast("long").alias("n"), F.array_join(text, ",").alias("entries"))
