"""Queries over a parameter catalog, which the part table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolake.operators import catalog
from aerolake.plans.registry import Tables, query

CATALOG = """catalog as (
    select p_partkey as pos,
        case when p_partkey % 50 = 7 then 'lower_' || replace(p_name, ' ', '_') when p_partkey % 50 = 8 then p_partkey::varchar || '_LED' when p_partkey % 50 = 9 then 'WIDGET_' || (p_partkey - 1)::varchar
            else upper(replace(p_name, ' ', '_')) || '_' || p_partkey::varchar end as name,
        p_name as display_name, p_type as category, p_brand as grp, case p_partkey % 4 when 0 then 'float' when 2 then 'bitmask' else 'enum' end as type,
        p_size::varchar as preset, case when p_partkey % 97 = 3 then 60.0::double else 0.0::double end as low, p_size::double as high,
        case when p_partkey % 11 = 0 then '' when p_partkey % 53 = 0 then 'see @NAME@' else 'Sets ' || p_name || ' of ' || p_brand end as description,
        case p_partkey % 4 when 1 then ['0', '4', '9'] when 2 then ['0', '1', '3'] else []::varchar[] end as keys,
        case p_partkey % 4 when 1 then ['off', 'on', 'auto ' || lower(p_type)] when 2 then ['first', 'second', 'fourth'] else []::varchar[] end as labels
    from part)"""


def definitions(t: Tables) -> DataFrame:
    key, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = (
        F.when(key % 50 == 7, F.concat(F.lit("lower_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
        .when(key % 50 == 8, F.concat(text, F.lit("_LED")))
        .when(key % 50 == 9, F.concat(F.lit("WIDGET_"), (key - 1).cast("string")))
        .otherwise(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), text))
    )
    named = lambda keys, labels: F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*labels))
    members = F.when(key % 4 == 1, named("049", [F.lit("off"), F.lit("on"), F.concat(F.lit("auto "), F.lower("p_type"))])).when(key % 4 == 2, named("013", map(F.lit, ("first", "second", "fourth"))))
    description = F.when(key % 11 == 0, "").when(key % 53 == 0, "see @NAME@").otherwise(F.concat(F.lit("Sets "), F.col("p_name"), F.lit(" of "), F.col("p_brand")))
    return t.part.select(
        key.alias("pos"), name.alias("name"), F.col("p_name").alias("display_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("group"),
        F.when(key % 4 == 0, "float").when(key % 4 == 2, "bitmask").otherwise("enum").alias("type"), F.col("p_size").cast("string").alias("default"),
        F.when(key % 97 == 3, 60.0).otherwise(0.0).alias("min"), F.col("p_size").cast("double").alias("max"), description.alias("description"), members.alias("members"),
    )


@query(f"""with {CATALOG},
    r as (
        select pos, name, case when lower(name) = 'cold' then 0 when starts_with(lower(name), 'cold') then 1 when contains(lower(name), 'cold') then 2 when contains(lower(display_name), 'cold') then 3
            when contains(lower(category), 'cold') or contains(lower(grp), 'cold') then 4 when contains(lower(description), 'cold') then 5 when list_bool_or(list_transform(labels, lambda l: contains(lower(l), 'cold'))) then 6 end as rank from catalog)
    select pos, name, rank from r where rank is not null""")
def param_search_ranked(t: Tables) -> DataFrame:
    return catalog.search(definitions(t), "cold").select("pos", "name", "rank")


@query(f"""with {CATALOG}, k as (select *, row_number() over (partition by grp order by pos) as k from catalog)
    select grp as "group", count(*) as n, min_by(category, pos) as category, string_agg(name, ',' order by pos) filter (where k <= 3) as samples from k group by grp""")
def param_groups(t: Tables) -> DataFrame:
    return catalog.groups(definitions(t)).withColumn("samples", F.array_join("samples", ","))


@query(f"""with {CATALOG} select grp as "group", array_to_string(list_sort(list_distinct(list(category))), ',') as categories, count(distinct category) as n from catalog group by grp""")
def param_categories(t: Tables) -> DataFrame:
    found = catalog.categories(definitions(t), "group")
    return found.select("group", F.array_join("categories", ",").alias("categories"), F.size("categories").cast("long").alias("n"))


@query(f"""with {CATALOG} select pos, name, type, preset as "default" from catalog where upper(name) in (select upper(replace(p_name, ' ', '_')) || '_' || p_partkey::varchar from part where p_partkey % 3 = 0)""")
def param_lookup(t: Tables) -> DataFrame:
    asked = t.part.where("p_partkey % 3 = 0").select(F.lower(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))).alias("asked"))
    return catalog.lookup_all(definitions(t), asked, "asked").select("pos", "name", "type", "default")


@query(f"""with {CATALOG} select pos, name, 'exact' as asked from catalog where rtrim(upper(grp), '_') = 'BRAND#13'
    union all select pos, name, 'prefix' from catalog where starts_with(upper(name), 'COLD_') and not exists (select 1 from catalog where rtrim(upper(grp), '_') = 'COLD')""")
def param_by_group(t: Tables) -> DataFrame:
    part = lambda g, asked: catalog.in_group(definitions(t), g).select("pos", "name", F.lit(asked).alias("asked"))
    return part("Brand#13_", "exact").unionByName(part("cold", "prefix"))


@query(f"""with {CATALOG},
    e as (
        select l_orderkey, l_linenumber, c0.name || case when l_linenumber = 7 then '_GONE' else '' end as entry, case when l_linenumber = 6 then null when l_linenumber = 5 then l_quantity + 0.5 else l_quantity - 2 end as value
        from lineitem join catalog c0 on c0.pos = l_partkey),
    names as (select upper(name) as key, name, type, low, high, keys from catalog),
    v as (
        select l_orderkey, l_linenumber, e.entry, value,
            case when name is null then 'not_found' when value is null then 'invalid_input' when type in ('enum', 'bitmask') and len(keys) > 0 and value <> floor(value) then 'not_an_integer'
                when type = 'enum' and len(keys) > 0 and not list_contains(keys, value::bigint::varchar) then 'not_a_member'
                when type = 'bitmask' and len(keys) > 0 and (value < 0 or (value::bigint & ~(11::bigint)) <> 0) then 'out_of_range' when type in ('enum', 'bitmask') and len(keys) > 0 then 'ok'
                when value < low or value > high then 'out_of_range' when type in ('enum', 'bitmask') then 'unverifiable' else 'ok' end as status
        from e left join names on names.key = upper(e.entry))
    select status, count(*) as n, count(*) filter (where status = 'ok') as valid, bool_and(status = 'ok') as all_valid, sum(l_orderkey * 7 + l_linenumber)::bigint as checksum from v group by status""")
def param_validate(t: Tables) -> DataFrame:
    known = definitions(t)
    line = F.col("l_linenumber")
    entries = t.lineitem.join(known.select(F.col("pos").alias("l_partkey"), F.col("name").alias("_n")), "l_partkey")
    value = F.when(line == 6, None).when(line == 5, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity") - 2)
    entries = entries.select("l_orderkey", "l_linenumber", F.concat("_n", F.when(line == 7, "_GONE").otherwise("")).alias("entry"), value.alias("value"))
    rows = catalog.validate(entries, known)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.bool_and("valid").alias("all_valid"), F.sum(F.col("l_orderkey") * 7 + line).alias("checksum"))


@query("""with n as (select upper(p_type) || case when p_size = 1 then '' else p_size::varchar end || '_' || upper(split_part(p_name, ' ', 1)) as name, min(p_partkey) as pos from part group by 1),
    b as (select *, regexp_replace(name, '^([A-Z]+)[0-9]+_', '\\1_') as base from n),
    f as (select case when exists (select 1 from n where n.name = b.base) then base else name end as name, pos, name as own from b)
    select name, min(pos) as pos, case when count(*) > 1 then string_agg(own, ',' order by pos, own) end as instances from f group by name""")
def param_collapse(t: Tables) -> DataFrame:
    number = F.when(F.col("p_size") == 1, "").otherwise(F.col("p_size").cast("string"))
    name = F.concat(F.upper("p_type"), number, F.lit("_"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))
    names = t.part.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("pos"))
    return catalog.fold_numbered(names).withColumn("instances", F.array_join("instances", ","))


FOUND = f"""{CATALOG}, tbl as (select count(*) as n, count(distinct coalesce(preset, '<none>')) as d, count(*) filter (where trim(coalesce(description, '')) = '') as e from catalog),
    parts as (select string_split(name, '_') as p from catalog), suf as (select distinct array_to_string(p[i:], '_') as name from (select p, unnest(range(2, len(p) + 1)) as i from parts) x),
    found as (
        select name, 'duplicate_name' as "check", 'error' as severity from (select name, row_number() over (partition by upper(name) order by pos) as k from catalog) x where k > 1
        union all select '', 'constant_default', 'error' from tbl where n > 20 and d = 1
        union all select name, 'name_shape', 'error' from catalog where not regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9_]*$')
        union all select name, 'digit_leading_name', 'warn' from catalog where regexp_matches(name, '^[0-9]')
        union all select name, 'suffix_collision', 'warn' from catalog where name in (select name from suf)
        union all select name, 'placeholder_leak', 'error' from catalog where regexp_matches(description, '@[A-Z_]+@')
        union all select '', 'empty_description', 'warn' from tbl where 2 * e > n
        union all select name, 'empty_description', 'warn' from catalog, tbl where trim(coalesce(description, '')) = '' and not (2 * e > n)
        union all select name, 'discrete_without_members', 'warn' from catalog where type in ('enum', 'bitmask') and len(keys) = 0
        union all select name, 'range_inverted', 'error' from catalog where low > high)"""


@query(f"""with {FOUND}
    select * from found union all select name, 'name_shape', 'error' from catalog where regexp_matches(name, '^[A-Za-z][A-Za-z0-9_]*$') and not regexp_matches(name, '^[A-Z][A-Z0-9_]*$')""")
def param_lint(t: Tables) -> DataFrame:
    """The catalog's names are in capitals, so those in lower case are findings too."""
    return catalog.lint(definitions(t), shape=catalog.CAPITALS)


@query("""select p_partkey, p_name, (select count(*) from part) as total, case when (select count(*) from part) > 150 then 150::bigint end as next_offset from part order by p_name, p_partkey limit 50 offset 100""")
def page_offset(t: Tables) -> DataFrame:
    return catalog.page(t.part.select("p_partkey", "p_name"), ["p_name", "p_partkey"], 100, 50)
