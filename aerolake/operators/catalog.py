"""Parameter catalogs: search, listing, validation, folding of numbered clones, lint.

A catalog has a row for each parameter: name, display_name, category, group, type (float, int, enum, bitmask), default, min, max,
description, members (map of enum keys or bit numbers to labels), pos (order of the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERED = r"^([A-Z]+)[0-9]+_"
PLACEHOLDER = "@[A-Z_]+@"
NAME_SHAPE = "^[A-Za-z0-9][A-Za-z0-9_]*$"
#: Of catalogs whose names are in capitals; a leading digit is a check of its own.
CAPITALS = r"^([A-Z][A-Z0-9_]*|[0-9][A-Za-z0-9_]*)\z"


def lookup(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.where(F.upper("name") == name.upper())


def search_rank(keyword: str) -> Column:
    """0 exact name, 1 prefix, 2 part of the name, 3 display name, 4 category or group, 5 description, 6 a member's label; null: no match."""
    key = F.lit(keyword.lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), key), F.lit(False))
    name = F.lower("name")
    labels = F.exists(F.map_values(F.coalesce("members", F.create_map().cast("map<string,string>"))), lambda v: F.contains(F.lower(v), key))
    rank = F.when(name == key, 0).when(F.startswith(name, key), 1).when(has("name"), 2).when(has("display_name"), 3)
    rank = rank.when(has("category") | has("group"), 4).when(has("description"), 5).when(labels, 6)
    return F.when(F.lit(bool(keyword)), rank)


def search(catalog: DataFrame, keyword: str, limit: int = 0) -> DataFrame:
    """Matches in order of rank and name; ``limit`` 0 returns all."""
    found = catalog.withColumn("rank", search_rank(keyword)).where("rank is not null")
    return found.orderBy("rank", "name").limit(limit) if limit else found


def groups(catalog: DataFrame) -> DataFrame:
    """group, n, category (of its first parameter), samples (its first three names)."""
    first_three = F.slice(F.array_sort(F.collect_list(F.when(F.col("_k") <= 3, F.struct("pos", "name")))), 1, 3)
    rows = catalog.withColumn("_k", F.row_number().over(Window.partitionBy("group").orderBy("pos")))
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.min_by("category", "pos").alias("category"), F.transform(first_three, lambda s: s["name"]).alias("samples"))


def categories(catalog: DataFrame, *keys: str) -> DataFrame:
    """keys, categories: the distinct categories, in order."""
    return catalog.groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def lookup_all(catalog: DataFrame, asked: DataFrame, name: str) -> DataFrame:
    """Definitions of all asked names, whatever their case, by one join; names asked twice count once, unknown ones not at all."""
    wanted = asked.select(F.upper(F.trim(name)).alias("_asked")).distinct()
    return catalog.join(wanted, F.upper("name") == F.col("_asked")).drop("_asked")


def in_group(catalog: DataFrame, group: str) -> DataFrame:
    """Parameters of a group, its trailing underscore optional; only if there is none, those whose name begins with it."""
    wanted = group.upper().rstrip("_")
    exact = F.rtrim(F.upper("group"), F.lit("_")) == wanted
    prefix = F.startswith(F.upper("name"), F.lit(wanted + "_"))
    matched = catalog.where(exact | prefix)
    any_exact = catalog.where(exact).agg((F.count("*") > 0).alias("_any"))
    return matched.crossJoin(F.broadcast(any_exact)).where(exact | ~F.col("_any")).drop("_any")


def verdict(value: Column) -> Column:
    """Fail-closed check of a value against the catalog columns of its row (null name: no such parameter)."""
    whole = value == F.floor(value)
    member = F.coalesce(F.map_contains_key("members", value.cast("long").cast("string")), F.lit(False))
    listed = F.coalesce(F.size(F.map_keys("members")), F.lit(0)) > 0
    bits = F.aggregate(F.coalesce(F.map_keys("members"), F.array().cast("array<string>")), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))))
    stray = (value < 0) | (value.cast("long").bitwiseAND(F.bitwise_not(bits)) != 0)
    kind = F.col("type")
    return (
        F.when(F.col("name").isNull(), "not_found")
        .when(value.isNull(), "invalid_input")
        .when(kind.isin("enum", "bitmask") & listed & ~whole, "not_an_integer")
        .when((kind == "enum") & listed & ~member, "not_a_member")
        .when((kind == "bitmask") & listed & stray, "out_of_range")
        .when(kind.isin("enum", "bitmask") & listed, "ok")
        .when((value < F.col("min")) | (value > F.col("max")), "out_of_range")
        .when(kind.isin("enum", "bitmask"), "unverifiable")
        .otherwise("ok")
    )


def validate(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """``entries`` (entry, value) with the parameter they name, whatever its case, and ``status``."""
    known = catalog.select("name", "type", "min", "max", "members", F.upper("name").alias("_key"))
    rows = entries.withColumn("_key", F.upper("entry")).join(known, "_key", "left").drop("_key")
    return rows.withColumn("status", verdict(F.col("value"))).withColumn("valid", F.col("status") == "ok")


def fold_numbered(names: DataFrame) -> DataFrame:
    """``names`` (name, pos) with numbered clones of an existing base folded into it: name, pos, instances (null if alone)."""
    rows = names.withColumn("_base", F.regexp_replace("name", NUMBERED, "$1_"))
    bases = names.select(F.col("name").alias("_base"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(bases, "_base", "left").withColumn("_to", F.when(F.col("_known"), F.col("_base")).otherwise(F.col("name")))
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"])
    out = rows.groupBy("_to").agg(F.min("pos").alias("pos"), held.alias("instances"))
    return out.select(F.col("_to").alias("name"), "pos", F.when(F.size("instances") > 1, F.col("instances")).alias("instances"))


def lint(catalog: DataFrame, many: int = 20, shape: str = NAME_SHAPE) -> DataFrame:
    """name, check, severity: a row for each finding; table-wide findings have an empty name. ``shape``: what names look like (``CAPITALS``: no lower case)."""
    finding = lambda df, check, severity: df.select("name", F.lit(check).alias("check"), F.lit(severity).alias("severity"))
    empty = F.coalesce(F.trim("description"), F.lit("")) == ""
    members = F.coalesce(F.map_keys("members"), F.array().cast("array<string>"))
    digit = F.col("name").rlike("^[0-9]")
    by_row = [
        (~F.col("name").rlike(shape), "name_shape", "error"),
        (digit, "digit_leading_name", "warn"),
        (F.col("description").rlike(PLACEHOLDER), "placeholder_leak", "error"),
        (empty, "empty_description", "warn"),
        (F.col("type").isin("enum", "bitmask") & (F.size(members) == 0), "discrete_without_members", "warn"),
        (F.col("min") > F.col("max"), "range_inverted", "error"),
        ((F.col("type") == "enum") & F.exists(members, lambda k: ~k.rlike("^-?[0-9]+$")), "enum_key_not_int", "error"),
    ]
    each = F.filter(F.array(*(F.when(found, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"))) for found, check, severity in by_row)), lambda x: x.isNotNull())
    rows = catalog.select("name", F.explode(each).alias("f")).select("name", "f.check", "f.severity")
    whole = catalog.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("default", F.lit("<none>"))).alias("defaults"), F.count_if(empty).alias("empty")).withColumn("name", F.lit(""))
    mostly_empty = whole.where(2 * F.col("empty") > F.col("n"))
    # Where most descriptions are empty, one finding for the table stands for those of its rows.
    rows = rows.join(F.broadcast(mostly_empty.select(F.lit("empty_description").alias("check"))), "check", "left_anti").select("name", "check", "severity")
    repeated = catalog.withColumn("_k", F.row_number().over(Window.partitionBy(F.upper("name")).orderBy("pos"))).where("_k > 1")
    parts = catalog.select(F.split("name", "_").alias("p")).where(F.size("p") > 1)
    suffixes = parts.select(F.explode(F.transform(F.sequence(F.lit(2), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "_"))).alias("name")).distinct()
    found = [
        finding(repeated, "duplicate_name", "error"),
        finding(whole.where((F.col("n") > many) & (F.col("defaults") == 1)), "constant_default", "error"),
        finding(catalog.join(suffixes, "name", "left_semi"), "suffix_collision", "warn"),
        finding(mostly_empty, "empty_description", "warn"),
    ]
    for f in found:
        rows = rows.unionByName(f)
    return rows


def lint_counts(findings: DataFrame) -> DataFrame:
    """check, severity, n."""
    return findings.groupBy("check", "severity").agg(F.count("*").alias("n"))


def slim(catalog: DataFrame, summary_chars: int = 120, *keep: str) -> DataFrame:
    """What a listing shows of each parameter: name, type, group, category, range, counts of members or bits in place of them, the beginning of its description. Empty: null."""
    size = lambda kind: F.when((F.col("type") == kind) & (F.size("members") > 0), F.size("members").cast("long"))
    both = F.col("min").isNotNull() & F.col("max").isNotNull()
    return catalog.select(
        *keep, "name", "type", F.nullif("group", F.lit("")).alias("group"), "category",
        F.when(both, F.concat(F.lit("["), F.col("min").cast("string"), F.lit(", "), F.col("max").cast("string"), F.lit("]"))).alias("range"),
        size("enum").alias("enum_count"), size("bitmask").alias("bit_count"), F.nullif(F.substring("description", 1, summary_chars), F.lit("")).alias("summary"),
    )


def full(catalog: DataFrame) -> DataFrame:
    """name, definition: all that is known of a parameter as JSON, empty fields left out."""
    return catalog.select("name", F.to_json(F.struct(*(c for c in catalog.columns if c != "pos")), {"ignoreNullFields": "true"}).alias("definition"))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit in order, with ``total`` and ``next_offset`` (null on the last page)."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset(offset).limit(limit)
    return cut.crossJoin(F.broadcast(total)).withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit).cast("long")))


def listing(catalog: DataFrame, group: str | None = None, category: str | None = None) -> DataFrame:
    """Slim entries of a group or a category; a whole catalog is never listed."""
    if group is None and category is None:
        raise ValueError(f"name a group or a category: there are {catalog.select('group').distinct().count()} groups")
    found = catalog if group is None else in_group(catalog, group)
    return slim(found if category is None else found.where(F.lower("category") == category.lower()))
