"""Reports: strict JSON envelopes and Markdown tables, written by executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = ("schema_version", "tool", "command", "status", "generated_at")


def strict(column: Column, kind: T.DataType) -> Column:
    """NaN and infinities as null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(strict(column[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: strict(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, v: strict(v, kind.valueType))
    return column


def envelopes(rows: DataFrame, command: str, status: str = "ok", generated_at: str | None = None) -> DataFrame:
    """One JSON text for each row: meta fields, which a payload may not replace, then the payload. Without a time the text is reproducible."""
    payload = [strict(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in META]
    meta = [F.lit(1).alias("schema_version"), F.lit("aerolake").alias("tool"), F.lit(command).alias("command"), F.lit(status).alias("status")]
    if generated_at:
        meta.append(F.lit(generated_at).alias("generated_at"))
    return rows.select(F.to_json(F.struct(*meta, *payload)).alias("value"))


def write_json(rows: DataFrame, path: str, command: str, **meta: str) -> None:
    envelopes(rows, command, **meta).write.text(path)


def markdown(rows: DataFrame, keys: Sequence[str], title: str, columns: Sequence[str], order: str) -> DataFrame:
    """keys, report: a Markdown table of each key's rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)), F.lit(" |"))
    head = "\n".join([f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit(f"## {title}\n\n{head}\n"), body).alias("report"))


def module_report(results: dict[str, DataFrame], key: str = "flight_id", columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """key, report: one Markdown text for each flight with a section for every module that found something for it, in the order of ``results``; ``columns`` names those of a
    module that are shown (otherwise all plain ones). Sections are made module by module and meet by flight.
    """
    if not results:
        raise ValueError("there are no results to report")
    sections = None
    for place, (module, rows) in enumerate(results.items()):
        plain = [f.name for f in rows.schema.fields if f.name != key and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        shown = list((columns or {}).get(module, plain)) or [key]
        own = markdown(rows, [key], module, shown, shown[0]).select(key, F.lit(place).alias("place"), "report")
        sections = own if sections is None else sections.unionByName(own)
    held = F.array_sort(F.collect_list(F.struct("place", "report")))
    return sections.groupBy(key).agg(F.concat(F.lit("# Flight report\n\n"), F.array_join(F.transform(held, lambda x: x["report"]), "\n\n")).alias("report"))


def capped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key in order, with ``returned`` and ``truncated``; 0 keeps all."""
    from pyspark.sql import Window

    whole = Window.partitionBy(*keys)
    rows = rows.withColumns({"_k": F.row_number().over(whole.orderBy(*order)), "_n": F.count("*").over(whole)})
    kept = rows.where(F.col("_k") <= most) if most else rows
    return kept.withColumns({"returned": F.least("_n", F.lit(most)) if most else F.col("_n"), "truncated": F.lit(most > 0) & (F.col("_n") > most)}).drop("_k", "_n")
