"""Parameter tables: JSON documents, one for each platform and firmware version, as catalog rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "name string, display_name string, category string, `group` string, type string, `default` string, min double, max double, unit string, description string, values map<string,string>, bitmask map<string,string>, increment double, user string, reboot_required boolean, read_only boolean"
DOCUMENT = f"schema_version int, parameters array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ROW.split(', '))}>>"


def version_name(text: str) -> str:
    """A firmware version as file names spell it."""
    return text.strip().lower().translate(str.maketrans(" _", "--"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all ``<platform>.json`` and ``<platform>.<version>.json`` under ``path``, with platform, fw_version (null: the default table) and pos."""
    documents = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("_file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    rows = documents.select("_file", F.posexplode("parameters").alias("pos", "p")).select("_file", "pos", "p.*")
    stem = F.split("_file", r"\.", 2)
    members = F.coalesce(F.col("values"), F.col("bitmask"))
    return rows.select(stem[0].alias("platform"), F.try_element_at(stem, F.lit(2)).alias("fw_version"), "pos", *(c for c in rows.columns if c not in ("_file", "pos")), members.alias("members"))


def versions(catalog: DataFrame) -> DataFrame:
    return catalog.select("platform", "fw_version").distinct()


def of_version(catalog: DataFrame, platform: str, fw: str | None = None) -> DataFrame:
    """The table of a platform: that of the version if there is one, else the default."""
    own = catalog.where(F.col("platform") == platform)
    wanted = own.where(F.col("fw_version") == version_name(fw)) if fw else own.limit(0)
    return own.where("fw_version is null").join(F.broadcast(wanted.select(F.lit(1).alias("_x")).limit(1)), F.lit(True), "left_anti").unionByName(wanted) if fw else own.where("fw_version is null")


def range_text(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.format_string("[%s, %s]", low, high)).when(low.isNotNull(), F.format_string(">= %s", low)).when(high.isNotNull(), F.format_string("<= %s", high))


def summary(description: Column, longest: int = 80) -> Column:
    """First sentence, cut with an ellipsis."""
    first = F.rtrim(F.split_part(description, F.lit(". "), F.lit(1)), F.lit("."))
    return F.when(F.length(first) > longest, F.concat(F.rtrim(F.substring(first, 1, longest - 3)), F.lit("..."))).otherwise(first)
