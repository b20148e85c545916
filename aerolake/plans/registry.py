"""All registered queries of the telemetry library with their DuckDB twins."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("series", "responses", "spectra", "fleet", "models", "catalog", "relational", "diagnosis", "settings", "conversions")


def query(sql: str | None = None) -> Callable:
    """Registers a function (tables) -> DataFrame by its name; ``sql`` is its twin."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


class Tables:
    """The tables of a folder by attribute, and the views of them that several queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def signals(self) -> DataFrame:
        """``events`` as a sampled signal of each user: idx in order of time, us, dt (s), channel, value."""
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        rows = self.events.select("user_id", "event_id", F.col("event_type").alias("channel"), "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
        w = Window.partitionBy("user_id").orderBy("us", "event_id")
        return rows.withColumn("idx", F.row_number().over(w).cast("long") - 1).withColumn("dt", (F.col("us") - F.lag("us").over(w)) / 1e6)


#: The twin of ``Tables.signals``.
SIGNALS = """signals as (
    select user_id, event_id, event_type as channel, value, epoch_us(ts) as us,
        row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
        (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6 as dt
    from events)"""

for _name in MODULES:
    if importlib.util.find_spec(f"aerolake.plans.{_name}"):
        importlib.import_module(f"aerolake.plans.{_name}")
