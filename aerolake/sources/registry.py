"""Adapters of log formats, one folder of many formats in one pass, and the tables and analyses of each platform in it.

An ``Adapter`` names a format, tells its files by name and head, decodes a file's bytes to message rows, and makes the tables of a fleet from such rows.
``register`` adds one of a third party; the first that recognises a file decodes it. All adapters give the rows of ``flightlog.SCHEMA``, so
files of all formats come out of one scan, split by ``adapter`` only afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerolake import api
from aerolake.sources import blackbox, detect, files, flightlog

HEAD_BYTES = 1024


@dataclass(frozen=True)
class Adapter:
    """``matches`` (path, head) -> whether a file is of this format; ``decode`` (bytes) -> rows of ``flightlog.SCHEMA`` without path and idx; ``flights`` (messages) ->
    the tables of a fleet. ``capabilities``: the modules that logs of it support.
    """

    name: str
    platform: str
    extensions: tuple[str, ...]
    matches: Callable[[str, bytes], bool]
    decode: Callable[[bytes], Iterator[tuple]]
    flights: Callable[[DataFrame], api.Flights]
    capabilities: tuple[str, ...] = field(default=())


def ends(path: str, *extensions: str) -> bool:
    return path.lower().rpartition(".")[2] in extensions


def is_telemetry(path: str, head: bytes) -> bool:
    return ends(path, "tlog") and len(head) > 8 and head[8] in (0xFE, 0xFD) and detect.EARLIEST_US <= int.from_bytes(head[:8], "big") <= detect.LATEST_US


def blackbox_messages(data: bytes) -> Iterator[tuple]:
    """Frames and headers of a blackbox log as messages: the kind of frame is their type, the segment their instance, a header's properties its text."""
    for segment, properties in blackbox.rows_of(data, True):
        yield "header", segment, None, None, None, None, None, {}, json.dumps(properties)
    for segment, idx, time_us, kind, values, corrupt in blackbox.rows_of(data, False):
        yield kind, segment, time_us, None, None, None, None, {**{k: float(v) for k, v in values.items()}, "_idx": float(idx), "_corrupt": float(corrupt)}, None


def blackbox_flights(messages: DataFrame) -> api.Flights:
    rows = messages.where("mtype <> 'header'").select("path", F.col("instance").alias("segment"), F.try_element_at("fields", F.lit("_idx")).cast("long").alias("idx"), "time_us", F.col("mtype").alias("kind"), F.col("fields").alias("values"))
    heads = messages.where("mtype = 'header'").select("path", F.col("instance").alias("segment"), F.from_json("text", "map<string,string>").alias("properties"))
    return api.Flights.from_blackbox(rows, heads)


def of_kind(kind: str) -> Callable[[DataFrame], api.Flights]:
    return lambda messages: api.Flights.from_messages(messages, kind)


_ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    """From now on files that ``adapter`` recognises, and none registered before it does, are its own; one of the same name is replaced in its place."""
    if not adapter.name or not adapter.extensions:
        raise ValueError("an adapter needs a name and extensions")
    _ADAPTERS[adapter.name] = adapter
    return adapter


def unregister(name: str) -> None:
    _ADAPTERS.pop(name, None)


def adapters() -> tuple[Adapter, ...]:
    return tuple(_ADAPTERS.values())


def adapter(name: str) -> Adapter:
    """The adapter of a name, whatever its case."""
    found = {a.name.lower(): a for a in adapters()}.get(name.strip().lower())
    if found is None:
        raise api.AnalysisError(files.ERRORS["unknown_format"], f"{name!r} is no adapter", f"known are {', '.join(a.name for a in adapters())}")
    return found


def listing(spark: SparkSession) -> DataFrame:
    """name, platform, extensions, capabilities of every adapter, in their order."""
    rows = [(k, a.name, a.platform, ", ".join(a.extensions), ", ".join(sorted(a.capabilities))) for k, a in enumerate(adapters())]
    return spark.createDataFrame(rows, "place int, name string, platform string, extensions string, capabilities string")


for _adapter in (
    Adapter("dataflash", "ardupilot", ("bin",), lambda path, head: ends(path, "bin") and head.startswith(detect.DATAFLASH_MAGIC), flightlog.read_dataflash, of_kind("dataflash"), api.CAPABILITIES["ardupilot"]),
    Adapter("dataflash_text", "ardupilot", ("log",), lambda path, head: ends(path, "log") and any(m.encode() in head for m in detect.TEXT_MARKS), flightlog.read_dataflash_text, of_kind("dataflash"), api.CAPABILITIES["ardupilot"]),
    Adapter("telemetry", "ardupilot", ("tlog",), is_telemetry, flightlog.read_telemetry, of_kind("telemetry"), api.CAPABILITIES["ardupilot"]),
    Adapter("blackbox", "betaflight", ("bbl", "bfl", "txt"), lambda path, head: ends(path, "bbl", "bfl", "txt") and detect.BLACKBOX_MAGIC[:9] in head[:64], blackbox_messages, blackbox_flights, api.CAPABILITIES["betaflight"]),
    Adapter("ulog", "px4", ("ulg", "ulog"), lambda path, head: ends(path, "ulg", "ulog") and head.startswith(detect.ULOG_MAGIC), flightlog.read_ulog, of_kind("ulog"), api.CAPABILITIES["px4"]),
):
    register(_adapter)


def recognised(path: str, head: bytes, known: Sequence[Adapter]) -> Adapter | None:
    """The first adapter that takes a file for its own; one that fails does not."""
    for a in known:
        try:
            if a.matches(path, head):
                return a
        except Exception:  # a third party's rule must not end the job
            continue
    return None


def read_folder(spark: SparkSession, pattern: str | Sequence[str], roots: Sequence[str] | None = None, most_bytes: int = detect.MOST_BYTES) -> DataFrame:
    """adapter, the columns of ``flightlog.SCHEMA`` and error of all logs of a pattern, whatever their formats, on any file system that Spark reads. Files that are
    unsafe, too large, broken or of no known format give a row with an error and nothing else.
    """
    known = adapters()
    extensions = sorted({e for a in known for e in a.extensions} | set(detect.EXTENSIONS))
    schema = StructType.fromDDL(f"adapter string, {flightlog.SCHEMA.split(', ', 1)[1]}")

    def decode(path: str, data: bytes) -> Iterator[tuple]:
        own = recognised(path, data[:HEAD_BYTES], known)
        if own is None:
            raise files.UnknownFormat(path)
        for idx, row in enumerate(own.decode(data)):
            yield own.name, idx, *row

    return files.decoded(files.listed(spark, pattern, roots, extensions, most_bytes), decode, schema, with_path=True)


def fleets(messages: DataFrame) -> dict[str, api.Flights]:
    """The tables of each adapter's logs among the messages of ``read_folder``; lazy, also where there is none of its logs."""
    good = messages.where("error is null").drop("error")
    return {a.name: a.flights(good.where(F.col("adapter") == a.name).drop("adapter")) for a in adapters()}


def analyze_folder(messages: DataFrame, modules: Sequence[str] | None = None, present: Sequence[str] | None = None) -> api.Analysis:
    """What ``api.analyze`` finds in the logs of each adapter, one result a module with adapter and platform in front; columns that a platform does not have are null.
    ``present`` names the adapters to run; without it those that the messages hold, of which there is a handful.
    """
    names = present if present is not None else sorted(r[0] for r in messages.where("error is null").select("adapter").distinct().collect())
    parts: dict[str, list[DataFrame]] = {}
    failures: list[tuple[str, str, str]] = []
    own_tables = fleets(messages)
    for name in names:
        own = adapter(name)
        wanted = None if modules is None else [m for m in modules if m in own.capabilities]
        if wanted == []:
            continue
        try:
            found = api.analyze(own_tables[own.name], modules=wanted)
        except api.AnalysisError as e:
            failures.append((own.name, e.code, str(e)))
            continue
        failures += [(f"{own.name}.{m}", code, text) for m, code, text in found.failures]
        for module, rows in found.results.items():
            parts.setdefault(module, []).append(rows.select(F.lit(own.name).alias("adapter"), F.lit(own.platform).alias("platform"), *rows.columns))
    if not parts:
        raise api.AnalysisError(api.ALL_FAILED if failures else api.NOTHING_RAN, "no module could run", "; ".join(t[:200] for *_, t in failures))
    joined = {m: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows) for m, rows in parts.items()}
    return api.Analysis(joined, failures)
