"""Spark data sources ``dataflash``, ``ulog`` and ``telemetry``: binary flight logs as rows of messages.

All three give (path, idx, mtype, instance, time_us, wall_us, sysid, compid, seq, fields map<string,double>, text). A file is a partition: its
formats are declared along the way, so it reads from front to back. Everything after is DataFrame work (``operators.ingest``).
"""

from __future__ import annotations

import glob as globbing
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from aerolake.sources.detect import DATAFLASH_MAGIC, MOST_BYTES, ULOG_MAGIC

SCHEMA = "path string, idx bigint, mtype string, instance int, time_us bigint, wall_us bigint, sysid int, compid int, seq int, fields map<string,double>, text string"
Row = tuple  # (mtype, instance, time_us, wall_us, sysid, compid, seq, fields, text)

#: DataFlash column letters: struct code and scale (None: text); fixed values.
DATAFLASH_KINDS = {
    "b": ("b", 1), "B": ("B", 1), "h": ("h", 1), "H": ("H", 1), "i": ("i", 1), "I": ("I", 1), "q": ("q", 1), "Q": ("Q", 1), "f": ("f", 1), "d": ("d", 1), "M": ("B", 1),
    "c": ("h", 0.01), "C": ("H", 0.01), "e": ("i", 0.01), "E": ("I", 0.01), "L": ("i", 1e-7), "n": ("4s", None), "N": ("16s", None), "Z": ("64s", None), "a": ("64s", None),
}
FORMAT_TYPE, FORMAT_LENGTH = 128, 89
#: ULog basic types as struct codes; fixed values.
ULOG_KINDS = {"int8_t": "b", "uint8_t": "B", "int16_t": "h", "uint16_t": "H", "int32_t": "i", "uint32_t": "I", "int64_t": "q", "uint64_t": "Q", "float": "f", "double": "d", "bool": "?", "char": "s"}
#: Telemetry messages by number: name, struct code and fields in the order of the wire; fixed values.
TELEMETRY = {
    0: ("HEARTBEAT", "IBBBBB", "custom_mode type autopilot base_mode system_status mavlink_version"),
    1: ("SYS_STATUS", "IIIHHhHHHHHHb", "present enabled health load voltage_battery current_battery drop_rate_comm errors_comm errors_count1 errors_count2 errors_count3 errors_count4 battery_remaining"),
    2: ("SYSTEM_TIME", "QI", "time_unix_usec time_boot_ms"),
    22: ("PARAM_VALUE", "fHH16sB", "param_value param_count param_index param_id param_type"),
    24: ("GPS_RAW_INT", "QiiiHHHHBB", "time_usec lat lon alt eph epv vel cog fix_type satellites_visible"),
    26: ("SCALED_IMU", "Ihhhhhhhhh", "time_boot_ms xacc yacc zacc xgyro ygyro zgyro xmag ymag zmag"),
    27: ("RAW_IMU", "Qhhhhhhhhh", "time_usec xacc yacc zacc xgyro ygyro zgyro xmag ymag zmag"),
    30: ("ATTITUDE", "Iffffff", "time_boot_ms roll pitch yaw rollspeed pitchspeed yawspeed"),
    33: ("GLOBAL_POSITION_INT", "IiiiihhhH", "time_boot_ms lat lon alt relative_alt vx vy vz hdg"),
    36: ("SERVO_OUTPUT_RAW", "IHHHHHHHHB", "time_usec servo1_raw servo2_raw servo3_raw servo4_raw servo5_raw servo6_raw servo7_raw servo8_raw port"),
    74: ("VFR_HUD", "ffffhH", "airspeed groundspeed alt climb heading throttle"),
    83: ("ATTITUDE_TARGET", "I4fffffB", "time_boot_ms q1 q2 q3 q4 body_roll_rate body_pitch_rate body_yaw_rate thrust type_mask"),
    116: ("SCALED_IMU2", "Ihhhhhhhhh", "time_boot_ms xacc yacc zacc xgyro ygyro zgyro xmag ymag zmag"),
    129: ("SCALED_IMU3", "Ihhhhhhhhh", "time_boot_ms xacc yacc zacc xgyro ygyro zgyro xmag ymag zmag"),
    148: ("AUTOPILOT_VERSION", "QQIIIIHH8s8s8s", "capabilities uid flight_sw_version middleware_sw_version os_sw_version board_version vendor_id product_id flight_custom middleware_custom os_custom"),
    178: ("AHRS2", "ffffii", "roll pitch yaw altitude lat lng"),
    253: ("STATUSTEXT", "B50s", "severity text"),
}


def text_of(data: bytes) -> str:
    return data.split(b"\0")[0].decode("utf-8", "replace")


def read_dataflash(data: bytes) -> Iterator[Row]:
    """Messages with a two-byte head and a type; type 128 declares the others. Bytes that fit nothing are skipped to the next head."""
    formats: dict[int, tuple[str, struct.Struct, list[tuple[str, float | None]], int]] = {}
    at = 0
    while (at := data.find(DATAFLASH_MAGIC, at)) >= 0 and at + 3 <= len(data):
        kind = data[at + 2]
        if kind == FORMAT_TYPE and at + FORMAT_LENGTH <= len(data):
            number, length, name, letters, columns = struct.unpack_from("<BB4s16s64s", data, at + 3)
            letters, names = text_of(letters), text_of(columns).split(",")
            if number != FORMAT_TYPE and all(c in DATAFLASH_KINDS for c in letters):
                form = struct.Struct("<" + "".join(DATAFLASH_KINDS[c][0] for c in letters))
                if form.size + 3 == length and len(names) == len(letters):
                    formats[number] = (text_of(name), form, [(n, DATAFLASH_KINDS[c][1]) for n, c in zip(names, letters, strict=True)], length)
            at += FORMAT_LENGTH
            continue
        known = formats.get(kind)
        if known is None or at + known[3] > len(data):
            at += 1
            continue
        name, form, columns, length = known
        fields, texts = {}, []
        for (column, scale), value in zip(columns, form.unpack_from(data, at + 3), strict=True):
            if scale is None:
                texts.append(text_of(value))
            else:
                fields[column] = float(value) * scale
        time = fields.get("TimeUS", fields["TimeMS"] * 1000 if "TimeMS" in fields else None)
        yield name, int(fields.get("I", fields.get("Instance", 0))), None if time is None else int(time), None, None, None, None, fields, " ".join(texts) or None
        at += length


#: Letters of DataFlash columns that hold text; fixed values.
TEXT_LETTERS = "".join(c for c, (_, scale) in DATAFLASH_KINDS.items() if scale is None)


def read_dataflash_text(data: bytes) -> Iterator[Row]:
    """The text form of a DataFlash log: lines of a type and its values, in their units; FMT lines declare columns. For logs that fit a task; ``read_text_logs`` splits them."""
    formats: dict[str, tuple[str, list[str]]] = {}
    for line in data.decode("utf-8", "replace").splitlines():
        name, *values = (v.strip() for v in line.split(","))
        if name == "FMT" and len(values) >= 5:
            formats[values[2]] = (values[3], values[4:])
            continue
        if name not in formats:
            continue
        letters, columns = formats[name]
        if not columns or len(values) < len(columns):
            continue
        values[len(columns) - 1 :] = [", ".join(values[len(columns) - 1 :])]
        fields, texts = {}, []
        for letter, column, value in zip(letters, columns, values, strict=False):
            if letter in TEXT_LETTERS:
                texts.append(value)
            elif (number := number_of(value)) is not None:
                fields[column] = number
        time = fields.get("TimeUS", fields["TimeMS"] * 1000 if "TimeMS" in fields else None)
        yield name, int(fields.get("I", fields.get("Instance", 0))), None if time is None else int(time), None, None, None, None, fields, " ".join(t for t in texts if t) or None


def number_of(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def read_text_logs(spark, pattern):
    """Messages of text DataFlash logs of any size: their lines are split among tasks, FMT lines are gathered as a small table (file, type, letters, columns), which is broadcast
    if a count finds it small, and every other line is read by its own file's. ``idx`` follows the lines of a file: the byte at which a split begins, and the line in it.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    raw = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    def number(batches):
        last, k = None, 0
        for batch in batches:
            places = []
            for at in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                k = k + 1 if at == last else 0
                last = at
                places.append(at[1] + k)
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(places, pa.int64()), batch["value"]], ["path", "idx", "line"])

    lines = raw.mapInArrow(number, "path string, idx long, line string").withColumn("v", F.transform(F.split("line", ",", -1), lambda x: F.trim(x))).drop("line")
    lines = lines.withColumn("mtype", F.get("v", F.lit(0)))
    declared = lines.where("mtype = 'FMT' and size(v) >= 6")
    formats = declared.groupBy("path", F.get("v", F.lit(3)).alias("mtype")).agg(F.max_by(F.struct(F.get("v", F.lit(4)).alias("letters"), F.slice("v", F.lit(6), F.size("v")).alias("columns")), "idx").alias("f"))
    formats = formats.select("path", "mtype", "f.*")
    # Some hundred rows a file.
    small = formats.count() <= 200_000
    rows = lines.where("mtype <> 'FMT'").join(F.broadcast(formats) if small else formats, ["path", "mtype"])
    n = F.size("columns")
    rows = rows.where((n > 0) & (F.size("v") > n))
    rest = F.array_join(F.slice("v", n + 1, F.size("v")), ", ")
    values = F.concat(F.slice("v", F.lit(2), n - 1), F.array(rest))
    cell = F.transform(F.arrays_zip(F.col("columns").alias("name"), values.alias("value")), lambda x, k: F.struct(x["name"].alias("name"), x["value"].alias("value"), F.substr("letters", k + 1, F.lit(1)).alias("letter")))
    rows = rows.withColumn("cells", cell)
    text = lambda x: F.contains(F.lit(TEXT_LETTERS), x["letter"]) & (x["letter"] != "")
    numeric = F.filter(F.transform(F.filter("cells", lambda x: ~text(x)), lambda x: F.struct(x["name"].alias("name"), x["value"].try_cast("double").alias("value"))), lambda x: x["value"].isNotNull())
    texts = F.array_join(F.filter(F.transform(F.filter("cells", text), lambda x: x["value"]), lambda x: x != ""), " ")
    rows = rows.withColumns({"fields": F.map_from_entries(numeric), "text": F.nullif(texts, F.lit(""))})
    of = lambda name: F.try_element_at("fields", F.lit(name))
    nothing = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "path", "idx", "mtype", F.coalesce(of("I"), of("Instance"), F.lit(0.0)).cast("int").alias("instance"), F.coalesce(of("TimeUS"), of("TimeMS") * 1000).cast("long").alias("time_us"), nothing("bigint").alias("wall_us"),
        nothing("int").alias("sysid"), nothing("int").alias("compid"), nothing("int").alias("seq"), "fields", "text",
    )


@dataclass
class Layout:
    """Flat struct of a ULog format: names of its values; texts as one value each."""

    form: struct.Struct
    names: list[str]


def ulog_layout(name: str, formats: dict[str, list[tuple[str, int, str]]], prefix: str = "") -> tuple[str, list[str]]:
    code, names = "", []
    for kind, count, field in formats[name]:
        if kind == "char":
            code += f"{count}s"
            names.append(prefix + field)
            continue
        for k in range(count):
            own = f"{prefix}{field}" + (f"[{k}]" if count > 1 else "")
            if kind in ULOG_KINDS:
                code += ULOG_KINDS[kind]
                names.append(own)
            else:
                inner, inner_names = ulog_layout(kind, formats, own + ".")
                code += inner
                names += inner_names
    return code, names


def split_field(text: str) -> tuple[str, int, str]:
    """(type, count, name) of a ``type[count] name`` declaration."""
    kind, _, name = text.strip().partition(" ")
    kind, _, count = kind.partition("[")
    return kind, int(count.rstrip("]") or 1), name


def read_ulog(data: bytes) -> Iterator[Row]:
    """Header, then messages of (size, type): F formats, A subscriptions, D data, P parameters, L texts."""
    if not data.startswith(ULOG_MAGIC):
        return
    formats: dict[str, list[tuple[str, int, str]]] = {}
    topics: dict[int, tuple[str, int, Layout]] = {}
    at = 16
    while at + 3 <= len(data):
        size, kind = struct.unpack_from("<HB", data, at)
        body = data[at + 3 : at + 3 + size]
        at += 3 + size
        if len(body) < size:
            return
        kind = chr(kind)
        if kind == "F":
            name, _, rest = body.decode("latin-1").partition(":")
            formats[name] = [split_field(f) for f in rest.split(";") if f.strip()]
        elif kind == "A":
            multi, number = struct.unpack_from("<BH", body)
            name = body[3:].decode("latin-1")
            if name in formats:
                code, names = ulog_layout(name, formats)
                topics[number] = (name, multi, Layout(struct.Struct("<" + code), names))
        elif kind == "D" and len(body) >= 2 and (known := topics.get(struct.unpack_from("<H", body)[0])):
            name, multi, layout = known
            payload = body[2:].ljust(layout.form.size, b"\0")  # trailing padding is not logged
            fields, texts = {}, []
            for field, value in zip(layout.names, layout.form.unpack_from(payload), strict=True):
                if isinstance(value, bytes):
                    texts.append(text_of(value))
                elif not field.startswith("_padding"):
                    fields[field] = float(value)
            time = fields.get("timestamp")
            yield name, multi, None if time is None else int(time), None, None, None, None, fields, " ".join(texts) or None
        elif kind == "P" and body:
            kind_of, _, name = split_field(body[1 : 1 + body[0]].decode("latin-1"))
            value = struct.unpack_from("<" + ULOG_KINDS[kind_of], body, 1 + body[0])[0]
            yield "parameter", 0, None, None, None, None, None, {"value": float(value)}, name
        elif kind == "L" and len(body) >= 9:
            level, time = struct.unpack_from("<BQ", body)
            yield "logged_text", 0, time, None, None, None, None, {"level": float(level)}, body[9:].decode("utf-8", "replace")


@dataclass
class Piece:
    """A stretch of a log that decodes by itself behind ``head``, the declarations before it; ``first``: how many rows come before its own."""

    head: bytes
    begin: int
    end: int
    first: int


def dataflash_pieces(data: bytes, size: int) -> Iterator[Piece]:
    """Pieces of about ``size`` bytes, cut where the decoder itself steps from one message to the next: it is followed by lengths alone, without decoding."""
    lengths: dict[int, int] = {}
    head, begin, declared, first, n, at = bytearray(), 0, 0, 0, 0, 0
    while (at := data.find(DATAFLASH_MAGIC, at)) >= 0 and at + 3 <= len(data):
        if at - begin >= size:
            yield Piece(bytes(head[:declared]), begin, at, first)
            begin, declared, first = at, len(head), n
        kind = data[at + 2]
        if kind == FORMAT_TYPE and at + FORMAT_LENGTH <= len(data):
            number, length, _, letters, columns = struct.unpack_from("<BB4s16s64s", data, at + 3)
            letters = text_of(letters)
            if number != FORMAT_TYPE and all(c in DATAFLASH_KINDS for c in letters) and len(text_of(columns).split(",")) == len(letters) and struct.calcsize("<" + "".join(DATAFLASH_KINDS[c][0] for c in letters)) + 3 == length:
                lengths[number] = length
                head += data[at : at + FORMAT_LENGTH]
            at += FORMAT_LENGTH
        elif (length := lengths.get(kind)) is None or at + length > len(data):
            at += 1
        else:
            n += 1
            at += length
    yield Piece(bytes(head[:declared]), begin, len(data), first)


def ulog_pieces(data: bytes, size: int) -> Iterator[Piece]:
    """Pieces of about ``size`` bytes, cut between messages; formats and subscriptions before a piece are its head."""
    if not data.startswith(ULOG_MAGIC):
        return
    head, begin, declared, first, n, at = bytearray(data[:16]), 16, 16, 0, 0, 16
    topics: set[int] = set()
    formats: set[str] = set()
    while at + 3 <= len(data):
        length, kind = struct.unpack_from("<HB", data, at)
        end, kind = at + 3 + length, chr(kind)
        if end > len(data):
            break
        if at - begin >= size:
            yield Piece(bytes(head[:declared]), begin, at, first)
            begin, declared, first = at, len(head), n
        if kind == "F":
            formats.add(data[at + 3 : end].partition(b":")[0].decode("latin-1"))
            head += data[at:end]
        elif kind == "A":
            if data[at + 6 : end].decode("latin-1") in formats:
                topics.add(struct.unpack_from("<H", data, at + 4)[0])
            head += data[at:end]
        n += kind == "D" and length >= 2 and struct.unpack_from("<H", data, at + 3)[0] in topics or kind == "P" and length > 0 or kind == "L" and length >= 9
        at = end
    yield Piece(bytes(head[:declared]), begin, len(data), first)


def telemetry_pieces(data: bytes, size: int) -> Iterator[Piece]:
    """Pieces of about ``size`` bytes, cut between frames, which declare nothing."""
    begin, first, n, at = 0, 0, 0, 0
    while at + 16 <= len(data):
        if at - begin >= size:
            yield Piece(b"", begin, at, first)
            begin, first = at, n
        mark, length = data[at + 8], data[at + 9]
        if mark == 0xFE:
            end = at + 14 + length + 2
        elif mark == 0xFD and at + 18 <= len(data):
            end = at + 18 + length + 2 + (13 if data[at + 10] & 1 else 0)
        else:
            at += 1
            continue
        if end > len(data):
            break
        n, at = n + 1, end
    yield Piece(b"", begin, len(data), first)


#: Ways to cut a log into pieces, by its format.
PIECES = {"dataflash": dataflash_pieces, "ulog": ulog_pieces, "telemetry": telemetry_pieces}
PIECE_BYTES = 16 << 20


def read_telemetry(data: bytes) -> Iterator[Row]:
    """An eight-byte clock (microseconds since 1970, most significant byte first) before every frame of either version."""
    at = 0
    forms = {n: struct.Struct("<" + code) for n, (_, code, _) in TELEMETRY.items()}
    while at + 16 <= len(data):
        mark, length = data[at + 8], data[at + 9]
        if mark == 0xFE:
            seq, system, component, number = data[at + 10 : at + 14]
            begin, end = at + 14, at + 14 + length + 2
        elif mark == 0xFD and at + 18 <= len(data):
            flags, seq, system, component = data[at + 10], data[at + 12], data[at + 13], data[at + 14]
            number = int.from_bytes(data[at + 15 : at + 18], "little")
            begin = at + 18
            end = begin + length + 2 + (13 if flags & 1 else 0)
        else:
            at += 1
            continue
        if end > len(data):
            return
        wall = int.from_bytes(data[at : at + 8], "big")
        if number in TELEMETRY:
            name, _, columns = TELEMETRY[number]
            form = forms[number]
            payload = data[begin : begin + length].ljust(form.size, b"\0")  # trailing zeros are not sent
            fields, texts = {}, []
            for column, value in zip(columns.split(), form.unpack_from(payload), strict=True):
                if isinstance(value, bytes):
                    texts.append(text_of(value))
                else:
                    fields[column] = float(value)
            boot = fields["time_boot_ms"] * 1000 if "time_boot_ms" in fields else fields["time_usec"] if 0 < fields.get("time_usec", 0) < 30 * 86_400e6 else None
            yield name, 0, None if boot is None else int(boot), wall, system, component, seq, fields, " ".join(texts) or None
        else:
            yield f"MSG_{number}", 0, None, wall, system, component, seq, {}, None
        at = end


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], decode):
        self.pattern, self.most_bytes, self.decode = options.get("path", ""), int(options.get("maxBytes", MOST_BYTES)), decode

    def partitions(self) -> list[File]:
        return [File(p) for p in sorted(globbing.glob(self.pattern))]

    def read(self, partition: File) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            data = file.read(self.most_bytes + 1)
        if len(data) > self.most_bytes:
            raise ValueError(f"{partition.path} has more than {self.most_bytes} bytes")
        for idx, row in enumerate(self.decode(data)):
            yield partition.path, idx, *row


class DataFlashSource(DataSource):
    decode = staticmethod(read_dataflash)

    @classmethod
    def name(cls) -> str:
        return "dataflash"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options), self.decode)


class ULogSource(DataFlashSource):
    decode = staticmethod(read_ulog)

    @classmethod
    def name(cls) -> str:
        return "ulog"


class TelemetrySource(DataFlashSource):
    decode = staticmethod(read_telemetry)

    @classmethod
    def name(cls) -> str:
        return "telemetry"


#: Decoders by the format that ``detect`` names.
DECODERS = {"dataflash": read_dataflash, "dataflash_text": read_dataflash_text, "ulog": read_ulog, "telemetry": read_telemetry}


def read_logs(spark, pattern, kind: str, roots=None, most_bytes: int = MOST_BYTES, piece_bytes: int | None = None):
    """Messages of the logs of a pattern on any file system Spark reads, with ``error``: unsafe, too large and unreadable files give a row with nothing else. With
    ``piece_bytes`` files are cut first (by a walk over message lengths) and their pieces decoded by as many tasks; the rows are the same.
    """
    if piece_bytes is not None:
        return read_pieces(spark, pattern, kind, roots, most_bytes, piece_bytes)
    from pyspark.sql.types import StructType

    from aerolake.sources import files

    fields = StructType.fromDDL(SCHEMA.split(", ", 1)[1])
    decode = DECODERS[kind]
    return files.decoded(files.listed(spark, pattern, roots, most_bytes=most_bytes), lambda data: ((idx, *row) for idx, row in enumerate(decode(data))), fields)


def read_pieces(spark, pattern, kind: str, roots, most_bytes: int, piece_bytes: int):
    """``read_logs`` with files cut into pieces, which are dealt out to tasks before they are decoded."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from aerolake.sources import files

    cut, decode = PIECES[kind], DECODERS[kind]
    parts = StructType.fromDDL("first bigint, data binary")

    def pieces(data: bytes) -> Iterator[tuple]:
        for p in cut(data, piece_bytes):
            yield p.first, p.head + data[p.begin : p.end]

    listed = files.decoded(files.listed(spark, pattern, roots, most_bytes=most_bytes), pieces, parts, rows=1)
    fields = StructType.fromDDL(SCHEMA.split(", ", 1)[1])
    names = [f.name for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(fields)
        for batch in batches:
            for path, first, data, error in zip(*(batch[c].to_pylist() for c in ("path", "first", "data", "error")), strict=True):
                rows: list[tuple] = []

                def out(path=path, rows=rows, error=None) -> pa.RecordBatch:
                    n = len(rows)
                    columns = [pa.array(c, types.field(k).type) for c, k in zip(zip(*rows, strict=True), names, strict=True)]
                    return pa.RecordBatch.from_arrays([pa.array([path] * n), *columns, pa.array([error] * n, pa.string())], ["path", *names, "error"])

                if error is None:
                    try:
                        for k, row in enumerate(decode(data)):
                            rows.append((first + k, *row))
                            if len(rows) == 2000:
                                yield out()
                                rows.clear()
                    except Exception as e:  # one broken piece must not end the job
                        error = f"{files.ERRORS['not_readable']}: {type(e).__name__}: {e}"
                if rows:
                    yield out()
                if error is not None:
                    rows[:] = [(None,) * len(names)]
                    yield out(error=error)

    return listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, f"path string, {SCHEMA.split(', ', 1)[1]}, error string")


def register(spark) -> None:
    for source in (DataFlashSource, ULogSource, TelemetrySource):
        spark.dataSource.register(source)
