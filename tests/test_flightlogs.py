from __future__ import annotations

import math
import struct

from aerolake.operators import ingest
from aerolake.sources import blackbox, flightlog
from aerolake.sources.detect import ULOG_MAGIC
from tests.test_sources import HEAD, segment


def dataflash():
    out = bytearray()
    forms = {130: ("PIDR", "Qffffff", "TimeUS,Tar,Act,P,I,D,FF"), 131: ("PARM", "QNf", "TimeUS,Name,Value"), 132: ("IMU", "QBffffff", "TimeUS,I,GyrX,GyrY,GyrZ,AccX,AccY,AccZ"), 133: ("RATE", "Qffffff", "TimeUS,RDes,R,PDes,P,YDes,Y")}
    codes = {n: "<" + "".join(flightlog.DATAFLASH_KINDS[c][0] for c in letters) for n, (_, letters, _) in forms.items()}
    for n, (name, letters, columns) in forms.items():
        out += b"\xa3\x95\x80" + struct.pack("<BB4s16s64s", n, struct.calcsize(codes[n]) + 3, name.encode(), letters.encode(), columns.encode())
    put = lambda n, *v: out.extend(b"\xa3\x95" + bytes([n]) + struct.pack(codes[n], *v))
    for i in range(30):
        us = 1_000_000 + i * 10_000
        put(130, us, 1.0, 0.5, 0.1, 0.2, 0.3, 0.0)
        put(132, us, i % 2, 0.1, 0.2, 0.3, 0.0, 0.0, 9.81)
        put(133, us, 10.0, 9.0, 20.0, 19.0, 30.0, 29.0)
        if i == 15:
            out += b"\xa3\x95\xffnoise"
    put(131, 5, b"ATC_P", 0.1)
    put(131, 9, b"ATC_P", 0.2)
    return bytes(out)


def ulog():
    out = bytearray(ULOG_MAGIC + b"\x01" + b"\0" * 8)
    put = lambda kind, body: out.extend(struct.pack("<HB", len(body), ord(kind)) + body)
    put("F", b"vehicle_rates_setpoint:uint64_t timestamp;float roll;float pitch;float yaw;uint8_t[4] _padding0;")
    put("F", b"vehicle_angular_velocity:uint64_t timestamp;float[3] xyz;")
    key = b"float MC_ROLL_P"
    put("P", bytes([len(key)]) + key + struct.pack("<f", 6.5))
    put("A", struct.pack("<BH", 0, 1) + b"vehicle_rates_setpoint")
    put("A", struct.pack("<BH", 0, 2) + b"vehicle_angular_velocity")
    for i in range(20):
        put("D", struct.pack("<HQfff", 2, 1000 + i * 1000, 0.1 * i, 0.0, 1.0))
        if i % 4 == 0:
            put("D", struct.pack("<HQfff", 1, 1000 + i * 1000, 0.1 * i, 0.5, 0.0))
    put("L", struct.pack("<BQ", 6, 5000) + b"hello")
    return bytes(out)


def telemetry():
    out = bytearray()
    seq = [0]

    def put(number, system, *v, version=2, wall=0):
        name, code, _ = flightlog.TELEMETRY[number]
        payload = struct.pack("<" + code, *v).rstrip(b"\0") or b"\0"
        out.extend((1_700_000_000_000_000 + wall).to_bytes(8, "big"))
        head = bytes([0xFD, len(payload), 0, 0, seq[0] % 256, system, 1]) + number.to_bytes(3, "little") if version == 2 else bytes([0xFE, len(payload), seq[0] % 256, system, 1, number])
        out.extend(head + payload + b"\0\0")
        seq[0] += 1

    put(0, 255, 0, 6, 8, 0, 0, 3)
    put(0, 1, 0, 2, 3, 81, 3, 3, version=1)
    for i in range(10):
        put(27, 1, 1_000_000 + i * 100_000, 0, 0, 1000, 100, 0, 0, 1, 2, 3, wall=i * 100_000)
        put(1, 1, 0, 0, 0, 0, 12_600 if i else 65_535, 500, 0, 0, 0, 0, 0, 0, 90, wall=i * 100_000)
        put(30, 77, 5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, wall=i * 100_000)
    return bytes(out)


def load(spark, tmp_path, kind, data, name):
    (tmp_path / name).write_bytes(data)
    flightlog.register(spark)
    return spark.read.format(kind).load(str(tmp_path / name))


def test_dataflash(spark, tmp_path):
    rows = load(spark, tmp_path, "dataflash", dataflash(), "a.bin")
    assert rows.count() == 92
    pid = ingest.dataflash_pid(rows).collect()
    assert {(r["axis"], round(r["desired"], 3)) for r in pid} == {("roll", round(math.degrees(1.0), 3)), ("pitch", 20.0), ("yaw", 30.0)}
    assert len(pid) == 90 and max(r["t"] for r in pid) == 1.29
    imu = ingest.dataflash_imu(rows)
    assert imu.count() == 15 and round(imu.first()["gx"], 4) == round(math.degrees(0.1), 4)
    assert [(r["name"], round(r["value"], 3)) for r in ingest.dataflash_params(rows).collect()] == [("ATC_P", 0.2)]


def test_ulog(spark, tmp_path):
    rows = load(spark, tmp_path, "ulog", ulog(), "a.ulg")
    assert {r["text"]: r["fields"]["value"] for r in rows.where("mtype = 'parameter'").collect()} == {"MC_ROLL_P": 6.5}
    assert rows.where("mtype = 'logged_text'").first()["text"] == "hello"
    pid = ingest.ulog_pid(rows)
    assert pid.count() == 60
    roll = {round(r["t"], 4): r for r in pid.where("axis = 'roll'").collect()}
    assert all(abs(r["desired"] - r["actual"]) < 1e-4 for t, r in roll.items() if t <= 0.017) and abs(roll[0.02]["desired"] - math.degrees(1.6)) < 1e-4


def test_telemetry(spark, tmp_path):
    rows = load(spark, tmp_path, "telemetry", telemetry(), "a.tlog")
    assert rows.count() == 32
    own = ingest.telemetry_messages(rows)
    assert {r["sysid"] for r in own.where("idx > 1").collect()} == {1}
    imu = ingest.telemetry_imu(rows).orderBy("idx").collect()
    assert len(imu) == 10 and abs(imu[0]["az"] - 9.80665) < 1e-9 and abs(imu[0]["gx"] - math.degrees(0.1)) < 1e-9
    battery = ingest.telemetry_battery(rows).collect()
    assert len(battery) == 9 and battery[0]["volt"] == 12.6 and battery[0]["curr"] == 5.0


def test_blackbox_tables(spark, tmp_path):
    (tmp_path / "a.bbl").write_bytes(segment(32)[0])
    blackbox.register(spark)
    frames = spark.read.format("blackbox").load(str(tmp_path / "a.bbl"))
    heads = spark.read.format("blackbox").option("content", "headers").load(str(tmp_path / "a.bbl"))
    pid = ingest.blackbox_pid(frames, heads)
    assert pid.count() == 32 and {r["axis"] for r in pid.collect()} == {"roll"} and pid.agg({"t": "max"}).first()[0] == 31 / 4000
    assert HEAD.startswith(b"H Product:")
