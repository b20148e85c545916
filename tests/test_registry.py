"""Mixed folders, adapters of third parties, text logs, blackbox tables."""

from __future__ import annotations

import math
import struct

import pytest
from pyspark.sql import functions as F

from aerolake import api
from aerolake.sources import blackbox, flightlog, registry
from tests.test_flightlogs import dataflash, telemetry, ulog
from tests.test_sources import segment

BOX_FIELDS = ["loopIteration", "time", *(f"axis{t}[{k}]" for t in "PIDF" for k in range(3)), *(f"setpoint[{k}]" for k in range(3)), *(f"gyroADC[{k}]" for k in range(3)), *(f"accSmooth[{k}]" for k in range(3)), *(f"motor[{k}]" for k in range(4)), "vbatLatest", "amperageLatest"]


def box(n=1500, tone=150.0, rate=1000.0):
    """A blackbox log of key frames alone with a tone on its gyro, one lost frame, two modes."""
    head = ["Product:Blackbox flight data recorder by Nicholas Sherlock", "Data version:2", "I interval:1", f"looptime:{int(1e6 / rate)}", "acc_1G:2048", "minthrottle:1000", "maxthrottle:2000", "gyro_lpf1_static_hz:120", "p_roll:45", "rpm_filter:1", "dshot_bidir:1"]
    kinds = [f"Field I name:{','.join(BOX_FIELDS)}", f"Field I signed:{','.join('1' * len(BOX_FIELDS))}", f"Field I predictor:{','.join('0' * len(BOX_FIELDS))}", f"Field I encoding:{','.join('0' * len(BOX_FIELDS))}", "Field S name:flightModeFlags", "Field S predictor:0", "Field S encoding:1"]
    out = bytearray("".join(f"H {x}\n" for x in [*head, *kinds]).encode())
    s = blackbox.encode_signed
    for i in range(n):
        if i in (0, n // 2):
            out += b"S" + blackbox.encode_unsigned(1 if i == 0 else 3)
        step = 200 if i // 300 % 2 else 0
        gyro = [int(100 * math.sin(2 * math.pi * tone * i / rate)) + step, 0, 0]
        if i == 100:
            gyro[1] = 30_000
        row = [i, i * int(1e6 / rate), *[10, 0, 0], *[5, 0, 0], *[3 * (i % 2), 0, 0], *[0, 0, 0], step, 0, 0, *gyro, 0, 0, 2048, 1500, 1500, 1500, 1500, 1620, 250]
        out += b"I" + b"".join(map(s, row))
    return bytes(out + b"E\xff")


def text_form(data):
    """The text form of a binary DataFlash log."""
    lines, forms = [], {}
    at = 0
    while (at := data.find(b"\xa3\x95\x80", at)) >= 0:
        number, _, name, letters, columns = struct.unpack_from("<BB4s16s64s", data, at + 3)
        forms[flightlog.text_of(name)] = (flightlog.text_of(letters), flightlog.text_of(columns).split(","))
        lines.append(f"FMT, {number}, 0, {flightlog.text_of(name)}, {flightlog.text_of(letters)}, {flightlog.text_of(columns)}")
        at += 3
    for name, _, _, *_, fields, text in flightlog.read_dataflash(data):
        letters, columns = forms[name]
        lines.append(", ".join([name, *(text if c in flightlog.TEXT_LETTERS else repr(fields[n]) for c, n in zip(letters, columns, strict=True))]))
    return "\n".join(lines) + "\nNOPE, 1, 2\nMSG, 3, one, two\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("logs")
    for name, data in {"a.bin": dataflash(), "b.log": text_form(dataflash()).encode(), "c.tlog": telemetry(), "d.bbl": box(), "e.ulg": ulog(), "f.txt": b"just a note", "g.bin": b"\xa3\x95", "h.csv": b"time,roll\n1,2\n"}.items():
        (path / name).write_bytes(data)
    return str(path)


def test_one_pass_over_a_mixed_folder(spark, folder):
    messages = registry.read_folder(spark, folder, [folder]).cache()
    counts = {(r["adapter"], r["path"].rpartition("/")[2]): r["count"] for r in messages.where("error is null").groupBy("adapter", "path").count().collect()}
    assert {k for k in counts} == {("dataflash", "a.bin"), ("dataflash_text", "b.log"), ("telemetry", "c.tlog"), ("blackbox", "d.bbl"), ("ulog", "e.ulg")}
    errors = {r["path"].rpartition("/")[2]: r["error"][:5] for r in messages.where("error is not null").collect()}
    assert errors == {"f.txt": "E1004", "g.bin": "E1005", "h.csv": "E1001"}
    fleet = registry.fleets(messages)
    assert fleet["dataflash"].pid.count() == fleet["dataflash_text"].pid.count() == 90 and fleet["ulog"].pid.count() == 60
    found = registry.analyze_folder(messages, ["filter", "quality"])
    assert {r["adapter"] for r in found.results["filter"].collect()} == {"dataflash", "dataflash_text", "blackbox", "ulog"}
    assert {(r["adapter"], r["platform"]) for r in found.results["quality"].select("adapter", "platform").collect()} >= {("dataflash", "ardupilot"), ("blackbox", "betaflight"), ("ulog", "px4")}
    messages.unpersist()


def test_a_third_party_adapter(spark, folder):
    def rows(data):
        for line in data.decode().splitlines()[1:]:
            t, roll = line.split(",")
            yield "ATT", 0, int(float(t) * 1e6), None, None, None, None, {"Roll": float(roll), "Pitch": 0.0, "Yaw": 0.0}, None

    registry.register(registry.Adapter("own", "ardupilot", ("csv",), lambda path, head: head.startswith(b"time,"), rows, registry.of_kind("dataflash"), ("quality",)))
    registry.register(registry.Adapter("failing", "px4", ("csv",), lambda path, head: 1 / 0, rows, registry.of_kind("ulog")))
    try:
        messages = registry.read_folder(spark, f"{folder}/h.csv", [folder])
        assert registry.fleets(messages)["own"].attitude.first()["roll"] == 2.0
        assert [r["name"] for r in registry.listing(spark).orderBy("place").collect()] == ["dataflash", "dataflash_text", "telemetry", "blackbox", "ulog", "own", "failing"]
        assert registry.adapter(" OWN ").platform == "ardupilot"
    finally:
        registry.unregister("own")
        registry.unregister("failing")
    with pytest.raises(api.AnalysisError, match="E1004"):
        registry.adapter("own")
    with pytest.raises(ValueError, match="name"):
        registry.register(registry.Adapter("", "px4", (), lambda *_: True, rows, registry.of_kind("ulog")))


def test_text_and_binary_form_of_a_log_are_equal(spark, folder, tmp_path):
    binary = flightlog.read_logs(spark, f"{folder}/a.bin", "dataflash").drop("error")
    names = [c for c in binary.columns if c not in ("path", "idx")]
    plain = lambda df: sorted((tuple(sorted(r["fields"].items())), *(r[c] for c in names if c != "fields")) for r in df.collect())
    whole = flightlog.read_logs(spark, f"{folder}/b.log", "dataflash_text").drop("error")
    (tmp_path / "c.log").write_text(text_form(dataflash()))
    (tmp_path / "d.log").write_text("FMT, 1, 0, ODD, QZfc, TimeUS,Name,x,y\r\nODD, 5, a, b, 1.5, 2, 3\nODD, 6\nODD, 7, n, x, nan\n\nFMT, 2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        split = flightlog.read_text_logs(spark, str(tmp_path)).cache()
        own = split.where("path like '%c.log'")
        assert split.rdd.getNumPartitions() > 3 and plain(binary) == plain(whole) == plain(own)
        order = [r["time_us"] for r in own.where("mtype = 'PIDR'").orderBy("idx").collect()]
        assert order == sorted(order) and own.select("idx").distinct().count() == own.count()
        odd = sorted((r["time_us"], r["text"], sorted(r["fields"])) for r in split.where("mtype = 'ODD'").collect())
        assert [o[0] for o in odd] == [5, 7]
        a, b = (api.Flights.from_messages(m, "dataflash") for m in (binary, own))
        for name in ("pid", "imu", "params"):
            rows = lambda f, name=name: sorted(tuple(v for k, v in r.asDict().items() if k not in ("flight_id", "idx")) for r in getattr(f, name).collect())
            assert rows(a) == rows(b) != []
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blackbox_logs_have_all_tables(spark, folder):
    frames, heads = (blackbox.read_blackbox(spark, f"{folder}/d.bbl", headers=h).drop("error") for h in (False, True))
    flights = api.Flights.from_blackbox(frames, heads)
    imu = {r["idx"]: r for r in flights.imu.collect()}
    assert len(imu) == 1500 and abs(imu[7]["az"] - 9.80665) < 1e-9 and imu[100]["gy"] == 0.0 and abs(imu[1]["t"] - 0.001) < 1e-12
    assert flights.motors.select("channel", "output").distinct().count() == 4 and flights.motors.first()["output"] == 0.5
    power = flights.battery.first()
    assert (power["volt"], power["curr"]) == (16.2, 2.5)
    assert [(r["idx"], r["mode_name"]) for r in flights.modes.orderBy("idx").collect()] == [(0, "acro"), (750, "stabilize")]
    params = {r["name"]: r["value"] for r in flights.params.collect()}
    assert params["pid.roll.p"] == params["p_roll"] == 45.0 and params["filter.gyro_lpf"] == 120.0 and "Product" not in params
    found = api.analyze(flights)
    assert found.failures == [] and {"fft", "filter", "hardware", "rpm_filter", "pid", "quality"} <= set(found.results)
    assert abs(max(api.fft(flights, over=10.0).first()["peaks"], key=lambda p: p["magnitude"])["freq"] - 150) < 1
    assert found.results["filter"].first()["chain"] == ["low-pass 120 Hz"]
    assert found.results["hardware"].first()["gains"][0]["p"] == 45.0
    assert found.results["rpm_filter"].first()["rpm_filter"]


def test_small_blackbox_logs_of_the_decoder(spark, tmp_path):
    (tmp_path / "a.bbl").write_bytes(segment(32)[0])
    flights = registry.fleets(registry.read_folder(spark, str(tmp_path)))["blackbox"]
    assert flights.imu.count() == 32 and flights.battery.count() == 0 and flights.pid.where(F.col("axis") == "roll").count() == 32
