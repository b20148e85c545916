"""What a user calls: modules over planted flights, tables of every log format, files that are unsafe or broken."""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolake import api
from aerolake.operators import catalog, ingest, models, responses, tables, vibration
from aerolake.sources import blackbox, files, flightlog, rules
from tests.test_flightlogs import dataflash, telemetry
from tests.test_library import second_order
from tests.test_sources import segment


def flight(spark, rate: float, seconds: float = 10.0, name: str = "a", zeta: float = 0.7, axes=("roll",)):
    n = int(rate * seconds)
    u = np.repeat([0, 50, 0, 50, 0], n // 5).astype(float)
    y = second_order(u, rate, omega=40.0, zeta=zeta)
    return spark.createDataFrame(pd.concat([pd.DataFrame({"flight_id": name, "axis": a, "idx": range(n), "t": np.arange(n) / rate, "desired": u, "actual": y}) for a in axes]))


def imu_of(spark, tones: dict[str, float], rate: float = 1000.0, n: int = 4000, name: str = "a"):
    t = np.arange(n) / rate
    rng = np.random.default_rng(4)
    gyro = {g: 2 * np.sin(2 * np.pi * tones[g] * t) + 1e-3 * rng.normal(size=n) if g in tones else 1e-3 * rng.normal(size=n) for g in ("gx", "gy", "gz")}
    return spark.createDataFrame(pd.DataFrame({"flight_id": name, "idx": range(n), "t": t, **gyro, "ax": np.sin(2 * np.pi * 80 * t), "ay": 0.0, "az": 9.81}))


def test_times_follow_the_rate_of_the_log(spark):
    got = {}
    for rate in (250.0, 1000.0):
        got[rate] = api.pid(api.Flights("ardupilot", pid=flight(spark, rate))).first()
    assert got[250.0]["windows"] > 0 and got[1000.0]["windows"] > 0
    assert abs(got[250.0]["rise_time_ms"] - got[1000.0]["rise_time_ms"]) < 9


def test_peaks_of_all_three_axes(spark):
    found = api.fft(api.Flights("ardupilot", imu=imu_of(spark, {"gx": 80.0, "gy": 150.0, "gz": 350.0})), 1000.0).first()
    assert [round(p["freq"], -1) for p in found["peaks"]] == [80, 150, 350]
    assert found["settings"]["mode"] == 4 and found["settings"]["enable"] == 1
    assert {p["param"] for p in found["native"]} >= {"INS_HNTCH_FREQ", "INS_GYRO_FILTER"}
    px4 = api.fft(api.Flights("px4", imu=imu_of(spark, {"gx": 80.0, "gy": 80.0, "gz": 350.0})), 1000.0).first()
    assert "static_notch_motor" in px4["warnings"] and px4["settings"]["freq2"] is not None
    assert vibration.one_line(F.lit(1), "px4") is not None


def test_filter_module(spark):
    params = spark.createDataFrame([("a", "INS_GYRO_FILTER", 40.0), ("a", "INS_HNTCH_ENABLE", 1.0), ("a", "INS_HNTCH_FREQ", 80.0), ("b", "INS_GYRO_FILTER", 100.0)], "flight_id string, name string, value double")
    flights = api.Flights("ardupilot", params=params)
    rows = {r["flight_id"]: r for r in api.filter(flights, 400.0).collect()}
    assert abs(rows["a"]["cutoff_3db_hz"] - 40) < 3 and abs(rows["b"]["cutoff_3db_hz"] - 100) < 1 and len(rows["a"]["curve"]) == 500
    assert len(rows["a"]["chain"]) == 2 and len(rows["b"]["chain"]) == 1
    deepest = min(rows["a"]["curve"], key=lambda x: x["magnitude_db"] if 60 < x["freq"] < 100 else 0)
    assert abs(deepest["freq"] - 80) < 2
    jumps = np.diff([x["phase_deg"] for x in rows["a"]["curve"]])
    assert np.abs(jumps).max() < 315
    manual = api.filter(flights, 400.0, gyro_filter_hz=20.0, notch_hz=60.0).first()
    assert manual["mode"] == "manual" and abs(manual["cutoff_3db_hz"] - 20) < 2
    assert [p["hz"] for p in manual["key_points"]] == [1.0, 5.0, 10.0, 20.0, 40.0, 80.0, 120.0]


def test_a_failing_module_ends_no_other(spark, tmp_path):
    good, broken = flight(spark, 250.0, axes=("roll", "pitch")), spark.createDataFrame([("a", 0, 0.0)], "flight_id string, idx long, t double")
    found = api.analyze(api.Flights("betaflight", pid=good, imu=broken, extra={"bad": lambda f: f.pid.select(F.assert_true(F.lit(False)).alias("x")), "rows": lambda f: f.pid.groupBy("flight_id").count()}), 1000.0)
    assert [(m, code) for m, code, _ in found.failures] == [("fft", "E5020")] and {"quality", "pid", "bad", "rows"} <= set(found.results)
    written = found.written(str(tmp_path / "out"))
    assert {m for m, _, _ in written.failures} == {"fft", "bad"} and written.results["rows"].first()["count"] == 5000
    with pytest.raises(api.AnalysisError) as none:
        api.analyze(api.Flights("px4"), 100.0)
    assert none.value.code == "E5098"
    with pytest.raises(api.AnalysisError) as failed:
        api.analyze(api.Flights("px4", imu=broken), 100.0, ["fft"])
    assert failed.value.code == "E5099"


def test_recommendations_of_all_modules(spark):
    pid, imu = flight(spark, 250.0, zeta=0.2), imu_of(spark, {"gx": 80.0, "gy": 80.0, "gz": 80.0})
    gains = spark.createDataFrame([("a", "roll", g, v) for g, v in (("p", 0.2), ("i", 0.1), ("d", 0.004))], "flight_id string, axis string, gain string, current double")
    flights = api.Flights("ardupilot", pid=pid, imu=imu)
    found = api.Analysis({"pid": api.pid(flights, gains, most=3), "fft": api.fft(flights, 1000.0)}, [])
    rows = api.recommendations(found).collect()
    assert {r["module"] for r in rows} == {"pid", "fft"} and 0 < sum(r["module"] == "pid" for r in rows) <= 3
    assert all(r["action"] == ("adjust" if r["module"] == "pid" else "set") for r in rows)


def test_validation_and_gates(spark):
    issues = {r["flight_id"]: r["issues"] for r in api.validation(api.Flights("ardupilot", pid=flight(spark, 250.0).where("idx < 50"), imu=imu_of(spark, {"gx": 80.0}, name="b"))).collect()}
    assert issues == {"a": ["pid_short", "gyro_short", "accel_short"], "b": ["no_pid"]}
    base = [(w, i, 10.0 if i >= 5 else 0.0, 10.0 if i >= 5 else 0.0, 5) for w in range(7) for i in range(40)]
    change = {1: lambda i, d, a: (d, math.nan if i == 7 else a), 2: lambda i, d, a: (d, 3000.0 if i == 7 else a), 3: lambda i, d, a: (d, 60.0 if i == 7 else a), 4: lambda i, d, a: (d, 45.0 if i == 7 else a), 5: lambda i, d, a: (d, 20.0 * (i % 2) if i < 5 else a), 6: lambda i, d, a: (0.0 if i > 20 else d, a)}
    rows = [(w, i, *(change[w](i, d, a) if w in change else (d, a)), s) for w, i, d, a, s in base] + [(9, i, 1.0, 1.0, 5) for i in range(10)]
    got = responses.step_window_reasons(spark.createDataFrame(rows, "w int, idx long, desired double, actual double, step long"), ["w"])
    assert {r["w"]: r["reason"] for r in got.select("w", "reason").distinct().collect()} == {0: "ok", 1: "not_finite", 2: "extreme_value", 3: "ratio", 4: "overshoot", 5: "baseline_unstable", 6: "several_steps", 9: "window_too_short"}


def messages(spark, rows):
    full = [("f", i, mtype, instance, us, us, 1, 1, i % 256, fields, text) for i, (mtype, instance, us, fields, text) in enumerate(rows)]
    return spark.createDataFrame(full, flightlog.SCHEMA)


def test_dataflash_tables(spark):
    rows = []
    for i in range(40):
        us = 1_000_000 + i * 100_000
        rows += [
            ("MAG", i % 2, us, {"MagX": 200.0, "MagY": -100.0, "MagZ": 300.0, "OfsX": 5.0, "MOX": 0.1}, None), ("ATT", 0, us, {"Roll": 1.0, "Pitch": 2.0, "Yaw": (350 + i) % 360.0}, None), ("BAT", 0, us + 50_000, {"Volt": 12.6, "Curr": float(i)}, None),
            ("RCOU", 0, us, {"C1": 1500.0, "C2": 0.0}, None), ("MODE", 0, us, {"ModeNum": 5.0}, None), ("GPS", 0, us, {"Lat": 50.0 + i, "Lng": 8.0, "Alt": 100.0, "Status": 3.0 if i < 21 else 1.0}, None),
        ]
    own = messages(spark, [*rows, ("PARM", 0, 5, {"Value": 0.135}, "ATC_RAT_RLL_P")])
    flights = api.Flights.from_messages(own, "dataflash")
    assert flights.mag.count() == 20 and flights.battery.first()["volt"] == 12.6
    assert [(r["channel"], r["output"]) for r in flights.motors.distinct().select("channel", "output").distinct().collect()] == [(1, 0.5)]
    assert flights.modes.first()["mode_name"] == "loiter" and flights.position.first()["lat"] == 60.0
    assert {r["name"]: r["value"] for r in flights.params.collect()} == {"ATC_RAT_RLL_P": 0.135, "pid.roll.p": 0.135}
    met = tables.with_current(flights.mag, flights.battery).orderBy("idx").collect()
    assert met[0]["curr"] == 0.0 and abs(met[5]["curr"] - 9.5) < 1e-9 and 0 <= met[5]["throttle"] <= 1
    turned = tables.with_field(flights.mag, flights.attitude, [F.lit(200.0), F.lit(0.0), F.lit(400.0)])
    assert turned.where("abs(sqrt(bx * bx + by * by + bz * bz) - sqrt(200 * 200 + 400 * 400)) > 1e-6").isEmpty() and turned.count() == 20
    assert api.magfit(api.Flights("ardupilot", mag=turned.withColumn("throttle", F.lit(0.0)))).count() == 1


def test_ulog_tables(spark):
    rows = []
    for i in range(30):
        us = 1000 + i * 4000
        rows += [
            ("sensor_combined", 0, us, {**{f"gyro_rad[{k}]": 0.1 for k in range(3)}, **{f"accelerometer_m_s2[{k}]": 1.0 for k in range(3)}, **{f"magnetometer_ga[{k}]": 0.2 for k in range(3)}}, None),
            ("battery_status", 0, us, {"voltage_v": 15.0, "current_a": 3.0}, None), ("vehicle_attitude", 0, us, {"q[0]": 1.0, "q[1]": 0.0, "q[2]": 0.0, "q[3]": 0.0}, None), ("actuator_outputs", 0, us, {"output[0]": 1500.0, "output[1]": 0.0}, None),
            ("vehicle_gps_position", 0, us, {"lat": 500_000_000.0, "lon": 80_000_000.0, "alt": 250_000.0}, None),
        ]
    flights = api.Flights.from_messages(messages(spark, [*rows, ("parameter", 0, None, {"value": 0.15}, "MC_ROLLRATE_P")]), "ulog")
    assert abs(flights.imu.first()["gx"] - math.degrees(0.1)) < 1e-9 and abs(flights.mag.first()["mx"] - 200.0) < 1e-9
    assert flights.attitude.first()["yaw"] == 0.0 and [(r["channel"], r["output"]) for r in flights.motors.select("channel", "output").distinct().collect()] == [(1, 0.5)]
    place = flights.position.first()
    assert (place["lat"], place["lon"], place["alt"]) == (50.0, 8.0, 250.0)
    assert {r["name"] for r in flights.params.collect()} == {"MC_ROLLRATE_P", "pid.roll.p"}


def test_telemetry_tables(spark):
    rows = [("HEARTBEAT", 0, None, {"type": 2.0, "custom_mode": 0.0}, None)]
    for i in range(40):
        us = 1_000_000 + i * 100_000
        rows += [("ATTITUDE", 0, us, {"roll": 0.1, "pitch": 0.0, "yaw": 0.0, "rollspeed": 0.1 * i, "pitchspeed": 0.0, "yawspeed": 0.0}, None), ("ATTITUDE_TARGET", 0, us, {"body_roll_rate": 0.1 * i, "body_pitch_rate": 0.0, "body_yaw_rate": 0.5}, None), ("SERVO_OUTPUT_RAW", 0, us, {f"servo{k}_raw": 1250.0 if k < 5 else 0.0 for k in range(1, 9)}, None)]
    rows += [("PARAM_VALUE", 0, None, {"param_value": 0.2}, "ATC_RAT_PIT_P"), ("HEARTBEAT", 0, None, {"type": 2.0, "custom_mode": 5.0}, None), ("GPS_RAW_INT", 0, 9_000_000, {"lat": 5e8, "lon": 8e7, "alt": 1e5, "fix_type": 3.0}, None)]
    flights = api.Flights.from_messages(messages(spark, rows), "telemetry")
    roll = flights.pid.where("axis = 'roll'")
    assert roll.count() == 40 and roll.where("abs(desired - actual) > 1e-6").isEmpty()
    assert flights.motors.select("channel").distinct().count() == 4 and flights.motors.first()["output"] == 0.25
    assert [r["mode_name"] for r in flights.modes.orderBy("idx").collect()] == ["stabilize", "loiter"]
    assert {r["name"] for r in flights.params.collect()} == {"ATC_RAT_PIT_P", "pid.pitch.p"} and abs(flights.position.first()["lat"] - 50) < 1e-9
    short = api.Flights.from_messages(messages(spark, rows[:8]), "telemetry")
    assert short.pid.count() == 0


def test_mode_flags(spark):
    got = spark.range(1).select(*(tables.betaflight_mode(F.lit(v)).alias(str(v)) for v in (0, 1, 3, 5, 1 + (1 << 15)))).first()
    assert list(got) == ["disarmed", "acro", "stabilize", "horizon", "failsafe"]


def test_unsafe_and_broken_files_give_error_rows(spark, tmp_path):
    inside, outside = tmp_path / "in", tmp_path / "out"
    inside.mkdir(), outside.mkdir()
    (inside / "a.bin").write_bytes(dataflash())
    (inside / "junk.bin").write_bytes(b"junk")
    (inside / "big.bin").write_bytes(b"\0" * 200_000)
    (outside / "secret.bin").write_bytes(dataflash())
    os.symlink(outside / "secret.bin", inside / "link.bin")
    (inside / "notes.doc").write_bytes(b"x")
    rows = flightlog.read_logs(spark, str(inside), "dataflash", roots=[str(inside)], most_bytes=100_000)
    errors = {r["path"].rpartition("/")[2]: r["error"].split(":")[0] for r in rows.where("error is not null").collect()}
    assert errors == {"junk.bin": "E1005", "big.bin": "E1002", "link.bin": "E1001", "notes.doc": "E1001"}
    assert rows.where("error is null").count() == 92 and ingest.dataflash_params(rows.where("error is null")).count() == 1
    assert files.resolves_inside(str(inside / "a.bin"), [str(inside)]) and not files.resolves_inside(str(inside / "link.bin"), [str(inside)]) and not files.resolves_inside(str(inside), [str(tmp_path)])
    (inside / "t.tlog").write_bytes(telemetry())
    assert flightlog.read_logs(spark, str(inside / "*.tlog"), "telemetry").count() == 32


def test_segments_of_a_log_are_flights(spark, tmp_path):
    (a, first), (b, second) = segment(40), segment(20, 2)
    (tmp_path / "one.bbl").write_bytes(a + b)
    (tmp_path / "bad.bbl").write_bytes(b"H Product:Blackbox flight data recorder by Nicholas Sherlock\nH looptime:250\n")
    frames = blackbox.read_blackbox(spark, str(tmp_path / "one.bbl"))
    heads = blackbox.read_blackbox(spark, str(tmp_path / "one.bbl"), headers=True)
    assert frames.where("kind in ('I', 'P')").count() == len(first) + len(second) and heads.count() == 2
    pid = ingest.blackbox_pid(frames, heads)
    assert {r["flight_id"].rpartition("#")[2]: r["n"] for r in pid.groupBy("flight_id").agg(F.count("*").alias("n")).collect()} == {"0": 40, "1": 20}
    assert pid.groupBy("flight_id", "axis").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d")).where("n <> d").isEmpty()
    cut = blackbox.read_blackbox(spark, str(tmp_path / "one.bbl"), most_frames=10, most_segments=1)
    assert sorted((r["kind"], sorted(r["values"])) for r in cut.where("kind = 'cut'").collect()) == [("cut", ["bytes_left"]), ("cut", ["segments_left"])]
    assert cut.where("kind in ('I', 'P')").count() == 10
    assert blackbox.read_blackbox(spark, str(tmp_path / "bad.bbl")).first()["error"].startswith("E100")


def test_listing_is_guarded(spark):
    rows = spark.createDataFrame([("ATC_P", "ATC", "tuning", "float", 0.0, 1.0, "gain", None), ("LOG", "LOG", "misc", "enum", None, None, "", {"0": "off"})], "name string, group string, category string, type string, min double, max double, description string, members map<string,string>")
    with pytest.raises(ValueError, match="2 groups"):
        catalog.listing(rows)
    got = catalog.listing(rows, category="MISC").first()
    assert (got["name"], got["enum_count"], got["range"], got["summary"]) == ("LOG", 1, None, None)
    assert "enum" in catalog.full(rows).where("name = 'LOG'").first()["definition"]


def test_user_layers_over_the_rules(spark, tmp_path):
    low, high = tmp_path / "common", tmp_path / "own"
    low.mkdir(), high.mkdir()
    (low / "a.json").write_text('{"thresholds": {"roll": {"overshoot_percent": {"max": 40}}}, "tuning_rules": {"not": "a list"}}')
    (low / "broken.json").write_text("{")
    (high / "b.json").write_text('{"thresholds": {"roll": {"overshoot_percent": {"max": 60}}}, "tuning_rules": [{"symptom": "overshoot", "gain": "p", "factor": 0.8}, {"symptom": "unheard", "gain": "p", "factor": 2}], "pid_bounds": {"ardupilot": {"p": [0.02, 0.3]}}}')
    found = rules.load([str(low), str(high)])
    assert found.limits["roll"][1] == (0, 60, 5) and found.limits["pitch"] == responses.LIMITS["pitch"] and found.rules == [("overshoot", "overshoot_percent", "p", 0.8)]
    assert found.bounds["ardupilot"]["p"] == (0.02, 0.3) and found.bounds["ardupilot"]["i"] == responses.BOUNDS["ardupilot"]["i"] and len(found.skipped) == 1
    (high / "c.json").write_text('{"thresholds": {"overshoot_percent": {"roll": 3}}}')
    assert not rules.by_axis({"overshoot_percent": {"roll": 3}}) and rules.load([str(high)]).limits["roll"][1] == (0, 60, 5)
    log = flight(spark, 250.0, zeta=0.3)
    gains = spark.createDataFrame([("a", "roll", "p", 0.2)], "flight_id string, axis string, gain string, current double")
    own, default = (api.pid(api.Flights("ardupilot", pid=log), gains, rules=r).first() for r in (found, None))
    assert default["score"] < own["score"]


def test_a_calibration_keeps_its_bounds(spark):
    rng = np.random.default_rng(5)
    b = rng.normal(size=(400, 3)) * 300
    raw = b / np.array([0.1, 1.0, 1.0]) - np.array([50.0, -20.0, 10.0])  # a diagonal term far under its bound
    rows = spark.createDataFrame(pd.DataFrame({"k": 1, "rx": raw[:, 0], "ry": raw[:, 1], "rz": raw[:, 2], "bx": b[:, 0], "by": b[:, 1], "bz": b[:, 2], "th": 0.0}))
    fit = models.calibrate(models.field_gram(rows, ["k"], ("rx", "ry", "rz"), ("bx", "by", "bz"), "th"), ["k"]).first()
    assert not fit["in_bounds"] and abs(fit["diagonal"][0] - 0.3) < 1e-9 and abs(fit["diagonal"][1] - 1) < 0.05 and max(map(abs, fit["offset"])) <= 2000
    best = minimum(raw, b)
    assert fit["rmse"] <= best * 1.02


def minimum(raw, b):
    """Root of the mean square of the residuals of the best offset for a diagonal (0.3, 1, 1)."""
    m = np.diag([0.3, 1.0, 1.0])
    left = b - raw @ m
    return float(np.sqrt(((left - left.mean(axis=0)) ** 2).sum() / left.size))


def test_quality_and_hardware_of_a_flight(spark):
    log, imu = flight(spark, 250.0, axes=("roll", "pitch")), imu_of(spark, {"gx": 80.0})
    params = spark.createDataFrame([("a", "INS_GYR_ID", 2752259.0), ("a", "INS_GYROFFS_X", 0.01), ("a", "COMPASS_DEV_ID", 97539.0), ("a", "COMPASS_OFS_Y", 12.0), ("a", "ATC_RAT_RLL_P", 0.135), ("a", "INS_GYRO_FILTER", 40.0)], "flight_id string, name string, value double")
    flights = api.Flights("ardupilot", pid=log, imu=imu, params=tables.mirrored(params, "ardupilot"))
    row = api.quality(flights).first()
    assert row["issues"] == ["mag_missing", "motors_missing", "battery_missing", "very_short"] and row["score"] == 55 and row["rating"] == "MARGINAL" and row["n_steps"] == 8 and round(row["rate_hz"]) == 250
    report = api.hardware(flights).first()
    assert [i["gyro_id"] for i in report["imus"]] == [2752259.0] and [c["offset"] for c in report["compasses"]] == [[0.0, 12.0, 0.0]]
    assert report["gains"][0]["p"] == 0.135 and report["filters"] == ["low-pass 40 Hz"] and len(report["devices"]) == 2


def test_betaflight_flight(spark):
    """Terms, a motor tone and parameters of five seconds at 1 kHz."""
    rate, n = 1000.0, 5000
    rng = np.random.default_rng(3)
    u = np.repeat([0, 200, 0, 200, 0], n // 5).astype(float)
    y = second_order(u, rate, omega=60.0, zeta=0.6)
    rows = [pd.DataFrame({"flight_id": "b", "axis": a, "idx": range(n), "t": np.arange(n) / rate, "desired": u, "actual": y, "p": 45 * (u - y) / 100, "i": 1.0, "d": noise * rng.normal(size=n), "ff": 0.0}) for a, noise in (("roll", 1.0), ("yaw", 80.0))]
    params = spark.createDataFrame([("b", "gyro_lpf1_static_hz", 150.0), ("b", "gyro_lowpass_hz", 150.0), ("b", "rpm_filter", 0.0)], "flight_id string, name string, value double")
    flights = api.Flights("betaflight", pid=spark.createDataFrame(pd.concat(rows)), imu=imu_of(spark, {"gx": 150.0, "gy": 150.0, "gz": 150.0}, name="b"), params=params)
    found = api.analyze(flights, rate)
    assert not found.failures and {"pid", "fft", "filter", "quality", "hardware", "feed_forward", "d_term", "rpm_filter"} == set(found.results)
    terms = {r["axis"]: r for r in found.results["d_term"].collect()}
    assert terms["yaw"]["assessment"] == "POOR" and terms["yaw"]["high_share"] > 0.5 and terms["yaw"]["d_to_p"] > terms["roll"]["d_to_p"]
    forward = {r["axis"]: r for r in found.results["feed_forward"].collect()}
    assert forward["roll"]["steps"] == 4 and forward["roll"]["ff_percent"] == 0.0 and forward["roll"]["factor"] == 1.2
    motor = found.results["rpm_filter"].first()
    assert not motor["rpm_filter"] and motor["above_floor"] > 20 and motor["assessment"] == "MARGINAL" and abs(motor["lowpass"] - 105) < 1e-9
    assert found.results["filter"].first()["cutoff_3db_hz"] is not None and any(abs(p["freq"] - 150) < 2 for p in found.results["fft"].first()["peaks"])


def test_telemetry_without_raw_sensors(spark):
    rows = [("HEARTBEAT", 0, None, {"type": 2.0, "custom_mode": 0.0}, None)] + [("ATTITUDE", 0, 1_000_000 + i * 100_000, {"rollspeed": 0.1, "pitchspeed": 0.0, "yawspeed": 0.0, "roll": 0.0, "pitch": 0.0, "yaw": 0.0}, None) for i in range(12)]
    imu = ingest.telemetry_imu(messages(spark, rows))
    assert imu.count() == 12 and abs(imu.first()["gx"] - math.degrees(0.1)) < 1e-9 and imu.first()["ax"] is None
    scaled = [("SCALED_IMU", 0, 1_000_000 + i * 100_000, {"xgyro": 100.0, "ygyro": 0.0, "zgyro": 0.0, "xacc": 0.0, "yacc": 0.0, "zacc": 1000.0}, None) for i in range(5)]
    both = ingest.telemetry_imu(messages(spark, rows + scaled))
    assert both.count() == 5 and abs(both.first()["az"] - 9.80665) < 1e-9
