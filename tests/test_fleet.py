"""Analyses that start from the messages of logs, which interleave, and from fleets whose flights have rates of their own."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake import api
from aerolake.operators import attitude, geomagnetic
from aerolake.sources import flightlog
from tests.test_api import flight, imu_of
from tests.test_library import second_order


def log_of(spark, path, rows):
    """Messages of one log in the order of their times."""
    rows = sorted(rows, key=lambda r: r[2])
    full = [(path, i, mtype, instance, us, us, 1, 1, i % 256, fields, text) for i, (mtype, instance, us, fields, text) in enumerate(rows)]
    return spark.createDataFrame(full, flightlog.SCHEMA)


def imu_rows(kind, rate, n, tone):
    t = np.arange(n) / rate
    wave = np.sin(2 * np.pi * tone * t)
    out = []
    for i in range(n):
        us = int(1e6 + 1e6 * t[i])
        if kind == "dataflash":
            out.append(("IMU", 0, us, {"GyrX": float(wave[i]), "GyrY": 0.0, "GyrZ": 0.0, "AccX": 0.0, "AccY": 0.0, "AccZ": 9.81}, None))
        elif kind == "ulog":
            out.append(("sensor_combined", 0, us, {"gyro_rad[0]": float(wave[i]), "gyro_rad[1]": 0.0, "gyro_rad[2]": 0.0, **{f"accelerometer_m_s2[{k}]": 0.0 for k in range(3)}}, None))
        else:
            out.append(("RAW_IMU", 0, us, {"xgyro": 1000 * float(wave[i]), "ygyro": 0.0, "zgyro": 0.0, "xacc": 0.0, "yacc": 0.0, "zacc": 1000.0, "xmag": 0.0, "ymag": 0.0, "zmag": 0.0}, None))
    return out


def noise_of(kind, rows, every):
    """``every`` other messages between two of these."""
    name = {"dataflash": "CTUN", "ulog": "cpuload", "telemetry": "VFR_HUD"}[kind]
    return [(name, 0, us + 1 + k, {"x": 1.0}, None) for _, _, us, _, _ in rows for k in range(every)]


@pytest.mark.parametrize("kind", ["dataflash", "ulog", "telemetry"])
def test_peaks_of_interleaved_logs(spark, kind):
    rows = imu_rows(kind, 1000.0, 3000, 80.0)
    found = {}
    for every in (0, 3):
        flights = api.Flights.from_messages(log_of(spark, "a", rows + noise_of(kind, rows, every)), kind)
        found[every] = api.fft(flights).first()
    assert found[0]["peaks"] == found[3]["peaks"] and abs(found[0]["rate_hz"] - 1000) < 1e-6
    assert abs(max(found[3]["peaks"], key=lambda p: p["magnitude"])["freq"] - 80) < 1


def test_each_flight_has_its_own_rate(spark):
    fleet = imu_of(spark, {"gx": 80.0}, 400.0, 3000, "slow").unionByName(imu_of(spark, {"gx": 900.0}, 4000.0, 12_000, "fast"))
    found = {r["flight_id"]: r for r in api.fft(api.Flights("ardupilot", imu=fleet.withColumn("idx", 7 * F.col("idx"))), over=15.0).collect()}
    for name, rate, tone in (("slow", 400.0, 80.0), ("fast", 4000.0, 900.0)):
        top = max(found[name]["peaks"], key=lambda p: p["magnitude"])
        assert abs(found[name]["rate_hz"] - rate) < 1e-6 and abs(top["freq"] - tone) < 1.1
    given = spark.createDataFrame([("slow", 800.0), ("fast", 4000.0)], "flight_id string, rate_hz double")
    twice = {r["flight_id"]: r for r in api.fft(api.Flights("ardupilot", imu=fleet), given, 15.0).collect()}
    assert abs(max(twice["slow"]["peaks"], key=lambda p: p["magnitude"])["freq"] - 160) < 2


def pid_rows(kind, rate, seconds=10.0):
    n = int(rate * seconds)
    u = np.repeat([0, 50, 0, 50, 0], n // 5).astype(float)
    y = second_order(u, rate, omega=40.0, zeta=0.7)
    rows = []
    for i, (a, b) in enumerate(zip(u, y, strict=True)):
        us = int(1e6 + 1e6 * i / rate)
        if kind == "dataflash":
            rows.append(("PIDR", 0, us, {"Tar": float(a), "Act": float(b), "P": 0.0, "I": 0.0, "D": 0.0, "FF": 0.0}, None))
        elif kind == "ulog":
            rows += [("vehicle_rates_setpoint", 0, us, {"roll": math.radians(a), "pitch": 0.0, "yaw": 0.0}, None), ("vehicle_angular_velocity", 0, us, {"xyz[0]": math.radians(b), "xyz[1]": 0.0, "xyz[2]": 0.0}, None)]
        else:
            rows += [("ATTITUDE_TARGET", 0, us, {"body_roll_rate": math.radians(a), "body_pitch_rate": 0.0, "body_yaw_rate": 0.0}, None), ("ATTITUDE", 0, us, {"rollspeed": math.radians(b), "pitchspeed": 0.0, "yawspeed": 0.0, "roll": 0.0, "pitch": 0.0, "yaw": 0.0}, None)]
    return rows


@pytest.mark.parametrize("kind", ["dataflash", "ulog", "telemetry"])
def test_windows_of_interleaved_logs(spark, kind):
    rows = pid_rows(kind, 250.0)
    found = {}
    for every in (0, 11):
        flights = api.Flights.from_messages(log_of(spark, "a", rows + noise_of(kind, rows, every)), kind)
        found[every] = api.pid(flights).where("axis = 'roll'").first()
    assert found[0]["windows"] == 4 and found[0].asDict() == found[11].asDict()


def test_spacing_follows_the_rate(spark):
    at = {rate: api.quality(api.Flights("ardupilot", pid=flight(spark, rate))).first()["n_steps"] for rate in (50.0, 1000.0)}
    assert at[50.0] == at[1000.0] == 4


def test_slow_series_are_averaged_step_by_step(spark):
    n, y = 600, [0.0]
    u = np.repeat([0, 50, 0, 50, 0], n // 5).astype(float)
    for x in u[:-1]:
        y.append(0.5 * y[-1] + 0.5 * float(x))
    slow = spark.createDataFrame([("slow", "roll", i, i / 10, float(u[i]), y[i]) for i in range(n)], "flight_id string, axis string, idx long, t double, desired double, actual double")
    fleet = slow.unionByName(flight(spark, 400.0, 10.0, "fast"))
    rows = api.step_response(api.Flights("ardupilot", pid=fleet.withColumn("idx", 3 * F.col("idx") + 1)))
    methods = {r["flight_id"]: (r["method"], r["windows"], r["steady_ok"]) for r in rows.select("flight_id", "method", "windows", "steady_ok").distinct().collect()}
    assert methods["slow"] == ("time_domain", 4, True) and methods["fast"][0] == "wiener" and methods["fast"][1] > 0
    slow = {r["lag"]: r["response"] for r in rows.where("flight_id = 'slow'").collect()}
    assert len(slow) in (14, 15) and abs(slow[0]) < 0.05 and abs(slow[13] - 1) < 0.05


def test_filters_by_rate_and_compared(spark):
    params = spark.createDataFrame([(f, "INS_GYRO_FILTER", 40.0) for f in ("a", "b", "c")] + [("b", "INS_HNTCH_ENABLE", 1.0), ("b", "INS_HNTCH_OPTS", 16.0)], "flight_id string, name string, value double")
    fleet = imu_of(spark, {"gx": 80.0}, 400.0, 500, "a").unionByName(imu_of(spark, {"gx": 80.0}, 2000.0, 500, "b"))
    flights = api.Flights("ardupilot", imu=fleet, params=params)
    found = {r["flight_id"]: r for r in api.filter(flights).collect()}
    assert {f: round(r["rate_hz"]) for f, r in found.items()} == {"a": 400, "b": 2000, "c": 400}
    assert [p["hz"] for p in found["b"]["key_points"]][-1] == 200 and found["a"]["key_points"][-1]["hz"] == 120
    assert abs(found["b"]["curve"][-1]["freq"] - 1000) < 1e-3
    compared = {r["flight_id"]: r for r in api.compare_filters(flights, {"ins_gyro_filter": 20.0}).collect()}
    assert compared["a"]["cutoff_after"] < compared["a"]["cutoff_before"] and "20 Hz" in compared["a"]["chain_after"][0]
    at = {p["hz"]: p for p in compared["a"]["difference"]}
    assert at[40.0]["magnitude_db"] < -6 and at[40.0]["phase_deg"] < 0 and abs(at[1.0]["magnitude_db"]) < 0.1


#: Published test values of a world model of the same epoch, at the ellipsoid: north, east, down in nT; fixed values.
KNOWN = [(80.0, 0.0, 6570.4, -146.3, 54606.0), (0.0, 120.0, 39624.3, 109.9, -10932.5), (-80.0, 240.0, 5940.6, 15772.1, -52480.8)]


def test_field_at_known_places(spark):
    rows = [(k, a, b, 0.0) for k, (a, b, *_) in enumerate(KNOWN)] + [(10, 0.0, 120.0 - 360, None), (11, 91.0, 0.0, 0.0), (12, None, 0.0, 0.0), (13, 90.0, 0.0, 0.0)]
    places = spark.createDataFrame(rows, "id int, lat double, lon double, alt double")
    found = {r["id"]: r for r in geomagnetic.model_field(places).collect()}
    for k, (_, _, *want) in enumerate(KNOWN):
        # Degrees above 6 hold the rest.
        assert all(abs(100 * found[k][n] - w) < 700 for n, w in zip(("north", "east", "down"), want, strict=True)), (found[k], want)
    assert abs(found[10]["north"] - found[1]["north"]) < 1e-9 and found[11]["north"] is None and found[12]["intensity"] is None and 500 < found[13]["intensity"] < 620
    later = geomagnetic.model_field(places.where("id = 1"), 2025.0).first()
    assert 0.5 < abs(later["north"] - found[1]["north"]) < 5
    on_grid = {r["id"]: r for r in attitude.field_at(places, geomagnetic.field_grid(spark)).collect()}
    assert abs(on_grid[1]["north"] - found[1]["north"]) < 1e-6 and abs(on_grid[10]["down"] - found[1]["down"]) < 1e-6 and on_grid[11]["north"] is None
    fallen = {r["id"]: r for r in attitude.expected_field(places).collect()}
    assert fallen[11]["north"] > 0 and fallen[12]["down"] > 0


def test_coefficient_files(spark, tmp_path):
    (tmp_path / "model.cof").write_text("    2020.0            OWN        01/01/2020\n  1  0  -29404.5       0.0        6.7        0.0\n  1  1   -1450.7    4652.9        7.7      -25.1\n" + "9" * 48 + "\n")
    epoch, model = geomagnetic.read_coefficients(spark, str(tmp_path / "model.cof"))
    assert epoch == 2020.0 and model == [(1, 0, -29404.5, 0.0, 6.7, 0.0), (1, 1, -1450.7, 4652.9, 7.7, -25.1)]
    place = spark.createDataFrame([(0.0, 0.0, 0.0)], "lat double, lon double, alt double")
    assert abs(geomagnetic.model_field(place, 2020.0, model, epoch).first()["north"] - 294.0) < 3


OFFSET, LAT, LON, ALT = np.array([120.0, -80.0, 45.0]), 47.0, 8.5, 400.0


def turning_flight(kind, n=1200, position="own"):
    """Messages of a flight that turns through all attitudes with an offset magnetometer; other messages between."""
    field = geomagnetic.harmonics(np.array([LAT]), np.array([LON]), np.array([ALT]), np.zeros(1), geomagnetic.terms())[:, 0] / 100
    rows = []
    for i in range(n):
        us, yaw, pitch, roll = 1_000_000 + 50_000 * i, (i * 3.1) % 360, 60 * math.sin(i / 40), 170 * math.sin(i / 95)
        cr, sr, cp, sp, cy, sy = (f(math.radians(x)) for x in (roll, pitch, yaw) for f in (math.cos, math.sin))
        turn = np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])
        mag = turn.T @ field - OFFSET
        w, x, y, z = (cr2 for cr2 in quaternion(roll, pitch, yaw))
        if kind == "dataflash":
            rows += [("MAG", 0, us, {f"Mag{a}": float(v) for a, v in zip("XYZ", mag, strict=True)}, None), ("ATT", 0, us, {"Roll": roll, "Pitch": pitch, "Yaw": yaw}, None), ("CTUN", 0, us + 7, {"x": 1.0}, None)]
            rows += [("BAT", 0, us + 9, {"Volt": 12.0, "Curr": 5.0 + i * 37 % 11}, None)]
        elif kind == "ulog":
            rows += [("sensor_mag", 0, us, {a: float(v) / 1000 for a, v in zip("xyz", mag, strict=True)}, None), ("vehicle_attitude", 0, us, {f"q[{k}]": v for k, v in enumerate((w, x, y, z))}, None), ("cpuload", 0, us + 7, {"x": 1.0}, None)]
        else:
            rows += [("RAW_IMU", 0, us, {**{f"{a}mag": float(v) for a, v in zip("xyz", mag, strict=True)}, **{f"{a}{s}": 0.0 for a in "xyz" for s in ("gyro", "acc")}}, None), ("ATTITUDE", 0, us, {"roll": math.radians(roll), "pitch": math.radians(pitch), "yaw": math.radians(yaw), "rollspeed": 0.0, "pitchspeed": 0.0, "yawspeed": 0.0}, None)]
    place = {"dataflash": ("GPS", {"Lat": LAT, "Lng": LON, "Alt": ALT, "Status": 3.0}), "ulog": ("vehicle_gps_position", {"lat": LAT * 1e7, "lon": LON * 1e7, "alt": ALT * 1e3}), "telemetry": ("GPS_RAW_INT", {"lat": LAT * 1e7, "lon": LON * 1e7, "alt": ALT * 1e3, "fix_type": 3.0})}[kind]
    place = {"own": place, "origin": ("ORGN", {"Lat": LAT, "Lng": LON, "Alt": ALT}), "estimate": ("AHR2", {"Lat": LAT, "Lng": LON, "Alt": ALT}), "none": None}[position]
    return rows + ([(place[0], 0, 2_000_003, place[1], None)] if place else [])


def quaternion(roll, pitch, yaw):
    cr, sr, cp, sp, cy, sy = (f(math.radians(x) / 2) for x in (roll, pitch, yaw) for f in (math.cos, math.sin))
    return cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy


@pytest.mark.parametrize(("kind", "position"), [("dataflash", "own"), ("dataflash", "origin"), ("dataflash", "estimate"), ("ulog", "own"), ("telemetry", "own")])
def test_calibration_from_a_log(spark, kind, position):
    flights = api.Flights.from_messages(log_of(spark, "a", turning_flight(kind, position=position)), kind)
    found = api.magfit(flights).first()
    assert all(abs(a - b) < 3 for a, b in zip(found["offset"], OFFSET, strict=True)), found
    assert found["has_position"] and found["rmse"] < 3 and "no_position" not in found["notes"] and found["n"] == 1200
    if kind == "dataflash":
        assert "magfit" in api.analyze(flights).results


def test_calibration_without_a_place(spark):
    flights = api.Flights.from_messages(log_of(spark, "a", turning_flight("dataflash", position="none")), "dataflash")
    found = api.magfit(flights).first()
    assert found["has_position"] is False and "no_position" in found["notes"] and found["n"] == 1200
    flights.attitude = None
    assert [(m, c) for m, c, _ in api.analyze(flights, modules=["magfit", "hardware"]).failures] == [("magfit", "E5030")]


def test_a_recorded_link_is_judged(spark):
    rows = [("HEARTBEAT", 0, 1_000_000, {"type": 2.0, "custom_mode": 0.0}, None)]
    for i in range(60):
        us = 1_000_000 + 100_000 * i + (9_000_000 if i >= 30 else 0)
        rows += [("ATTITUDE", 0, us, {"roll": 0.0, "pitch": 0.0, "yaw": 0.0, "rollspeed": 0.1, "pitchspeed": 0.0, "yawspeed": 0.0}, None), ("ATTITUDE_TARGET", 0, us + 5, {"body_roll_rate": 0.1 * (i % 9), "body_pitch_rate": 0.0, "body_yaw_rate": 0.0}, None)]
    flights = api.Flights.from_messages(log_of(spark, "a", rows), "telemetry")
    health = flights.health.first()
    assert {"terms_missing", "telemetry_rate", "gyro_from_attitude", "no_accelerometer", "no_parameters", "link_gaps"} <= set(health["notes"]) and "dropped_frames" not in health["notes"] and health["penalty"] == 15
    judged, plain = api.quality(flights).first(), None
    flights.health = None
    plain = api.quality(flights).first()
    assert judged["score"] == max(0, plain["score"] - 15) and set(judged["issues"]) == set(plain["issues"]) | set(health["notes"])


def test_reports_of_every_platform(spark):
    from aerolake.sources import sinks

    named = {"betaflight": [("looptime", 125.0), ("pid_process_denom", 2.0), ("gyro_lpf1_static_hz", 250.0), ("gyro_notch1_hz", 0.0), ("p_roll", 45.0)], "px4": [("IMU_GYRO_CUTOFF", 40.0), ("MC_ROLLRATE_P", 0.15)], "ardupilot": [("SCHED_LOOP_RATE", 400.0), ("INS_GYRO_FILTER", 20.0), ("ATC_RAT_RLL_P", 0.135)]}
    want = {"betaflight": (8000.0, 4000.0, {"gyro_lpf1_static_hz": 250.0}, 45.0, 5), "px4": (None, None, {"IMU_GYRO_CUTOFF": 40.0}, 0.15, 2), "ardupilot": (400.0, None, {"INS_GYRO_FILTER": 20.0}, 0.135, 3)}
    from aerolake.operators import tables

    for platform, values in named.items():
        params = tables.mirrored(spark.createDataFrame([("a", *v) for v in values], "flight_id string, name string, value double"), platform)
        flights = api.Flights(platform, params=params, pid=flight(spark, 250.0))
        found = api.hardware(flights).first()
        assert (found["loop_rate_hz"], found["pid_rate_hz"], found["filter_settings"], found["gains"][0]["p"], found["total_params"]) == want[platform] and found["issues"] == ["gyro_short", "accel_short"]
    more = api.analyze(flights, modules=["validation", "hardware", "filter"]).results
    assert set(more) == {"validation", "hardware", "filter"}
    report = sinks.module_report({"hardware": more["hardware"], "filter": more["filter"]}).first()["report"]
    assert report.startswith("# Flight report") and report.index("## hardware") < report.index("## filter") and "loop_rate_hz" in report


def test_steps_on_the_gyros_grid(spark):
    slow = flight(spark, 100.0)
    fast = flight(spark, 1000.0).where("axis = 'roll'")
    imu = fast.select("flight_id", "idx", "t", F.col("actual").alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.0).alias("gz"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(9.81).alias("az"))
    flights = api.Flights("ardupilot", pid=slow, imu=imu)
    grid = api.on_imu_grid(flights).where("axis = 'roll'")
    got = {r["idx"]: r for r in grid.collect()}
    assert len(got) == 9991 and abs(got[5]["t"] - 0.005) < 1e-9
    own = {r["idx"]: r["actual"] for r in fast.where("idx < 9000").collect()}
    assert max(abs(got[i]["actual"] - v) for i, v in own.items()) < 1e-6
    found = api.step_response(flights, prefer_imu=True).where("axis = 'roll'").select("rate_hz", "method").distinct().collect()
    assert [(round(r["rate_hz"]), r["method"]) for r in found] == [(1000, "wiener")]


def test_errors_are_explained(spark):
    from aerolake.functions import errors

    rows = spark.createDataFrame([("E1004: unknown_format",), ("E5030: AnalysisError: no",), ("odd",), (None,)], "error string")
    got = [r["error"] for r in errors.with_errors(rows).collect()]
    assert got[0]["family"] == "log_file" and got[0]["name"] == "unknown_format" and got[0]["hint"] and got[1]["message"] == "AnalysisError: no" and got[2]["code"] is None and got[2]["message"] == "odd" and got[3] is None
    assert errors.table(spark).where("family = 'analysis'").count() == 9
    only = api.Flights("ardupilot", pid=flight(spark, 250.0))
    told = api.analyze(only, modules=["pid", "magfit", "fft", "coverage"])
    assert set(told.results) == {"pid"} and {(m, c) for m, c, _ in told.failures} == {("magfit", "E3004"), ("fft", "E3001"), ("coverage", "E3005")}
