from __future__ import annotations

import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolake import api
from aerolake.functions import units
from aerolake.operators import attitude, catalog, filters, models, spectral
from aerolake.plans import registry
from aerolake.sources import params, sinks
from aerolake.streaming import flights as live
from tests.oracle import same_rows


def one(df):
    return df.first().asDict()


def second_order(u, rate, omega=55.0, zeta=0.5):
    y, v, x, dt = np.zeros(len(u)), 0.0, 0.0, 1 / rate
    for k in range(len(u)):
        v += dt * (omega**2 * (u[k] - x) - 2 * zeta * omega * v)
        x += dt * v
        y[k] = x
    return y


def levels(n, rate, seed=42, most=120.0):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.uniform(-most, most, 12), n // 12 + 1)[:n] + rng.normal(0, 0.08 * most, n)


def test_step_response_settles_and_orders_damping():
    u = levels(12_000, 1000)
    mild, hard = (spectral.step_response(u, second_order(u, 1000, zeta=z), 1000.0) for z in (1.2, 0.3))
    assert mild[1] > 0 and 0.8 < mild[0][200:].mean() < 1.2 and mild[0].max() < 1.25
    assert hard[0].max() > 1.04 * mild[0].max()


def test_weak_excitation_gives_no_window():
    u = np.clip(levels(10_000, 1000, seed=3), -15, 15)
    assert spectral.step_response(u, u, 1000.0)[1] == 0


@pytest.mark.parametrize("n", [3050, 3000, 2100, 130, 40])
def test_segments_do_not_change_a_response(spark, n):
    u = levels(n, 100, seed=5)
    y = second_order(u, 100, omega=20.0)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "idx": 7 + np.arange(n), "desired": u, "actual": y}))
    whole, windows = spectral.step_response(u, y, 100.0)
    assert windows > 0 or n < 64
    for segment in (1000, 1 << 16):
        got = spectral.wiener_step(df, ["k"], 100.0, segment=segment).orderBy("lag").collect()
        assert len(got) == len(whole) and {r["windows"] for r in got} == {windows}
        assert np.allclose([r["response"] or 0.0 for r in got], whole, atol=1e-12)


def test_peak_at_a_known_frequency():
    t = np.arange(400) / 400
    s = spectral.amplitude_spectra((2 * np.sin(2 * np.pi * 80 * t) + np.random.default_rng(1).normal(0, 0.1, 400))[None], 400.0, "dbfs")[0]
    assert spectral.find_peaks(s, np.median(s) + 30, 15, 3)[0][0] == 80
    assert (spectral.amplitude_spectra(np.zeros((1, 64)), 100.0, "dbfs") == -120).all()


def test_arx_recovers_a_plant(spark):
    rng = np.random.default_rng(1)
    u, y = rng.normal(size=2000), np.zeros(2000)
    for k in range(2, 2000):
        y[k] = 1.5 * y[k - 1] - 0.7 * y[k - 2] + 0.2 * u[k - 1]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "idx": range(2000), "u": u, "y": y}))
    rows, names = models.lagged(df, ["k"], "y", "u", 2, 1, 1)
    fit = models.solve(models.gram(rows, ["k"], names, "y0"), ["k"], 3)
    got = one(fit)
    assert np.allclose(got["theta"], [-1.5, 0.7, 0.2], atol=1e-8) and got["fit_percent"] > 99.9 and got["reliable"]
    poles = one(models.poles_to_dynamics(fit, ["k"], 2, 1, 100.0))
    assert 0.05 <= poles["zeta"] <= 2 and poles["omega"] > 1 and abs(poles["gain"] - 1.0) < 1e-6


def test_simulation_over_blocks_is_the_recursion(spark):
    rng = np.random.default_rng(2)
    n, models_of = 1000, {"stable": [-1.5, 0.7, 0.2, 0.1], "slow": [-0.999, 0.0, 0.5, -0.2], "unstable": [-1.2, 0.1, 1.0, 0.0], "silent": [-3.0, 0.5, 1.0, 1.0], "odd": [-0.5, 0.1, 1.0, 0.5]}
    rows, want = [], {}
    for k, theta in models_of.items():
        u = np.zeros(n) if k == "silent" else rng.normal(size=n)
        if k == "odd":
            u[[300, 301]] = 1e13, 0.0
        y = np.zeros(n)
        for i in range(n):
            y[i] = sum(theta[2 + j] * u[i - 1 - j] for j in range(2) if i - 1 - j >= 0) - sum(theta[j - 1] * y[i - j] for j in (1, 2) if i - j >= 0)
            if not -1e12 < y[i] < 1e12:
                y[i:] = np.nan
                break
        want[k] = y
        rows.append(pd.DataFrame({"k": k, "idx": 5 + 2 * np.arange(n), "u": u}))
    fits = spark.createDataFrame(list(models_of.items()), "k string, theta array<double>")
    samples = spark.createDataFrame(pd.concat(rows)).repartition(3)
    for block in (64, 1 << 13):
        got = models.simulate(samples, fits, ["k"], "u", 2, 2, 1, block=block).toPandas().sort_values(["k", "idx"])
        for k, y in want.items():
            own = got[got.k == k]
            assert list(own.idx) == list(5 + 2 * np.arange(n))
            assert np.allclose(own.simulated, y, rtol=1e-9, atol=1e-9, equal_nan=True), (k, block)
    assert np.isnan(want["odd"][-1]) and not np.isnan(want["odd"][300])


def test_calibration_recovers_a_distorted_sphere(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(500, 3))
    b = 450 * v / np.linalg.norm(v, axis=1, keepdims=True)
    m = np.array([[0.98, 0.02, -0.015], [0.02, 1.03, 0.01], [-0.015, 0.01, 0.95]])
    t, motor, offset = rng.uniform(0, 1, 500), np.array([5.0, -3.0, 2.0]), np.array([120.0, -80.0, 45.0])
    raw = (b - np.outer(t, motor)) @ np.linalg.inv(m).T - offset
    df = spark.createDataFrame(pd.DataFrame({"flight_id": "a", "mx": raw[:, 0], "my": raw[:, 1], "mz": raw[:, 2], "bx": b[:, 0], "by": b[:, 1], "bz": b[:, 2], "throttle": t}))
    got = one(api.magfit(api.Flights("ardupilot", mag=df)))
    assert np.allclose(got["offset"], offset, atol=1e-5) and np.allclose(got["diagonal"], [0.98, 1.03, 0.95], atol=1e-8)
    assert np.allclose(got["off_diagonal"], [0.02, -0.015, 0.01], atol=1e-8) and np.allclose(got["motor"], motor, atol=1e-5)
    assert got["rmse"] < 1e-4 and got["in_bounds"] and got["coverage"] > 0.9
    back = units.compensated([F.col(c) for c in ("mx", "my", "mz")], offset, (0.98, 1.03, 0.95), (0.02, -0.015, 0.01), motor, F.col("throttle"))
    assert df.select(F.max(F.abs(back[0] - F.col("bx"))).alias("e")).first()["e"] < 1e-9


def test_units(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", -3.0, 0.5), ("b", 90.0, 1.0)], "k string, desired double, actual double")
    got = {(r["k"], round(r["desired"], 6)) for r in units.degrees_if_radians(df, ["k"], ["desired", "actual"]).collect()}
    assert got == {("a", round(math.degrees(1), 6)), ("a", round(math.degrees(-3), 6)), ("b", 90.0)}
    row = one(spark.range(1).select(
        units.acceleration_from_mg(F.lit(1000.0)).alias("a"), units.acceleration_from_adc(F.lit(512.0), F.lit(None).cast("double")).alias("b"), units.pwm_share(F.lit(1500.0)).alias("c"), units.coordinate(F.lit(473977418.0)).alias("d"),
        units.measured_voltage(F.lit(65535.0)).alias("e"), units.change_percent(F.lit(0.0), F.lit(2.0)).alias("f"), units.version_text(F.lit(0x04050601)).alias("g"), units.frame_kind(F.lit(6)).alias("h"), units.tenths("setpoint[0]", F.lit(50.0), F.lit(True)).alias("i"),
        units.tenths("axisP[0]", F.lit(50.0), F.lit(True)).alias("j"), units.null_if_odd(F.lit(float("nan"))).alias("k"), units.motor_share(F.lit(3000.0), F.lit(1000.0), F.lit(2000.0)).alias("l"),
    ))
    assert row == {"a": 9.80665, "b": 2 * 9.80665, "c": 0.5, "d": pytest.approx(47.3977418), "e": None, "f": 0.0, "g": "4.5.6", "h": "hex", "i": 5.0, "j": 50.0, "k": None, "l": 1.0}
    assert units.platform_name(" BF ") == "betaflight"
    with pytest.raises(ValueError):
        units.platform_name("x")


def test_quaternions_round_trip(spark):
    angles = [F.lit(10.0), F.lit(-20.0), F.lit(130.0)]
    q = attitude.from_euler(*angles)
    back = spark.range(1).select(*(c.alias(n) for n, c in zip("rpy", attitude.to_euler(q), strict=True)), *(c.alias(n) for n, c in zip("abc", attitude.rotate(q, attitude.rotate(q, [F.lit(1.0), F.lit(2.0), F.lit(3.0)]), transpose=True), strict=True)))
    got = one(back)
    assert [round(got[k], 9) for k in "rpyabc"] == [10.0, -20.0, 130.0, 1.0, 2.0, 3.0]


def test_lowpass_is_3_db_down_at_its_cutoff(spark):
    rows = spark.createDataFrame([(50.0, 1000.0, f) for f in (1.0, 50.0, 150.0)], "cutoff double, rate double, freq double")
    got = {r["freq"]: r["magnitude_db"] for r in filters.lowpass_response(rows).collect()}
    assert abs(got[1.0]) < 0.01 and abs(got[50.0] + 3.0103) < 1e-3 and got[150.0] < -15


def test_catalog_file(spark, tmp_path):
    table = {"schema_version": 2, "parameters": [{"name": "ATC_RAT_RLL_P", "group": "ATC_", "type": "float", "min": 0.0, "max": 0.35, "description": "Roll gain. More text."}, {"name": "BATT_MONITOR", "group": "BATT_", "type": "enum", "values": {"0": "off", "4": "both"}}, {"name": "ODD", "type": "enum"}]}
    (tmp_path / "ardupilot.json").write_text(json.dumps(table))
    (tmp_path / "ardupilot.copter-4.5.json").write_text(json.dumps({"schema_version": 2, "parameters": table["parameters"][:1]}))
    rows = params.read_catalog(spark, str(tmp_path))
    assert params.versions(rows).count() == 2
    assert params.of_version(rows, "ardupilot", "Copter_4.5").count() == 1 and params.of_version(rows, "ardupilot").count() == 3 and params.of_version(rows, "ardupilot", "none").count() == 3
    entries = spark.createDataFrame([("atc_rat_rll_p", 0.2), ("ATC_RAT_RLL_P", 0.5), ("BATT_MONITOR", 4.0), ("BATT_MONITOR", 3.0), ("BATT_MONITOR", 0.5), ("ODD", 1.0), ("GONE", 1.0), ("ODD", None)], "entry string, value double")
    got = [(r["entry"], r["value"], r["status"]) for r in catalog.validate(entries, params.of_version(rows, "ardupilot")).collect()]
    assert sorted(s for _, _, s in got) == sorted(["ok", "out_of_range", "ok", "not_a_member", "not_an_integer", "unverifiable", "not_found", "invalid_input"])
    assert rows.where("name = 'ATC_RAT_RLL_P'").select(params.summary(F.col("description")).alias("s"), params.range_text(F.col("min"), F.col("max")).alias("r")).first() == ("Roll gain", "[0.0, 0.35]")


def test_fold_keeps_order_and_orphans(spark):
    names = ["BATT2_MONITOR", "BATT_MONITOR", "GPS2_RATE", "BATT9_MONITOR"]
    got = {r["name"]: (r["pos"], r["instances"]) for r in catalog.fold_numbered(spark.createDataFrame(list(enumerate(names)), "pos long, name string")).collect()}
    assert got == {"BATT_MONITOR": (0, ["BATT2_MONITOR", "BATT_MONITOR", "BATT9_MONITOR"]), "GPS2_RATE": (2, None)}


def test_lint_of_a_catalog_in_capitals(spark, data_dir, tmp_path):
    names = ["A_B", "a_B", "Ab", "3D_X", "3d_x", "9-X", "A-B", "_A", "", "A\n", "\u00c9", None]
    rows = spark.createDataFrame(list(enumerate(names)), "pos long, name string").selectExpr(
        "*", "'t' as description", "'float' as type", "'1' as default", "0D as min", "1D as max", "cast(null as map<string,string>) as members"
    )
    odd = lambda **k: {r["name"] for r in catalog.lint(rows, **k).where("check = 'name_shape'").collect()}
    assert odd() == {"9-X", "A-B", "_A", "", "\u00c9"} and odd(shape=catalog.CAPITALS) == odd() | {"a_B", "Ab", "A\n"}

    shapes = lambda path: sorted(r["name"] for r in registry.QUERIES["param_lint"](spark, path).where("check = 'name_shape'").collect())
    lower = [f"lower_{r['p_name']}".replace(" ", "_") for r in spark.read.parquet(f"{data_dir}/part.parquet").where("p_partkey % 50 = 7").collect()]
    assert shapes(data_dir) == sorted(lower) != []
    parts = [(50 * i + j, p, "BRAND", "TYPE", i, 1.0) for i, p in enumerate(["red rose", "RED", "9 x", "red-rose", "", "red\n", "\u00e9t\u00e9", None]) for j in (0, 7, 8, 9)]
    spark.createDataFrame(parts, spark.read.parquet(f"{data_dir}/part.parquet").schema).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    same_rows(registry.QUERIES["param_lint"](spark, str(tmp_path)), con, registry.ORACLES["param_lint"])
    assert len(shapes(str(tmp_path))) == 11


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], "x"), (2, 0.5, [], "y")], "id int, v double, a array<double>, status string")
    got = [json.loads(r["value"]) for r in sinks.envelopes(rows, "test").orderBy("value").collect()]
    assert got[0]["status"] == "ok" and got[0]["tool"] == "aerolake" and "generated_at" not in got[0]
    assert [g.get("v") for g in got] == [None, 0.5]
    sinks.write_json(rows, str(tmp_path / "out"), "test")
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert sinks.markdown(rows, ["status"], "T", ["id", "v"], "id").where("status = 'y'").first()["report"] == "## T\n\n| id | v |\n|---|---|\n| 2 | 0.5 |"
    cut = sinks.capped(spark.createDataFrame([("a", i) for i in range(5)], "k string, i int"), ["k"], ["i"], 3)
    assert [(r["i"], r["returned"], r["truncated"]) for r in cut.orderBy("i").collect()] == [(0, 3, True), (1, 3, True), (2, 3, True)]


def test_analysis_of_a_fleet(spark):
    rate, n = 250.0, 2500
    rows = []
    for flight, zeta in (("a", 0.7), ("b", 0.3)):
        u = np.repeat([0, 50, 0, 50, 0], n // 5).astype(float)
        y = second_order(u, rate, omega=40.0, zeta=zeta)
        rows.append(pd.DataFrame({"flight_id": flight, "axis": "roll", "idx": range(n), "t": np.arange(n) / rate, "desired": u, "actual": y}))
    pid = spark.createDataFrame(pd.concat(rows))
    t = np.arange(4000) / 1000
    imu = spark.createDataFrame(pd.DataFrame({"flight_id": "a", "idx": range(4000), "t": t, "gx": 2 * np.sin(2 * np.pi * 80 * t), "gy": 0.0, "gz": 0.0, "ax": np.sin(2 * np.pi * 80 * t), "ay": 0.0, "az": 9.81}))
    found = api.analyze(api.Flights("ardupilot", pid=pid, imu=imu, extra={"rows": lambda f: f.pid.groupBy("flight_id").count()}), 1000.0).results
    assert set(found) == {"quality", "pid", "fft", "sysid", "rows"}
    by = {r["flight_id"]: r for r in found["pid"].collect()}
    assert by["a"]["windows"] == 4 and by["b"]["overshoot_percent"] > by["a"]["overshoot_percent"]
    assert {r["rate_hz"] for r in found["quality"].select(F.round("rate_hz", 3).alias("rate_hz")).collect()} == {250.0}
    peaks = found["fft"].first()
    assert any(abs(p["freq"] - 80) < 2 and p["source"] == "motor" for p in peaks["peaks"]) and peaks["level"] == "EXCELLENT"
    with pytest.raises(ValueError):
        api.analyze(api.Flights("px4"), 100.0)
    with pytest.raises(ValueError):
        api.analyze(api.Flights("px4", pid=pid), 100.0, ["nothing"])


def test_streams(spark, data_dir, tmp_path):
    events = spark.read.parquet(f"{data_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    steps = run(live.live_steps(stream()), "steps")
    assert steps.count() > 0 and steps.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("step").alias("d")).where("n <> d").isEmpty()
    windows = run(live.quality_by_window(stream(), late="40 days"), "windows", "complete")
    assert windows.agg(F.sum("n")).first()[0] == events.count()
    sessions = run(live.link_sessions(stream(), gap="2 hours", late="40 days"), "sessions", "complete")
    assert sessions.agg(F.sum("n")).first()[0] == events.count()
    frames = spark.createDataFrame([("a", 0, 5.0), ("a", 1, None), ("a", 2, 7.0), ("b", 0, None)], "k string, idx long, flags double")
    frames.coalesce(1).write.parquet(str(tmp_path / "frames"))
    carried = run(live.carry_forward(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames")), "k", "flags"), "carried")
    assert sorted((r["k"], r["idx"], r["flags"]) for r in carried.where("flags is not null").collect()) == [("a", 0, 5.0), ("a", 1, 5.0), ("a", 2, 7.0)]
