from __future__ import annotations

import random

import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from aerolake.operators import align, attitude, bands, diagnosis, responses, series, spectral


def test_notes(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    rows = spark.range(1).select(
        diagnosis.field_notes(a(500.0, 0.0, 0.0), a(1.0, 1.3, 1.0), a(0.0, 0.06, 0.0), a(0.0, 0.0, 31.0), F.lit(False)).alias("bad"),
        diagnosis.field_notes(a(10.0, 0.0, 0.0), a(1.0, 1.05, 1.0), a(0.0, 0.01, 0.0), a(0.0, 0.0, 1.0), F.lit(True)).alias("good"),
        diagnosis.telemetry_notes(F.lit(False), F.lit(40), F.lit(0), F.lit(4.0), F.lit(0), F.lit(4.0), F.lit(0), F.lit(0), F.lit(2), F.lit(7.0), F.lit(2), F.lit(1)).alias("link"),
        diagnosis.telemetry_notes(F.lit(True), F.lit(40), F.lit(40), F.lit(60.0), F.lit(40), F.lit(400.0), F.lit(40), F.lit(9), F.lit(0), F.lit(0.0), F.lit(1), F.lit(2)).alias("fine"),
    )
    assert rows.first().asDict() == {"bad": ["offset_warning", "diagonal_critical", "off_diagonal_warning", "motor_critical", "coverage_short"], "good": [], "fine": ["terms_missing"], "link": ["receive_clock", "no_desired_rates", "gyro_from_attitude", "fft_limited", "no_accelerometer", "no_parameters", "link_gaps", "dropped_frames", "other_vehicles", "no_multirotor"]}


def test_filter_chains(spark):
    params = spark.createDataFrame([("a", "ins_gyro_filter", 40.0, 1), ("a", "INS_GYRO_FILTER", 60.0, 2), ("a", "INS_HNTCH_ENABLE", 1.0, 3), ("a", "INS_HNTCH_FREQ", 90.0, 4), ("b", "OTHER", 1.0, 1)], "flight string, name string, value double, idx long")
    wide = diagnosis.parameters_wide(params, ["flight"], diagnosis.FILTER_PARAMS["ardupilot"], "idx")
    got = {r["flight"]: (r["cutoff"], [(n["center"], n["bandwidth"]) for n in r["notches"]]) for r in diagnosis.filter_chain(wide, "ardupilot").collect()}
    assert got == {"a": (60.0, [(90.0, 40.0)]), "b": (20.0, [])}
    fast = diagnosis.parameters_wide(spark.createDataFrame([("a", "gyro_notch1_hz", 200.0), ("a", "gyro_notch1_cutoff", 150.0)], "flight string, name string, value double"), ["flight"], diagnosis.FILTER_PARAMS["betaflight"])
    row = diagnosis.filter_chain(fast, "betaflight").first()
    assert row["cutoff"] == 250.0 and row["notches"][0]["bandwidth"] == 100.0
    assert diagnosis.filter_chain(diagnosis.parameters_wide(params, ["flight"], diagnosis.FILTER_PARAMS["px4"]), "px4").first()["notches"] == []


def test_levels_and_severity(spark):
    rows = spark.createDataFrame([(-1.0,), (13.0,), (16.0,), (23.0,), (5.0,)], "v double")
    got = [r["s"] for r in rows.select(responses.severity(F.col("v"), F.lit(15.0), True).alias("s")).collect()]
    assert got == [None, "low", "medium", "high", None]
    levels = [r["l"] for r in rows.select(bands.level_below(F.col("v"), bands.VIBRATION["betaflight"]).alias("l")).collect()]
    assert levels == ["EXCELLENT", "MARGINAL", "POOR", "POOR", "GOOD"]


def test_harmonics_inherit(spark):
    peak = lambda f: F.struct(F.lit(f).alias("freq"), F.lit(1.0).alias("magnitude"))
    found = spark.range(1).select(spectral.with_harmonics(F.array(*map(peak, (500.5, 100.0, 200.0, 300.0)))).alias("p")).first()["p"]
    assert [(p["freq"], p["source"], p["harmonic"]) for p in found] == [(100.0, "motor", False), (200.0, "motor", True), (300.0, "motor", True), (500.5, "high", False)]
    assert spark.range(1).select(spectral.with_harmonics(F.array().cast("array<struct<freq:double,magnitude:double>>")).alias("p")).first()["p"] == []


def spaced(steps, spacing):
    out = []
    for s in sorted(steps):
        if not out or s - out[-1] >= spacing:
            out.append(s)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(steps=st.lists(st.integers(0, 200), min_size=1, max_size=40), spacing=st.integers(1, 30))
def test_spacing_is_greedy(spark, steps, spacing):
    rows = spark.createDataFrame([("k", s) for s in steps], "k string, step long")
    assert [r["step"] for r in series.keep_spaced(rows, ["k"], spacing).orderBy("step").collect()] == spaced(steps, spacing)


def test_spacing_over_blocks_is_greedy(spark):
    rng = random.Random(4)
    spacing, n = 7, 20_000
    found = {
        "dense": list(range(n)), "thin": [i for i in range(n) if rng.random() < 0.1], "gaps": [i for i in range(n) if i // 1500 % 3 == 0 and rng.random() < 0.6], "edge": [447, 448, 449, 454, 455, 895, 896, 901, 902, 903],
        None: [i for i in range(n) if rng.random() < 0.4] * 2,
    }
    rows = spark.createDataFrame([(k, s) for k, steps in found.items() for s in steps], "k string, step long").repartition(3)
    got = {}
    for r in series.keep_spaced(rows, ["k"], spacing, block=64).collect():
        got.setdefault(r["k"], []).append(r["step"])
    assert {k: sorted(v) for k, v in got.items()} == {k: spaced(set(v), spacing) for k, v in found.items()}


def test_a_long_dense_series_is_spaced_in_time(spark):
    n = 1_000_000
    steps = series.keep_spaced(spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("step")), ["k"], 5)
    assert steps.agg(F.count("*"), F.min("step"), F.max("step"), F.sum(F.col("step") % 5)).first() == (n // 5, 0, n - 5, 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(times=st.lists(st.floats(0, 100), min_size=1, max_size=12, unique=True), at=st.lists(st.floats(-10, 110), min_size=1, max_size=12))
def test_interpolation_is_numpys(spark, times, at):
    import numpy as np

    times = sorted(times)
    values = [float(i * i % 7) for i in range(len(times))]
    left = spark.createDataFrame([("k", i, t) for i, t in enumerate(at)], "k string, i long, t double")
    right = spark.createDataFrame([("k", t, v) for t, v in zip(times, values, strict=True)], "k string, t double, v double")
    got = {r["i"]: r["v"] for r in align.interpolate_at(left, right, ["k"], "t", ["v"], "i").collect()}
    assert np.allclose([got[i] for i in range(len(at))], np.interp(at, times, values), atol=1e-9)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 60), size=st.integers(2, 20), hop=st.integers(1, 12))
def test_frames_are_complete(spark, n, size, hop):
    rows = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("idx"))
    got = {}
    for r in series.frames(rows, ["k"], size, hop).collect():
        got.setdefault(r["frame"], []).append((r["place"], r["idx"]))
    want = {k: [(p, k * hop + p) for p in range(size)] for k in range((n - size) // hop + 1)} if n >= size else {}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_series_without_the_other_side(spark):
    left = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 5.0)], "k string, i long, t double")
    right = spark.createDataFrame([("a", 1.0, 3.0)], "k string, t double, v double")
    assert {r["k"]: r["v"] for r in align.interpolate_at(left, right, ["k"], "t", ["v"], "i").collect()} == {"a": 3.0, "b": None}
    assert len(attitude.lattice(80)) == 80
