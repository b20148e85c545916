"""Splines of model responses, frames over the ends, links that fall silent, logs in pieces."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolake import api
from aerolake.operators import models, spectral
from aerolake.sources import flightlog
from aerolake.streaming import flights as live
from tests.test_api import flight
from tests.test_flightlogs import dataflash, telemetry, ulog


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 30])
def test_splines_equal_a_dense_solution(n):
    rng = np.random.default_rng(n)
    y, at = rng.normal(size=(3, n)), np.linspace(0, n - 1, 7 * n)
    got = models.cubic_spline(y, at)
    assert np.allclose(got[:, [0, -1]], y[:, [0, -1]])
    if n < 4:
        assert np.allclose(got, np.stack([np.polyval(np.polyfit(np.arange(n), row, n - 1), at) for row in y]), atol=1e-6)
        return
    # Unknowns: four coefficients a span; values at both ends, two smooth derivatives inside, no knot at the second and the last but one value.
    spans = n - 1
    for row, found in zip(y, got, strict=True):
        a, b = [], []
        for i in range(spans):
            for t, v in ((0.0, row[i]), (1.0, row[i + 1])):
                line = np.zeros(4 * spans)
                line[4 * i : 4 * i + 4] = [1, t, t**2, t**3]
                a.append(line)
                b.append(v)
        for i in range(spans - 1):
            for left, right in (([0, 1, 2, 3], [0, 1, 0, 0]), ([0, 0, 2, 6], [0, 0, 2, 0])):
                line = np.zeros(4 * spans)
                line[4 * i : 4 * i + 4], line[4 * i + 4 : 4 * i + 8] = left, -np.array(right)
                a.append(line)
                b.append(0.0)
        for i in (0, spans - 2):
            line = np.zeros(4 * spans)
            line[4 * i + 3], line[4 * i + 7] = 1, -1
            a.append(line)
            b.append(0.0)
        c = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0].reshape(spans, 4)
        i = np.clip(np.floor(at).astype(int), 0, spans - 1)
        assert np.allclose(found, (c[i] * ((at - i)[:, None] ** np.arange(4))).sum(axis=1))


def test_model_steps_of_each_series(spark):
    fleet = flight(spark, 250.0, 4.0, "slow").unionByName(flight(spark, 1000.0, 4.0, "fast"))
    rows = api.model_step(api.Flights("ardupilot", pid=fleet), oversample=4).groupBy("flight_id").agg(F.count("*").alias("n"), F.max("t").alias("t"), F.max_by("response", "t").alias("last")).collect()
    found = {r["flight_id"]: r for r in rows}
    assert found["slow"]["n"] == 4 * min(500, (found["slow"]["n"] // 4)) and abs(found["slow"]["t"] - found["fast"]["t"]) < 0.05
    assert all(abs(r["last"] - 1) < 0.1 for r in rows)
    odd = spark.createDataFrame([("a", [1.0]), ("b", []), ("c", None), ("d", [0.0, 1.0])], "k string, response array<double>")
    assert {r["k"]: r["response"] for r in models.smoothed(odd, ["k"], 2).collect()} == {"a": [1.0, 1.0], "b": [], "c": None, "d": [0.0, pytest.approx(1 / 3), pytest.approx(2 / 3), 1.0]}


@pytest.mark.parametrize(("n", "size", "overlap", "segment"), [(100, 16, 0.5, 1 << 16), (100, 16, 0.5, 16), (37, 16, 0.25, 20), (5, 16, 0.75, 8), (64, 15, 0.5, 16), (1, 8, 0.0, 8)])
def test_frames_over_the_ends(spark, n, size, overlap, segment):
    x = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, idx long, value double")
    hop, half = max(1, int(size * (1 - overlap))), size // 2
    long = np.concatenate([np.zeros(half), x, np.zeros(half)])
    long = np.concatenate([long, np.zeros(-(len(long) - size) % hop if len(long) >= size else size - len(long))])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    want = {(k, b): 20 * np.log10(v + 1e-9) for k, at in enumerate(range(0, len(long) - size + 1, hop)) for b, v in enumerate(np.abs(np.fft.rfft(long[at : at + size] * window)) / window.sum())}
    got = {(r["frame"], r["bin"]): r["magnitude_db"] for r in spectral.padded_spectrogram(df, ["k"], size, overlap, 100.0, segment=segment).collect()}
    assert got.keys() == want.keys() and all(abs(max(got[k], -150) - max(want[k], -150)) < 1e-6 for k in want)


def test_a_silent_link_ends_without_a_message(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    begin = datetime.datetime(2024, 1, 1)
    rows = lambda link, *seconds: [(link, begin + datetime.timedelta(seconds=s)) for s in seconds]
    batches = [rows(1, 0, 1, 2) + rows(2, 0, 1), rows(2, 2, 3, 20, 21), rows(2, 60), rows(2, 61)]
    try:
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
        stream = spark.readStream.schema("user_id long, ts timestamp, b int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = live.live_links(stream, gap_ms=3000, late="1 second").writeStream.format("memory").queryName("links").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        found = sorted((r["link"], r["first_ms"] // 1000 % 1000, r["n"], r["reason"]) for r in spark.table("links").collect())
        first = int(begin.replace(tzinfo=datetime.timezone.utc).timestamp()) % 1000
        at = lambda s: (first + s) % 1000
        assert ("1", at(0), 3, "silent") in found and ("2", at(20), 2) in {f[:3] for f in found} and sum(f[0] == "1" for f in found) == 1
        assert sum(f[2] for f in found if f[0] == "2") == 6
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize(("kind", "name", "data"), [("dataflash", "a.bin", dataflash()), ("ulog", "a.ulg", ulog()), ("telemetry", "a.tlog", telemetry())])
def test_logs_in_pieces_are_the_same_rows(spark, tmp_path, kind, name, data):
    (tmp_path / name).write_bytes(data)
    (tmp_path / f"b{name}").write_bytes(data[: len(data) * 2 // 3])
    (tmp_path / f"c{name}").write_bytes(b"nothing of the kind")
    assert len(list(flightlog.PIECES[kind](data, 200))) > 3
    key = lambda r: tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r)
    plain = lambda df: sorted(map(key, df.where("error is null").collect()), key=repr)
    whole = flightlog.read_logs(spark, str(tmp_path), kind)
    for size in (1, 200, 1 << 20):
        cut = flightlog.read_logs(spark, str(tmp_path), kind, piece_bytes=size)
        assert plain(cut) == plain(whole) != []


def test_messages_inside_noise_are_cut_where_the_decoder_steps():
    rng = np.random.default_rng(5)
    data = bytearray(dataflash())
    for at in rng.integers(400, len(data), 60):
        data[at] = int(rng.integers(256))
    whole = [(r[0], r[2], sorted(r[7].items()) if r[7] == r[7] else None) for r in flightlog.read_dataflash(bytes(data))]
    for size in (1, 37, 500):
        rows, first = [], []
        for p in flightlog.dataflash_pieces(bytes(data), size):
            first.append(p.first == len(rows))
            rows += [(r[0], r[2], sorted(r[7].items())) for r in flightlog.read_dataflash(p.head + bytes(data)[p.begin : p.end])]
        assert all(first) and repr(rows) == repr(whole)
