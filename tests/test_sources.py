from __future__ import annotations

import random

import pytest

from aerolake.sources import blackbox, detect

FIELDS = "H Field I name:loopIteration,time,gyroADC[0],motor[0],motor[1]\nH Field I signed:0,0,1,0,0\nH Field I predictor:0,0,0,4,5\nH Field I encoding:1,1,0,1,0\nH Field P predictor:6,2,1,1,1\nH Field P encoding:9,0,0,0,0\nH Field S name:flightModeFlags\nH Field S predictor:0\nH Field S encoding:1\n"
HEAD = f"H Product:Blackbox flight data recorder by Nicholas Sherlock\nH Data version:2\nH I interval:8\nH minthrottle:1000\nH looptime:250\n{FIELDS}".encode()


def segment(n=40, seed=1):
    """Encoded frames and the rows that they stand for."""
    rng, out, rows = random.Random(seed), bytearray(HEAD), []
    out += b"S" + blackbox.encode_unsigned(5)
    u, s = blackbox.encode_unsigned, blackbox.encode_signed
    for i in range(n):
        row = [i, 1000 + 250 * i + rng.randrange(3), rng.randrange(-500, 500), 1100 + rng.randrange(200), 1100 + rng.randrange(200)]
        if i % 8 == 0:
            out += b"I" + u(row[0]) + u(row[1]) + s(row[2]) + u(row[3] - 1000) + s(row[4] - row[3])
            before = last = row
        else:
            out += b"P" + s(row[1] - (2 * last[1] - before[1])) + s(row[2] - last[2]) + s(row[3] - last[3]) + s(row[4] - last[4])
            before, last = last, row
        rows.append(row)
    return bytes(out + b"E\xff"), rows


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 70_000, 2**31 - 1, 2**32 - 1])
def test_numbers_round_trip(n):
    assert blackbox.unsigned_vb(blackbox.encode_unsigned(n), 0) == (n, len(blackbox.encode_unsigned(n)))
    if n < 2**31:
        for x in (n, -n):
            assert blackbox.signed_vb(blackbox.encode_signed(x), 0)[0] == x


def test_groups():
    assert blackbox.group_of_three(bytes([0b00_01_10_11]), 0) == ([1, -2, -1], 1)
    assert blackbox.group_of_three(bytes([0b01_000111, 0b1000_0001]), 0) == ([7, -8, 1], 2)
    assert blackbox.group_of_three(bytes([0b11_00_01_00, 5, 0x00, 0xFF, 250]), 0) == ([5, -256, -6], 5)
    assert blackbox.group_of_four(bytes([0b11_10_01_00, 0x71, 0x21, 0x23, 0x40]), 0) == ([0, 7, 18, 4660], 5)
    assert blackbox.group_of_eight(bytes([0b101, 2, 4]), 0, 3) == ([1, 0, 2], 3)


def test_source_decodes_segments(spark, tmp_path):
    (a, first), (b, second) = segment(), segment(20, 2)
    (tmp_path / "one.bbl").write_bytes(a + b)
    blackbox.register(spark)
    rows = spark.read.format("blackbox").load(str(tmp_path / "*.bbl")).orderBy("segment", "idx").collect()
    names = ["loopIteration", "time", "gyroADC[0]", "motor[0]", "motor[1]"]
    assert [[r["values"][c] for c in names] for r in rows] == first + second
    assert {r["values"]["flightModeFlags"] for r in rows} == {5} and {r["corrupt"] for r in rows} == {0}
    head = spark.read.format("blackbox").option("content", "headers").load(str(tmp_path / "*.bbl")).collect()
    assert [h["properties"]["looptime"] for h in head] == ["250", "250"]


def test_corrupt_bytes_are_skipped():
    data, rows = segment()
    at = data.index(b"E\xff")
    broken = data[:at] + b"\x00\x01garbage" + data[at:]
    found = list(blackbox.decode(broken))
    assert [list(f[3].values())[1:] for f in found] == rows[:-1]  # a frame that ends at no mark is not trusted
    assert found[-1][4] == 0
    assert list(blackbox.decode(HEAD)) == [] and list(blackbox.decode(b"")) == []


def test_detection_and_safe_paths(spark, tmp_path):
    stamp = (1_700_000_000_000_000).to_bytes(8, "big")
    files = {"a.bin": b"\xa3\x95rest", "b.log": b"FMT, 128", "c.tlog": stamp + b"\xfdrest", "d.bbl": HEAD, "e.ulg": detect.ULOG_MAGIC + b"x", "f.bin": b"nothing", "g.exe": b"\xa3\x95", "h.tlog": b"\0" * 8 + b"\xfd", "big.bin": b"\xa3\x95" + b"0" * 5000}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = {r["path"].rpartition("/")[2]: r["format"] for r in detect.detect(spark, str(tmp_path), [str(tmp_path)], most_bytes=4000).collect()}
    assert found == {"a.bin": "dataflash", "b.log": "dataflash_text", "c.tlog": "telemetry", "d.bbl": "blackbox", "e.ulg": "ulog", "f.bin": None, "h.tlog": None}
    assert detect.detect(spark, str(tmp_path), ["/elsewhere"]).count() == 0
