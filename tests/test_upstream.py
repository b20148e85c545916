"""Catalogs from published metadata and C sources."""

from __future__ import annotations

import json

import pytest

from aerolake.operators import catalog
from aerolake.sources import params, upstream

PDEF = {
    "json": {"version": 0},
    "ATC_": {"ATC_RAT_RLL_P": {"DisplayName": "Roll P", "Description": "Roll axis gain. More is stiffer.", "Range": {"low": "0.01", "high": "0.5"}, "Increment": "0.005", "User": "Standard"}},
    "BATT_": {"BATT_MONITOR": {"DisplayName": "Monitor", "Values": {"0": "Disabled ", " 4": "Analog"}, "RebootRequired": "True", "Description": "Which monitor"}, "BATT_OPTIONS": {"DisplayName": "Options", "Bitmask": {"0": "One", "3": "Two"}, "Units": "", "Description": "Bits"}},
    "Copter": {"PILOT_SPEED": {"DisplayName": "Speed", "Units": "cm/s", "Range": {"low": "x", "high": "inf"}, "ReadOnly": "true"}, "BATT_MONITOR": {"DisplayName": "again"}},
    "Empty": {}, "Odd": "text",
}
PX4 = {"version": 1, "parameters": [
    {"name": "MC_ROLLRATE_P", "group": "Multicopter Rate Control", "type": "Float", "default": 0.15, "min": 0.01, "max": 0.5, "increment": 0.01, "shortDesc": "Roll rate P gain", "category": "Standard"},
    {"name": "SYS_X", "group": "System Things!", "type": "Int32", "default": 1, "values": [{"value": 0, "description": "Off "}, {"value": 1, "description": "On"}], "shortDesc": "x", "longDesc": "Longer text.", "rebootRequired": True},
    {"name": "SYS_BITS", "group": "", "type": "Int32", "default": 0, "bitmask": [{"index": 2, "description": "two"}], "shortDesc": "bits", "units": "m"}, {"group": "no name"},
]}
SETTINGS_C = r"""
// const char * const lookupTableGhost[] = { "NO" };
static const char * const lookupTableOffOn[] = {
    "OFF", "ON" /* , "MAYBE" */
};
const char *const lookupTableLowpassType[] = { "PT1", "BIQUAD",
#ifdef USE_MORE
    "PT2",
#endif
};
const char * const lookupTableCrashRecovery[] = { "OFF", "ON", "BEEP" };
#define LOCAL_MAX ( 0x10 )
const clivalue_t valueTable[] = {
// PG_GYRO_CONFIG
    { PARAM_NAME_GYRO_LPF1_TYPE,    VAR_UINT8  | MASTER_VALUE | MODE_LOOKUP, .config.lookup = { TABLE_GYRO_LPF_TYPE }, PG_GYRO_CONFIG, offsetof(gyroConfig_t, gyro_lpf1_type) },
    { PARAM_NAME_GYRO_LPF1_STATIC_HZ, VAR_UINT16 | MASTER_VALUE, .config.minmaxUnsigned = { 0, LPF_MAX_HZ }, PG_GYRO_CONFIG, offsetof(gyroConfig_t, gyro_lpf1_static_hz) },
    { "p_roll", VAR_UINT8 | PROFILE_VALUE, .config.minmaxUnsigned = { 0, PID_GAIN_MAX }, PG_PID_PROFILE, offsetof(pidProfile_t, pid[PID_ROLL].P) },
#if defined(USE_ACC)
    { "acc_trim_pitch", VAR_INT16 | MASTER_VALUE, .config.minmax = { -300, (300) }, PG_ACCELEROMETER_CONFIG, offsetof(x_t, y) },
#endif
    { "serial_update", VAR_UINT32 | MASTER_VALUE, .config.u32Max = UINT32_MAX, PG_SERIAL_CONFIG, offsetof(x_t, y) },
    { "features_bit", VAR_UINT32 | MASTER_VALUE | MODE_BITSET, .config.bitpos = 5, PG_SOME_THING, offsetof(x_t, y) },
    { "accel_cal", VAR_INT16 | MODE_ARRAY, .config.array.length = XYZ_AXIS_COUNT, PG_ACCELEROMETER_CONFIG, offsetof(x_t, y) },
    { "crash_recovery", VAR_UINT8 | MODE_LOOKUP, .config.lookup = { TABLE_CRASH_RECOVERY }, PG_PID_PROFILE, offsetof(x_t, y) },
    { "ghost", VAR_UINT8 | MODE_LOOKUP, .config.lookup = { TABLE_GHOST }, PG_PID_PROFILE, offsetof(x_t, y) },
    { "far_away", VAR_UINT8, .config.minmaxUnsigned = { 0, NOT_DEFINED }, PG_PID_PROFILE, offsetof(x_t, y) }, { "local", VAR_UINT8, .config.minmaxUnsigned = { 1, LOCAL_MAX }, PG_PID_PROFILE, 0 },
};
"""
PID_H = "#define PID_GAIN_MAX 250 // most\n#define LPF_MAX_HZ LPF_LIMIT\n#define LPF_LIMIT (LPF_DEEP)\n#define LPF_DEEP 1000\n#define NOT_A_NUMBER foo()\n"
NAMES_H = '#define PARAM_NAME_GYRO_LPF1_TYPE "gyro_lpf1_type"\n#define PARAM_NAME_GYRO_LPF1_STATIC_HZ "gyro_lpf1_static_hz"\n'


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    path = tmp_path_factory.mktemp("upstream")
    for name, text in {"apm.pdef.json": json.dumps(PDEF, indent=1), "px4.json": json.dumps(PX4), "c/settings.c": SETTINGS_C, "c/pid.h": PID_H, "c/parameter_names.h": NAMES_H}.items():
        (path / name).parent.mkdir(exist_ok=True)
        (path / name).write_text(text)
    return path


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def no_errors(df):
    return [r for r in catalog.lint(df).where("severity = 'error'").collect()] == []


def test_ardupilot_metadata(spark, sources):
    df = upstream.ardupilot_catalog(spark, str(sources / "apm.pdef.json"))
    found = by_name(df)
    assert list(found) == ["ATC_RAT_RLL_P", "BATT_MONITOR", "BATT_OPTIONS", "PILOT_SPEED"] and no_errors(df)
    roll, monitor, speed = found["ATC_RAT_RLL_P"], found["BATT_MONITOR"], found["PILOT_SPEED"]
    assert (roll["type"], roll["category"], roll["min"], roll["max"], roll["increment"], roll["default"], roll["user"]) == ("float", "pid", 0.01, 0.5, 0.005, None, "Standard")
    assert (monitor["type"], monitor["members"], monitor["group"], monitor["reboot_required"], monitor["category"]) == ("enum", {"0": "Disabled", "4": "Analog"}, "BATT_", True, "battery")
    assert found["BATT_OPTIONS"]["bitmask"] == {"0": "One", "3": "Two"} and (speed["category"], speed["min"], speed["max"], speed["read_only"], speed["description"]) == ("vehicle", None, None, True, "Speed")


def test_px4_metadata(spark, sources):
    df = upstream.px4_catalog(spark, str(sources / "px4.json"))
    found = by_name(df)
    assert set(found) == {"MC_ROLLRATE_P", "SYS_X", "SYS_BITS"} and no_errors(df)
    assert (found["MC_ROLLRATE_P"]["type"], found["MC_ROLLRATE_P"]["default"], found["MC_ROLLRATE_P"]["category"]) == ("float", "0.15", "pid")
    assert (found["SYS_X"]["type"], found["SYS_X"]["values"], found["SYS_X"]["category"], found["SYS_X"]["description"]) == ("enum", {"0": "Off", "1": "On"}, "system_things", "Longer text.")
    assert (found["SYS_BITS"]["type"], found["SYS_BITS"]["category"], found["SYS_BITS"]["unit"]) == ("bitmask", "misc", "m")


def test_settings_in_c(spark, sources):
    said = spark.createDataFrame([("p_roll", "Roll gain")], "name string, description string")
    df = upstream.betaflight_catalog(spark, str(sources / "c"), said)
    found = by_name(df)
    assert len(found) == 11 and no_errors(df)
    lpf = found["gyro_lpf1_type"]
    assert (lpf["type"], lpf["values"], lpf["group"], lpf["category"]) == ("enum", {"0": "PT1", "1": "BIQUAD", "2": "PT2"}, "GYRO_CONFIG", "filter")
    bounds = {n: (found[n]["min"], found[n]["max"]) for n in found}
    assert bounds["gyro_lpf1_static_hz"] == (0, 1000) and bounds["p_roll"] == (0, 250) and bounds["acc_trim_pitch"] == (-300, 300) and bounds["serial_update"] == (0, 4294967295)
    assert bounds["far_away"] == (0, None) and bounds["local"] == (1, 16) and bounds["features_bit"] == (0, 1)
    assert found["features_bit"]["bitmask"] == {"5": "set"} and found["features_bit"]["category"] == "some_thing" and found["accel_cal"]["type"] == "array"
    assert found["crash_recovery"]["values"] == {"0": "OFF", "1": "ON", "2": "BEEP"} and found["ghost"]["values"] is None and found["ghost"]["type"] == "enum"
    assert found["p_roll"]["description"] == "Roll gain" and found["gyro_lpf1_static_hz"]["unit"] == "Hz"
    verdicts = {(r["entry"], r["status"]) for r in catalog.validate(spark.createDataFrame([("p_roll", 251.0), ("crash_recovery", 2.0), ("local", 0.0)], "entry string, value double"), df).collect()}
    assert ("crash_recovery", "ok") in verdicts and len({s for e, s in verdicts if e != "crash_recovery" and s == "ok"}) == 0


def test_catalogs_become_files(spark, sources, tmp_path):
    own = upstream.px4_catalog(spark, str(sources / "px4.json"))
    row = upstream.documents(own, "px4", "v1.15 Beta").first()
    assert row["file"] == "px4.v1.15-beta.json"
    (tmp_path / row["file"]).write_text(row["document"])
    again = params.read_catalog(spark, str(tmp_path))
    assert {(r["platform"], r["fw_version"]) for r in again.collect()} == {("px4", "v1.15-beta")}
    keep = [c for c in own.columns if c != "members"]
    assert sorted(map(str, own.select(keep).collect())) == sorted(map(str, again.select(keep).collect()))
