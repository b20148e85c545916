"""From messages to the tables of a fleet beyond PID and IMU: magnetometer, attitude, motors, battery, modes, position, parameters of every log format.

Every table has flight_id, idx and t (seconds on the clock of the log), in the library's units: mGauss, degrees, shares of full output,
volt, ampere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.functions import units
from aerolake.operators import align, attitude, ingest, series
from aerolake.operators.ingest import flight, seconds, value

#: Flight modes of copters by number, by their generic names; fixed values.
COPTER_MODES = {0: "stabilize", 1: "acro", 2: "althold", 3: "auto", 4: "guided", 5: "loiter", 6: "rtl", 7: "circle", 9: "land", 11: "drift", 13: "sport", 14: "flip", 15: "autotune", 16: "poshold", 17: "brake", 18: "throw", 20: "guided_nogps", 21: "smart_rtl", 23: "follow"}
#: Types of vehicles whose mode numbers are those of copters; fixed values.
COPTER_TYPES = (2, 3, 4, 13, 14, 15, 29)
#: Generic names of gains and filters by their native ones; fixed values.
GENERIC = {
    "ardupilot": {
        **{f"ATC_RAT_{a}_{g}": f"pid.{n}.{g.lower()}" for a, n in (("RLL", "roll"), ("PIT", "pitch"), ("YAW", "yaw")) for g in ("P", "I", "D", "FF")},
        "INS_HNTCH_ENABLE": "filter.notch1.enable", "INS_HNTCH_FREQ": "filter.notch1.freq", "INS_HNTCH_BW": "filter.notch1.bw", "INS_GYRO_FILTER": "filter.gyro_lpf", "INS_ACCEL_FILTER": "filter.accel_lpf",
        "COMPASS_OFS_X": "mag.ofs.x", "COMPASS_OFS_Y": "mag.ofs.y", "COMPASS_OFS_Z": "mag.ofs.z",
    },
    "betaflight": {**{f"{g}_{n}": f"pid.{n}.{'ff' if g == 'f' else g}" for n in ("roll", "pitch", "yaw") for g in "pidf"}, "gyro_lpf1_static_hz": "filter.gyro_lpf", "gyro_lpf2_static_hz": "filter.gyro_lpf2", "dterm_lpf1_static_hz": "filter.dterm_lpf", **{f"pid_{n}_{g}": f"pid.{n}.{'ff' if g == 'f' else g}" for n in ("roll", "pitch", "yaw") for g in "pidf"}, "gyro_lowpass_hz": "filter.gyro_lpf", "gyro_lowpass2_hz": "filter.gyro_lpf2", "dterm_lowpass_hz": "filter.dterm_lpf"},
    "px4": {**{f"MC_{n}RATE_{g}": f"pid.{m}.{g.lower()}" for n, m in (("ROLL", "roll"), ("PITCH", "pitch"), ("YAW", "yaw")) for g in ("P", "I", "D", "FF")}, "IMU_GYRO_CUTOFF": "filter.gyro_lpf"},
}


def mirrored(params: DataFrame, platform: str, overwrite: bool = False) -> DataFrame:
    """``params`` (flight_id, name, value) with every native gain and filter under its generic name too; a generic row that is there stays unless ``overwrite``."""
    pairs = F.create_map(*(F.lit(x) for pair in GENERIC[platform].items() for x in pair))
    known = params.withColumn("_generic", F.try_element_at(pairs, F.col("name")))
    added = known.where("_generic is not null").groupBy("flight_id", F.col("_generic").alias("name")).agg(F.max_by("value", "name").alias("value"))
    if overwrite:
        return params.join(added, ["flight_id", "name"], "left_anti").unionByName(added)
    return params.unionByName(added.join(params, ["flight_id", "name"], "left_anti"))


def numbers(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """flight_id, idx, t and the named columns, of rows in which the first of them is known."""
    return rows.select(flight(), "idx", "t", *(c.alias(n) for n, c in fields.items())).where(F.col(next(iter(fields))).isNotNull())


def mode_name(number: Column, vehicle: Column | None = None) -> Column:
    """Generic name of a copter's mode number; of other vehicles, and of numbers without a name, MODE and the number."""
    table = F.create_map(*(x for k, v in COPTER_MODES.items() for x in (F.lit(k), F.lit(v))))
    named = F.try_element_at(table, number.cast("int"))
    if vehicle is not None:
        named = F.when(vehicle.cast("int").isin(*COPTER_TYPES), named)
    return F.coalesce(named, F.concat(F.lit("MODE"), number.cast("int").cast("string")))


def betaflight_mode(flags: Column) -> Column:
    """Generic name of the flight mode that the flag bits of a frame stand for."""
    bit = lambda n: F.getbit(flags.cast("long"), F.lit(n)) == 1
    return F.when(~bit(0), "disarmed").when(bit(1), "stabilize").when(bit(2), "horizon").when(bit(15), "failsafe").otherwise("acro")


# DataFlash


def dataflash_mag(messages: DataFrame, least: int = 10) -> DataFrame:
    rows = series.primary_instance(seconds(messages.where("mtype = 'MAG'")), ["path"], "instance", 0, least)
    return numbers(rows, {"mx": value("MagX"), "my": value("MagY"), "mz": value("MagZ"), **{f"{k}_{a}": value(f"{n}{a.upper()}") for k, n in (("ofs", "Ofs"), ("mot", "MO")) for a in "xyz"}})


def dataflash_attitude(messages: DataFrame) -> DataFrame:
    return numbers(seconds(messages.where("mtype = 'ATT'")), {"roll": value("Roll"), "pitch": value("Pitch"), "yaw": value("Yaw")})


def dataflash_battery(messages: DataFrame, least: int = 1) -> DataFrame:
    rows = series.primary_instance(seconds(messages.where(F.col("mtype").isin("BAT", "CURR"))), ["path"], "instance", 0, least)
    return numbers(rows, {"volt": value("Volt"), "curr": value("Curr")})


def dataflash_motors(messages: DataFrame, channels: int = 14) -> DataFrame:
    """flight_id, idx, t, channel, output (share of full output), of channels that ever pass 800 microseconds."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), value(f"C{k}", f"Ch{k}").alias("pwm")) for k in range(1, channels + 1))))
    rows = seconds(messages.where("mtype = 'RCOU'")).select(flight(), "idx", "t", each.alias("c")).select("flight_id", "idx", "t", "c.*").where("pwm is not null")
    return units.active_channels(rows, ["flight_id"], "channel", "pwm", 800.0).withColumn("output", units.pwm_share(F.col("pwm"))).drop("pwm")


def dataflash_modes(messages: DataFrame) -> DataFrame:
    return numbers(seconds(messages.where("mtype = 'MODE'")), {"mode_number": value("ModeNum", "Mode")}).withColumn("mode_name", mode_name(F.col("mode_number")))


def dataflash_position(messages: DataFrame) -> DataFrame:
    """flight_id, lat, lon, alt: of the middle fix (status 3 or better) of a flight; without one of its last origin, else of its middle AHR2 estimate."""
    rows = seconds(messages.where(F.col("mtype").isin("GPS", "ORGN", "AHR2")))
    degrees = lambda c: F.when(F.abs(c) > 1000, c * 1e-7).otherwise(c)
    found = numbers(rows, {"lat": degrees(value("Lat")), "lon": degrees(value("Lng")), "alt": value("Alt"), "status": value("Status"), "kind": F.col("mtype")})
    usable = (F.col("kind") != "GPS") | (F.coalesce("status", F.lit(3.0)) >= 3)
    placed = found.where(usable & ((F.col("lat") != 0) | (F.col("lon") != 0))).drop("status")
    rank = F.when(F.col("kind") == "GPS", 0).when(F.col("kind") == "ORGN", 1).otherwise(2)
    best = series.by_priority(placed, ["flight_id"], rank)
    last = F.max("idx").over(Window.partitionBy("flight_id"))
    return middle_fix(best.withColumn("_last", last).where("kind <> 'ORGN' or idx = _last").drop("kind", "_last"))


def dataflash_versions(messages: DataFrame) -> DataFrame:
    """flight_id, firmware (text of the last VER message), board, idx, t."""
    rows = seconds(messages.where("mtype = 'VER'")).select(flight(), "idx", "t", F.col("text").alias("firmware"), value("APJ").cast("long").alias("board"))
    return rows.withColumn("_last", F.max("idx").over(Window.partitionBy("flight_id"))).where("idx = _last").drop("_last")


def dataflash_texts(messages: DataFrame) -> DataFrame:
    """flight_id, idx, t, text of what the vehicle said (MSG)."""
    return seconds(messages.where("mtype = 'MSG'")).select(flight(), "idx", "t", "text").where("text is not null")


def dataflash_autotune(messages: DataFrame) -> DataFrame:
    """flight_id, idx, t, axis, p, i, d of ATUN messages."""
    return numbers(seconds(messages.where("mtype = 'ATUN'")), {"axis": value("Axis"), "p": value("P", "RP"), "i": value("I"), "d": value("D", "RD")})


# ULog


def ulog_imu(messages: DataFrame) -> DataFrame:
    rows = seconds(messages.where("mtype = 'sensor_combined' and instance = 0"))
    return numbers(rows, {f"g{a}": F.degrees(value(f"gyro_rad[{k}]")) for k, a in enumerate("xyz")} | {f"a{a}": value(f"accelerometer_m_s2[{k}]") for k, a in enumerate("xyz")})


def ulog_mag(messages: DataFrame) -> DataFrame:
    """From sensor_mag; for flights without it from what old firmware puts into sensor_combined. Gauss to mGauss."""
    rows = seconds(messages.where("mtype in ('sensor_mag', 'sensor_combined') and instance = 0")).withColumn("_rank", F.when(F.col("mtype") == "sensor_mag", 0).otherwise(1))
    axes = {f"m{a}": units.milligauss(F.when(F.col("_rank") == 0, value(a)).otherwise(value(f"magnetometer_ga[{k}]"))) for k, a in enumerate("xyz")}
    found = rows.select(flight(), "idx", "t", "_rank", *(c.alias(n) for n, c in axes.items())).where("mx is not null")
    return series.by_priority(found, ["flight_id"], F.col("_rank")).drop("_rank")


def ulog_attitude(messages: DataFrame) -> DataFrame:
    rows = numbers(seconds(messages.where("mtype = 'vehicle_attitude' and instance = 0")), {f"q{k + 1}": value(f"q[{k}]") for k in range(4)})
    return rows.withColumns(dict(zip(("roll", "pitch", "yaw"), attitude.to_euler(attitude.normalized([F.col(f"q{k}") for k in range(1, 5)])), strict=True)))


def ulog_battery(messages: DataFrame) -> DataFrame:
    return numbers(seconds(messages.where("mtype = 'battery_status' and instance = 0")), {"volt": value("voltage_v"), "curr": value("current_a")})


def ulog_motors(messages: DataFrame, channels: int = 12) -> DataFrame:
    """actuator_motors as they are, within 0..1; for flights without them the active pulses of actuator_outputs."""
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("channel"), value(f"control[{k}]").alias("share"), value(f"output[{k}]").alias("pwm")) for k in range(channels))))
    rows = seconds(messages.where("mtype in ('actuator_motors', 'actuator_outputs') and instance = 0")).select(flight(), "idx", "t", F.when(F.col("mtype") == "actuator_motors", 0).otherwise(1).alias("_rank"), each.alias("c"))
    rows = rows.select("flight_id", "idx", "t", "_rank", "c.*").where("share is not null and not isnan(share) or pwm is not null")
    kept = series.by_priority(rows, ["flight_id"], F.col("_rank"))
    active = kept.groupBy("flight_id", "channel").agg(F.max("share").alias("_share"), F.max("pwm").alias("_pwm")).where("_share > 0 or _pwm > 800").select("flight_id", "channel")
    output = F.when(F.col("_rank") == 0, F.least(F.greatest("share", F.lit(0.0)), F.lit(1.0))).otherwise(units.pwm_share(F.col("pwm")))
    return kept.join(active, ["flight_id", "channel"], "left_semi").select("flight_id", "idx", "t", "channel", output.alias("output"))


def ulog_position(messages: DataFrame) -> DataFrame:
    """Middle fix; degrees either way, metres from millimetres."""
    rows = numbers(seconds(messages.where("mtype in ('vehicle_gps_position', 'sensor_gps') and instance = 0")), {"lat": value("lat", "latitude_deg"), "lon": value("lon", "longitude_deg"), "alt": value("alt", "altitude_msl_m")})
    rows = rows.select("flight_id", "idx", "t", units.coordinate(F.col("lat")).alias("lat"), units.coordinate(F.col("lon")).alias("lon"), units.altitude(F.col("alt")).alias("alt"))
    return middle_fix(rows)


def ulog_params(messages: DataFrame) -> DataFrame:
    return messages.where("mtype = 'parameter'").groupBy(flight(), F.col("text").alias("name")).agg(F.max_by(value("value"), "idx").alias("value"))


# Telemetry


def telemetry_pid(messages: DataFrame, least: int = 10) -> DataFrame:
    """pid_samples: wanted body rates brought to the clock of the measured ones, radians to degrees; flights with fewer than ``least`` messages of either kind have none."""
    rows = ingest.telemetry_messages(messages).where("mtype in ('ATTITUDE', 'ATTITUDE_TARGET')")
    axes = ("roll", "pitch", "yaw")
    actual = rows.where("mtype = 'ATTITUDE'").select(flight(), "idx", "t", *(F.degrees(value(f"{a}speed")).alias(f"actual_{a}") for a in axes))
    desired = rows.where("mtype = 'ATTITUDE_TARGET'").select(flight(), "idx", "t", *(F.degrees(value(f"body_{a}_rate")).alias(a) for a in axes))
    actual, desired = series.long_enough(actual, ["flight_id"], least), series.long_enough(desired, ["flight_id"], least)
    met = align.interpolate_at(actual, desired.drop("idx"), ["flight_id"], "t", axes, "idx")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("desired"), F.col(f"actual_{a}").alias("actual")) for a in axes)))
    return met.select("flight_id", "idx", "t", each.alias("r")).select("flight_id", "r.axis", "idx", "t", "r.desired", "r.actual").where("desired is not null")


def telemetry_mag(messages: DataFrame) -> DataFrame:
    return numbers(ingest.telemetry_messages(messages).where("mtype = 'RAW_IMU'"), {f"m{a}": value(f"{a}mag") for a in "xyz"})


def telemetry_attitude(messages: DataFrame) -> DataFrame:
    return numbers(ingest.telemetry_messages(messages).where("mtype = 'ATTITUDE'"), {a: F.degrees(value(a)) for a in ("roll", "pitch", "yaw")})


def telemetry_motors(messages: DataFrame) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), value(f"servo{k}_raw").alias("pwm")) for k in range(1, 9))))
    rows = ingest.telemetry_messages(messages).where("mtype = 'SERVO_OUTPUT_RAW'").select(flight(), "idx", "t", each.alias("c")).select("flight_id", "idx", "t", "c.*").where("pwm is not null")
    return units.active_channels(rows, ["flight_id"], "channel", "pwm", 800.0).withColumn("output", units.pwm_share(F.col("pwm"))).drop("pwm")


def telemetry_params(messages: DataFrame) -> DataFrame:
    rows = ingest.telemetry_messages(messages).where("mtype = 'PARAM_VALUE'")
    return rows.groupBy(flight(), F.col("text").alias("name")).agg(F.max_by(value("param_value"), "idx").alias("value"))


def telemetry_modes(messages: DataFrame) -> DataFrame:
    """A row at each change of mode; the first heartbeat counts."""
    rows = ingest.telemetry_messages(messages).where("mtype = 'HEARTBEAT'").withColumns({"mode_number": value("custom_mode"), "_type": value("type")}).where("_type <> 6")
    changed = series.changes(rows, ["path"], "mode_number", "t", "idx")
    return changed.select(flight(), "idx", "t", "mode_number", mode_name(F.col("mode_number"), F.col("_type")).alias("mode_name"))


def telemetry_position(messages: DataFrame) -> DataFrame:
    rows = ingest.telemetry_messages(messages).where("mtype = 'GPS_RAW_INT'")
    return middle_fix(numbers(rows, {"lat": value("lat") * 1e-7, "lon": value("lon") * 1e-7, "alt": value("alt") * 1e-3, "fix": value("fix_type")}).where("fix >= 3").drop("fix"))


#: Seconds without a message of the vehicle after which its link counts as lost; a fixed value.
LINK_GAP = 3.0


def telemetry_health(messages: DataFrame) -> DataFrame:
    """flight_id, notes (codes) and penalty (of the quality score) of logs recorded over a radio link: from counts of their messages, rates, losses and systems."""
    from aerolake.operators import diagnosis

    own = ingest.telemetry_messages(messages)
    count = lambda *kinds: F.count_if(F.col("mtype").isin(*kinds))
    moved = (F.abs(value("xacc")) + F.abs(value("yacc")) + F.abs(value("zacc"))) > 0
    counts = own.groupBy("path").agg(
        F.bool_or(F.col("time_us").isNotNull()).alias("clocked"), count("ATTITUDE").alias("attitudes"), count("ATTITUDE_TARGET").alias("targets"), count("RAW_IMU", "SCALED_IMU").alias("raw_imu"),
        F.count_if(F.col("mtype").isin("RAW_IMU", "SCALED_IMU") & moved).alias("accel"), count("PARAM_VALUE").alias("params"), F.max(F.when(F.col("mtype") == "HEARTBEAT", value("type"))).cast("int").alias("vehicle"),
    )
    of = lambda name, *kinds: series.measured_rate(own.where(F.col("mtype").isin(*kinds)), ["path"]).select("path", F.col("rate_hz").alias(name))
    waited = own.select("path", (F.col("wall") - F.lag("wall").over(series.along(["path"], "wall", "idx"))).alias("dt"))
    gaps = series.long_gaps(waited, ["path"], LINK_GAP).select("path", "gaps")
    counted = own.where("seq is not null")
    lost = series.sequence_drops(counted, ["path", "sysid", "compid"], "seq", "idx").groupBy("path").agg((100 * F.sum("dropped") / (F.sum("frames") + F.sum("dropped"))).alias("dropped"))
    systems = messages.where((F.col("mtype") == "HEARTBEAT") & (value("type") != 6)).groupBy("path").agg(F.countDistinct("sysid").alias("systems"))
    rows = counts
    for other in (of("attitude_hz", "ATTITUDE"), of("gyro_hz", "RAW_IMU", "SCALED_IMU"), gaps, lost, systems):
        rows = rows.join(other, "path", "left")
    known = lambda c, otherwise: F.coalesce(c, F.lit(otherwise))
    notes = diagnosis.telemetry_notes(
        F.col("clocked"), F.col("attitudes"), F.col("targets"), known("attitude_hz", 0.0), F.col("raw_imu"), known("gyro_hz", 0.0), F.col("accel"), F.col("params"), known("gaps", 0), known("dropped", 0.0), known("systems", 0), known("vehicle", 2),
    )
    return rows.select(flight(), notes.alias("notes"), diagnosis.telemetry_penalty(F.col("targets")).alias("penalty"))


# All of them


def middle_fix(rows: DataFrame) -> DataFrame:
    from aerolake.operators import diagnosis

    return diagnosis.middle_row(rows, ["flight_id"], "t", "idx").select("flight_id", "lat", "lon", "alt")


def with_current(mag: DataFrame, battery: DataFrame) -> DataFrame:
    """``mag`` with ``curr`` interpolated from the battery's clock and ``throttle``, its share of the largest in the flight (0 where none flows)."""
    met = align.interpolate_at(mag, battery.select("flight_id", "t", "curr").where("curr is not null"), ["flight_id"], "t", ["curr"], "idx")
    return units.throttle_share(met, ["flight_id"], "curr")


def with_field(mag: DataFrame, attitudes: DataFrame, field: Sequence[Column], order: str = "idx") -> DataFrame:
    """``mag`` with the field (north, east, down in mGauss) of its place turned into the body's axes by the attitude at its time: bx, by, bz."""
    angles = ("roll", "pitch", "yaw")
    turned = attitudes.select("flight_id", "t", *(f(F.radians(a)).alias(f"{n}_{a}") for a in angles for n, f in (("sin", F.sin), ("cos", F.cos))))
    met = align.interpolate_at(mag, turned, ["flight_id"], "t", [f"{n}_{a}" for a in angles for n in ("sin", "cos")], order)
    met = met.withColumns({a: F.degrees(F.atan2(f"sin_{a}", f"cos_{a}")) for a in angles})  # an angle is never interpolated across its wrap
    q = attitude.from_euler(F.col("roll"), F.col("pitch"), F.col("yaw"))
    turned_field = attitude.rotate([q[0], -q[1], -q[2], -q[3]], list(field))
    return met.withColumns(dict(zip(("bx", "by", "bz"), turned_field, strict=True))).drop(*(f"{n}_{a}" for a in angles for n in ("sin", "cos")), *angles).where("bx is not null")
