"""From rows of messages, as the sources give them, to the library's tables in its units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolake.functions import units
from aerolake.operators import align, series


def flight() -> Column:
    return F.col("path").alias("flight_id")


def value(*names: str) -> Column:
    """The first of these fields that a message has."""
    return F.coalesce(*(F.try_element_at("fields", F.lit(n)) for n in names))


def seconds(rows: DataFrame) -> DataFrame:
    """``t``: seconds on the log's own clock, which all tables of a flight share."""
    return rows.withColumn("t", F.col("time_us") / 1e6)


def dataflash_pid(messages: DataFrame) -> DataFrame:
    """pid_samples: PIDR, PIDP, PIDY; for an axis without them the rates of RATE. Radians become degrees per series."""
    rows = seconds(messages.where(F.col("mtype").isin("PIDR", "PIDP", "PIDY", "RATE")))
    own = rows.where("mtype <> 'RATE'").select(flight(), "idx", "t", F.when(F.col("mtype") == "PIDR", "roll").when(F.col("mtype") == "PIDP", "pitch").otherwise("yaw").alias("axis"), value("Tar", "Des").alias("desired"), value("Act").alias("actual"), value("P").alias("p"), value("I").alias("i"), value("D").alias("d"), value("FF").alias("ff"), F.lit(0).alias("priority"))
    rate = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), value(f"{c}Des").alias("desired"), value(c).alias("actual")) for a, c in (("roll", "R"), ("pitch", "P"), ("yaw", "Y")))))
    legacy = rows.where("mtype = 'RATE'").select(flight(), "idx", "t", rate.alias("r")).select("flight_id", "idx", "t", "r.*", *(F.lit(None).cast("double").alias(c) for c in ("p", "i", "d", "ff")), F.lit(1).alias("priority"))
    both = own.unionByName(legacy).where("desired is not null and actual is not null")
    kept = series.by_priority(both, ["flight_id", "axis"], F.col("priority")).drop("priority")
    return units.degrees_if_radians(kept, ["flight_id", "axis"], ["desired", "actual"])


def dataflash_imu(messages: DataFrame, least: int = 10) -> DataFrame:
    """imu_samples of the primary sensor, or of all where it has fewer than ``least`` rows; deg/s and m/s2."""
    rows = seconds(messages.where("mtype = 'IMU'"))
    rows = series.primary_instance(rows, ["path"], "instance", 0, least)
    return rows.select(flight(), "idx", "t", *(F.degrees(value(c)).alias(n) for c, n in (("GyrX", "gx"), ("GyrY", "gy"), ("GyrZ", "gz"))), *(value(c).alias(n) for c, n in (("AccX", "ax"), ("AccY", "ay"), ("AccZ", "az"))))


def dataflash_params(messages: DataFrame) -> DataFrame:
    """params: the last value of each name."""
    return messages.where("mtype = 'PARM'").groupBy(flight(), F.col("text").alias("name")).agg(F.max_by(value("Value"), "idx").alias("value"))


def telemetry_messages(messages: DataFrame) -> DataFrame:
    """Messages of the vehicle alone, once a heartbeat that is no ground station's names it, on one clock ``t`` (s)."""
    from aerolake.operators.diagnosis import own_system

    vehicle = (F.col("mtype") == "HEARTBEAT") & (value("type") != 6)
    rows = own_system(messages, ["path"], "sysid", vehicle, "idx").withColumns({"wall": F.col("wall_us") / 1e6, "vehicle": F.col("time_us") / 1e6})
    return align.reconcile_clocks(rows, ["path"], "wall", "vehicle")


def telemetry_imu(messages: DataFrame) -> DataFrame:
    """imu_samples from RAW_IMU, else SCALED_IMU, else the body rates of ATTITUDE alone: milli-g to m/s2, milliradians (there radians) to degrees per second."""
    rank = F.when(F.col("mtype") == "RAW_IMU", 0).when(F.col("mtype") == "SCALED_IMU", 1).otherwise(2)
    rows = telemetry_messages(messages).where("mtype in ('RAW_IMU', 'SCALED_IMU', 'ATTITUDE')").withColumn("_rank", rank)
    rows = series.by_priority(rows, ["path"], F.col("_rank"))
    body = F.col("mtype") == "ATTITUDE"
    gyro = {f"g{c}": F.when(body, F.degrees(value(f"{a}speed"))).otherwise(units.rate_from_mrad(value(f"{c}gyro"))) for c, a in (("x", "roll"), ("y", "pitch"), ("z", "yaw"))}
    return rows.select(flight(), "idx", "t", *(c.alias(n) for n, c in gyro.items()), *(units.acceleration_from_mg(value(f"{c}acc")).alias(f"a{c}") for c in "xyz"))


def telemetry_battery(messages: DataFrame) -> DataFrame:
    rows = telemetry_messages(messages).where("mtype = 'SYS_STATUS'")
    volt = units.measured_voltage(value("voltage_battery"))
    return rows.select(flight(), "idx", "t", (volt / 1000).alias("volt"), units.drawn_current(value("current_battery") / 100).alias("curr")).where("volt is not null")


def ulog_pid(messages: DataFrame) -> DataFrame:
    """pid_samples: rate setpoints brought to the gyro's clock by interpolation, radians to degrees."""
    rows = seconds(messages.where(F.col("mtype").isin("vehicle_rates_setpoint", "vehicle_angular_velocity")))
    axes = ("roll", "pitch", "yaw")
    actual = rows.where("mtype = 'vehicle_angular_velocity'").select(flight(), "idx", "t", *(F.degrees(value(f"xyz[{k}]")).alias(f"actual_{a}") for k, a in enumerate(axes)))
    desired = rows.where("mtype = 'vehicle_rates_setpoint'").select(flight(), "t", *(F.degrees(value(a)).alias(a) for a in axes))
    met = align.interpolate_at(actual, desired, ["flight_id"], "t", axes, "idx")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("desired"), F.col(f"actual_{a}").alias("actual")) for a in axes)))
    return met.select("flight_id", "idx", "t", each.alias("r")).select("flight_id", "r.axis", "idx", "t", "r.desired", "r.actual")


def blackbox_pid(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """pid_samples of a decoded blackbox log: clock from the headers' loop time, high-resolution fields in tenths. Every segment of a file is a flight
    of its own, 'path#segment': its clock and numbers begin anew.
    """
    number = lambda name, default: F.coalesce(F.try_element_at("properties", F.lit(name)).cast("double"), F.lit(float(default)))
    interval = F.coalesce(F.try_element_at("properties", F.lit("P interval")), F.lit("1/1"))
    numerator, denominator = F.split_part(interval, F.lit("/"), F.lit(1)).cast("double"), F.greatest(F.coalesce(F.try_element_at(F.split(interval, "/"), F.lit(2)).cast("double"), F.lit(1.0)), F.lit(1.0))
    every = F.when(F.contains(interval, F.lit("/")), denominator / F.greatest(numerator, F.lit(1.0))).otherwise(numerator)
    head = headers.select("path", "segment", (1e6 / (number("looptime", 250) * every)).alias("rate_hz"), (number("blackbox_high_resolution", 0) > 0).alias("fine"))
    rows = frames.where("kind in ('I', 'P')").join(head, ["path", "segment"])
    rows = rows.withColumn("idx", F.col("idx").cast("long"))
    of = lambda name: F.try_element_at("values", F.lit(name)).cast("double")
    axes = ("roll", "pitch", "yaw")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), units.tenths("setpoint", of(f"setpoint[{k}]"), F.col("fine")).alias("desired"), units.tenths("gyroADC", of(f"gyroADC[{k}]"), F.col("fine")).alias("actual"), of(f"axisP[{k}]").alias("p"), of(f"axisI[{k}]").alias("i"), of(f"axisD[{k}]").alias("d"), of(f"axisF[{k}]").alias("ff")) for k, a in enumerate(axes))))
    own = F.concat(F.col("path"), F.lit("#"), F.col("segment").cast("string")).alias("flight_id")
    out = rows.select(own, "segment", "idx", (F.col("idx") / F.col("rate_hz")).alias("t"), each.alias("r")).select("flight_id", "segment", "r.axis", "idx", "t", *(f"r.{c}" for c in ("desired", "actual", "p", "i", "d", "ff")))
    repaired = series.repair_outliers(out.where("actual is not null"), ["flight_id", "axis"], MOST_RATE, "actual")
    return repaired.withColumn("actual", F.col("repaired")).drop("repaired")


#: Degrees a second beyond which a decoded rate is a lost frame's; throttle pulses of a log without them; fixed values.
MOST_RATE, LOW_PULSE, HIGH_PULSE = 2000.0, 1070.0, 2000.0


def blackbox_rows(frames: DataFrame, headers: DataFrame, kinds: str = "'I', 'P'") -> DataFrame:
    """flight_id, idx, t, kind, values, properties, fine of the frames of every segment, on the clock of ``blackbox_pid``."""
    of = lambda name, default: F.coalesce(F.try_element_at("properties", F.lit(name)).cast("double"), F.lit(float(default)))
    interval = F.coalesce(F.try_element_at("properties", F.lit("P interval")), F.lit("1/1"))
    parts = F.transform(F.split(interval, "/"), lambda x: F.greatest(F.coalesce(x.try_cast("double"), F.lit(1.0)), F.lit(1.0)))
    every = F.when(F.size(parts) > 1, parts[1] / parts[0]).otherwise(parts[0])
    head = headers.select("path", "segment", "properties", (1e6 / (of("looptime", 250) * every)).alias("rate_hz"), (of("blackbox_high_resolution", 0) > 0).alias("fine"))
    rows = frames.where(f"kind in ({kinds})").join(head, ["path", "segment"])
    own = F.concat("path", F.lit("#"), F.col("segment").cast("string"))
    return rows.select(own.alias("flight_id"), F.col("idx").cast("long").alias("idx"), (F.col("idx") / F.col("rate_hz")).alias("t"), "kind", "values", "properties", "fine")


def frame_value(*names: str) -> Column:
    """The first of these fields that a frame has."""
    return F.coalesce(*(F.try_element_at("values", F.lit(n)).cast("double") for n in names))


def property_value(name: str, default: float) -> Column:
    return F.coalesce(F.try_element_at("properties", F.lit(name)).try_cast("double"), F.lit(float(default)))


def blackbox_imu(frames: DataFrame, headers: DataFrame, unfiltered: bool = False) -> DataFrame:
    """imu_samples: gyro in deg/s, values that lost frames make repaired; acceleration in m/s2 (null without it). ``unfiltered``: the gyro before its filters, where it is logged."""
    rows = blackbox_rows(frames, headers)
    gyro = {f"g{a}": units.tenths("gyroADC", frame_value(*([f"gyroUnfilt[{k}]"] if unfiltered else [f"gyroADC[{k}]", f"gyroData[{k}]"])), F.col("fine")) for k, a in enumerate("xyz")}
    acc = {f"a{a}": units.acceleration_from_adc(frame_value(f"accSmooth[{k}]", f"accData[{k}]"), property_value("acc_1G", 256)) for k, a in enumerate("xyz")}
    out = rows.select("flight_id", "idx", "t", *(c.alias(n) for n, c in {**gyro, **acc}.items())).where("gx is not null")
    for n in gyro:
        out = series.repair_outliers(out, ["flight_id"], MOST_RATE, n).withColumn(n, F.col("repaired")).drop("repaired")
    return out


def blackbox_motors(frames: DataFrame, headers: DataFrame, channels: int = 8) -> DataFrame:
    """flight_id, idx, t, channel, output (share of the throttle range that the header gives)."""
    rows = blackbox_rows(frames, headers)
    low, high = property_value("minthrottle", LOW_PULSE), property_value("maxthrottle", HIGH_PULSE)
    raw = lambda k: frame_value(f"motor[{k}]")
    each = F.explode(F.array(*(F.struct(F.lit(k + 1).alias("channel"), F.when(raw(k).isNotNull() & (high > low), units.motor_share(raw(k), low, high)).otherwise(raw(k)).alias("output")) for k in range(channels))))
    return rows.select("flight_id", "idx", "t", each.alias("c")).select("flight_id", "idx", "t", "c.*").where("output is not null")


def blackbox_battery(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """flight_id, idx, t, volt, curr of logs that hold them, in hundredths."""
    rows = blackbox_rows(frames, headers)
    return rows.select("flight_id", "idx", "t", (frame_value("vbatLatest") / 100).alias("volt"), units.drawn_current(frame_value("amperageLatest") / 100).alias("curr")).where("volt is not null")


#: Number of the event that holds flight mode flags; a fixed value.
MODE_EVENT = 30


def blackbox_modes(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """flight_id, idx, t, mode_number (flags), mode_name at each change, from the slow fields and from mode events."""
    from aerolake.operators import tables

    rows = blackbox_rows(frames, headers, "'I', 'P', 'E'")
    flags = F.when(F.col("kind") == "E", F.when(frame_value("event") == MODE_EVENT, frame_value("value0"))).otherwise(frame_value("flightModeFlags"))
    known = rows.select("flight_id", "idx", "t", F.when(F.col("kind") == "E", 0).otherwise(1).alias("_late"), flags.alias("mode_number")).where("mode_number is not null")
    changed = series.changes(known, ["flight_id"], "mode_number", "idx", "_late")
    return changed.select("flight_id", "idx", "t", "mode_number", tables.betaflight_mode(F.col("mode_number")).alias("mode_name"))


def blackbox_versions(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """flight_id, firmware, kind, board, craft of every segment, as its header names them."""
    own = F.concat("path", F.lit("#"), F.col("segment").cast("string")).alias("flight_id")
    named = {"firmware": "Firmware revision", "kind": "Firmware type", "board": "Board information", "craft": "Craft name"}
    return headers.select(own, *(F.try_element_at("properties", F.lit(v)).alias(k) for k, v in named.items()))


def blackbox_params(frames: DataFrame, headers: DataFrame) -> DataFrame:
    """params: the numbers among the header properties of every segment."""
    own = F.concat("path", F.lit("#"), F.col("segment").cast("string"))
    rows = headers.select(own.alias("flight_id"), F.explode("properties").alias("name", "value"))
    return rows.select("flight_id", "name", F.col("value").try_cast("double").alias("value")).where("value is not null")
