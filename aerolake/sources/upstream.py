"""Parameter catalogs from what firmware projects publish: two JSON layouts and a settings table in C, as rows of ``params.ROW``.

``ardupilot_catalog`` and ``px4_catalog`` read generated metadata with Spark's own JSON and map functions. ``betaflight_catalog`` reads C sources: each file is
tokenised in a task (``tokens``), its macros, lookup tables and table entries come out as rows, and names, bounds and members are resolved
by joins. ``documents`` makes of such rows the files that ``params.read_catalog`` reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolake.operators import diagnosis
from aerolake.sources.params import ROW, version_name

SCHEMA_VERSION = 2
NAMES = [f.split()[0].strip("`") for f in ROW.split(", ")]
#: Categories by patterns of names, the first that fits; fixed values.
ARDUPILOT_RULES = [
    (r"^ATC_RAT_(RLL|PIT|YAW)_", "pid"), (r"^ATC_ANG_(RLL|PIT|YAW)_P", "pid"), (r"^ATC_(ACCEL|RATE)_", "rate"), (r"^ATC_", "attitude"), (r"^PSC", "position"),
    (r"^INS_(HNTCH|HNTC2|NOTCH|GYRO_FILTER|ACCEL_FILTER|LOG_BAT|FAST_SAMPLE|GYRO_RATE)", "filter"), (r"^INS_", "imu"), (r"^COMPASS_", "mag"), (r"^BATT\d*_", "battery"), (r"^MOT_", "motor"),
    (r"^(SERVO|RC\d|RC_|RCMAP_|FLTMODE|SIMPLE|SUPER_SIMPLE)", "rc"), (r"^GPS", "gps"), (r"^LOG_", "logging"), (r"^EK[23]_", "ekf"), (r"^(FS_|ARMING_|FENCE_|AVOID_|AFS_|BRD_SAFETY)", "safety"),
    (r"^(SERIAL|CAN_|SCR_|BRD_|NET_|MAV|SR\d)", "system"), (r"^(H_|AROT_)", "heli"), (r"^OSD", "osd"), (r"^AUTOTUNE_", "autotune"), (r"^BARO", "baro"), (r"^(WPNAV_|LOIT_|RTL_|LAND_|CIRCLE_|AUTO_)", "navigation"),
]
VEHICLES = ("copter", "plane", "rover", "sub", "tracker", "blimp")
PX4_RULES = [
    (r"^MC_(ROLL|PITCH|YAW)RATE_", "pid"), (r"^MC_", "attitude"), (r"^IMU_(GYRO|DGYRO|ACCEL)_(CUTOFF|NF|DNF)", "filter"), (r"^IMU_", "imu"), (r"^EKF2_", "ekf"), (r"^BAT\d*_", "battery"), (r"^(CAL_MAG|SENS_MAG|MAG_)", "mag"),
    (r"^MPC_", "position"), (r"^FW_", "fixedwing"), (r"^(COM_|FD_|GF_|NAV_FORCE)", "safety"), (r"^(SDLOG_|LOG_)", "logging"), (r"^(GPS_|SENS_GPS)", "gps"), (r"^(PWM_|MOT_|CA_)", "motor"), (r"^RC(\d+|_)", "rc"),
]
BETAFLIGHT_RULES = [
    (r"^(p|i|d|f)_(roll|pitch|yaw)$", "pid"), (r"^d_(max|min)_", "pid"), (r"^(anti_gravity|iterm_|feedforward_|tpa_|abs_control|d_max|thrust_linear|pidsum|pid_at_min_throttle|simplified_(pid|d))", "pid"),
    (r"^(gyro_lpf|gyro_notch|gyro_hardware_lpf|dterm_lpf|dterm_notch|dyn_notch|rpm_filter|acc_lpf|yaw_lowpass|simplified_(gyro|dterm)_filter)", "filter"), (r"^(roll|pitch|yaw)_(rc_rate|srate|expo)$", "rate"), (r"^(rates_type|thr_mid|thr_expo|throttle_limit)", "rate"),
    (r"^(vbat_|ibata|current_meter|battery_|voltage_meter|amperage_meter|bat_)", "battery"), (r"^(mag_|align_mag|compass)", "mag"), (r"^(acc_|align_acc|gyro_[1-8]_|gyro_offset|gyro_enable|gyro_calib|gyro_to_use|gyro_overflow|gyro_hardware)", "imu"),
    (r"^(motor_|mixer_|dshot_|min_throttle|max_throttle|idle_)", "motor"), (r"^(rc_|rx_|serialrx|rssi|min_check|max_check|deadband|yaw_deadband|srxl2|spektrum|sbus|crsf|fport|msp_override|switch_arming|throttle_correction)", "rc"),
    (r"^(osd|displayport|max7456|cms)", "osd"), (r"^(blackbox|debug)", "logging"), (r"^(gps|imu_|nav_|pos_hold|alt_hold)", "navigation"), (r"^(failsafe|arming|small_angle|runaway|crash_recovery|gyro_cal_on_first_arm)", "safety"),
    (r"^(vtx|led|beeper|buzzer|telemetry|frsky|smartport|ibus|jetiexbus|mavlink|hott|ltm)", "peripheral"),
]
GROUP_CATEGORIES = {"PG_PID_PROFILE": "pid", "PG_GYRO_CONFIG": "imu", "PG_ACCELEROMETER_CONFIG": "imu", "PG_COMPASS_CONFIG": "mag", "PG_OSD_CONFIG": "osd", "PG_BLACKBOX_CONFIG": "logging", "PG_MOTOR_CONFIG": "motor", "PG_RX_CONFIG": "rc", "PG_VOLTAGE_SENSOR_ADC_CONFIG": "battery"}
#: Lookup arrays whose C names do not follow from those of their tables; fixed values.
TABLE_ARRAYS = {
    "TABLE_GYRO_LPF_TYPE": "lookupTableLowpassType", "TABLE_DTERM_LPF_TYPE": "lookupTableDtermLowpassType", "TABLE_MOTOR_PWM_PROTOCOL": "lookupTablePwmProtocol", "TABLE_GPS_RESCUE_SANITY_CHECK": "lookupTableRescueSanityType",
    "TABLE_GPS_RESCUE_ALT_MODE": "lookupTableRescueAltitudeMode", "TABLE_RX_FRSKY_SPI_A1_SOURCE": "lookupTableFrskySpiA1Source", "TABLE_POSITION_ALT_SOURCE": "lookupTablePositionAltitudeSource", "TABLE_LED_PROFILE": "lookupTableLEDProfile",
    "TABLE_POSHOLD_SOURCE": "lookupTablePosHoldSource", "TABLE_CMS_BACKGROUND": "lookupTableCMSMenuBackgroundType", "TABLE_SERIAL_RX": "lookupTableSerialRX", "TABLE_RATES_TYPE": "lookupTableRatesType", "TABLE_LEDSTRIP_COLOR": "lookupTableLedstripColors",
}
#: Numbers of C's limit macros; fixed values.
LIMITS = {"UINT8_MAX": 255, "INT8_MIN": -128, "INT8_MAX": 127, "UINT16_MAX": 65535, "INT16_MIN": -32768, "INT16_MAX": 32767, "UINT32_MAX": 4294967295, "XYZ_AXIS_COUNT": 3}


def number(text: Column) -> Column:
    """A finite number, else null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def or_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """Catalog rows with pos, their places in order of name, and members."""
    from pyspark.sql import Window

    placed = rows.withColumn("pos", F.row_number().over(Window.orderBy("name")).cast("int") - 1)  # a catalog has some thousand rows
    return placed.select("pos", *NAMES, F.coalesce("values", "bitmask").alias("members"))


def ardupilot_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of generated metadata: an object of groups, each an object of parameters. A name that several groups have is the first group's. Defaults are not published."""
    inner = "map<string,struct<DisplayName:string,Description:string,User:string,Units:string,Increment:string,RebootRequired:string,ReadOnly:string,Range:map<string,string>,`Values`:map<string,string>,Bitmask:map<string,string>>>"
    text = spark.read.text(path, wholetext=True)
    groups = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("group", "bag")).where("`group` <> 'json'")
    each = groups.select("group", F.explode(F.from_json("bag", inner)).alias("name", "p")).where("p is not null")
    rows = each.groupBy("name").agg(F.min_by(F.struct("group", "p"), "group").alias("f")).select("name", "f.group", "f.p.*")
    bare = F.lower(F.regexp_replace("group", "_+$", ""))
    own = F.when((bare == "") | bare.isin(*VEHICLES), "vehicle").otherwise(bare)
    known = lambda c: F.when(F.size(c) > 0, F.transform_keys(F.transform_values(c, lambda _, v: F.trim(v)), lambda k, _: F.trim(k)))
    values, bitmask = known(F.col("Values")), known(F.col("Bitmask"))
    true = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    return ordered(rows.select(
        "name", F.coalesce(or_null(F.col("DisplayName")), "name").alias("display_name"), diagnosis.categorize(F.col("name"), ARDUPILOT_RULES, own).alias("category"), "group",
        F.when(values.isNotNull(), "enum").when(bitmask.isNotNull(), "bitmask").otherwise("float").alias("type"), F.lit(None).cast("string").alias("default"),
        number(F.try_element_at("Range", F.lit("low"))).alias("min"), number(F.try_element_at("Range", F.lit("high"))).alias("max"), F.coalesce("Units", F.lit("")).alias("unit"),
        F.trim(F.coalesce(or_null(F.col("Description")), "DisplayName", F.lit(""))).alias("description"), values.alias("values"), bitmask.alias("bitmask"), number(F.col("Increment")).alias("increment"),
        F.coalesce("User", F.lit("")).alias("user"), true(F.col("RebootRequired")).alias("reboot_required"), true(F.col("ReadOnly")).alias("read_only"),
    ))


def px4_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows of generated metadata: a list of parameters with their defaults; members are lists of numbers and what they mean."""
    member = lambda key: f"array<struct<{key}:string,description:string>>"
    inner = f"array<struct<name:string,`group`:string,type:string,shortDesc:string,longDesc:string,`default`:string,min:string,max:string,increment:string,units:string,category:string,rebootRequired:boolean,`values`:{member('value')},bitmask:{member('index')}>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.parameters"), inner)).alias("p")).select("p.*").where("name <> ''")
    pair = lambda m, key: F.struct(F.coalesce(m[key], F.lit("")), F.trim(F.coalesce(m["description"], F.lit(""))))
    named = lambda c, key: F.when(F.size(c) > 0, F.map_from_entries(F.transform(c, lambda m: pair(m, key))))
    values, bitmask = named(F.col("values"), "value"), named(F.col("bitmask"), "index")
    return ordered(rows.select(
        "name", F.trim(F.coalesce(or_null(F.col("shortDesc")), "name")).alias("display_name"), diagnosis.categorize(F.col("name"), PX4_RULES, F.coalesce(or_null(slug(F.col("group"))), F.lit("misc"))).alias("category"),
        F.coalesce("group", F.lit("")).alias("group"), F.when(values.isNotNull(), "enum").when(bitmask.isNotNull(), "bitmask").when(F.col("type") == "Float", "float").otherwise("int").alias("type"), "default",
        number(F.col("min")).alias("min"), number(F.col("max")).alias("max"), F.coalesce("units", F.lit("")).alias("unit"), F.trim(F.coalesce("longDesc", "shortDesc", F.lit(""))).alias("description"), values.alias("values"), bitmask.alias("bitmask"),
        number(F.col("increment")).alias("increment"), F.coalesce("category", F.lit("")).alias("user"), F.coalesce("rebootRequired", F.lit(False)).alias("reboot_required"), F.lit(False).alias("read_only"),
    ))


#: Comments, texts, preprocessor lines, numbers, names and single signs of C.
TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|\#[^\n]*(?:(?<=\\)\n[^\n]*)*|0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?[fFuUlL]*|[A-Za-z_]\w*|\S', re.DOTALL)


def tokens(source: str) -> list[str]:
    """Tokens of C source; comments are left out, a preprocessor line is one token."""
    return [t for t in TOKEN.findall(source) if not t.startswith(("//", "/*"))]


def closed(found: Sequence[str], at: int) -> int:
    """The place behind the brace that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(found)):
        depth += (found[k] == "{") - (found[k] == "}")
        if depth == 0:
            return k + 1
    return len(found)


def parts_of(found: Sequence[str]) -> list[list[str]]:
    """Tokens between the commas of an initialiser, inner braces kept whole."""
    out, depth = [[]], 0
    for t in found:
        depth += (t in "{([") - (t in "})]") if len(t) == 1 else 0
        if t == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def text_of(token: str) -> str:
    return token[1:-1] if token.startswith('"') else token


FACTS = "kind string, name string, place int, value string, parts map<string,string>"


def facts(source: str) -> Iterator[tuple]:
    """What a C file says: ``macro`` (name, value), ``member`` (of a lookup array: name, place, text), ``table`` (name of an entry of an enumeration of tables), and
    ``entry`` (of the value table: name or macro, place; flags, group and the fields of its .config initialisers).
    """
    found = tokens(source)
    for t in found:
        if m := re.match(r"#\s*define\s+(\w+)\s+(.+?)\s*(?://.*)?$", t, re.DOTALL):
            yield "macro", m[1], None, m[2].strip(), None
    code = [t for t in found if not t.startswith("#")]
    k = 0
    while k < len(code):
        if code[k] == "typedef" and code[k + 1 : k + 3] == ["enum", "{"]:
            end = closed(code, k + 2)
            if code[end : end + 1] == ["lookupTableIndex_e"]:
                for place, part in enumerate(parts_of(code[k + 3 : end - 1])):
                    yield "table", part[0], place, None, None
            k = end
        elif code[k + 1 : k + 5] == ["[", "]", "=", "{"] and re.match(r"[A-Za-z_]", code[k]):
            name, end = code[k], closed(code, k + 4)
            before = code[max(0, k - 6) : k]
            own = parts_of(code[k + 5 : end - 1])
            if "char" in before:
                for place, part in enumerate(p for p in own if p[0].startswith('"')):
                    yield "member", name, place, "".join(map(text_of, part)), None
            elif "clivalue_t" in before:
                for place, part in enumerate(own):
                    if part[0] == "{":
                        yield entry(parts_of(part[1:-1]), place)
            k = end
        else:
            k += 1


def entry(fields: list[list[str]], place: int) -> tuple:
    said = {"flags": " ".join(fields[1]) if len(fields) > 1 else "", "group": next((t for f in fields for t in f if t.startswith("PG_")), "")}
    for f in fields[2:]:
        if f[:3] == [".", "config", "."] and "=" in f:
            at = f.index("=")
            key, value = "".join(f[3:at]), f[at + 1 :]
            inner = parts_of(value[1:-1]) if value[:1] == ["{"] else [value]
            for k, v in enumerate(inner):
                said[f"{key}.{k}"] = "".join(v)
    name = fields[0][0] if fields and fields[0] else ""
    return "entry", name, place, None, said


def c_facts(spark: SparkSession, pattern: str | Sequence[str]) -> DataFrame:
    """path and ``FACTS`` of C files, each tokenised in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if rows := list(facts((content or b"").decode("utf-8", "replace"))):
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
                    columns = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *columns], ["path", *(f.split()[0] for f in FACTS.split(", "))])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, f"path string, {FACTS}")


def literal(text: Column) -> Column:
    """The whole number that a C literal, in brackets or not, stands for; else null."""
    bare = F.trim(F.regexp_replace(text, r"^[\s(]+|[\s)]+$", ""))
    hexadecimal = F.when(bare.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(bare, 3, 20), 16, 10).cast("long"))
    return F.coalesce(F.when(bare.rlike("^-?[0-9]{1,18}$"), bare.cast("long")), hexadecimal)


def macros(found: DataFrame, depth: int = 3) -> DataFrame:
    """name, number of the macros that stand for a whole number, also by way of others, up to ``depth`` of them; the first definition of a name counts."""
    spark = found.sparkSession
    limits = spark.createDataFrame([(n, str(v)) for n, v in LIMITS.items()], "name string, value string").select("name", "value", F.lit("").alias("path"))
    own = found.where("kind = 'macro'").select("name", "value", "path").unionByName(limits)
    first = own.groupBy("name").agg(F.min_by("value", "path").alias("value"))
    known = first.select("name", literal(F.col("value")).alias("number"), F.regexp_replace("value", r"[\s()]", "").alias("other"))
    for _ in range(depth):
        other = known.select(F.col("name").alias("other"), F.col("number").alias("found"))
        known = known.join(other, "other", "left").select("name", F.coalesce("number", "found").alias("number"), "other")
    return known.where("number is not null").select("name", "number")


def betaflight_catalog(spark: SparkSession, pattern: str | Sequence[str], descriptions: DataFrame | None = None) -> DataFrame:
    """Rows of the settings table among the C sources of ``pattern``; bounds whose macro no source defines are null, enumerations whose array none holds have no members.
    ``descriptions`` (name, description) may say what the sources do not.
    """
    found = c_facts(spark, pattern).cache()
    texts = found.where("kind = 'macro' and value rlike '^\"[^\"]*\"$'").groupBy("name").agg(F.min_by("value", "path").alias("value")).select(F.col("name").alias("raw"), F.regexp_replace("value", '"', "").alias("macro_text"))
    entries = found.where("kind = 'entry'").select(F.col("name").alias("raw"), "parts")
    entries = entries.join(texts, "raw", "left").withColumn("name", F.when(F.col("raw").startswith('"'), F.regexp_replace("raw", '"', "")).otherwise(F.col("macro_text"))).where("name <> ''").drop("macro_text")
    part = lambda *keys: F.coalesce(*(F.try_element_at("parts", F.lit(k)) for k in keys))
    wide = entries.select(
        "name", part("group").alias("pg"), part("minmaxUnsigned.0", "minmax.0").alias("low"), part("minmaxUnsigned.1", "minmax.1", "u32Max.0", "d32Max.0").alias("high"), part("u32Max.0", "d32Max.0").isNotNull().alias("from_zero"),
        part("lookup.0").alias("table"), part("bitpos.0").alias("bit"), part("array.length.0").alias("length"),
    )
    numbers = macros(found)
    for c in ("low", "high", "bit"):
        named = numbers.select(F.col("name").alias(f"_{c}"), F.col("number").alias(f"_{c}_number"))
        wide = wide.withColumn(f"_{c}", F.regexp_replace(c, r"[\s()]", "")).join(named, f"_{c}", "left").withColumn(f"{c}_number", F.coalesce(literal(F.col(c)), f"_{c}_number")).drop(f"_{c}", f"_{c}_number")
    members = found.where("kind = 'member'").groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("place").cast("string"), "value")))).alias("members"))
    loose = lambda c: F.regexp_replace(F.lower(c), "s+$", "")
    arrays = members.groupBy(loose(F.col("name")).alias("key")).agg(F.min_by("members", "name").alias("members"))
    special = F.create_map(*(F.lit(x) for pair in TABLE_ARRAYS.items() for x in pair))
    camel = F.concat(F.lit("lookupTable"), F.regexp_replace(F.regexp_replace("table", "^TABLE_", ""), "_", ""))
    wide = wide.withColumn("key", loose(F.coalesce(F.try_element_at(special, F.col("table")), camel))).join(arrays, "key", "left")
    if descriptions is not None:
        wide = wide.join(descriptions.groupBy("name").agg(F.max("description").alias("said")), "name", "left")
    said = F.coalesce("said", F.lit("")) if descriptions is not None else F.lit("")
    by_group = F.create_map(*(F.lit(x) for pair in GROUP_CATEGORIES.items() for x in pair))
    other = F.coalesce(F.try_element_at(by_group, F.col("pg")), or_null(F.replace(slug(F.regexp_replace("pg", "^PG_", "")), F.lit("_config"), F.lit(""))), F.lit("misc"))
    is_bit = F.col("bit").isNotNull()
    bits = F.when(F.col("bit_number").isNotNull(), F.create_map(F.col("bit_number").cast("string"), F.lit("set")))
    rows = wide.groupBy("name").agg(F.first(F.struct(*(c for c in wide.columns if c != "name"))).alias("f")).select("name", "f.*")  # one row a name: builds repeat some
    return ordered(rows.select(
        "name", F.replace("name", F.lit("_"), F.lit(" ")).alias("display_name"), diagnosis.categorize(F.col("name"), BETAFLIGHT_RULES, other).alias("category"), F.regexp_replace("pg", "^PG_", "").alias("group"),
        F.when(F.col("table").isNotNull(), "enum").when(F.col("length").isNotNull(), "array").when(is_bit, "bitmask").otherwise("int").alias("type"), F.lit(None).cast("string").alias("default"),
        F.when(is_bit | F.col("from_zero"), 0).otherwise(F.col("low_number")).cast("double").alias("min"), F.when(is_bit, 1).otherwise(F.col("high_number")).cast("double").alias("max"),
        F.when(F.col("name").rlike("_hz$|_hz_|_freq"), "Hz").when(F.col("name").rlike("_ms$|_us$"), "ms").otherwise("").alias("unit"), said.alias("description"),
        F.col("members").alias("values"), bits.alias("bitmask"), F.lit(None).cast("double").alias("increment"), F.lit("").alias("user"), F.lit(False).alias("reboot_required"), F.lit(False).alias("read_only"),
    ))


def documents(catalog: DataFrame, platform: str, fw: str | None = None) -> DataFrame:
    """file (the name that ``params.read_catalog`` expects) and document: a catalog as one JSON text of the present schema, its parameters in order of name."""
    each = F.struct("pos", F.to_json(F.struct(*NAMES)).alias("text"))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["text"]), ",")
    head = F.to_json(F.struct(F.lit(platform).alias("platform"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(version_name(fw) if fw else None).alias("fw_version"), F.count("*").alias("parameter_count"), F.array_sort(F.collect_set("category")).alias("categories")))
    document = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"parameters":['), held, F.lit("]}"))
    return catalog.agg(document.alias("document")).select(F.lit(f"{platform}.{version_name(fw)}.json" if fw else f"{platform}.json").alias("file"), "document")
