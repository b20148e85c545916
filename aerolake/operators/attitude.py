"""Quaternions, attitude bins, the earth's field and packed device ids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolake.operators import series


def normalized(q: Sequence[Column]) -> list[Column]:
    size = F.sqrt(sum((c * c for c in q), F.lit(0.0)))
    return [F.when(size > 0, c / size) for c in q]


def from_euler(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Quaternion (w, x, y, z) of Z-Y-X angles in degrees."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(F.radians(a) / 2), F.sin(F.radians(a) / 2)) for a in (roll, pitch, yaw))
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def to_euler(q: Sequence[Column]) -> list[Column]:
    """Roll, pitch, yaw in degrees."""
    w, x, y, z = q
    sine = F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0))
    return [F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), F.degrees(F.asin(sine)), F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))]


def rotate(q: Sequence[Column], v: Sequence[Column], transpose: bool = False) -> list[Column]:
    """R(q) v, or its transpose times v."""
    w, x, y, z = (q[0], *((-c for c in q[1:]) if transpose else q[1:]))
    a, b, c = v
    return [
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - w * z) * b + 2 * (x * z + w * y) * c,
        2 * (x * y + w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - w * x) * c,
        2 * (x * z - w * y) * a + 2 * (y * z + w * x) * b + (1 - 2 * (x * x + y * y)) * c,
    ]


def lattice(points: int = 80) -> list[tuple[float, float, float]]:
    """Unit vectors spread evenly by the golden angle."""
    turn = math.pi * (3 - math.sqrt(5))
    out = []
    for i in range(points):
        z = 1 - 2 * (i + 0.5) / points
        r = math.sqrt(max(0.0, 1 - z * z))
        out.append((r * math.cos(turn * i), r * math.sin(turn * i), z))
    return out


def nearest_bin(v: Sequence[Column], points: int = 80) -> Column:
    """Number of the lattice point with the largest dot product, the smallest of equals: a loop over a constant array inside the row, not a join."""
    x, y, z = v
    grid = F.array(*(F.array(*map(F.lit, p)) for p in lattice(points)))
    dots = F.transform(grid, lambda p, i: F.struct((p[0] * x + p[1] * y + p[2] * z).alias("d"), (-i).alias("i")))
    return -F.array_max(dots)["i"].cast("long")


def coverage(binned: DataFrame, keys: Sequence[str], points: int = 80) -> DataFrame:
    """Rows with ``weight`` = mean rows of a used bin over the rows of its bin, and ``coverage`` = share of the bins used."""
    per_bin = Window.partitionBy(*keys, "bin")
    counts = binned.groupBy(*keys).agg(F.count("*").alias("_n"), F.countDistinct("bin").alias("_bins"))
    rows = binned.withColumn("_in_bin", F.count("*").over(per_bin))
    joined = rows.join(counts, list(keys)) if keys else rows.crossJoin(F.broadcast(counts))
    return joined.withColumns({"weight": F.col("_n") / F.col("_bins") / F.col("_in_bin"), "coverage": F.col("_bins") / points}).drop("_n", "_bins", "_in_bin")


def dipole_grid(spark: SparkSession, step: int = 10, pole_lat: float = 80.7, pole_lon: float = -72.7, field: float = 298.0) -> DataFrame:
    """lat, lon, declination, inclination, intensity (mGauss at the equator of the dipole: ``field``) of a tilted dipole, by rule."""
    rows = []
    p = math.radians(pole_lat)
    for lat in range(-90, 91, step):
        for lon in range(-180, 181, step):
            a, d = math.radians(lat), math.radians(lon - pole_lon)
            s = max(-1.0, min(1.0, math.sin(a) * math.sin(p) + math.cos(a) * math.cos(p) * math.cos(d)))
            m = math.asin(s)
            declination = math.degrees(math.atan2(-math.cos(p) * math.sin(d), math.sin(p) * math.cos(a) - math.cos(p) * math.sin(a) * math.cos(d)))
            rows.append((lat, lon, declination, math.degrees(math.atan2(2 * math.sin(m), math.cos(m))), field * math.sqrt(1 + 3 * s * s)))
    return spark.createDataFrame(rows, "g_lat int, g_lon int, declination double, inclination double, intensity double")


def field_at(places: DataFrame, grid: DataFrame, step: int = 10) -> DataFrame:
    """``places`` (lat, lon) with the grid's values interpolated between the four corners of their cell, and the field as north, east, down. Longitudes of any turn;
    places beyond the grid's latitudes, or without numbers, have nulls.
    """
    names = ("declination", "inclination", "intensity")
    corner = lambda d_lat, d_lon: grid.select((F.col("g_lat") - d_lat * step).alias("c_lat"), (F.col("g_lon") - d_lon * step).alias("c_lon"), *(F.col(n).alias(f"{n}{d_lat}{d_lon}") for n in names))
    cells = corner(0, 0)
    for at in ((0, 1), (1, 0), (1, 1)):
        cells = cells.join(corner(*at), ["c_lat", "c_lon"])
    lon = F.when(F.col("lon").between(-180, 180), F.col("lon")).otherwise(F.pmod(F.col("lon") + 180, F.lit(360)) - 180)
    inside = F.when(F.col("lat").between(-90, 90), F.col("lat"))
    rows = places.withColumns({"_lon": lon, "c_lat": F.when(inside.isNotNull(), F.least(F.floor(inside / step) * step, F.lit(90 - step))).cast("int"), "c_lon": F.least(F.floor(lon / step) * step, F.lit(180 - step)).cast("int")})
    # A grid of whole degrees has 65,160 cells; a finer one is shuffled.
    rows = rows.join(F.broadcast(cells) if grid.count() <= 100_000 else cells, ["c_lat", "c_lon"], "left")
    x, y = (F.col("lat") - F.col("c_lat")) / step, (F.col("_lon") - F.col("c_lon")) / step
    mixed = {n: (1 - x) * ((1 - y) * F.col(f"{n}00") + y * F.col(f"{n}01")) + x * ((1 - y) * F.col(f"{n}10") + y * F.col(f"{n}11")) for n in names}
    out = rows.select(*places.columns, *(c.alias(n) for n, c in mixed.items()))
    flat = F.col("intensity") * F.cos(F.radians("inclination"))
    return out.withColumns({"north": flat * F.cos(F.radians("declination")), "east": flat * F.sin(F.radians("declination")), "down": F.col("intensity") * F.sin(F.radians("inclination"))})


def expected_field(places: DataFrame, grid: DataFrame | None = None, step: int = 10, year: float | Column = 2020.0) -> DataFrame:
    """``places`` (lat, lon, alt; null: no position) with north, east, down in mGauss: of the model (``geomagnetic``) at ``year``, or of a ``grid``; where that has
    nothing, by the dip rule at the place's latitude, or at the equator without one.
    """
    from aerolake.operators import diagnosis, geomagnetic

    parts = ("north", "east", "down")
    known = (geomagnetic.model_field(places, year) if grid is None else field_at(places, grid, step)).drop("declination", "inclination", "intensity")
    usable = F.coalesce(F.col("lat"), F.lit(0.0))
    rule = diagnosis.dip_field(F.when(usable.between(-90, 90), usable).otherwise(0.0), F.coalesce(F.col("alt"), F.lit(0.0)))
    return known.withColumns({n: F.coalesce(n, 10 * c) for n, c in zip(parts, rule, strict=True)})


#: Bus types of packed device ids; fixed values.
BUSES = {0: "unknown", 1: "i2c", 2: "spi", 3: "uavcan", 4: "sitl", 5: "msp", 6: "serial"}


def decode_device(device_id: Column) -> dict[str, Column]:
    """bus_type (bits 0-2), bus (3-7), address (8-15), device (16-23), and the name of the bus."""
    part = lambda shift, mask: F.shiftright(device_id, shift).bitwiseAND(mask).cast("long")
    kind = part(0, 7)
    name = F.lit("unknown")
    for code, label in BUSES.items():
        name = F.when(kind == code, label).otherwise(name)
    return {"bus_type": kind, "bus": part(3, 31), "address": part(8, 255), "device": part(16, 255), "bus_name": name}


#: Samples and ranges in degrees that a calibration flight needs, and what makes it good; fixed values.
COVERAGE = {"samples": 500, "yaw": 300.0, "pitch": 40.0, "roll": 40.0, "good_samples": 1000, "good_yaw": 360.0}


def flight_coverage(rows: DataFrame, keys: Sequence[str], limits: dict[str, float] = COVERAGE, order: str = "idx") -> DataFrame:
    """keys, samples, yaw_range (unwrapped), pitch_range, roll_range, coverage_ok, quality (good, acceptable, poor) of a flight's attitudes in degrees."""
    turned = series.unwrap_degrees(rows, keys, "yaw", order)
    span = lambda c: F.max(c) - F.min(c)
    out = turned.groupBy(*keys).agg(F.count("*").alias("samples"), span("unwrapped").alias("yaw_range"), span("pitch").alias("pitch_range"), span("roll").alias("roll_range"))
    ok = (F.col("samples") >= limits["samples"]) & (F.col("yaw_range") >= limits["yaw"]) & (F.col("pitch_range") >= limits["pitch"]) & (F.col("roll_range") >= limits["roll"])
    good = (F.col("samples") >= limits["good_samples"]) & (F.col("yaw_range") >= limits["good_yaw"])
    return out.withColumns({"coverage_ok": ok, "quality": F.when(good, "good").when(ok, "acceptable").otherwise("poor")})
