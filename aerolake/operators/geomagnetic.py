"""The Earth's main field from spherical-harmonic coefficients: at any place and date, and as a grid for ``attitude.field_at``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Radius (km) that the coefficients refer to; half axis (km) and flattening of the ellipsoid; fixed values.
RADIUS_KM, AXIS_KM, FLATTENING = 6371.2, 6378.137, 1 / 298.257223563
#: International reference field of 2020.0 up to degree 6: n m g h (nT), and for the first degrees their change a year; fixed values.
EPOCH = 2020.0
COEFFICIENTS = """
1 0 -29404.8 0 5.7 0
1 1 -1450.9 4652.5 7.4 -25.9
2 0 -2499.6 0 -11.0 0
2 1 2982.0 -2991.6 -7.0 -30.2
2 2 1677.0 -734.6 -2.1 -22.4
3 0 1363.2 0 2.2 0
3 1 -2381.2 -82.1 -5.9 6.0
3 2 1236.2 241.9 3.1 -1.1
3 3 525.7 -543.4 -12.0 0.5
4 0 903.0 0
4 1 809.5 281.9
4 2 86.3 -158.4
4 3 -309.4 199.7
4 4 48.0 -349.7
5 0 -234.3 0
5 1 363.2 47.7
5 2 187.8 208.3
5 3 -140.7 -121.2
5 4 -151.2 32.3
5 5 13.5 98.9
6 0 66.0 0
6 1 65.5 -19.1
6 2 72.9 25.1
6 3 -121.5 52.8
6 4 -36.2 -64.5
6 5 13.5 8.9
6 6 -64.7 68.1
"""
FIELD = ("north", "east", "down", "declination", "inclination", "intensity")
#: (n, m, g, h, yearly change of g, of h)
Term = tuple[int, int, float, float, float, float]


def terms(text: str = COEFFICIENTS) -> list[Term]:
    """Coefficients of a text: lines of n, m, g, h and, where they are known, their yearly changes. Other lines are passed over."""
    out = []
    for line in text.splitlines():
        parts = line.split()
        if 4 <= len(parts) <= 6 and parts[0].isdigit() and parts[1].isdigit() and 0 <= int(parts[1]) <= int(parts[0]) <= 100:
            out.append((int(parts[0]), int(parts[1]), *map(float, parts[2:]), *[0.0] * (6 - len(parts))))
    return sorted(out)


def read_coefficients(spark: SparkSession, path: str) -> tuple[float, list[Term]]:
    """(epoch, terms) of a coefficient file, whose first line begins with its epoch."""
    lines = [r[0] for r in spark.read.text(path).limit(20_000).collect()]
    return float(lines[0].split()[0]), terms("\n".join(lines[1:]))


def harmonics(lat: np.ndarray, lon: np.ndarray, alt_m: np.ndarray, years: np.ndarray, model: Sequence[Term]) -> np.ndarray:
    """(north, east, down) in nT at geodetic places, ``years`` after the model's epoch; Schmidt's half-normalised functions by recursion."""
    phi, lam = np.radians(lat), np.radians(lon)
    squeeze = FLATTENING * (2 - FLATTENING)
    bend = AXIS_KM / np.sqrt(1 - squeeze * np.sin(phi) ** 2)
    flat, up = (bend + alt_m / 1000) * np.cos(phi), (bend * (1 - squeeze) + alt_m / 1000) * np.sin(phi)
    r = np.hypot(flat, up)
    geocentric = np.arcsin(up / r)
    c, s = np.sin(geocentric), np.maximum(np.cos(geocentric), 1e-9)  # of the angle from the pole
    top = max((n for n, *_ in model), default=0)
    p, d = {(0, 0): np.ones_like(c)}, {(0, 0): np.zeros_like(c)}
    for n in range(1, top + 1):
        for m in range(n + 1):
            if m == n:
                k = np.sqrt((2 * n - 1) / (2 * n)) if n > 1 else 1.0
                p[n, m], d[n, m] = k * s * p[n - 1, m - 1], k * (s * d[n - 1, m - 1] + c * p[n - 1, m - 1])
            else:
                q, k = np.sqrt(n * n - m * m), np.sqrt((n - 1) ** 2 - m * m) if m < n - 1 else 0.0
                before, slope = p.get((n - 2, m), 0.0), d.get((n - 2, m), 0.0)
                p[n, m] = ((2 * n - 1) * c * p[n - 1, m] - k * before) / q
                d[n, m] = ((2 * n - 1) * (c * d[n - 1, m] - s * p[n - 1, m]) - k * slope) / q
    x, y, z = np.zeros_like(c), np.zeros_like(c), np.zeros_like(c)
    for n, m, g, h, dg, dh in model:
        scale = (RADIUS_KM / r) ** (n + 2)
        g, h = g + dg * years, h + dh * years
        wave = g * np.cos(m * lam) + h * np.sin(m * lam)
        x += scale * wave * d[n, m]
        y += scale * m * (g * np.sin(m * lam) - h * np.cos(m * lam)) * p[n, m] / s
        z -= scale * (n + 1) * wave * p[n, m]
    lean = geocentric - phi
    return np.stack([x * np.cos(lean) - z * np.sin(lean), y, x * np.sin(lean) + z * np.cos(lean)])


def model_field(places: DataFrame, year: float | Column = EPOCH, model: Sequence[Term] | None = None, epoch: float = EPOCH) -> DataFrame:
    """``places`` (lat, lon, alt in metres, null: 0) with the field: north, east, down and intensity in mGauss, declination and inclination in degrees. Longitudes of any
    turn; a place without numbers, or beyond the poles, has nulls.
    """
    own = list(model) if model is not None else terms()
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema.fields), *(f"{n} double" for n in FIELD)])
    year = year if isinstance(year, Column) else F.lit(float(year))
    names = places.columns
    alt = F.coalesce(F.col("alt").cast("double"), F.lit(0.0)) if "alt" in names else F.lit(0.0)
    rows = places.select(*names, F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"), alt.alias("_alt"), (year.cast("double") - epoch).alias("_years"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon, alt, years = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("_lat", "_lon", "_alt", "_years"))
            known = np.isfinite(lat) & np.isfinite(lon) & np.isfinite(alt) & np.isfinite(years) & (np.abs(lat) <= 90)
            north, east, down = harmonics(*(np.where(known, v, 0.0) for v in (lat, lon, alt, years)), own) / 100
            level = np.hypot(north, east)
            found = (north, east, down, np.degrees(np.arctan2(east, north)), np.degrees(np.arctan2(down, level)), np.hypot(level, down))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *(pa.array(v, mask=~known) for v in found)], [*names, *FIELD])

    return rows.mapInArrow(run, kinds)


def field_grid(spark: SparkSession, step: int = 10, year: float = EPOCH, model: Sequence[Term] | None = None, epoch: float = EPOCH) -> DataFrame:
    """g_lat, g_lon, declination, inclination, intensity at whole ``step`` degrees, as ``attitude.field_at`` takes them; Spark makes its rows."""
    lats = spark.range(0, 180 // step + 1).select((F.col("id") * step - 90).cast("int").alias("g_lat"))
    places = lats.select("g_lat", F.explode(F.sequence(F.lit(-180), F.lit(180), F.lit(step))).alias("g_lon"))
    found = model_field(places.withColumns({"lat": F.col("g_lat"), "lon": F.col("g_lon")}), year, model, epoch)
    return found.select("g_lat", "g_lon", "declination", "inclination", "intensity")
