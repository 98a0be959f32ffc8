"""National grid eastings and northings to WGS84 degrees: inverse transverse Mercator, then a Helmert shift.

Arrow-batched, as the meridional arc is solved by iteration.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids (semi-axes in metres), the grid's origin and scale, and the shift from its datum to WGS84.
AIRY, WGS84 = (6377563.396, 6356256.909), (6378137.0, 6356752.314245)
SCALE, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, np.radians(49.0), np.radians(-2.0), 400000.0, -100000.0
SHIFT, ROTATION, PPM = (446.448, -125.157, 542.060), np.radians(np.array((0.1502, 0.2470, 0.8421)) / 3600), -20.4894


def _arc(lat, a, b):
    n = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    return b * SCALE * ((1 + n + 1.25 * (n**2 + n**3)) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * np.sin(d) * np.cos(s) + 15 / 8 * (n**2 + n**3) * np.sin(2 * d) * np.cos(2 * s) - 35 / 24 * n**3 * np.sin(3 * d) * np.cos(3 * s))


def to_airy(east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude in radians on the grid's own datum."""
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    lat = LAT0 + (north - NORTH0) / (a * SCALE)
    for _ in range(8):
        lat = lat + (north - NORTH0 - _arc(lat, a, b)) / (a * SCALE)
    sin2, tan = np.sin(lat) ** 2, np.tan(lat)
    nu, rho = a * SCALE / np.sqrt(1 - e2 * sin2), a * SCALE * (1 - e2) / (1 - e2 * sin2) ** 1.5
    eta2, sec, t2 = nu / rho - 1, 1 / np.cos(lat), tan**2
    d = east - EAST0
    out = lat - d**2 * tan / (2 * rho * nu) + d**4 * tan / (24 * rho * nu**3) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) - d**6 * tan / (720 * rho * nu**5) * (61 + 90 * t2 + 45 * t2**2)
    lon = LON0 + d * sec / nu - d**3 * sec / (6 * nu**3) * (nu / rho + 2 * t2) + d**5 * sec / (120 * nu**5) * (5 + 28 * t2 + 24 * t2**2) - d**7 * sec / (5040 * nu**7) * (61 + 662 * t2 + 1320 * t2**2 + 720 * t2**3)
    return out, lon


def to_wgs84(east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees."""
    lat, lon = to_airy(np.asarray(east, float), np.asarray(north, float))
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    nu = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    x, y, z = nu * np.cos(lat) * np.cos(lon), nu * np.cos(lat) * np.sin(lon), nu * (1 - e2) * np.sin(lat)
    (tx, ty, tz), (rx, ry, rz), s = SHIFT, ROTATION, 1 + PPM * 1e-6
    x, y, z = tx + s * x - rz * y + ry * z, ty + rz * x + s * y - rx * z, tz - ry * x + rx * y + s * z
    a, b = WGS84
    e2, p = 1 - (b / a) ** 2, np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - e2))
    for _ in range(6):
        lat = np.arctan2(z + e2 * a / np.sqrt(1 - e2 * np.sin(lat) ** 2) * np.sin(lat), p)
    return np.degrees(lat), np.degrees(np.arctan2(y, x))


def _points(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    lat, lon = to_wgs84(east.to_numpy(float), north.to_numpy(float))
    return pd.DataFrame({"lat": lat, "lon": lon})


def grid_to_degrees(east: Column, north: Column) -> Column:
    """struct(lat, lon); null where either is missing."""
    point = F.pandas_udf(_points, "lat double, lon double")(F.coalesce(east.cast("double"), F.lit(float("nan"))), F.coalesce(north.cast("double"), F.lit(float("nan"))))
    return F.when(east.isNotNull() & north.isNotNull(), point)


def _envelope(west: pd.Series, south: pd.Series, east: pd.Series, north: pd.Series) -> pd.DataFrame:
    corners = [to_wgs84(x.to_numpy(float), y.to_numpy(float)) for x in (west, east) for y in (south, north)]
    lats, lons = np.stack([c[0] for c in corners]), np.stack([c[1] for c in corners])
    return pd.DataFrame({"south": lats.min(0), "west": lons.min(0), "north": lats.max(0), "east": lons.max(0)})


def grid_box_to_degrees(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The envelope of a grid box's four corners in degrees."""
    return F.pandas_udf(_envelope, "south double, west double, north double, east double")(*(c.cast("double") for c in (west, south, east, north)))
