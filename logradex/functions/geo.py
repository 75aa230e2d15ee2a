"""Distances, projection and cells, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
BRAZIL = (-73.99044997, -33.75208127, -28.83594354, 5.27184108)  # west, south, east, north


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would skip a null


# Transverse Mercator by Krueger's series in the third flattening, GRS80
_F = 1 / 298.257222101
_N = _F / (2 - _F)
_A = EARTH_RADIUS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_E = 2 * math.sqrt(_N) / (1 + _N)


def utm(lat: Column, lon: Column, meridian: float = -45.0) -> tuple[Column, Column]:
    """Easting and northing in metres of a southern zone (scale 0.9996, false origin 500 km and 10 000 km)."""
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    s = F.sin(phi)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - _E * atanh(_E * s))
    xi = F.atan2(t, F.cos(lam))
    eta = atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + 0.9996 * _A * east, 10_000_000 + 0.9996 * _A * north


def grid(lat: Column, lon: Column, metres: float, latitude: float) -> tuple[Column, Column]:
    """Cell numbers of a grid whose cells are at least ``metres`` wide up to the given latitude."""
    step = math.degrees(metres / EARTH_RADIUS)
    wide = step / max(math.cos(math.radians(min(latitude, 89.0))), 1e-6)
    return F.floor(lat / step), F.floor(lon / wide)


def point_wkt(lat: Column, lon: Column) -> Column:
    """The point as well-known text; null if a coordinate is."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


def point_wkb(lat: Column, lon: Column) -> Column:
    """The point as well-known binary (little-endian); null if a coordinate is.  Spark has no function for the bytes of
    a double, so this is an Arrow UDF over whole batches."""

    def batch(y: pa.Array, x: pa.Array) -> pa.Array:
        out = np.zeros((len(y), 21), np.uint8)
        out[:, 0] = out[:, 1] = 1
        for at, c in ((5, x), (13, y)):
            out[:, at : at + 8] = c.fill_null(0.0).to_numpy().astype("<f8").view(np.uint8).reshape(-1, 8)
        missing = ~(y.is_valid().to_numpy(zero_copy_only=False) & x.is_valid().to_numpy(zero_copy_only=False))
        raw = out.tobytes()
        return pa.array([None if m else raw[i * 21 : i * 21 + 21] for i, m in enumerate(missing.tolist())], pa.binary())

    return F.arrow_udf(batch, "binary")(lat, lon)


def h3_cell(lat: Column, lon: Column, res: int) -> Column:
    """Cell of the hexagonal grid as text, null where a coordinate is; needs the h3 package."""
    try:
        import h3
    except ImportError as e:
        raise RuntimeError("cells of the hexagonal grid need the h3 package, which is not installed") from e

    def batch(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist())
        return pa.array([None if x is None or y is None else h3.latlng_to_cell(x, y, res) for x, y in pairs], pa.string())

    return F.arrow_udf(batch, "string")(lat, lon)
