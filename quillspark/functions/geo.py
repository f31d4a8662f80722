"""Geography columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# The ellipsoid and eccentricity of the GCJ-02 offset.
AXIS, ECCENTRICITY = 6378245.0, 0.00669342162296594323


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def point_of(wkt: Column) -> Column:
    """struct<longitude, latitude> of 'Point(lng lat)', null if malformed or out of range."""
    pattern = r"(?i)^\s*Point\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)\s*$"
    lng, lat = (F.regexp_extract(wkt, pattern, i).try_cast("double") for i in (1, 2))
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lng.alias("longitude"), lat.alias("latitude")))


def gcj_offset(lat: Column, lng: Column) -> Column:
    """struct<lat, lng>: what GCJ-02 adds to WGS-84; zero outside its area."""
    x, y = lng - 105.0, lat - 35.0
    pi = F.lit(math.pi)

    def wave(z, weights):
        return sum((w * F.sin(z * pi * f) for w, f in weights), F.lit(0.0)) * (2.0 / 3.0)

    both = wave(x, ((20.0, 6.0), (20.0, 2.0)))
    d_lat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + both + wave(y, ((20.0, 1.0), (40.0, 1 / 3), (160.0, 1 / 12), (320.0, 1 / 30)))
    d_lng = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + both + wave(x, ((20.0, 1.0), (40.0, 1 / 3), (150.0, 1 / 12), (300.0, 1 / 30)))
    magic = 1 - ECCENTRICITY * F.pow(F.sin(F.radians(lat)), 2)
    inside = lng.between(72.004, 137.8347) & lat.between(0.8293, 55.8271)
    lat_off = d_lat * 180.0 / ((AXIS * (1 - ECCENTRICITY)) / (magic * F.sqrt(magic)) * pi)
    lng_off = d_lng * 180.0 / (AXIS / F.sqrt(magic) * F.cos(F.radians(lat)) * pi)
    return F.struct(F.when(inside, lat_off).otherwise(0.0).alias("lat"), F.when(inside, lng_off).otherwise(0.0).alias("lng"))


def to_gcj(lat: Column, lng: Column) -> Column:
    off = gcj_offset(lat, lng)
    return F.struct((lat + off["lat"]).alias("lat"), (lng + off["lng"]).alias("lng"))


def to_wgs(lat: Column, lng: Column) -> Column:
    """The usual approximate inverse: the offset at the shifted point is taken off."""
    off = gcj_offset(lat, lng)
    return F.struct((lat - off["lat"]).alias("lat"), (lng - off["lng"]).alias("lng"))


def jittered(value: Column, key: Column, spread: float) -> Column:
    """A coordinate moved by up to ``spread``, always alike for one key."""
    return value + (F.pmod(F.xxhash64(key), F.lit(20001)) / 10000.0 - 1.0) * spread
