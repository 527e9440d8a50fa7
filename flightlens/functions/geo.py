"""Geodesic and geometric column functions; angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
#: Metres of one degree of latitude, rounded down so that boxes come out too large.
METRES_PER_DEGREE = 111_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def point_in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether an odd number of edges of ring ([[lat, lon], ...]) lie beside the point; false under three vertices."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def beside(p: Column, q: Column) -> Column:
        crosses = (p[1] > lon) != (q[1] > lon)
        at = (p[0] - q[0]) * (lon - q[1]) / (p[1] - q[1] + F.lit(1e-12)) + q[0]
        return crosses & (lat < at)

    inside = F.aggregate(F.zip_with(ring, following, beside), F.lit(False), lambda odd, b: odd != b)
    return F.coalesce((F.size(ring) >= 3) & inside, F.lit(False))


def scaled_degrees(value: Column, limit: float) -> Column:
    """Degrees from degrees or from 1e-7 degrees, by range."""
    return F.when(F.abs(value) > limit, value / 1e7).otherwise(value)


def scaled_metres(value: Column, limit: float = 10000.0) -> Column:
    """Metres from metres or millimetres, by range."""
    return F.when(value > limit, value / 1000.0).otherwise(value)


def feet_to_metres(value: Column) -> Column:
    return F.round(value * 0.3048, 2)


def off_null_island(lat: Column, lon: Column, least: float = 0.0) -> Column:
    """Neither coordinate missing, and not both within `least` of zero."""
    return lat.isNotNull() & lon.isNotNull() & ((F.abs(lat) > least) | (F.abs(lon) > least))


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees of degrees, minutes, seconds and a hemisphere letter."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.round(F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).otherwise(value), 7)


def is_valid_fix(lat: Column, lon: Column, alt: Column) -> Column:
    """Inside WGS-84 bounds and not below ground."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & (alt >= 0), F.lit(False))


def seconds_between(later: Column, earlier: Column) -> Column:
    """later - earlier in seconds, to the microsecond."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals, exact ties to even; as printf does, and without separators."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))
