"""Distances and speeds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371
NS_PER_HOUR = 3.6e12


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance. Rounding near antipodes is clamped so it cannot yield NaN."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    chord = F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord))
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def hours_between(earlier_ns: Column, later_ns: Column) -> Column:
    """Exact integer difference first, then one division."""
    return (later_ns - earlier_ns).cast("double") / F.lit(NS_PER_HOUR)


def is_finite(value: Column) -> Column:
    """False for null, NaN and the infinities."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))
