"""Distances and time zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the Earth's radius in miles.
EARTH_MILES = 3958.7613


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine."""
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    inside = F.when(h.isNotNull(), F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))
    return 2 * EARTH_MILES * F.asin(F.sqrt(inside))


def snapped(distance: Column, least: float = 1.0) -> Column:
    """Zero for distances that are rounding noise."""
    return F.when(distance < least, F.lit(0.0)).otherwise(distance)


def zone_shift(to: Column, origin: Column) -> Column:
    """Hours to the east, within [-12, 12): over the date line the short way counts."""
    return F.pmod(to - origin + 12, F.lit(24.0)) - 12
