"""Distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84: equatorial radius in metres and flattening (fixed values).
EARTH_RADIUS_M = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def planar(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Distance in degrees: the root of summed squares, not hypot, which differs from it in the last bit and so breaks
    ties between equally near edges otherwise than SQL does."""
    return F.sqrt((lng1 - lng2) * (lng1 - lng2) + (lat1 - lat2) * (lat1 - lat2))


def geodesic_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Ellipsoidal distance in km by the radii of curvature at the mean latitude; for distances within a route."""
    mid = F.radians((lat1 + lat2) / 2)
    w = 1 - E2 * F.sin(mid) * F.sin(mid)
    meridian = EARTH_RADIUS_M * (1 - E2) / (w * F.sqrt(w))
    normal = EARTH_RADIUS_M / F.sqrt(w)
    return F.hypot(meridian * F.radians(lat2 - lat1), normal * F.cos(mid) * F.radians(lng2 - lng1)) / 1000
