"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, clamp: bool = False) -> Column:
    """Great-circle distance. clamp keeps the root at 1 or less, for points at the far end."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    root = F.sqrt(h)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), root) if clamp else root)
