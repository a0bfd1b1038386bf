"""Distances on the sphere, and a place's reach."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
NEAREST_M = 30_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would pass over a null, so an unknown position must not get that far.
    return F.when(a.isNotNull(), 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def reach_m(population: Column) -> Column:
    """How far a place counts as itself: ten metres for the root of a head, between 2 and 40 km."""
    return F.greatest(F.lit(2000.0), F.least(F.lit(40000.0), 10 * F.sqrt(F.greatest(population, F.lit(0)).cast("double"))))
