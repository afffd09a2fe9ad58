"""Flat-earth distance in miles and the grid that makes it an equality join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Miles per degree, degrees per radian as used by the distance.
MILES_PER_DEGREE = 69.1
DEGREES_PER_RADIAN = 57.3


def distance_miles(venue_lat: Column, venue_lon: Column, lat: Column, lon: Column) -> Column:
    north = F.lit(MILES_PER_DEGREE) * (venue_lat - lat)
    east = F.lit(MILES_PER_DEGREE) * (venue_lon - lon) * F.cos(venue_lat / F.lit(DEGREES_PER_RADIAN))
    return F.sqrt(F.pow(north, 2) + F.pow(east, 2))


def cell(degrees: Column, size: float) -> Column:
    """Index of the grid cell; null for values that are no coordinate."""
    return F.floor(degrees / F.lit(size)).try_cast("bigint")


def cells_around(degrees: Column, reach: Column, size: float) -> Column:
    """All cell indexes touched by ``degrees`` plus or minus ``reach``."""
    return F.sequence(cell(degrees - reach, size), cell(degrees + reach, size))


def reach_degrees(venue_lat: Column, radius_miles: float) -> tuple[Column, Column]:
    """Half-widths in degrees (north, east) of the box that holds the whole circle.

    Degrees of longitude shrink with the latitude, so the box widens; it never
    needs to exceed the whole globe.  The small slack covers rounding at the rim.
    """
    north = radius_miles / MILES_PER_DEGREE * (1 + 1e-9)
    shrink = F.greatest(F.abs(F.cos(venue_lat / F.lit(DEGREES_PER_RADIAN))), F.lit(1e-9))
    return F.lit(north), F.least(F.lit(360.0), F.lit(north) / shrink)
