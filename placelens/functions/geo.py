"""Distances and boxes in degrees; boxes are closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_TO_MILES = 0.621371


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def inflate(south: Column, west: Column, north: Column, east: Column, factor: float = 1.0) -> tuple[Column, Column, Column, Column]:
    """Each side moves out by half the factor of the box's size."""
    dy, dx = (north - south) * factor / 2, (east - west) * factor / 2
    return south - dy, west - dx, north + dy, east + dx


def overlaps(a: tuple, b: tuple) -> Column:
    """Boxes (south, west, north, east) meet."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def contains(box: tuple, lat: Column, lon: Column) -> Column:
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def farthest_corner_km(lat: Column, lon: Column, box: tuple) -> Column:
    return F.greatest(*(haversine_km(lat, lon, y, x) for y in (box[0], box[2]) for x in (box[1], box[3])))


def box_within_circle(lat: Column, lon: Column, radius: Column, box: tuple) -> Column:
    return farthest_corner_km(lat, lon, box) <= radius


def circle_meets_box(lat: Column, lon: Column, radius: Column, box: tuple) -> Column:
    y = F.greatest(box[0], F.least(box[2], lat))
    x = F.greatest(box[1], F.least(box[3], lon))
    return haversine_km(lat, lon, y, x) <= radius


def centre(box: tuple) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def miles(km: Column) -> Column:
    return km * KM_TO_MILES
