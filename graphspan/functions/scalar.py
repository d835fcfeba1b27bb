"""Scalar functions over numbers, places, spans and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two places."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def distance_bucket(km: Column) -> Column:
    return F.when(km.isNull(), F.lit(None)).when(km <= 300, "near").when(km <= 1500, "regional").otherwise("far")


def coarse_km(km: Column) -> Column:
    """To tens, halves to even."""
    return F.bround(km, -1)


def coarse(coordinate: Column) -> Column:
    """To tenths of a degree, halves to even."""
    return F.bround(coordinate, 1)


def is_coarse(coordinate: Column) -> Column:
    return coarse(coordinate) == coordinate


def equirectangular(lat: Column, lon: Column, width: float, height: float) -> tuple[Column, Column]:
    return (lon + 180.0) / 360.0 * width, (90.0 - lat) / 180.0 * height


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def gate(nodes: Column, relations: Column) -> Column:
    """How much evidence there is, saturating at four nodes and three relations."""
    return F.sqrt(F.least(F.lit(1.0), nodes / 4.0) * F.least(F.lit(1.0), relations / 3.0))


def span_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))
    either = (end_a - start_a) + (end_b - start_b) - both
    return F.when(either <= 0, 0.0).otherwise(both / either)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))


def set_f1(a: Column, b: Column) -> Column:
    """1 where both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)
