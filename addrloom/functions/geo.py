"""Geometry as native Column expressions."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres of a degree of latitude, as boxes are padded, and on the sphere of ``haversine``.
DEGREE_M = 111_320.0
SPHERE_DEGREE_M = radians(1) * EARTH_M


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(EARTH_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same by the arc sine, as the census has it; differs in the last digit."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def box_overlap(a: str, b: str) -> Column:
    """The share of the smaller of two boxes (structs min_lat, min_lon, max_lat, max_lon) that both cover; 0 where they miss."""
    side = lambda box, c: F.col(f"{box}.{c}")
    area = lambda box: (side(box, "max_lat") - side(box, "min_lat")) * (side(box, "max_lon") - side(box, "min_lon"))
    high = lambda c: F.least(side(a, f"max_{c}"), side(b, f"max_{c}"))
    low = lambda c: F.greatest(side(a, f"min_{c}"), side(b, f"min_{c}"))
    lat, lon = high("lat") - low("lat"), high("lon") - low("lon")
    return F.when((lat > 0) & (lon > 0), lat * lon / F.least(area(a), area(b))).otherwise(0.0)


def cell(x: Column, size: float) -> Column:
    """G03"""
    return F.floor(x / F.lit(size)).cast("bigint")


def with_cells(df: DataFrame, radius_m: float, lat: str = "lat", lon: str = "lon", around: bool = False, wide: int = 1, within: Column | None = None) -> DataFrame:
    """``df`` with the columns cy, cx of a grid; around: a row for each cell that may hold a point within ``radius_m``,
    or ``within`` that many metres where rows look less far.

    Rows of cells are as high as ``wide`` times the radius: 1 gives a point nine cells or more, 4 gives it two or three, 8 fewer than two,
    with more points in each. A cell's width in degrees belongs to its row: the height at the row's end nearer to
    the pole, so that it holds at any latitude, in few cells. Longitudes don't wrap at 180 degrees.
    """
    near = radius_m * 1.000001 / SPHERE_DEGREE_M
    dy = near * wide
    narrow = lambda degrees: F.greatest(F.cos(F.radians(F.least(degrees, F.lit(90.0)))), F.lit(1e-6))
    row = F.floor(F.col(lat) / dy).cast("bigint")
    width = lambda r: F.lit(dy) / narrow(F.greatest(F.abs(r), F.abs(r + 1)) * dy)
    if not around:
        return df.withColumn("cy", row).withColumn("cx", F.floor(F.col(lon) / width(F.col("cy"))).cast("bigint"))
    own_near = F.lit(near) if within is None else within * (1.000001 / SPHERE_DEGREE_M)
    reach = F.least(own_near * 1.000001 / narrow(F.abs(lat) + own_near), F.lit(360.0))
    low, high = (F.floor((F.col(lat) + by) / dy).cast("bigint") for by in (own_near * -1.000001, own_near * 1.000001))
    own = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"_reach": reach, "cy": F.explode(F.sequence(low, high))})
    w = width(F.col("cy"))
    cells = F.sequence(F.floor((F.col(lon) - F.col("_reach")) / w).cast("bigint"), F.floor((F.col(lon) + F.col("_reach")) / w).cast("bigint"))
    return own.withColumn("cx", F.explode(cells)).select(*df.columns, "cy", "cx")


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """inclusive; false for null coordinates."""
    return F.coalesce(lat.between(box[0], box[2]) & lon.between(box[1], box[3]), F.lit(False))


def pad_box(box: tuple[float, float, float, float], metres: float) -> tuple[float, float, float, float]:
    """F03"""
    dlat = metres / DEGREE_M
    dlon = dlat / max(cos(radians((box[0] + box[2]) / 2)), 0.01)
    return box[0] - dlat, box[1] - dlon, box[2] + dlat, box[3] + dlon


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Strictly inside a polygon's exterior ring (even-odd rule); points on the border are out."""
    inside, border = F.lit(0), F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (x0, y0) == (x1, y1):
            continue
        crosses = (F.lit(y0) > y) != (F.lit(y1) > y)
        side = (y - F.lit(y0)) * F.lit(x1 - x0) - (x - F.lit(x0)) * F.lit(y1 - y0)
        right = side > 0 if y1 > y0 else side < 0
        inside = inside + F.when(crosses & right, 1).otherwise(0)
        border = border | ((side == 0) & x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1)))
    return F.coalesce((inside % 2 == 1) & ~border, F.lit(False))


def sample_ordinal(key: Column) -> Column:
    """Ids of digits as numbers, others by crc32."""
    return F.when(key.rlike(r"^\d+$"), key.try_cast("bigint")).otherwise(F.crc32(key.cast("binary")))
