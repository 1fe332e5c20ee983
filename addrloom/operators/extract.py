"""Geometry of ways and relations in a map extract, and clipping elements to a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions.geo import in_box

SIDES = ("minlat", "minlon", "maxlat", "maxlon")


def way_bounds(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """The box of each way over those of its nodes that have a place.

    ``way_nodes``: way_id, node_id; ``nodes``: node_id, lat, lon. Ways without such a node have no row.
    """
    j = way_nodes.join(nodes.where("lat IS NOT NULL AND lon IS NOT NULL"), "node_id")
    return j.groupBy("way_id").agg(F.min("lat").alias("minlat"), F.min("lon").alias("minlon"), F.max("lat").alias("maxlat"), F.max("lon").alias("maxlon"))


def relation_bounds(members: DataFrame, bounds: DataFrame) -> DataFrame:
    """The union of the boxes of each relation's member ways, with its centre; has_geometry is false where no member has a box.

    ``members``: relation_id, way_id.
    """
    j = members.join(bounds, "way_id", "left").groupBy("relation_id").agg(F.min("minlat").alias("minlat"), F.min("minlon").alias("minlon"), F.max("maxlat").alias("maxlat"), F.max("maxlon").alias("maxlon"))
    return with_centre(j).withColumn("has_geometry", F.col("minlat").isNotNull())


def with_centre(bounds: DataFrame) -> DataFrame:
    return bounds.withColumns({"lat": (F.col("minlat") + F.col("maxlat")) / 2, "lon": (F.col("minlon") + F.col("maxlon")) / 2})


def touches(kind: Column, lat: Column, lon: Column, sides: tuple[Column, Column, Column, Column], box: tuple[float, float, float, float]) -> Column:
    """ways and relations by their box, where it is known; else and for nodes by the point. Borders count."""
    low_lat, low_lon, high_lat, high_lon = sides
    crossing = (low_lat <= box[2]) & (high_lat >= box[0]) & (low_lon <= box[3]) & (high_lon >= box[1])
    return F.when(kind.isin("way", "relation"), F.coalesce(crossing, in_box(lat, lon, box))).otherwise(in_box(lat, lon, box))
