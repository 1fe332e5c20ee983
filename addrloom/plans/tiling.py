"""Quadtree tiles: a level at a time over counts for each cell, not over points."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions.text import slugify
from addrloom.operators.reports import suffixed_ids

# Cells below the first span aren't split, those of points outside all areas are down to the second.
MIN_SPAN_DEG, OUTSIDE_SPAN_DEG = 0.003, 0.01
NAME_KEYS = ("AREA_NAME", "area_name", "NEIGHBOURHOOD_NAME", "NEIGHBOURHOOD", "Neighbourhood", "name")
PARENT_KEYS = ("COMMUNITY", "Community", "community")


def quadkeys(points: DataFrame, box: tuple[float, float, float, float], levels: int) -> DataFrame:
    """Points with the key of their cell at the finest level, a digit (0-3) for each level."""
    n = 1 << levels
    y = F.least(F.floor((F.col("lat") - box[0]) / (box[2] - box[0]) * n), F.lit(n - 1)).cast("bigint")
    x = F.least(F.floor((F.col("lon") - box[1]) / (box[3] - box[1]) * n), F.lit(n - 1)).cast("bigint")
    digit = lambda k: (F.shiftright(y, k).bitwiseAND(F.lit(1)) * 2 + F.shiftright(x, k).bitwiseAND(F.lit(1))).cast("string")
    return points.withColumn("quadkey", F.concat(*[digit(k) for k in range(levels - 1, -1, -1)]))


def depth(box: tuple[float, float, float, float], span: float = MIN_SPAN_DEG) -> int:
    """The first level whose cells are narrower than ``span`` degrees on both axes."""
    return max(0, ceil(log2(max(box[2] - box[0], box[3] - box[1]) / span + 1e-9)))


def quadtree(points: DataFrame, box: tuple[float, float, float, float], most: int = 500, levels: int | None = None, cap_deg: float | None = None) -> DataFrame:
    """Q01: the coarsest cells with ``most`` points at most: prefix, level, points. Cells narrower than MIN_SPAN_DEG aren't split (``levels``
    sets another depth); with ``cap_deg`` cells wider than that always are, as those of points outside all areas (Q02).

    One aggregation of the points by finest cell; everything else works on those counts.
    """
    levels = depth(box) if levels is None else levels
    least = 0 if cap_deg is None else min(levels, depth(box, cap_deg))
    cells = quadkeys(points, box, levels).groupBy("quadkey").agg(F.count("*").alias("n"))
    prefix = F.explode(F.sequence(F.lit(least), F.lit(levels)))
    up = cells.select("quadkey", "n", prefix.alias("level")).select(F.expr("substr(quadkey, 1, level)").alias("prefix"), "level", "n")
    sums = up.groupBy("prefix", "level").agg(F.sum("n").alias("n"))
    fits = (F.col("n") <= most) | (F.col("level") == levels)
    parent = sums.select(F.col("prefix").alias("_p"), F.col("n").alias("_n"))
    j = sums.where(fits).join(parent, F.expr("substr(prefix, 1, level - 1)") == F.col("_p"), "left")
    return j.where((F.col("level") == least) | (F.col("_n") > most)).select("prefix", "level", F.col("n").alias("points"))


def tile_name(base: Column, prefix: Column) -> Column:
    """Q01: the name of a cell: that of the whole and a quarter for each level."""
    quarter = F.create_map(*map(F.lit, ("0", "SW", "1", "SE", "2", "NW", "3", "NE")))
    return F.array_join(F.concat(F.array(base), F.transform(F.filter(F.split(prefix, ""), lambda d: d != ""), lambda d: F.try_element_at(quarter, d))), "-")


def no_layer(points: DataFrame, box: tuple[float, float, float, float], city: str, most: int = 500) -> DataFrame:
    """Q05: the tiles of a city without an area layer: the whole box, under the city's name, split like any area."""
    tiles = quadtree(points, box, most).withColumn("name", tile_name(F.lit(city), F.col("prefix")))
    return suffixed_ids(tiles.withColumn("slug", slugify(F.col("name"))), "slug", ["prefix"]).select("tile_id", "name", "prefix", "level", "points")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _prop(props: Column, key: str) -> Column:
    return F.nullif(F.trim(F.get_json_object(props, f"$['{key}']")), F.lit(""))


def area_names(areas: DataFrame, name_field: str = "", parent_field: str = "") -> DataFrame:
    """The name of each area from its properties (JSON in ``props``; ``fid`` its id).

    A declared name field must be filled. A declared parent goes before every name, one that is only found before names that
    occur more than once; never a parent equal to the name but for case.
    """
    if name_field:
        base = F.coalesce(_prop(F.col("props"), name_field), F.raise_error(F.lit(f"{name_field} is declared but empty")))
    else:
        number = F.coalesce(_prop(F.col("props"), "AREA_ID"), _prop(F.col("props"), "_id"), F.lit("?"))
        base = F.coalesce(*[_prop(F.col("props"), k) for k in NAME_KEYS], F.concat(F.lit("neighbourhood-"), number))
    parent = _prop(F.col("props"), parent_field) if parent_field else F.coalesce(*[_prop(F.col("props"), k) for k in PARENT_KEYS])
    a = areas.withColumns({"_base": base, "_parent": parent})
    repeated = F.lit(True) if parent_field else F.count("*").over(Window.partitionBy("_base")) > 1
    prefixed = repeated & F.coalesce(F.lower("_parent") != F.lower("_base"), F.lit(False))
    return a.select("fid", F.when(prefixed, F.concat_ws(" ", "_parent", "_base")).otherwise(F.col("_base")).alias("name"))


def in_polygons(points: DataFrame, polygons: DataFrame, size: float = 0.01) -> DataFrame:
    """Each point with each polygon it lies strictly inside of, even-odd over ``ring``, an array of structs (x, y).

    Polygons are spread over the grid cells of their box; a point meets those of its cell only.
    """
    at = lambda v: F.floor(v / F.lit(size)).cast("bigint")
    xs, ys = F.col("ring.x"), F.col("ring.y")
    p = polygons.withColumn("_cx", F.explode(F.sequence(at(F.array_min(xs)), at(F.array_max(xs))))).withColumn("_cy", F.explode(F.sequence(at(F.array_min(ys)), at(F.array_max(ys)))))
    p = p.select("polygon_id", "ring", "_cx", "_cy")
    j = points.withColumns({"_cx": at(F.col("lon")), "_cy": at(F.col("lat"))}).join(p, ["_cx", "_cy"])
    edge = """transform(sequence(0, size(ring) - 1), i -> struct(ring[i].x as x0, ring[i].y as y0, ring[(i + 1) % size(ring)].x as x1, ring[(i + 1) % size(ring)].y as y1))"""
    side = "((lat - e.y0) * (e.x1 - e.x0) - (lon - e.x0) * (e.y1 - e.y0))"
    crossed = f"size(filter({edge}, e -> (e.y0 > lat) <> (e.y1 > lat) and if(e.y1 > e.y0, {side} > 0, {side} < 0))) % 2 = 1"
    border = f"exists({edge}, e -> {side} = 0 and lon between least(e.x0, e.x1) and greatest(e.x0, e.x1) and lat between least(e.y0, e.y1) and greatest(e.y0, e.y1))"
    return j.where(f"{crossed} and not {border}").drop("_cx", "_cy", "ring")


def outside(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """Q02: points in no polygon."""
    return points.join(in_polygons(points, polygons).select(key), key, "left_anti")
