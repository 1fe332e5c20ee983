"""Queries that write files of the given tables' rows and read them back: extracts, tile lists, street lists, layers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from addrloom.operators import coverage, polygons
from addrloom.plans import polygon_queries as areas_of
from addrloom.plans.oracle import FEAT
from addrloom.plans.queries import BOX, cands, feats, osm, query
from addrloom.plans.stage import shared
from addrloom.sources import document, files, pbf
from addrloom.sources.lattice import LATTICE, lattice

#: Half the side of the square that a way or a relation's member way gets around its point, in degrees.
HALF = 1e-5


def extract_rows(spark, d):
    """The lattice as elements: nodes, ways of four nodes, multipolygons of such a way, interpolation ways over two nodes."""
    o = osm(spark, d)
    tags = F.map_filter(F.create_map(F.lit("addr:housenumber"), F.col("housenumber"), F.lit("addr:street"), F.col("street"), F.lit("name"), F.col("name")), lambda k, v: v.isNotNull())
    o = o.select("osm_id", "osm_type", "lat", "lon", tags.alias("tags"))
    point = o.where("osm_type = 'node'").select(F.lit("node").alias("kind"), F.col("osm_id").alias("id"), "lat", "lon", "tags")
    shape = o.where("osm_type <> 'node'").withColumn("way", F.col("osm_id") + F.when(F.col("osm_type") == "way", 0).otherwise(2_000_000_000))
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(HALF * y).alias("y"), F.lit(HALF * x).alias("x")) for k, (y, x) in enumerate(((-1, -1), (-1, 1), (1, 1), (1, -1)))]))
    ring = shape.withColumn("c", corners).select(F.lit("node").alias("kind"), (10_000_000_000 + 4 * F.col("way") + F.col("c.k")).alias("id"), (F.col("lat") + F.col("c.y")).alias("lat"), (F.col("lon") + F.col("c.x")).alias("lon"))
    refs = F.transform(F.array(*map(F.lit, (0, 1, 2, 3, 0))), lambda k: 10_000_000_000 + 4 * F.col("way") + k)
    way = shape.select(F.lit("way").alias("kind"), F.col("way").alias("id"), refs.alias("refs"), F.when(F.col("osm_type") == "way", F.col("tags")).alias("tags"))
    member = F.array(F.struct(F.lit("way").alias("kind"), F.col("way").alias("ref"), F.lit("outer").alias("role")))
    relation = shape.where("osm_type = 'relation'").select(F.lit("relation").alias("kind"), F.col("osm_id").alias("id"), member.alias("members"), F.map_concat("tags", F.create_map(F.lit("type"), F.lit("multipolygon"))).alias("tags"))
    line = lattice(spark, d, "interp").select(F.lit("way").alias("kind"), F.col("osm_id").alias("id"), F.array("n1", "n2").alias("refs"), F.create_map(F.lit("addr:interpolation"), F.lit("odd")).alias("tags"))
    out = point
    for f in (ring, way, relation, line):
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def extract(spark, d):
    path = f"{shared(spark)}/extract-{uuid.uuid4().hex}"
    pbf.write_pbf(extract_rows(spark, d), path)
    return path


_UNIT = "CAST(round({} * 1e7) AS BIGINT)"
_ELEMENTS = f"""{LATTICE}, e AS (SELECT osm_type AS type, osm_id AS id, lat, lon, CASE WHEN osm_type = 'node' THEN 0e0 ELSE {HALF!r}::DOUBLE END AS h, housenumber, FALSE AS line FROM osm),
l AS (SELECT i.osm_id AS id, MIN(o.lat) AS la, MAX(o.lat) AS lb, MIN(o.lon) AS oa, MAX(o.lon) AS ob FROM interp i JOIN osm o ON o.osm_type = 'node' AND o.osm_id IN (i.n1, i.n2) GROUP BY 1),
f AS (SELECT type, id, lat, lon, lat - h AS la, lat + h AS lb, lon - h AS oa, lon + h AS ob, type || 's' AS kind FROM e UNION ALL SELECT 'way', id, NULL, NULL, la, lb, oa, ob, 'interp_ways' FROM l),
g AS (SELECT *, la <= {BOX[2]!r}::DOUBLE AND lb >= {BOX[0]!r}::DOUBLE AND oa <= {BOX[3]!r}::DOUBLE AND ob >= {BOX[1]!r}::DOUBLE AS inside FROM f)"""


@query("S08_extract", f"{_ELEMENTS} SELECT type, id, {_UNIT.format('lat')} AS lat, {_UNIT.format('lon')} AS lon FROM g WHERE inside")
def _(spark, d):
    unit = lambda c: F.round(F.col(c) * 1e7).cast("bigint").alias(c)
    return pbf.address_elements(spark, extract(spark, d), BOX)[0].select("type", "id", unit("lat"), unit("lon"))


@query("S08_counts", f"{_ELEMENTS} SELECT CASE WHEN inside THEN kind ELSE 'outside_bbox' END AS what, COUNT(*) AS n FROM g GROUP BY 1")
def _(spark, d):
    return pbf.address_elements(spark, extract(spark, d), BOX)[1]


@query("K06_tiles_file", f"{areas_of._TILES} SELECT tile AS id, parent AS name, points AS count FROM tiles")
def _(spark, d):
    tiles, _ = polygons.area_tiles(areas_of.points(spark, d), areas_of.areas(spark, d), areas_of.MOST)
    x, y = F.col("rings")[0]["x"], F.col("rings")[0]["y"]
    rows = tiles.select(F.col("tile").alias("id"), F.col("parent").alias("name"), F.array(F.array_min(y), F.array_min(x), F.array_max(y), F.array_max(x)).alias("bbox"), F.col("points").alias("count"))
    path = f"{shared(spark)}/tiles-{uuid.uuid4().hex}.json"
    document.write_tiles(rows, rows.agg(F.count("*").alias("tile_count"), F.sum("count").alias("assigned_after")), path, areas_of.MOST, 10)
    return files.read_tiles(spark, path).select("id", "name", "count")


_STREETS = f"""{FEAT}, a AS (SELECT street_norm, COUNT(*) AS n_source FROM (SELECT street_norm FROM cand) WHERE street_norm <> '' GROUP BY 1), b AS (SELECT street_norm, COUNT(*) AS n_osm FROM feat WHERE street_norm <> '' GROUP BY 1),
j AS (SELECT street_norm, COALESCE(n_source, 0) AS n_source, COALESCE(n_osm, 0) AS n_osm, CASE WHEN n_osm IS NULL THEN 'missing' WHEN n_source IS NULL THEN 'extra' ELSE 'matched' END AS kind FROM a FULL JOIN b USING (street_norm))"""


@query("K07_streets_file", f"{_STREETS} SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY greatest(n_source, n_osm) DESC, street_norm) AS place, street_norm, n_source, n_osm, COUNT(*) OVER (PARTITION BY kind) AS of_kind FROM j")
def _(spark, d):
    path = f"{shared(spark)}/streets-{uuid.uuid4().hex}.json"
    named = cands(spark, d).withColumn("street", F.col("street_norm"))
    document.write_streets(coverage.street_match(named, feats(spark, d)), path)
    return files.read_streets(spark, path).select("kind", F.col("place").cast("bigint").alias("place"), "street_norm", "n_source", "n_osm", "of_kind")


@query("S12_elements", f"{LATTICE} SELECT osm_type AS type, osm_id AS id, housenumber FROM osm")
def _(spark, d):
    o = osm(spark, d).orderBy("osm_id")
    tags = F.create_map(F.lit("addr:housenumber"), F.col("housenumber"))
    path = f"{shared(spark)}/elements-{uuid.uuid4().hex}.json"
    document.write_document({"elements": o.select(F.col("osm_type").alias("type"), F.col("osm_id").alias("id"), "lat", "lon", tags.alias("tags"))}, path)
    return files.read_elements(spark, path, "elements").select("type", "id", F.try_element_at("tags", F.lit("addr:housenumber")).alias("housenumber"))


@query("S13_layer", f"WITH {areas_of._AREAS} SELECT parent AS name, CAST(4 AS INTEGER) AS corners, {_UNIT.format('x0')} AS west, {_UNIT.format('y1')} AS north FROM boxes")
def _(spark, d):
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(ring, F.slice(ring, 1, 1))).alias("coordinates"))
    rows = areas_of.areas(spark, d).select(F.lit("Feature").alias("type"), F.struct(F.col("parent").alias("AREA_NAME")).alias("properties"), shape.alias("geometry"))
    path = f"{shared(spark)}/layer-{uuid.uuid4().hex}.json"
    document.write_document({"features": rows}, path, {"type": "FeatureCollection"})
    layer = files.read_layer(spark, path)
    return layer.select(F.get_json_object("props", "$.AREA_NAME").alias("name"), F.size("ring").alias("corners"), F.round(F.array_min("ring.x") * 1e7).cast("bigint").alias("west"), F.round(F.array_max("ring.y") * 1e7).cast("bigint").alias("north"))
