"""Files of the tool: cached elements, area layers and tile lists in; tile lists, street lists, CSV tables out.

Each sink is a folder of part files and a marker, written by the tasks; nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.sources import document

_FIELDS = ("type string", "id bigint", "lat double", "lon double", "center struct<lat:double,lon:double>", "bounds struct<minlat:double,minlon:double,maxlat:double,maxlon:double>", "nodes array<bigint>", "tags map<string,string>")
ELEMENTS = ", ".join(_FIELDS)
LAYER = "features array<struct<properties:string,geometry:struct<type:string,coordinates:string>>>"
TILES = "tiles array<struct<id:string,name:string,bbox:array<double>,count:bigint>>"


def read_elements(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """Cached elements, one JSON object a line, a whole array in a file, or the list ``field`` of a document; no rows where there is no file.

    A document that ``document`` wrote is read by many tasks, any other file by one.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], ELEMENTS)
    if field:
        rows = document.read_list(spark, path, field, ELEMENTS)
        if rows is not None:
            return rows
        struct = ", ".join(f.replace(" ", ": ", 1) for f in _FIELDS)
        return spark.read.schema(f"`{field}` array<struct<{struct}>>").json(path, multiLine=True).select(F.inline(field))
    return spark.read.schema(ELEMENTS).json(path, multiLine=True)


def read_streets(spark: SparkSession, path: str) -> DataFrame:
    """The lists of a streets document: kind, place from 1 on, of_kind (the total it states), street_norm, n_source, n_osm, source_name, osm_name."""
    kinds = ("missing", "extra", "matched")
    row = "array<struct<street_norm: string, n_source: bigint, n_osm: bigint, source_name: string, osm_name: string>>"
    d = spark.read.schema(f"totals struct<{', '.join(f'{k}: bigint' for k in kinds)}>, {', '.join(f'{k} {row}' for k in kinds)}").json(path, multiLine=True)
    each = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"totals.{k}").alias("of_kind"), F.col(k).alias("rows")) for k in kinds])).alias("k"))
    rows = each.select("k.kind", "k.of_kind", F.posexplode("k.rows").alias("pos", "s"))
    return rows.select("kind", (F.col("pos") + 1).alias("place"), "of_kind", "s.*")


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """The polygons of an area layer: polygon_id, props (JSON), ring (exterior only). Parts of a multi-polygon get rows of their own."""
    f = spark.read.schema(LAYER).json(path, multiLine=True).select(F.posexplode("features").alias("fid", "f"))
    rings = "array<array<array<array<double>>>>"
    coordinates = F.col("f.geometry.coordinates")
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(coordinates, rings)).when(
        F.col("f.geometry.type") == "Polygon", F.from_json(F.concat(F.lit("["), coordinates, F.lit("]")), rings))
    parts = f.select("fid", F.col("f.properties").alias("props"), F.posexplode(many).alias("part", "rings"))
    ring = F.transform(F.get("rings", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    # A ring repeats its first point at the end.
    ring = F.when(F.get(ring, F.lit(0)).eqNullSafe(F.element_at(ring, -1)), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)
    return parts.select(F.concat_ws("-", "fid", "part").alias("polygon_id"), "fid", "props", ring.alias("ring"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tiles of a list file with their boxes."""
    t = spark.read.schema(TILES).json(path, multiLine=True).select(F.explode("tiles").alias("t"))
    side = lambda i: F.get("t.bbox", F.lit(i))
    return t.select("t.id", "t.name", side(0).alias("min_lat"), side(1).alias("min_lon"), side(2).alias("max_lat"), side(3).alias("max_lon"), "t.count")


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included; the folder's marker appears only once all parts are there."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows in a global order, range-partitioned, so the parts read in name order are sorted; empty texts stay empty."""
    rows.orderBy(*order).write.mode("overwrite").csv(path, header=True, emptyValue="", quote='"', escape='"')
