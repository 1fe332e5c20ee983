"""Queries over polygon tiles: staggered areas, one for each nation, under the points of the lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.operators import polygons
from addrloom.plans.queries import query, src
from addrloom.sources.lattice import LATTICE

#: West and south of the areas, their width and height, how far each column of five is shifted up; no point lies on one of their lines.
WEST, SOUTH, WIDTH, HEIGHT, SHIFT = -79.6021173, 43.5951237, 0.004, 0.04, 0.009
BOX = (43.59, -79.61, 43.83, -79.37)
MOST, FLOOR = 100, 75
_AREAS = f"""areas AS (SELECT n_name AS parent, {WEST}::DOUBLE + {WIDTH}::DOUBLE * (n_nationkey // 5) AS x0, {SOUTH}::DOUBLE + {HEIGHT}::DOUBLE * (n_nationkey % 5) + {SHIFT}::DOUBLE * (n_nationkey // 5) AS y0 FROM nation),
boxes AS (SELECT parent, x0, y0, x0 + {WIDTH}::DOUBLE AS x1, y0 + {HEIGHT}::DOUBLE AS y1 FROM areas)"""


def areas(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    column = F.floor(F.col("n_nationkey") / 5)
    x0, y0 = F.lit(WEST) + F.lit(WIDTH) * column, F.lit(SOUTH) + F.lit(HEIGHT) * (F.col("n_nationkey") % 5) + F.lit(SHIFT) * column
    x1, y1 = x0 + WIDTH, y0 + HEIGHT
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return n.select(F.col("n_name").alias("parent"), F.array(F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1))).alias("rings"))


def points(spark, d) -> DataFrame:
    return src(spark, d).select("identity_key", "lon", "lat")


_LEVELS = 4
_KEY = " || ".join(f"CAST(((y >> {i}) & 1) * 2 + ((x >> {i}) & 1) AS VARCHAR)" for i in range(_LEVELS - 1, -1, -1))
_TILES = f"""{LATTICE}, {_AREAS},
ip AS (SELECT parent, CAST(floor((lon - x0) / (x1 - x0) * {1 << _LEVELS}) AS BIGINT) AS x, CAST(floor((lat - y0) / (y1 - y0) * {1 << _LEVELS}) AS BIGINT) AS y FROM src JOIN boxes ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1),
ik AS (SELECT parent, {_KEY} AS q FROM ip),
il AS (SELECT parent, substr(q, 1, l) AS prefix, l AS level, COUNT(*) AS n FROM ik, range(0, {_LEVELS + 1}) AS t(l) GROUP BY ALL),
tiles AS (SELECT s.parent, s.parent || array_to_string(list_transform(range(1, s.level + 1), lambda i: '-' || ['SW', 'SE', 'NW', 'NE'][CAST(substr(s.prefix, i, 1) AS INTEGER) + 1]), '') AS tile, CAST(s.level AS INTEGER) AS level, s.n AS points
  FROM il s LEFT JOIN il u ON s.parent = u.parent AND s.level = u.level + 1 AND substr(s.prefix, 1, u.level) = u.prefix WHERE (s.n <= {MOST} OR s.level = {_LEVELS}) AND (s.level = 0 OR u.n > {MOST}))"""


@query("Q01_area_tiles", f"{_TILES} SELECT tile, parent, level, points, CAST(round({WIDTH}::DOUBLE * {HEIGHT}::DOUBLE * 1e12 / (1 << (2 * level))) AS BIGINT) AS area FROM tiles")
def _(spark, d):
    tiles, _ = polygons.area_tiles(points(spark, d), areas(spark, d), MOST)
    return tiles.select("tile", "parent", "level", "points", F.round(polygons.area(F.col("rings")) * 1e12).cast("bigint").alias("area"))


@query("Q01_tile_of_point", f"{_TILES}, k AS (SELECT identity_key, parent, substr(q, 1, l) AS prefix, l FROM (SELECT identity_key, parent, {_KEY.replace('y >>', 'iy >>').replace('x >>', 'ix >>')} AS q FROM (SELECT identity_key, parent, CAST(floor((lon - x0) / (x1 - x0) * {1 << _LEVELS}) AS BIGINT) AS ix, CAST(floor((lat - y0) / (y1 - y0) * {1 << _LEVELS}) AS BIGINT) AS iy FROM src JOIN boxes ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1)), range(0, {_LEVELS + 1}) AS t(l)) SELECT identity_key, tile FROM k JOIN tiles ON tile = k.parent || array_to_string(list_transform(range(1, l + 1), lambda i: '-' || ['SW', 'SE', 'NW', 'NE'][CAST(substr(prefix, i, 1) AS INTEGER) + 1]), '')")
def _(spark, d):
    return polygons.area_tiles(points(spark, d), areas(spark, d), MOST)[1].select("identity_key", "tile")


@query("J31_borders", f"""WITH {_AREAS} SELECT a.parent AS a, b.parent AS b, CAST(round(1e6 * CASE WHEN abs(a.y1 - b.y0) < 1e-9 OR abs(a.y0 - b.y1) < 1e-9 THEN least(a.x1, b.x1) - greatest(a.x0, b.x0) ELSE least(a.y1, b.y1) - greatest(a.y0, b.y0) END) AS BIGINT) AS length
  FROM boxes a JOIN boxes b ON a.parent <> b.parent AND ((abs(a.y1 - b.y0) < 1e-9 OR abs(a.y0 - b.y1) < 1e-9) AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1e-9 OR (abs(a.x1 - b.x0) < 1e-9 OR abs(a.x0 - b.x1) < 1e-9) AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 1e-9)""")
def _(spark, d):
    found = polygons.borders(areas(spark, d).withColumnRenamed("parent", "tile"), "tile")
    return found.select("a", "b", F.round(F.col("length") / (polygons.UNITS / 1e6)).cast("bigint").alias("length"))


_FIRST, _LAST = 5, 8
_SIDE = BOX[2] - BOX[0]
_CELLS = f"""{_AREAS},
grid AS (SELECT level, x, y, {BOX[1]}::DOUBLE + x * {_SIDE!r}::DOUBLE / (1 << level) AS gx0, {BOX[0]}::DOUBLE + y * {_SIDE!r}::DOUBLE / (1 << level) AS gy0, {_SIDE!r}::DOUBLE / (1 << level) AS s FROM (SELECT CAST(level AS INTEGER) AS level FROM range({_FIRST}, {_LAST + 1}) AS t(level)), range(0, {1 << _LAST}) AS a(x), range(0, {1 << _LAST}) AS b(y) WHERE x < (1 << level) AND y < (1 << level)),
judged AS (SELECT level, x, y, bool_or(gx0 >= x0 AND gx0 + s <= x1 AND gy0 >= y0 AND gy0 + s <= y1) AS covered, bool_or(x0 < gx0 + s AND x1 > gx0 AND y0 < gy0 + s AND y1 > gy0 AND NOT (gx0 >= x0 AND gx0 + s <= x1 AND gy0 >= y0 AND gy0 + s <= y1)) AS crosses FROM grid, boxes GROUP BY ALL)"""


@query("Q02_cover", f"WITH {_CELLS} SELECT j.level, j.x, j.y, CASE WHEN j.crosses THEN 'crossing' ELSE 'outside' END AS state FROM judged j LEFT JOIN judged u ON u.level = j.level - 1 AND u.x = j.x >> 1 AND u.y = j.y >> 1 WHERE NOT j.covered AND (j.level = {_FIRST} OR u.crosses AND NOT u.covered) AND (NOT j.crosses OR j.level = {_LAST})")
def _(spark, d):
    return polygons.cover(areas(spark, d), BOX)


_CELL = lambda c, o: f"CAST(floor(({c} - {o!r}::DOUBLE) / {_SIDE / (1 << _LAST)!r}::DOUBLE) AS BIGINT)"


@query("Q02_outside_tiles", f"""{LATTICE}, {_CELLS},
o AS (SELECT {_CELL('lon', BOX[1])} AS fx, {_CELL('lat', BOX[0])} AS fy FROM src WHERE NOT EXISTS (SELECT 1 FROM boxes WHERE lon > x0 AND lon < x1 AND lat > y0 AND lat < y1)),
up AS (SELECT CAST(l AS INTEGER) AS level, fx >> CAST({_LAST} - l AS INTEGER) AS x, fy >> CAST({_LAST} - l AS INTEGER) AS y, COUNT(*) AS n FROM o, range({_FIRST}, {_LAST + 1}) AS t(l) GROUP BY ALL),
ot AS (SELECT s.* FROM up s LEFT JOIN up u ON u.level = s.level - 1 AND u.x = s.x >> 1 AND u.y = s.y >> 1 WHERE (s.n <= {MOST} OR s.level = {_LAST}) AND (s.level = {_FIRST} OR u.n > {MOST}))
SELECT t.level, t.x, t.y, t.n AS points, COUNT(*) FILTER (WHERE NOT covered AND NOT crosses) AS outside_cells, COUNT(*) FILTER (WHERE NOT covered AND crosses) AS crossing_cells
  FROM ot t JOIN judged j ON j.level = {_LAST} AND j.x >> ({_LAST} - t.level) = t.x AND j.y >> ({_LAST} - t.level) = t.y GROUP BY ALL""")
def _(spark, d):
    return polygons.outside_tiles(points(spark, d), areas(spark, d), "identity_key", BOX, MOST)


def merged(spark, d):
    tiles, _ = polygons.area_tiles(points(spark, d), areas(spark, d), MOST)
    return tiles, polygons.merge_rounds(tiles, polygons.borders(tiles, "tile"), FLOOR, MOST, MOST + MOST // 2)


@query("Q03_merge_tiles")
def _(spark, d):
    return merged(spark, d)[1].select("tile", "parent", "points", F.array_join("merged_from", ",").alias("merged_from"), (F.col("points") < FLOOR).alias("below_floor"))


@query("A19_tile_statistics")
def _(spark, d):
    tiles, after = merged(spark, d)
    return polygons.merge_statistics(tiles, after, points(spark, d), FLOOR)
