"""Tiles as polygons: areas cut into quarters, cells around the areas, shared borders, and merging in rounds.

A polygon is a column ``rings``, an array of rings of structs (x, y), the outer one first. Points never meet polygons but by
an equi join on a cell or a tile; each level or round is a written table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions.rings import QUARTERS, quarters
from addrloom.plans.stage import materialize

RINGS = "array<array<struct<x: double, y: double>>>"
# Points of a tile, degrees below which tiles aren't cut, degrees of tiles outside all areas, points of merged tiles.
MOST, MIN_SPAN_DEG, OUTSIDE_SPAN_DEG = 500, 0.003, 0.01
FLOOR, SOFT, HARD = 250, 500, 750
#: Edges closer than this (radians; degrees) are on one line; lines are cut into bins of so many degrees.
ANGLE, OFFSET, BIN = 1e-6, 1e-7, 0.01
#: Units of a degree in which borders are added up, exactly and in any order.
UNITS = 1_000_000_000


def span(side: str) -> Column:
    """Width (``x``) or height (``y``) of the outer ring."""
    values = F.col("rings")[0][side]
    return F.array_max(values) - F.array_min(values)


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings; a point on a border is inside of one side only."""

    def crossed(r: Column) -> Column:
        def hit(i: Column) -> Column:
            p, q = r[i], r[(i + 1) % F.size(r)]
            return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])

        return F.size(F.filter(F.sequence(F.lit(0), F.size(r) - 1), hit))

    return F.aggregate(rings, F.lit(0), lambda n, r: n + crossed(r)) % 2 == 1


def on_border(rings: str, x: str, y: str) -> Column:
    p, q = "r[i]", "r[(i + 1) % size(r)]"
    flat = f"({y} - {p}.y) * ({q}.x - {p}.x) = ({x} - {p}.x) * ({q}.y - {p}.y)"
    between = " and ".join(f"{v} between least({p}.{s}, {q}.{s}) and greatest({p}.{s}, {q}.{s})" for v, s in ((x, "x"), (y, "y")))
    return F.expr(f"exists({rings}, r -> exists(sequence(0, size(r) - 1), i -> {flat} and {between}))")


def area(rings: Column) -> Column:
    """That of the outer ring less those of the others."""

    def one(r: Column) -> Column:
        def turn(i: Column) -> Column:
            p, q, o = r[i], r[(i + 1) % F.size(r)], r[0]
            return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"])

        return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), F.size(r) - 1), turn), F.lit(0.0), lambda a, v: a + v)) / 2

    return 2 * one(rings[0]) - F.aggregate(F.transform(rings, one), F.lit(0.0), lambda a, v: a + v)


def in_areas(points: DataFrame, areas: DataFrame, key: str, size: float = 0.01) -> DataFrame:
    """``points`` (lon, lat) with the ``key`` of each of ``areas`` (key, rings) that they lie strictly inside of; a row for each."""
    cell = lambda v: F.floor(v / F.lit(size)).cast("bigint")
    xs, ys = F.col("rings")[0]["x"], F.col("rings")[0]["y"]
    spread = areas.withColumn("_cx", F.explode(F.sequence(cell(F.array_min(xs)), cell(F.array_max(xs))))).withColumn("_cy", F.explode(F.sequence(cell(F.array_min(ys)), cell(F.array_max(ys)))))
    near = points.withColumns({"_cx": cell(F.col("lon")), "_cy": cell(F.col("lat"))}).join(spread.select(key, "rings", "_cx", "_cy"), ["_cx", "_cy"])
    return near.where(inside(F.col("rings"), F.col("lon"), F.col("lat")) & ~on_border("rings", "lon", "lat")).drop("_cx", "_cy", "rings")


_PIECES = pa.list_(pa.struct([("name", pa.string()), ("rings", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))]))
_CUT = pa.schema([("piece", pa.string()), ("parent", pa.string()), ("cx", pa.float64()), ("cy", pa.float64()), *((q, _PIECES) for q in QUARTERS)])
CUT = "piece string, parent string, cx double, cy double, " + ", ".join(f"{q} array<struct<name: string, rings: {RINGS}>>" for q in QUARTERS)


def cut_quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each tile's parts in the quarters of its bounds. A quarter with several gets them as -SW-1, -SW-2, ..."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            rows = []
            for r in b.slice(lo, 256).to_pylist():
                cx, cy, parts = quarters([[(p["x"], p["y"]) for p in ring] for ring in r["rings"]])
                row = {"piece": r["piece"], "parent": r["parent"], "cx": cx, "cy": cy}
                for q, found in parts.items():
                    ends = [f"-{k}" for k in range(1, len(found) + 1)] if len(found) > 1 else [""]
                    row[q] = [{"name": f"{r['piece']}-{q}{e}", "rings": [[{"x": x, "y": y} for x, y in ring] for ring in rings]} for e, rings in zip(ends, found)]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_CUT)


def area_tiles(points: DataFrame, areas: DataFrame, most: int = MOST, min_span: float = MIN_SPAN_DEG, cap: float = math.inf) -> tuple[DataFrame, DataFrame]:
    """Q01: tiles (tile, parent, level, points, rings) of ``areas`` (parent, rings), and each point with its tile.

    A tile with more than ``most`` points, or wider than ``cap``, is cut into the quarters of its bounds, unless it is
    below ``min_span`` on both axes. Its parts in a quarter are tiles of their own; empty ones are left out. A
    point on a cutting line belongs to the south or west, so that none is lost.

    A level costs one join of the points of tiles still to cut with these tiles; points of finished tiles rest.
    """
    pieces = areas.select(F.col("parent").alias("piece"), "parent", "rings")
    inner = in_areas(points, pieces.select("piece", "rings"), "piece")
    tiles, placed, level = [], [], 0
    while True:
        inner = materialize(inner, "points")
        sized = materialize(pieces.join(inner.groupBy("piece").agg(F.count("*").alias("points")), "piece"), "tiles")
        at_floor = (span("x") < min_span) & (span("y") < min_span)
        over = (span("x") > cap) | (span("y") > cap)
        done = at_floor | ((F.col("points") <= most) & ~over)
        tiles.append(sized.where(done).select(F.col("piece").alias("tile"), "parent", F.lit(level).alias("level"), "points", "rings"))
        placed.append(inner.join(sized.where(done).select("piece"), "piece", "left_semi"))
        open_ = sized.where(~done)
        if open_.isEmpty():
            break
        parts = materialize(open_.select("piece", "parent", "rings").mapInArrow(cut_quarters, CUT), "quarters")
        pieces = parts.select("parent", F.explode(F.concat(*QUARTERS)).alias("p")).select(F.col("p.name").alias("piece"), "parent", "p.rings")
        south = F.when(F.col("lon") <= F.col("cx"), F.col("SW")).otherwise(F.col("SE"))
        north = F.when(F.col("lon") <= F.col("cx"), F.col("NW")).otherwise(F.col("NE"))
        here = F.when(F.col("lat") <= F.col("cy"), south).otherwise(north)
        j = inner.join(parts, "piece").withColumn("_here", here)
        # Nearly always the quarter has one part. A point that rounding puts between several goes to the first.
        fits = F.filter("_here", lambda p: inside(p["rings"], F.col("lon"), F.col("lat")))
        chosen = F.when(F.size("_here") < 2, F.get("_here", F.lit(0))).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.get("_here", F.lit(0))))
        inner = j.withColumn("piece", chosen["name"]).select(*inner.columns).where("piece IS NOT NULL")
        level += 1
    return _union(tiles), _union(placed).withColumnRenamed("piece", "tile")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def edges(polygons: DataFrame, key: str) -> DataFrame:
    """The sides of all rings: key, x0, y0, x1, y1, from the lower x, then lower y on; no sides of length 0."""
    ring = polygons.select(key, F.explode("rings").alias("r")).select(key, "r", F.explode(F.sequence(F.lit(0), F.size("r") - 1)).alias("i"))
    ends = F.array_sort(F.array(F.col("r")[F.col("i")], F.col("r")[(F.col("i") + 1) % F.size("r")]))
    e = ring.select(key, ends.alias("e"))
    return e.select(key, *[F.col("e")[k][c].alias(f"{c}{k}") for k in (0, 1) for c in ("x", "y")]).where("x0 <> x1 OR y0 <> y1")


def borders(polygons: DataFrame, key: str) -> DataFrame:
    """(a, b, length) of all pairs of polygons that share a border, both ways; corners don't count. Length in 1 / UNITS degrees.

    Sides meet by the line that bears them (angle and distance from a corner of the whole) and a bin on it; a pair
    comes about only where sides overlap. A line of any length is many bins, so no line is one task.
    """
    side = edges(polygons, key)
    low = side.agg(F.floor(F.min("x0")).alias("_ox"), F.floor(F.min(F.least("y0", "y1"))).alias("_oy"))  # one row
    side = side.crossJoin(F.broadcast(low))
    side = side.withColumns({c: F.col(c) - F.col("_ox" if c[0] == "x" else "_oy") for c in ("x0", "y0", "x1", "y1")}).drop("_ox", "_oy")
    angle = F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    side = side.withColumn("t", F.when(angle <= -math.pi / 2 + 2 * ANGLE, angle + math.pi).otherwise(angle))
    along = lambda k: F.col(f"x{k}") * F.cos("t") + F.col(f"y{k}") * F.sin("t")
    side = side.withColumns({"c": F.col("y0") * F.cos("t") - F.col("x0") * F.sin("t"), "s0": F.least(along(0), along(1)), "s1": F.greatest(along(0), along(1))})
    side = side.withColumns({"ka": F.floor(F.col("t") / ANGLE), "ko": F.floor(F.col("c") / OFFSET)})
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    keyed = side.withColumn("d", step).withColumn("bin", F.explode(F.sequence(F.floor(F.col("s0") / BIN), F.floor(F.col("s1") / BIN))))
    keyed = keyed.select(key, (F.col("ka") + F.col("d.i")).alias("la"), (F.col("ko") + F.col("d.j")).alias("lo"), "bin", "ka", "ko", F.greatest("s0", F.col("bin") * BIN).alias("s0"), F.least("s1", (F.col("bin") + 1) * BIN).alias("s1"))
    a, b = keyed.alias("a"), keyed.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("la", "lo", "bin")]
    once = (F.col("a.la") == F.greatest("a.ka", "b.ka")) & (F.col("a.lo") == F.greatest("a.ko", "b.ko"))  # of up to four keys two sides share, one
    shared = F.least("a.s1", "b.s1") - F.greatest("a.s0", "b.s0")
    pairs = a.join(b, [*same, F.col(f"a.{key}") != F.col(f"b.{key}"), once, shared > 1e-12])
    found = pairs.groupBy(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b")).agg(F.sum(F.round(shared * UNITS).cast("bigint")).alias("length"))
    return found.where("length > 0")


def merge_rounds(tiles: DataFrame, near: DataFrame, floor: int = FLOOR, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """``tiles`` (tile, parent, points) after those under ``floor``, smallest first, have joined a neighbour; with merged_from.

    ``near`` is (a, b, length), both ways. Of neighbours that keep the sum within ``hard``: one of the same parent, then a sum
    within ``soft``, the longest border, the smallest sum, the first name. The larger tile stays, the neighbour on ties.

    One after another and in rounds come to the same: a tile is merged once no smaller one that is still to merge lies
    within two steps. Any other that could change what it sees would be such a one, or a union of such ones. All those merge at
    once, in joins over written tables; two of them never touch the same tile. That holds if any two tiles under the
    floor may merge.
    """
    if 2 * (floor - 1) > hard:
        raise ValueError("two tiles below the floor must fit into one")
    now = materialize(tiles.select("tile", "parent", F.col("points").cast("bigint").alias("points"), F.array().cast("array<string>").alias("merged_from"), F.lit(False).alias("stuck")), "merge-tiles")
    near = materialize(near.select("a", "b", "length"), "merge-borders")
    while True:
        small = now.where((F.col("points") < floor) & ~F.col("stuck")).select("tile", F.struct("points", "tile").alias("k"))
        if small.isEmpty():
            break
        seen = small.unionByName(near.join(small, near["b"] == small["tile"]).select(F.col("a").alias("tile"), "k")).groupBy("tile").agg(F.min("k").alias("k"))
        two = small.select("tile").join(near, F.col("tile") == F.col("a")).select("tile", F.col("b").alias("at"))
        two = small.select("tile", F.col("tile").alias("at")).unionByName(two).join(seen.select(F.col("tile").alias("at"), "k"), "at").groupBy("tile").agg(F.min("k").alias("least"))
        ready = small.join(two, "tile").where(F.col("least") == F.col("k")).select("tile")
        t = now.join(ready, "tile").select("tile", "parent", "points", "merged_from")
        other = now.select(F.col("tile").alias("b"), F.col("parent").alias("_parent"), F.col("points").alias("_points"))
        together = F.col("points") + F.col("_points")
        score = F.struct((F.col("parent") != F.col("_parent")).alias("other"), (together > soft).alias("over"), (-F.col("length")).alias("border"), together.alias("sum"), F.col("b").alias("b"), F.col("_points").alias("size"))
        best = t.join(near.withColumnRenamed("a", "tile"), "tile").join(other, "b").where(together <= hard).groupBy("tile").agg(F.min(score).alias("to"))
        moves = materialize(t.select("tile", "points").join(best, "tile", "left"), "moves")
        stays = F.col("to.size") >= F.col("points")  # the neighbour
        pairs = moves.where("to IS NOT NULL").select(F.when(stays, F.col("tile")).otherwise(F.col("to.b")).alias("drop"), F.when(stays, F.col("to.b")).otherwise(F.col("tile")).alias("keep"), F.col("to.sum").alias("sum"))
        joined = pairs.join(now.select(F.col("tile").alias("drop"), F.col("merged_from").alias("_more")), "drop").select(F.col("keep").alias("tile"), "sum", F.concat("_more", F.array("drop")).alias("_more"))
        lone = moves.where("to IS NULL").select("tile", F.lit(True).alias("_lone"))
        left = now.join(pairs.select(F.col("drop").alias("tile")), "tile", "left_anti").join(joined, "tile", "left").join(lone, "tile", "left")
        left = left.select("tile", "parent", F.coalesce("sum", "points").alias("points"), F.when(F.col("_more").isNull(), F.col("merged_from")).otherwise(F.concat("merged_from", "_more")).alias("merged_from"), F.coalesce("_lone", "stuck").alias("stuck"))
        name = lambda c: pairs.select(F.col("drop").alias(c), F.col("keep").alias(f"_{c}"))
        moved = near.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "length").where("a <> b")
        now, near = materialize(left, "merge-tiles"), materialize(moved.groupBy("a", "b").agg(F.sum("length").alias("length")), "merge-borders")
    return now.select("tile", "parent", "points", "merged_from")


def merge_statistics(before: DataFrame, after: DataFrame, points: DataFrame, floor: int = FLOOR) -> DataFrame:
    """One row of counts of a build."""
    b = before.agg(F.count("*").alias("pre_merge_tile_count"))
    a = after.agg(F.count("*").alias("tile_count"), F.coalesce(F.sum(F.size("merged_from")), F.lit(0)).cast("bigint").alias("merges"), F.count(F.when(F.col("points") < floor, 1)).alias("below_floor_remaining"), F.coalesce(F.sum("points"), F.lit(0)).cast("bigint").alias("assigned_after"))
    n = points.agg(F.count("*").alias("total_addresses"))
    return n.crossJoin(b).crossJoin(a).withColumn("orphan_count", F.col("total_addresses") - F.col("assigned_after"))  # of one row each


def cover(areas: DataFrame, box: tuple[float, float, float, float], start: float = OUTSIDE_SPAN_DEG, finest: float = OUTSIDE_SPAN_DEG / 8) -> DataFrame:
    """Q02: square cells over ``box`` (south, west, north, east) less those inside of an area: level, x, y, state (outside or crossing).

    Cells of ``start`` degrees at most; one that an area's border crosses is cut in four, down to ``finest``. Only crossing
    cells go on to the next level, each with the areas that it meets there, so the work grows with the length of the borders.
    """
    side = max(box[2] - box[0], box[3] - box[1])
    first, last = (max(0, math.ceil(math.log2(side / s) - 1e-9)) for s in (start, finest))
    size = lambda level: side / (1 << level)
    spark = areas.sparkSession
    count = lambda lo, hi: max(1, math.ceil((hi - lo) / size(first) - 1e-9))
    rows = spark.range(count(box[1], box[3]) * count(box[0], box[2]))
    nx = count(box[1], box[3])
    cells = rows.select((F.col("id") % nx).alias("x"), F.floor(F.col("id") / nx).cast("bigint").alias("y"))
    xs, ys = F.col("rings")[0]["x"], F.col("rings")[0]["y"]
    at = lambda v, o: F.floor((v - F.lit(o)) / F.lit(size(first))).cast("bigint")
    meets = areas.select("rings", F.explode(F.sequence(at(F.array_min(xs), box[1]), at(F.array_max(xs), box[1]))).alias("x"), F.sequence(at(F.array_min(ys), box[0]), at(F.array_max(ys), box[0])).alias("_y"))
    meets = meets.select("rings", "x", F.explode("_y").alias("y")).join(cells, ["x", "y"], "left_semi")
    out = [cells.join(meets.select("x", "y"), ["x", "y"], "left_anti").select(F.lit(first).alias("level"), "x", "y", F.lit("outside").alias("state"))]
    level = first
    while True:
        s = size(level)
        judged = materialize(meets.select("x", "y", "rings", (F.lit(box[1]) + F.col("x") * s).alias("x0"), (F.lit(box[0]) + F.col("y") * s).alias("y0")).withColumns({"x1": F.col("x0") + s, "y1": F.col("y0") + s}).withColumns({"mx": F.col("x0") + s / 2, "my": F.col("y0") + s / 2}).withColumns({"crosses": _crosses(), "holds": inside(F.col("rings"), F.col("mx"), F.col("my"))}).select("x", "y", "rings", "crosses", "holds"), "cover")
        each = judged.groupBy("x", "y").agg(F.max(~F.col("crosses") & F.col("holds")).alias("covered"), F.max("crosses").alias("crosses")).where("NOT covered")
        out.append(each.where(~F.col("crosses") | F.lit(level == last)).select(F.lit(level).alias("level"), "x", "y", F.when(F.col("crosses"), "crossing").otherwise("outside").alias("state")))
        if level >= last:
            return _union(out)
        going = judged.join(each.where("crosses").select("x", "y"), ["x", "y"])
        kids = F.explode(F.array(*[F.struct((2 * F.col("x") + i).alias("x"), (2 * F.col("y") + j).alias("y")) for j in (0, 1) for i in (0, 1)]))
        meets = going.withColumn("k", kids).select("k.x", "k.y", "rings")
        level += 1


def _crosses() -> Column:
    """Whether a side of ``rings`` has a point strictly inside of the cell (x0, y0, x1, y1): clipping the side to the cell leaves more than an end."""
    p, q = "r[i]", "r[(i + 1) % size(r)]"
    near = f"greatest({p}.x, {q}.x) > x0 and least({p}.x, {q}.x) < x1 and greatest({p}.y, {q}.y) > y0 and least({p}.y, {q}.y) < y1"
    turn = lambda x, y: f"sign(({q}.x - {p}.x) * ({y} - {p}.y) - ({q}.y - {p}.y) * ({x} - {p}.x))"
    corners = ", ".join(turn(x, y) for x in ("x0", "x1") for y in ("y0", "y1"))
    apart = f"array_min(array({corners})) < 0 and array_max(array({corners})) > 0"
    return F.expr(f"exists(rings, r -> exists(sequence(0, size(r) - 1), i -> {near} and {apart}))")


def outside_tiles(points: DataFrame, areas: DataFrame, key: str, box: tuple[float, float, float, float], most: int = MOST, cap: float = OUTSIDE_SPAN_DEG, finest: float = OUTSIDE_SPAN_DEG / 8) -> DataFrame:
    """Q02: tiles of the points outside all ``areas`` (key, rings): level, x, y, points, and the cells of ``cover`` it has, outside and crossing, counted in finest cells.

    A tile is the coarsest cell of ``cap`` degrees at most that has no more than ``most`` points; cells at ``finest`` stay whole. Points
    outside of the cells of ``box`` are in no tile.
    """
    side = max(box[2] - box[0], box[3] - box[1])
    first, last = (max(0, math.ceil(math.log2(side / s) - 1e-9)) for s in (cap, finest))
    out = points.join(in_areas(points, areas.select(F.lit(0).alias("_area"), "rings"), "_area").select(key), key, "left_anti")
    cell = lambda c, o: F.floor((F.col(c) - F.lit(o)) / F.lit(side / (1 << last))).cast("bigint")
    most_x, most_y = (max(1, math.ceil((hi - lo) / side * (1 << first) - 1e-9)) << (last - first) for lo, hi in ((box[1], box[3]), (box[0], box[2])))
    placed = out.select(cell("lon", box[1]).alias("fx"), cell("lat", box[0]).alias("fy")).where((F.col("fx") >= 0) & (F.col("fx") < most_x) & (F.col("fy") >= 0) & (F.col("fy") < most_y))
    counted = materialize(placed.groupBy("fx", "fy").agg(F.count("*").alias("n")), "outside")
    level = F.explode(F.sequence(F.lit(first), F.lit(last)))
    shift = lambda c, by: F.call_function("shiftright", F.col(c), by)
    up = counted.withColumn("level", level).withColumns({"x": shift("fx", F.lit(last) - F.col("level")), "y": shift("fy", F.lit(last) - F.col("level"))}).groupBy("level", "x", "y").agg(F.sum("n").alias("points"))
    fits = (F.col("points") <= most) | (F.col("level") == last)
    above = up.select((F.col("level") + 1).alias("level"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("points").alias("_above"))
    j = up.where(fits).withColumns({"_x": shift("x", F.lit(1)), "_y": shift("y", F.lit(1))}).join(above, ["level", "_x", "_y"], "left")
    tiles = j.where((F.col("level") == first) | (F.col("_above") > most)).select("level", "x", "y", "points")
    whole = F.call_function("power", F.lit(4), F.lit(last) - F.col("level")).cast("bigint")
    cells = cover(areas, box, cap, finest)
    # A tile has the cells of the cover in it; one without any lies in a larger cell, which is outside.
    mine = cells.withColumn("tl", F.explode(F.sequence(F.lit(first), F.col("level")))).withColumns({"tx": shift("x", F.col("level") - F.col("tl")), "ty": shift("y", F.col("level") - F.col("tl"))})
    sums = mine.groupBy(F.col("tl").alias("level"), F.col("tx").alias("x"), F.col("ty").alias("y")).agg(F.sum(F.when(F.col("state") == "outside", whole).otherwise(0)).alias("outside_cells"), F.count(F.when(F.col("state") == "crossing", 1)).alias("crossing_cells"))
    found = tiles.join(sums, ["level", "x", "y"], "left")
    return found.withColumns({"outside_cells": F.coalesce("outside_cells", whole), "crossing_cells": F.coalesce("crossing_cells", F.lit(0).cast("bigint"))})
