"""Polygon tiles: cutting, cover, borders and merging against brute force."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from addrloom.functions import rings as geometry
from addrloom.operators import polygons

SHAPE = f"parent string, rings {polygons.RINGS}"


def as_rings(rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def comb(teeth, w=1.0, h=5.0, x0=0.0, y0=0.0):
    pts = [(0, 0), (teeth * 2 - 1, 0)]
    for k in range(teeth - 1, -1, -1):
        pts += [(2 * k + 1, 5), (2 * k, 5), *([(2 * k, 1), (2 * k - 1, 1)] if k else [])]
    return [[(x0 + x * w, y0 + y * h / 5) for x, y in pts]]


def star(rnd, n, x0, y0, r):
    return [[(x0 + (k := rnd.uniform(0.2, 1) * r) * math.cos(2 * math.pi * i / n), y0 + k * math.sin(2 * math.pi * i / n)) for i in range(n)]]


RND = random.Random(4)
SHAPES = {"comb": comb(4, 0.01, 0.05), "frame": [[(0.1, 0), (0.2, 0), (0.2, 0.1), (0.1, 0.1)], [(0.12, 0.02), (0.18, 0.02), (0.18, 0.08), (0.12, 0.08)]], "wedge": [[(0.3, 0), (0.4, 0), (0.4, 0.1), (0.35, 0.05), (0.3, 0.1)]], "star": star(RND, 31, 0.55, 0.05, 0.06)}


def test_cutting_keeps_the_area_and_every_point():
    rnd = random.Random(1)
    for rings in [*SHAPES.values(), *(star(rnd, n, 0, 0, 1) for n in (5, 12, 40) for _ in range(15))]:
        x0, y0, x1, y1 = geometry.bounds(rings)
        pieces = [rings]
        for _ in range(3):
            pieces = [k for p in pieces for q in geometry.quarters(p)[2].values() for k in q]
            assert math.isclose(sum(map(geometry.area, pieces)), geometry.area(rings), rel_tol=1e-9)
        for _ in range(200):
            x, y = rnd.uniform(x0, x1), rnd.uniform(y0, y1)
            assert sum(geometry.within(p, x, y) for p in pieces) == geometry.within(rings, x, y)


def test_parts_of_a_cut():
    assert [len(s) for s in geometry.cut(comb(4), 1, 3.0)] == [1, 4]  # the teeth
    assert [len(s) for s in geometry.cut(comb(4), 1, 1.0)] == [1, 4]  # along the bottoms of the gaps
    assert [len(s) for s in geometry.cut(SHAPES["wedge"], 1, 0.05)] == [1, 2]  # through the tip
    assert [len(s) for s in geometry.cut(SHAPES["frame"], 0, 0.15)] == [1, 1]  # through the hole
    low, high = geometry.cut(SHAPES["frame"], 0, 0.11)
    assert [len(p) for p in (*low, *high)] == [1, 2]  # the hole stays with its side
    assert [len(s) for s in geometry.cut([[(0, 0), (1, 0), (1, 1), (0, 1)]], 1, 0.0)] == [0, 1]  # only a side on the line
    assert [len(s) for s in geometry.cut([[(0, 0), (1, 0), (1, 1), (0, 1)]], 1, 1.0)] == [1, 0]


def spread(rnd, rings, n):
    x0, y0, x1, y1 = geometry.bounds(rings)
    return [(rnd.uniform(x0, x1), y0 + (y1 - y0) * rnd.random() ** 2) for _ in range(n)]


def test_area_tiles(spark):
    rnd = random.Random(7)
    pts = [p for rings in SHAPES.values() for p in spread(rnd, rings, 1500)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id bigint, lon double, lat double")
    areas = spark.createDataFrame([(k, as_rings(r)) for k, r in SHAPES.items()] + [("empty", as_rings([[(9, 9), (9.1, 9), (9, 9.1)]]))], SHAPE)
    tiles, placed = polygons.area_tiles(points, areas, most=60)
    tiles, where = tiles.collect(), {}
    for r in placed.collect():
        assert r.id not in where
        where[r.id] = r.tile
    inner = {i for i, p in enumerate(pts) if any(geometry.within(r, *p) for r in SHAPES.values())}
    assert set(where) == inner  # no point of an area is lost, none added
    shapes = {t.tile: [[(p.x, p.y) for p in ring] for ring in t.rings] for t in tiles}
    for t in tiles:
        assert t.points == sum(v == t.tile for v in where.values()) > 0
        x0, y0, x1, y1 = geometry.bounds(shapes[t.tile])
        assert t.points <= 60 or (x1 - x0 < polygons.MIN_SPAN_DEG and y1 - y0 < polygons.MIN_SPAN_DEG)
        assert t.tile.count("-S") + t.tile.count("-N") == t.level
    assert all(geometry.within(shapes[t], *pts[i]) for i, t in where.items())
    assert any(t.tile.endswith("-2") for t in tiles)  # a quarter with two parts
    assert sum(geometry.area(s) for s in shapes.values()) <= sum(geometry.area(r) for r in SHAPES.values()) + 1e-12


def test_no_points(spark):
    areas = spark.createDataFrame([(k, as_rings(r)) for k, r in SHAPES.items()], SHAPE)
    tiles, placed = polygons.area_tiles(spark.createDataFrame([], "id bigint, lon double, lat double"), areas)
    assert tiles.count() == placed.count() == 0


def shared(a, b):
    """Length of the common border of two polygons, side by side."""
    total = 0.0
    sides = lambda rings: [(p, q) for r in rings for p, q in zip(r, r[1:] + r[:1])]
    for (ax, ay), (bx, by) in sides(a):
        n = math.hypot(bx - ax, by - ay)
        u = ((bx - ax) / n, (by - ay) / n)
        for (cx, cy), (dx, dy) in sides(b):
            if max(abs(u[0] * (y - ay) - u[1] * (x - ax)) for x, y in ((cx, cy), (dx, dy))) < 1e-9:
                s = sorted(u[0] * (x - ax) + u[1] * (y - ay) for x, y in ((cx, cy), (dx, dy)))
                total += max(0.0, min(n, s[1]) - max(0.0, s[0]))
    return total


def test_borders(spark):
    pieces = {}
    for k, rings in {**SHAPES, "tilted": [[(0.7, 0.0), (0.8, 0.03), (0.77, 0.13), (0.67, 0.1)]], "beside": [[(0.8, 0.03), (0.9, 0.06), (0.87, 0.16), (0.785, 0.08)]]}.items():
        todo = [(k, rings, 0)]
        while todo:
            name, r, level = todo.pop()
            if level == 2:
                pieces[name] = r
                continue
            todo += [(f"{name}-{q}{i}", p, level + 1) for q, parts in geometry.quarters(r)[2].items() for i, p in enumerate(parts)]
    pieces["left"], pieces["right"] = [[(5, 5), (5.5, 5), (5.5, 6), (5, 6)]], [[(5.5, 5.25), (6, 5.25), (6, 7), (5.5, 7)]]
    pieces["corner"] = [[(6, 7), (7, 7), (7, 8), (6, 8)]]
    got = {(r.a, r.b): r.length / polygons.UNITS for r in polygons.borders(spark.createDataFrame([(k, as_rings(r)) for k, r in pieces.items()], SHAPE.replace("parent", "tile")), "tile").collect()}
    want = {(a, b): n for a in pieces for b in pieces if a != b and (n := shared(pieces[a], pieces[b])) > 1e-8}
    assert got == pytest.approx(want, abs=1e-7) and len(want) > 60
    assert got["left", "right"] == 0.75 and ("right", "corner") not in got


def absorb(tiles, near, floor, soft, hard):
    """One after another: the smallest tile below the floor joins its best neighbour."""
    n, parent = {t: c for t, _, c in tiles}, {t: p for t, p, _ in tiles}
    took, links = {t: [] for t in n}, {t: {} for t in n}
    for a, b, length in near:
        links[a][b] = length
    heap = [(c, t) for t, c in n.items() if c < floor]
    heapq.heapify(heap)
    while heap:
        c, i = heapq.heappop(heap)
        if n.get(i) != c:
            continue
        options = [(parent[i] != parent[j], c + n[j] > soft, -length, c + n[j], j) for j, length in links[i].items() if c + n[j] <= hard]
        if not options:
            continue
        j = min(options)[-1]
        keep, drop = (j, i) if n[j] >= c else (i, j)
        n[keep] += n.pop(drop)
        took[keep] += [*took.pop(drop), drop]
        for k, length in links.pop(drop).items():
            del links[k][drop]
            if k != keep:
                links[keep][k] = links[k][keep] = links[keep].get(k, 0) + length
        if n[keep] < floor:
            heapq.heappush(heap, (n[keep], keep))
    return {t: (c, took[t]) for t, c in n.items()}


@pytest.mark.parametrize("seed,side,hard,ties", [(1, 7, 750, False), (2, 9, 500, True), (3, 5, 600, True), (4, 10, 750, False)])
def test_rounds_merge_as_one_after_another_does(spark, seed, side, hard, ties):
    rnd = random.Random(seed)
    cell = lambda x, y: f"t{x:02}{y:02}"
    tiles = [(cell(x, y), f"p{x // 3}", rnd.choice([10, 50, 100, 240]) if ties else rnd.choice([rnd.randrange(1, 250), rnd.randrange(1, 500)])) for x in range(side) for y in range(side)]
    near = []
    for x in range(side):
        for y in range(side):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < side and y + dy < side and rnd.random() < 0.9:
                    length = 7 if ties else rnd.randrange(1, 100)
                    near += [(cell(x, y), cell(x + dx, y + dy), length), (cell(x + dx, y + dy), cell(x, y), length)]
    got = polygons.merge_rounds(spark.createDataFrame(tiles, "tile string, parent string, points bigint"), spark.createDataFrame(near, "a string, b string, length bigint"), hard=hard)
    rows = got.collect()
    assert {r.tile: (r.points, r.merged_from) for r in rows} == absorb(tiles, near, 250, 500, hard)
    assert sum(r.points for r in rows) == sum(t[2] for t in tiles) and all(r.points <= hard for r in rows)
    with pytest.raises(ValueError):
        polygons.merge_rounds(got, got, floor=400)


def test_cover_and_outside_tiles(spark):
    rnd = random.Random(3)
    areas = {k: r for k, r in SHAPES.items() if k != "comb"} | {"over": [[(0.15, 0.05), (0.33, 0.06), (0.2, 0.2)]]}
    box = (-0.05, 0.05, 0.27, 0.69)
    frame = spark.createDataFrame([(k, as_rings(r)) for k, r in areas.items()], SHAPE)
    pts = [(rnd.uniform(0.05, 0.69), rnd.uniform(-0.05, 0.27)) for _ in range(4000)] + [(0.06 + rnd.random() * 0.004, 0.2 + rnd.random() * 0.004) for _ in range(900)]
    outer = {i for i, p in enumerate(pts) if not any(geometry.within(r, *p) for r in areas.values())}
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id bigint, lon double, lat double")
    cap, finest = 0.02, 0.0025
    side = 0.64
    cells = {(r.level, r.x, r.y): r.state for r in polygons.cover(frame, box, cap, finest).collect()}
    levels = {k[0] for k in cells}
    assert levels == {5, 6, 7, 8}

    def holder(p):
        found = [k for k in ((lv, math.floor((p[0] - box[1]) / (side / 2**lv)), math.floor((p[1] - box[0]) / (side / 2**lv))) for lv in levels) if k in cells]
        assert len(found) < 2
        return found[0] if found else None

    for i, p in enumerate(pts):
        h = holder(p)
        assert (i in outer) if h and cells[h] == "outside" else (i not in outer) if h is None else h[0] == 8
    assert sum(1 for k in cells if cells[k] == "crossing") < 900 < 4**8 / 2
    tiles = polygons.outside_tiles(points, frame, "id", box, most=300, cap=cap, finest=finest).collect()
    assert sum(t.points for t in tiles) == len(outer)
    for t in tiles:
        s = side / 2**t.level
        mine = [i for i in outer if math.floor((pts[i][0] - box[1]) / s) == t.x and math.floor((pts[i][1] - box[0]) / s) == t.y]
        assert len(mine) == t.points and s <= cap and (t.points <= 300 or t.level == 8)
        assert 0 < t.outside_cells + t.crossing_cells <= 4 ** (8 - t.level)
    assert len({(t.level, t.x, t.y) for t in tiles}) == len(tiles) and {t.level for t in tiles} != {5}
