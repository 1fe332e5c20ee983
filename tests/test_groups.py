"""Hot groups, long ranges and odd places: the operators against brute force over all pairs."""

import random
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from addrloom.functions import geo, text
from addrloom.operators import checks, coverage, reports, streets, uploads
from addrloom.operators import conflate as conf
from addrloom.sources import history
from addrloom.sources.recipes import Recipe


def metres(a, b):
    y, x = radians(b[0] - a[0]), radians(b[1] - a[1])
    return 2 * 6_371_000 * asin(sqrt(sin(y / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(x / 2) ** 2))


def stacked():
    """A third of the rows at one point, others around it and along a street."""
    rnd = random.Random(7)
    rows = [(1, str(i), "9 A ST", "m", "Land", 43.6, -79.5) for i in range(100)]
    rows += [(1 + i % 2, f"x{i}", ["9 A ST", "8 A ST"][i % 2], [None, "m"][i % 3 == 0], "Land", 43.6 + rnd.random() * 1e-4, -79.5 + rnd.random() * 1e-4) for i in range(200)]
    return rows + [(1, "far", "9 A ST", "m", "Land", 44.0, -79.0), (1, "null", "9 A ST", "m", "Land", None, -79.0), (1, "shop", "9 A ST", "m", "Structure", 43.6, -79.5)]


CANDS = "run_id bigint, candidate_id string, address_full string, muni string, cls string, lat double, lon double"


def test_close_candidates_by_brute_force(spark):
    rows = stacked()
    got = {(r.run_id, r.candidate_id): (r.n, r.list) for r in checks.close_candidates(spark.createDataFrame(rows, CANDS), 3.0).collect()}
    key = lambda k: (not k.isdigit(), int(k) if k.isdigit() else 0, k)
    want = {}
    for a in rows:
        near = [(round(metres(a[5:], b[5:]) * 100), key(b[1]), b[1]) for b in rows if a[5] is not None and b[5] is not None and a[0] == b[0] and a[1] != b[1] and metres(a[5:], b[5:]) <= 3]
        if near:
            want[a[0], a[1]] = len(near), "|".join(f"{k}@{cm // 100}.{cm % 100:02d}" for cm, _, k in sorted(near)[:5])
    assert got == want and max(n for n, _ in got.values()) > 100


def test_siblings_by_brute_force(spark):
    rows = stacked()
    got = {(r.run_id, r.candidate_id): (r.sibling_id, round(r.sibling_dist, 6), r.is_canonical) for r in conf.land_siblings(spark.createDataFrame(rows, CANDS)).collect()}
    key = lambda k: (not k.isdigit(), int(k) if k.isdigit() else 0, k)
    land = [r for r in rows if r[4] == "Land" and r[5] is not None]
    want = {}
    for a in land:
        near = [(metres(a[5:], b[5:]), key(b[1]), b[1]) for b in land if a[:1] + a[2:4] == b[:1] + b[2:4] and a[1] != b[1]]
        if near:
            d, _, k = min(near)
            want[a[0], a[1]] = k, round(d, 6), key(a[1]) < min(n[1] for n in near)
    assert got == want


def test_the_grid_loses_no_pair_near_the_poles(spark):
    rnd = random.Random(2)
    for lat in (0.0, 60.0, 85.0, 89.999, -80.0):
        pts = [(i, lat + rnd.uniform(-0.0006, 0.0006), rnd.uniform(0, 0.0012 / max(cos(radians(lat)), 1e-3))) for i in range(60)]
        pts = [(i, min(y, 90.0), x) for i, y, x in pts]
        df = spark.createDataFrame(pts, "i int, lat double, lon double")
        other = df.select(F.col("i").alias("j"), F.col("lat").alias("a"), F.col("lon").alias("b"))
        pairs = geo.with_cells(df, 50.0, around=True).join(geo.with_cells(other, 50.0, "a", "b"), ["cy", "cx"])
        got = [(r.i, r.j) for r in pairs.where(geo.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")) <= 50).select("i", "j").collect()]
        want = {(p[0], q[0]) for p in pts for q in pts if metres(p[1:], q[1:]) <= 49.9999}
        assert want <= set(got) and len(got) == len(set(got))


def test_a_long_range_costs_no_rows(spark):
    ranges = spark.createDataFrame([("a", "m", "S", 1, 9_999_999_999), ("b", "m", "S", 8, 2), ("c", None, "S", 3, 9), ("d", "m", "T", 1, 5)], "candidate_id string, muni string, street_norm string, lo_num bigint, hi_num bigint")
    singles = spark.createDataFrame([("m", "S", n) for n in (1, 2, 4, 5, 5, 7, 8)] + [(None, "S", 9), ("m", "S", None)], "muni string, street_norm string, lo_num bigint")
    got = {r.candidate_id: (r.parity_present, r.parity_total, r.category) for r in coverage.range_coverage(ranges, singles).collect()}
    assert got == {"a": (3, 5_000_000_000, "partial"), "b": (3, 4, "partial"), "c": (1, 4, "partial"), "d": (0, 3, "uncovered")}


def test_tile_ids_avoid_those_taken(spark):
    t = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "a-2", "a", "b", "a", "a-2", "a-2-2", "b"])], "no int, slug string")
    got = {r.no: r.tile_id for r in reports.suffixed_ids(t, "slug", ["no"]).collect()}
    assert got == {0: "a", 1: "a-2", 2: "a-3", 3: "b", 4: "a-4", 5: "a-2-2", 6: "a-2-2-2", 7: "b-2"}


def test_streets_once_or_row_by_row(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "King St. W"), (2, None), (3, "King St. W"), (4, "")], "k int, street string")
    want = {1: "KING ST W", 2: "", 3: "KING ST W", 4: ""}
    for most in (100, 1):
        monkeypatch.setattr(streets, "SPELLINGS", most)
        found = streets.with_streets(rows, {"norm": text.normalize_street})
        assert found.columns == ["k", "street", "norm"] and {r.k: r.norm for r in found.collect()} == want


def test_ids_of_any_length_in_order(spark):
    ids = ["9", "10", "007", "7", "123456789012345678901234", "123456789012345678901235", "0", "x1", "syn:2"]
    got = [r.v for r in spark.createDataFrame([(v,) for v in ids], "v string").orderBy(text.id_order(F.col("v"))).collect()]
    assert got == ["0", "007", "7", "9", "10", "123456789012345678901234", "123456789012345678901235", "syn:2", "x1"]


def test_checks_follow_declared_fields():
    bare, full = Recipe("street", "full"), Recipe("street", "full", lo_num="props:A", hi_num="props:B", address_class="props:C")
    assert set(checks.VERSIONS) - set(checks.available(bare)) == {"suffix_range", "intra_source_duplicate"} and checks.available(full) == tuple(checks.VERSIONS)
    with pytest.raises(ValueError):
        checks.available(bare, ("suffix_range",))


def test_no_snapshot_and_no_plan_are_errors(spark):
    s = spark.createDataFrame([(1, 1)], "id bigint, skipped int")
    with pytest.raises(Exception, match="no snapshot"):
        history.latest_snapshot(s).collect()
    with pytest.raises(ValueError):
        uploads.changeset_tags(s, "x", "c", "s", "")
