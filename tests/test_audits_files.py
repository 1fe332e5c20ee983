"""Range audit, reverse sweep, back-fill, extracts, dataset texts and files on small frames."""

import csv
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from addrloom.functions import datasets
from addrloom.operators import backfill, extract, orphans, range_audit
from addrloom.sources import files

SRC = "identity_key string, lo_num bigint, hi_num bigint, lo_num_suf string, hi_num_suf string, number string, street string, muni string, cls string, address_full string"


def source(spark, n=300, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lo = rnd.choice([None, *range(1, 12)])
        hi = None if lo is None else rnd.choice([None, lo, lo + 1, lo + 2, lo + 4, lo + 150, lo - 2])
        rows.append((str(i), lo, hi, rnd.choice(["None", None, "A"]), rnd.choice(["None", "", "B"]), rnd.choice([None, " ", str(lo), f"{lo}a"]), rnd.choice(["Oak St", "Elm Ave W", "", None]), rnd.choice(["M", "N", None]), rnd.choice(["Land", None]), rnd.choice(["1-3 Oak", "1–3 Oak", "x", None])))
    return rows, spark.createDataFrame(rows, SRC)


def numbers(lo, hi):
    return list(range(lo, hi + 1, 2 if lo % 2 == hi % 2 else 1))


def test_audit_counts_by_brute_force(spark):
    rows, s = source(spark)
    got = {(r.section, r.item): r.n for r in range_audit.audit_counts(s).collect()}
    ranges = [r for r in rows if r[1] is not None and r[2] is not None and r[1] != r[2]]
    clean = lambda v: v if v not in (None, "None") else ""
    assert got["rows", "active"] == len(rows) and got["rows", "range"] == len(ranges)
    assert got["rows", "reversed"] == sum(r[1] > r[2] for r in ranges)
    assert got["rows", "suffix_only"] == sum(r[1] is not None and r[1] == r[2] and clean(r[3]) != clean(r[4]) for r in rows)
    assert got["class", "?"] == sum(r[8] is None for r in ranges) and got["form", "numeric"] == sum(not clean(r[3]) and not clean(r[4]) for r in ranges)
    assert got["span", "3-10"] == sum(r[2] - r[1] not in (1, 2) and r[2] - r[1] <= 10 for r in ranges)
    assert got["parity", "mixed"] == sum((r[1] + r[2]) % 2 for r in ranges) and got["dash", "–"] == sum(r[9] == "1–3 Oak" for r in ranges)
    assert range_audit.audit_counts(s.limit(0)).count() == 0


def test_sibling_cover_by_brute_force(spark):
    rows, s = source(spark)
    singles = {(r[6], r[7], r[1]) for r in rows if r[1] is not None and r[1] == r[2] and r[6]}
    want = {}
    for r in rows:
        if r[1] is not None and r[2] is not None and r[1] != r[2]:
            n = numbers(r[1], r[2])
            hits = sum((r[6], r[7], x) in singles for x in n)
            want[r[0]] = (hits, len(n), "none" if not hits else "full" if hits == len(n) else "partial")
    assert {r.identity_key: (r.present, r.expected, r.cover) for r in range_audit.sibling_cover(s).collect()} == want


def test_feature_cover_prefers_the_long_name(spark):
    s = spark.createDataFrame([("a", 1, 5, "Oak St"), ("b", 1, 3, "Elm Ave"), ("c", 7, 5, "Oak St"), ("d", 1, 3, None)], "identity_key string, lo_num bigint, hi_num bigint, street string")
    f = spark.createDataFrame([("1-3;9", "Oak Street"), ("5", "Oak St"), ("3b, x", "Elm Ave"), ("1-900", "Elm Ave"), (None, "Elm Ave")], "housenumber string, street string")
    got = {r.identity_key: (r.present, r.expected, r.cover) for r in range_audit.feature_cover(s, f).collect()}
    assert got == {"a": (2, 3, "partial"), "b": (1, 2, "partial"), "c": (0, 0, "none"), "d": (0, 2, "none")}


def test_source_index_by_brute_force(spark):
    rows, s = source(spark)
    want = {}
    name = {"Oak St": "OAK ST", "Elm Ave W": "ELM AVE W"}
    clean = lambda v: v.strip() if v not in (None, "None") else ""
    for r in rows:
        if r[6]:
            written = (r[5] or "").strip().upper()
            if r[1] is not None and r[2] is not None and r[1] != r[2] and not clean(r[3]) and not clean(r[4]):
                keys = [str(n) for n in numbers(r[1], r[2])]
            else:
                keys = ([written] + ([str(r[1])] if r[1] is not None and r[1] == r[2] and not clean(r[3]) else [])) if written else []
            for k in keys:
                want[name[r[6]], k] = want.get((name[r[6]], k), 0) + 1
    assert {(r.street_norm, r.token): r.n_rows for r in orphans.listed(orphans.source_index(s)).collect()} == want


def swept(spark):
    t = "osm_id bigint, osm_type string, is_poi boolean, street_norm string, housenumber string, street string, lat double, lon double, tags map<string,string>"
    rows = [(1, "node", False, "OAK ST", "1;3", "Oak St", 0.5, 0.5, {}), (2, "node", False, "OAK ST", "9;1;7", "Oak St", 0.5, 0.5, {"entrance": "main", "name": "N"}), (3, "node", False, "", "4", None, 0.5, 0.5, {}),
            (4, "node", False, "OAK ST", "1", "Oak St", 5.0, 5.0, {}), (5, "node", True, "OAK ST", "8", "Oak St", 0.5, 0.5, {}), (6, "way", False, "", "8", " ", 0.5, 0.5, {"building": "house"}), (7, "relation", False, "", "8", None, None, None, {}), (8, "way", False, "OAK ST", "8", "Oak St", 0.5, 0.5, {})]
    f = spark.createDataFrame(rows, t)
    index = spark.createDataFrame([("OAK ST", "1", 2, None, None, None, None), ("OAK ST", None, 1, 2, 1, 0, 1)], "street_norm string, token string, n_rows bigint, step int, parity int, level int, node bigint")  # 3 by a range
    inside = (F.col("lat") < 1) & (F.col("lon") < 1)
    return orphans.node_rows(f, index, inside), orphans.no_street_polygons(f, inside)


def test_orphans(spark, tmp_path):
    nodes, polygons = swept(spark)
    got = {r.osm_id: (r.bucket, r.reason, r.missing_parts, r.matched_parts) for r in nodes.unionByName(polygons).collect()}
    assert got == {1: ("pure", "matched", "", "1;3"), 2: ("entrance", "missing_in_source", "9;7", "1"), 3: ("pure", "no_addr_street", "", ""), 4: ("pure", "outside", "", ""),
                   6: ("buildings_no_street", "no_addr_street_polygon", "", ""), 7: ("buildings_no_street", "outside", "", "")}
    assert {r.bucket: r[1:] for r in orphans.totals(nodes.unionByName(polygons)).collect()} == {"pure": (2, 1, 0, 1, 1), "entrance": (1, 0, 1, 0, 0), "buildings_no_street": (1, 0, 0, 1, 1)}
    assert [(r.label, r.n) for r in orphans.building_values(polygons).collect()] == [("house", 1)]
    files.write_csv(orphans.file_rows(nodes, polygons), f"file://{tmp_path}/o", ["bucket", "reason", "osm_id"])
    read = [r for p in sorted((tmp_path / "o").glob("part-*")) for r in csv.DictReader(p.open())]
    assert [r["osm_id"] for r in read] == ["6", "2", "3"] and tuple(read[0]) == orphans.COLUMNS and read[1]["missing_parts"] == "9;7" and read[2]["addr_street"] == ""


def test_routes(spark):
    c = spark.createDataFrame([(1, "a", "CHECKED"), (1, "b", "APPROVED"), (1, "c", "CHECKED"), (1, "d", "CHECKED"), (2, "e", "CHECKED"), (1, "f", None), (1, "g", "CHECKED")], "run_id int, candidate_id string, stage string")
    r = c.select("run_id", "candidate_id", F.lit("drift").alias("check_id"), F.lit(1).alias("version"), F.when(F.col("candidate_id") == "d", "PASS").when(F.col("candidate_id") == "g", "SKIP").otherwise("FLAG").alias("verdict"))
    items = spark.createDataFrame([(1, "c", "OPEN", "range,a"), (1, "f", "REJECTED", "x")], "run_id int, candidate_id string, status string, reason_code string")
    stored = spark.createDataFrame([(1, "a", "drift", 0)], "run_id int, candidate_id string, check_id string, version int")
    up = spark.createDataFrame([(2,)], "run_id int")
    got = {x.candidate_id: (x.route, x.reason_code) for x in backfill.route(backfill.fresh(r, stored), c, items, up).collect()}
    assert got == {"a": ("new", "drift"), "b": ("recorded_only", None), "c": ("merged", "a,drift,range"), "d": ("passed", None), "e": ("recorded_only", None), "f": ("recorded_only", None)}
    assert backfill.fresh(r, stored.withColumn("version", F.lit(1))).where("candidate_id = 'a'").count() == 0


def test_way_and_relation_boxes(spark):
    wn = spark.createDataFrame([(1, 11), (1, 12), (2, 13), (3, 99)], "way_id int, node_id int")
    nodes = spark.createDataFrame([(11, 1.0, 2.0), (12, 3.0, -4.0), (13, 9.0, 9.0), (14, None, 1.0)], "node_id int, lat double, lon double")
    b = extract.way_bounds(wn, nodes)
    got = {r.relation_id: (r.lat, r.lon, r.has_geometry) for r in extract.relation_bounds(spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "relation_id int, way_id int"), b).collect()}
    assert got == {7: (5.0, 2.5, True), 8: (None, None, False)}
    e = spark.createDataFrame([("way", 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), ("node", 0.0, 0.0, 0.0, 0.0, 1.0, 1.0), ("way", 1.5, 1.5, None, None, None, None), ("way", None, None, None, None, None, None)], "t string, lat double, lon double, a double, b double, c double, d double")
    assert [r.x for r in e.select(extract.touches(F.col("t"), F.col("lat"), F.col("lon"), tuple(F.col(x) for x in "abcd"), (1.0, 1.0, 2.0, 2.0)).alias("x")).collect()] == [True, False, True, False]


@pytest.mark.parametrize(("full", "number", "street"), [("5 Oak St, Twp", "5", "Oak St"), ("3 ALLISON LINE BLENHEIM TOWN", "3", "ALLISON LINE"), ("Oak", "", "Oak"), ("", "", ""), (None, "", ""), ("Town", "", "Town")])
def test_combined_texts(spark, full, number, street):
    places = F.array(F.lit("blenheim"), F.lit("Town"), F.lit(""))
    n, s = datasets.resolve(F.lit(None).cast("string"), F.col("f"), F.lit(None).cast("string"), [], places)
    assert tuple(spark.createDataFrame([(full,)], "f string").select(n, s).first()) == (number, street)


def test_files(spark, tmp_path):
    assert files.read_elements(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "e.json").write_text(json.dumps([{"type": "way", "id": 5, "center": {"lat": 1.5, "lon": 2}, "nodes": [1, 2], "tags": {"addr:housenumber": "7"}}, {"type": "node", "id": 6, "lat": 1, "lon": 2}]))
    got = files.read_elements(spark, f"file://{tmp_path}/e.json").orderBy("id").collect()
    assert [(r.type, r.id) for r in got] == [("way", 5), ("node", 6)] and got[0].center.lat == 1.5 and got[0].tags == {"addr:housenumber": "7"} and got[1].bounds is None
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "l.json").write_text(json.dumps({"features": [{"properties": {"AREA_NAME": "x"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square[:3]]]}}, {"properties": None, "geometry": None}]}))
    layer = files.read_layer(spark, f"file://{tmp_path}/l.json").orderBy("polygon_id").collect()
    assert [(r.polygon_id, len(r.ring)) for r in layer] == [("0-0", 3), ("1-0", 3), ("1-1", 3)] and json.loads(layer[0].props) == {"AREA_NAME": "x"}
    (tmp_path / "t.json").write_text(json.dumps({"tiles": [{"id": "a", "name": "A", "bbox": [1, 2, 3, 4], "count": 9}]}))
    assert tuple(files.read_tiles(spark, f"file://{tmp_path}/t.json").first()) == ("a", "A", 1.0, 2.0, 3.0, 4.0, 9)
    files.write_json(spark.createDataFrame([("a", None)], "id string, n int"), f"file://{tmp_path}/out")
    assert [json.loads(x) for p in Path(tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()] == [{"id": "a", "n": None}]
