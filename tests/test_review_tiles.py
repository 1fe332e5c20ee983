"""Review, maintenance, tiles and map files on small frames."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from addrloom.functions import mapxml
from addrloom.operators import maintenance, profile, review
from addrloom.plans import tiling


def test_queue_order_and_pages(spark):
    c = spark.createDataFrame([(1, k, "A", "MISSING", None, None, "Land", "APPROVED", t) for k, t in (("1", "t5"), ("2", "t1"), ("10", "t1"), ("3", "t9"))], "run_id int, candidate_id string, address_full string, verdict string, poi_id bigint, proposed_postcode string, cls string, stage string, stage_updated_at string")
    items = spark.createDataFrame([(1, "3", "range,match_far", "OPEN", None), (1, "1", "match_farther", "OPEN", "t5")], "run_id int, candidate_id string, reason_code string, status string, opened_at string")
    ids = lambda df: [r.candidate_id for r in df.orderBy("position").collect()]
    assert ids(review.queue(c, items, auto=True)) == ["3", "2", "10", "1"]
    assert ids(review.queue(c, items, auto=True, offset=1, limit=2)) == ["2", "10"]
    assert ids(review.queue(c, items, auto=True, reasons=("match_far",))) == ["3"]
    assert ids(review.queue(c, items, postcode=True)) == [] and ids(review.queue(c, items, door_only=True)) == []
    assert ids(review.queue(c, items.limit(0), auto=True)) == ["2", "10", "1", "3"]


def test_view_is_clamped():
    assert review.clamp((0.0, 0.0, 0.02, 0.02)) == (0.0, 0.0, 0.02, 0.02)
    assert review.clamp((0.0, 0.0, 1.0, 0.02)) == pytest.approx((0.485, -0.005, 0.515, 0.025))


def test_lines_take_the_street_of_the_way_then_of_an_end(spark):
    ways = spark.createDataFrame([(1, "Own St", 11, 12), (2, "", 11, 12), (3, None, 13, 99)], "osm_id bigint, street string, n1 bigint, n2 bigint")
    nodes = spark.createDataFrame([(11, "node", "", 1.0, 2.0), (12, "node", "End Rd", 3.0, 4.0), (13, "node", None, 0.0, 0.0), (99, "way", "X", 0.0, 0.0)], "osm_id bigint, osm_type string, street string, lat double, lon double")
    got = {r.osm_id: (r.street, r.streets, r.n_ends) for r in review.interpolation_lines(ways, nodes).collect()}
    assert got == {1: ("Own St", ["END RD", "OWN ST"], 2), 2: ("End Rd", ["END RD"], 2), 3: (None, [], 1)}


def test_provenance(spark):
    rows = [(1, 1, "us", True, False, 1), (2, 1, "us", True, False, 1), (2, 2, "x", True, False, 2), (3, 1, "x", True, False, 1), (3, 2, "us", True, False, 1), (4, 1, "us", True, True, None), (5, 1, None, True, False, 1), (5, 2, "us", False, False, None)]
    v = spark.createDataFrame(rows, "element_id int, version int, editor string, visible boolean, is_feature boolean, geometry int")
    got = {r.element_id: (r.verdict, r.n_community_edits, r.geometry_changed) for r in maintenance.provenance(v, ("us",)).collect()}
    assert got == {1: ("pristine_ours", 0, False), 2: ("community_touched", 1, True), 3: ("community_node", 0, False), 4: ("keep_feature", 0, False), 5: ("already_deleted", 0, True)}


def test_retired_points_without_history_ask_for_care(spark):
    r = spark.createDataFrame([("a", "5", "K ST", 43.6, -79.6), ("b", "6", "K ST", 43.6, -79.6), ("c", "7", "K ST", 43.6, -79.6), ("d", None, "K ST", 43.6, -79.6)], "candidate_id string, housenumber string, street_norm string, lat double, lon double")
    f = spark.createDataFrame([(1, "5", "K ST", 43.6, -79.6), (2, "5", "K ST", 43.6, -79.6), (3, "6", "K ST", 43.6, -79.6), (4, "7", "K ST", 44.6, -79.6)], "osm_id bigint, num string, street_norm string, lat double, lon double")
    known = spark.createDataFrame([(1, "pristine_ours", False), (3, "keep_feature", True)], "osm_id bigint, verdict string, is_feature boolean")
    got = {x.candidate_id: (x.matches, x.verdict, x.summary) for x in maintenance.retirements(r, f, known, 100.0).collect()}
    assert got == {"a": (2, "unknown", "caution"), "b": (1, "keep_feature", "feature"), "c": (0, "no_match", "no_match"), "d": (0, "no_match", "no_match")}


def test_gate():
    assert not maintenance.lagging(None, None) and maintenance.lagging("2026-01-01", None) and not maintenance.lagging("2026-01-01T05", "2026-01-01")
    with pytest.raises(ValueError):
        maintenance.advance(5, 10, "2026-02-01", "2026-01-01")
    assert maintenance.advance(5, 10, "2026-02-01", "2026-01-01", force=True) == 10


def test_singles_in_ranges_by_brute_force(spark):
    rnd = random.Random(4)
    r = [(rnd.choice(["m", None]), rnd.choice("AB"), rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(12)]
    s = [(rnd.choice(["m", None]), rnd.choice("AB"), rnd.choice([None, rnd.randint(0, 60)]), None) for _ in range(120)]
    schema = "muni string, street_norm string, lo_num int, hi_num int"
    got = {x.muni: (x.singles, x.inside) for x in profile.singles_in_ranges(spark.createDataFrame(r, schema), spark.createDataFrame(s, schema)).collect()}
    for m in ("m", None):
        mine = [x for x in s if x[0] == m and x[2] is not None]
        assert got[m] == (len(mine), sum(any(q[:2] == x[:2] and min(q[2:]) <= x[2] <= max(q[2:]) for q in r) for x in mine))


def test_polygons_by_brute_force(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(0, 0.05), rnd.uniform(0, 0.05)) for i in range(200)] + [(900, 0.0, 0.0), (901, 0.0, 0.01)]
    ring = [(0.0, 0.0), (0.04, 0.01), (0.03, 0.05), (0.02, 0.02)]
    p = spark.createDataFrame([("t", [{"x": x, "y": y} for x, y in ring])], "polygon_id string, ring array<struct<x double, y double>>")
    d = spark.createDataFrame(pts, "id int, lon double, lat double")

    def inside(x, y):
        n = 0
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            n += (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0
        return n % 2 == 1

    want = {i for i, x, y in pts if inside(x, y)} - {900}
    assert {r.id for r in tiling.in_polygons(d, p).collect()} == want
    assert {r.id for r in tiling.outside(d, p, "id").collect()} == {i for i, *_ in pts} - want


def test_names(spark):
    rows = [(1, '{"AREA_NAME": "Park", "COMMUNITY": "East"}'), (2, '{"name": " Park ", "COMMUNITY": "PARK"}'), (3, '{"AREA_NAME": "Hill", "COMMUNITY": "East"}'), (4, '{"_id": 7}'), (5, None)]
    a = spark.createDataFrame(rows, "fid int, props string")
    assert {r.fid: r.name for r in tiling.area_names(a).collect()} == {1: "East Park", 2: "Park", 3: "Hill", 4: "neighbourhood-7", 5: "neighbourhood-?"}
    assert {r.fid: r.name for r in tiling.area_names(a.where("fid in (1, 3)"), "AREA_NAME", "COMMUNITY").collect()} == {1: "East Park", 3: "East Hill"}
    with pytest.raises(Exception, match="declared but empty"):
        tiling.area_names(a, "AREA_NAME").collect()


def test_files_are_xml(spark):
    rows = [(1, "7", None, 43.6, -79.5, " 5 ", 'A & "B" <St>\n', None), (1, "8", -2, 43.6, -79.5, "", "B", "M5V"), (1, "9", None, None, -79.5, "1", "B", None)]
    d = spark.createDataFrame(rows, "run_id int, candidate_id string, local_node_id bigint, lat double, lon double, hn string, st string, pc string").withColumn("tags", mapxml.upload_tags(F.col("hn"), F.col("st"), F.col("pc"), "Src"))
    for changeset in (None, 9):
        text = "".join(r.line for r in mapxml.document(d, changeset).orderBy("part", F.desc("local_id")).collect())
        nodes = ET.fromstring(text).findall(".//node")
        assert [n.get("id") for n in nodes] == ["-2", "-7"] and nodes[0].get("lat") == "43.6000000" and nodes[0].get("changeset") == (changeset and "9")
        assert [{t.get("k"): t.get("v") for t in n} for n in nodes] == [{"addr:street": "B", "source": "Src", "addr:postcode": "M5V"}, {"addr:housenumber": "5", "addr:street": 'A & "B" <St>\n', "source": "Src"}]
    with pytest.raises(ValueError):
        mapxml.upload_tags(F.col("hn"), F.col("st"), F.col("pc"), " ")


def test_referenced_nodes_are_kept(spark):
    el = spark.createDataFrame([("node", 1), ("node", 2), ("node", 3), ("way", 1), ("relation", 5)], "osm_type string, osm_id bigint")
    members = spark.createDataFrame([(1, 1), (1, 2), (8, 3)], "way_id bigint, node_id bigint")
    edited = spark.createDataFrame([("way", 1), ("node", 2), ("relation", 5), ("relation", 5)], el.schema)
    got = [(r.osm_type, r.osm_id, r.is_edited) for r in mapxml.keep_set(el, edited, members).orderBy("part", "osm_id").collect()]
    assert got == [("node", 1, False), ("node", 2, True), ("way", 1, True), ("relation", 5, True)]
