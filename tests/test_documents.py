"""JSON documents written by many tasks: order, sidecar, failure, empty lists."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from addrloom.sources import document, files


def test_document_is_one_file_in_order(spark, tmp_path):
    a = spark.range(5000).select("id", F.concat(F.lit('"é\n'), "id").alias("text"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("gap")).repartition(7).orderBy(F.desc("id"))
    b = spark.range(0).select("id")
    path = tmp_path / "x.json"
    document.write_document({"a": a, "b": b, "c": spark.range(1)}, f"file://{path}", {"version": 1, "né": [None]}, {"snapshot": 7})
    d = json.loads(path.read_text())
    assert list(d) == ["version", "né", "a", "b", "c"] and d["né"] == [None] and d["b"] == [] and d["c"] == [{"id": 0}]
    assert d["a"] == [{"id": i, "text": f'"é\n{i}', "gap": i if i % 3 else None} for i in range(4999, -1, -1)]
    meta = json.loads((tmp_path / "x.json.meta.json").read_text())
    assert meta == {"snapshot": 7, "rows": {"a": 5000, "b": 0, "c": 1}, "bytes": len(path.read_bytes()), "sha256": hashlib.sha256(path.read_bytes()).hexdigest()}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.json", "x.json.meta.json"]


def test_failed_job_leaves_nothing(spark, tmp_path):
    path = tmp_path / "y.json"
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        document.write_document({"a": bad}, f"file://{path}")
    assert list(tmp_path.iterdir()) == []
    document.write_document({"a": spark.range(3)}, f"file://{path}")
    document.write_document({"a": spark.range(4)}, f"file://{path}")  # takes the place of the first
    assert len(json.loads(path.read_text())["a"]) == 4


def test_streets_and_tiles_come_back(spark, tmp_path):
    rows = [("A ST", 3, 0, "A St", None, "missing"), ("B ST", 9, 0, "B St", None, "missing"), ("C ST", 0, 2, None, "C Street", "extra"), ("D ST", 3, 0, "D", None, "missing")]
    streets = spark.createDataFrame(rows, "street_norm string, n_source bigint, n_osm bigint, source_name string, osm_name string, kind string")
    path = f"file://{tmp_path}/streets.json"
    document.write_streets(streets, path)
    assert json.loads((tmp_path / "streets.json").read_text())["totals"] == {"source_streets": 3, "osm_streets": 1, "missing": 3, "extra": 1, "matched": 0}
    assert [(r.kind, r.place, r.of_kind, r.street_norm, r.osm_name) for r in files.read_streets(spark, path).orderBy("kind", "place").collect()] == [("extra", 1, 1, "C ST", "C Street"), ("missing", 1, 3, "B ST", None), ("missing", 2, 3, "A ST", None), ("missing", 3, 3, "D ST", None)]
    tiles = spark.createDataFrame([("b", "B", [1.0, 2.0, 3.0, 4.0], 7), ("a", "A", [0.0, 0.0, 1.0, 1.0], 9)], "id string, name string, bbox array<double>, count bigint")
    path = f"file://{tmp_path}/tiles.json"
    document.write_tiles(tiles, spark.sql("SELECT 2 AS tile_count"), path, 500, 104)
    assert [(r.id, r.max_lat, r["count"]) for r in files.read_tiles(spark, path).collect()] == [("a", 1.0, 9), ("b", 3.0, 7)]
    assert json.loads((tmp_path / "tiles.json.meta.json").read_text())["tile_count"] == 2


def test_a_document_is_read_in_spans(spark, tmp_path):
    path = f"file://{tmp_path}/e.json"
    rows = spark.range(500).select(F.lit("node").alias("type"), "id", F.create_map(F.lit("name"), F.concat(F.lit('],"\n{é,'), "id")).alias("tags")).repartition(3).orderBy("id")
    document.write_document({"none": spark.range(0), "elements": rows, "more": spark.range(7)}, path, {"version": 1})
    for size in (499, 1000, 1 << 20):
        lines = spark.read.format("json_document").options(path=path, partitionBytes=size).load()
        text = (tmp_path / "e.json").read_bytes()
        assert "".join(f"{r.line}\n" for r in lines.orderBy("at").collect()).encode() == text
    found = files.read_elements(spark, path, "elements")
    assert {(r.type, r.id, r.tags["name"]) for r in found.collect()} == {("node", i, f'],"\n{{é,{i}') for i in range(500)}
    assert files.read_elements(spark, path, "none").count() == 0 and files.read_elements(spark, path, "more").count() == 7
    (tmp_path / "e.json.meta.json").unlink()  # not known to be of the writer: by one task
    assert files.read_elements(spark, path, "elements").count() == 500
