"""PBF extracts: numbers, round trips over several partitions and files, bad blobs, the address scan against a plain pass."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom.sources import pbf

ROWS = "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, members array<struct<kind:string,ref:bigint,role:string>>"


def test_numbers():
    rnd = random.Random(1)
    n = [rnd.choice([0, 1, -1, 127, 128, 2**40, -(2**62), 2**63 - 1, -(2**63), rnd.randrange(-(10**6), 10**6)]) for _ in range(500)]
    assert pbf.unzigzag(pbf.varints(pbf.pack(n, zigzag=True))).tolist() == n
    assert pbf.varints(pbf.pack([abs(x) for x in n])).tolist() == [abs(x) for x in n]
    near = [rnd.randrange(10**15) for _ in range(99)]
    assert np.cumsum(pbf.unzigzag(pbf.varints(pbf.pack(near, True, True)))).tolist() == near
    with pytest.raises(ValueError):
        pbf.varints(b"\x80")


def some_elements(rnd, n=700):
    tags = lambda: {k: rnd.choice(["x", "é<&", "12A", ""]) for k in rnd.sample(["addr:housenumber", "addr:interpolation", "name", "日本", "type"], rnd.randrange(4))}
    rows = [("node", i * 3 - 50, round(rnd.uniform(-90, 90), 7), round(rnd.uniform(-180, 180), 7), tags(), None, None) for i in range(n)]
    rows += [("way", i + 10**12, None, None, tags(), [rnd.randrange(-50, 3 * n) for _ in range(rnd.randrange(9))], None) for i in range(n // 4)]
    kinds = lambda: [{"kind": rnd.choice(pbf.KINDS), "ref": rnd.choice([rnd.randrange(n), 10**12 + rnd.randrange(n // 4)]), "role": rnd.choice(["outer", "inner", ""])} for _ in range(rnd.randrange(5))]
    return rows + [("relation", i, None, None, tags() | {"type": rnd.choice(["multipolygon", "site"])}, None, kinds()) for i in range(n // 5)]


def plain(r):
    return (r.kind, r.id, *(None if x is None else round(x * 1e7) for x in (r.lat, r.lon)), tuple(sorted(r.tags.items())), r.refs and tuple(r.refs), r.members and tuple((m.kind, m.ref, m.role) for m in r.members))


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('pbf')}/x"
    rows = some_elements(random.Random(2))
    frame = spark.createDataFrame(rows, ROWS)
    pbf.write_pbf(frame.repartition(3), path)
    return path, frame


def test_round_trip(spark, written):
    path, frame = written
    back = pbf.read_pbf(spark, path, partition_bytes=1500)
    empty = lambda r: (*r[:5], r[5] or None, r[6] or None)
    assert sorted(map(empty, map(plain, back.collect())), key=repr) == sorted(map(empty, map(plain, frame.collect())), key=repr)
    assert back.rdd.getNumPartitions() >= 6  # files of several blobs are read by several tasks
    assert {r.kind for r in pbf.read_pbf(spark, path, "way").select("kind").distinct().collect()} == {"way"}
    assert back.where("error IS NOT NULL").count() == 0


def test_bad_blobs_are_named(spark, written, tmp_path):
    path, _ = written
    local = path.removeprefix("file://")
    from pathlib import Path

    whole = sorted(Path(local).glob("*.pbf"))[0].read_bytes()
    spans = [s for p in pbf.walk(str(sorted(Path(local).glob("*.pbf"))[0])) for s in p.spans]
    broken = bytearray(whole)
    broken[spans[1][1] + 20] ^= 255
    (tmp_path / "a.pbf").write_bytes(broken)
    (tmp_path / "b.pbf").write_bytes(whole[: spans[-1][1] + 5])
    (tmp_path / "c.pbf").write_bytes(whole + b"\xff\xff\xff\xff rest")
    (tmp_path / "d.pbf").write_bytes(b"")
    got = {(r.file.rpartition("/")[2], r.at): r.error for r in pbf.bad_blobs(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {("a.pbf", spans[1][0]), ("b.pbf", spans[-1][0]), ("c.pbf", len(whole))}
    good = lambda name: pbf.read_pbf(spark, f"file://{tmp_path}/{name}").where("error IS NULL").count()
    assert good("c.pbf") > good("a.pbf") > 0 and good("b.pbf") > 0 and good("d.pbf") == 0


def test_single_nodes_raw_blobs_and_offsets():
    node = pbf.field(1, pbf.pack([7], True)[0]) + pbf.field(2, pbf.pack([1])) + pbf.field(3, pbf.pack([2])) + pbf.field(8, pbf.varints(pbf.pack([-5], True)).tolist()[0]) + pbf.field(9, 40)
    block = pbf.field(1, pbf.field(1, b"") + pbf.field(1, b"k") + pbf.field(1, b"v")) + pbf.field(2, pbf.field(1, node)) + pbf.field(17, 1000) + pbf.field(19, 10**9) + pbf.field(20, 3 * 10**9)
    got = list(pbf.elements(pbf.unpack(memoryview(pbf.field(1, block))), {"node"}))
    assert got == [("node", 7, pytest.approx(1 - 5e-6), pytest.approx(3 + 2e-5), [("k", "v")], None, None)]
    with pytest.raises(ValueError):
        pbf.unpack(memoryview(pbf.field(2, 5) + pbf.field(3, zlib.compress(b"longer"))))
    with pytest.raises(ValueError):
        pbf.unpack(memoryview(pbf.field(4, b"lzma")))


def scanned(rows, box):
    """The same in one pass over lists."""
    inside = lambda a, b, c, d: a <= box[2] and c >= box[0] and b <= box[3] and d >= box[1]
    at = {r[1]: (r[2], r[3]) for r in rows if r[0] == "node"}
    sides, out, counts = {}, {}, dict.fromkeys(["nodes", "ways", "interp_ways", "relations", "relations_no_geometry", "outside_bbox"], 0)
    for kind, i, lat, lon, tags, refs, _ in rows:
        if kind == "node" and "addr:housenumber" in tags:
            ok = inside(lat, lon, lat, lon)
            counts["nodes" if ok else "outside_bbox"] += 1
            if ok:
                out["node", i] = (lat, lon)
        if kind == "way" and (p := [at[x] for x in refs if x in at]):
            sides[i] = (min(x[0] for x in p), min(x[1] for x in p), max(x[0] for x in p), max(x[1] for x in p))
            if "addr:housenumber" in tags or "addr:interpolation" in tags:
                what = "ways" if "addr:housenumber" in tags else "interp_ways"
                counts[what if inside(*sides[i]) else "outside_bbox"] += 1
                if inside(*sides[i]):
                    out["way", i] = ((sides[i][0] + sides[i][2]) / 2, (sides[i][1] + sides[i][3]) / 2) if what == "ways" else None
    for kind, i, _, _, tags, _, members in rows:
        if kind == "relation" and "addr:housenumber" in tags and tags["type"] == "multipolygon" and any(m["kind"] == "way" for m in members):
            s = [sides[m["ref"]] for m in members if m["kind"] == "way" and m["ref"] in sides]
            if not s:
                counts["relations_no_geometry"] += 1
                continue
            b = (min(x[0] for x in s), min(x[1] for x in s), max(x[2] for x in s), max(x[3] for x in s))
            counts["relations" if inside(*b) else "outside_bbox"] += 1
            if inside(*b):
                out["relation", i] = ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    return out, counts


def test_address_scan(spark, tmp_path):
    rows = some_elements(random.Random(8), 1500)
    path = f"file://{tmp_path}/scan"
    pbf.write_pbf(spark.createDataFrame(rows, ROWS).repartition(2), path)
    box = (-30.0, -60.0, 20.0, 50.0)
    found, counts = pbf.address_elements(spark, path, box)
    want, numbers = scanned(rows, box)
    got = {(r.type, r.id): None if r.lat is None else (r.lat, r.lon) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == (None if v is None else pytest.approx(v, abs=1e-6)) for k, v in want.items())
    assert {r.what: r.n for r in counts.collect()} == {k: v for k, v in numbers.items() if v}
    assert found.where(F.col("type") == "way").where("size(nodes) > 0 AND minlat <= maxlat").count() == sum(k[0] == "way" for k in want)
