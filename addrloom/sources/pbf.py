"""Map extracts in PBF as a Spark data source: read by ranges of blobs, written a file for each task.

A file is a row of blobs, each compressed on its own: the driver walks their heads, tasks decode them. Numbers are packed
as variable-length integers, most of them as differences; they are decoded in numpy, a field at a time.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from addrloom.functions.geo import in_box
from addrloom.operators.extract import SIDES, relation_bounds, touches, way_bounds

#: at: where the element's blob begins in its file; error: what is wrong with a blob, in a row of its own.
SCHEMA = "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, members array<struct<kind:string,ref:bigint,role:string>>, file string, at bigint, error string"
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())),
                    ("members", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))), ("file", pa.string()), ("at", pa.int64()), ("error", pa.string())])
# Fixed values of the format: wire numbers of the fields used, kinds of members, the largest head and blob, units of a degree.
KINDS = ("node", "way", "relation")
MAX_HEAD, MAX_BLOB, UNITS = 64 * 1024, 32 * 1024 * 1024, 10_000_000
#: Bytes of blobs in a partition; elements in a written blob.
PARTITION, BLOCK = 32 * 1024 * 1024, 8000


def varints(data: bytes | memoryview) -> np.ndarray:
    """All variable-length integers of a packed field, unsigned."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    if not len(last) or last[-1] != len(b) - 1:
        raise ValueError("a number is cut off")
    first = np.concatenate(([0], last[:-1] + 1))
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max()) + 1):
        more = first + k <= last
        out[more] |= (b[first[more] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def unzigzag(n: np.ndarray) -> np.ndarray:
    return (n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64)


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a message: an integer, or the bytes of a nested one."""
    at, end = 0, len(data)

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < end:
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        elif key & 7 == 2:
            n = number()
            if at + n > end:
                raise ValueError("a field is cut off")
            yield key >> 3, data[at : at + n]
            at += n
        elif key & 7 in (1, 5):
            at += 8 if key & 7 == 1 else 4
        else:
            raise ValueError(f"wire type {key & 7}")


def unpack(blob: memoryview) -> memoryview:
    parts = dict(fields(blob))
    if 1 in parts:
        return memoryview(parts[1])
    if 3 not in parts:
        raise ValueError("a blob that is neither raw nor zlib")
    if parts.get(2, MAX_BLOB) > MAX_BLOB:
        raise ValueError("a blob of more than 32 MB")
    press = zlib.decompressobj()
    data = press.decompress(parts[3], MAX_BLOB)
    if not press.eof or len(data) != parts.get(2, len(data)):
        raise ValueError("a blob of another size than it says")
    return memoryview(data)


def elements(block: memoryview, kinds: set[str]) -> Iterator[tuple]:
    """(kind, id, lat, lon, tags, refs, members) of a block; groups of other kinds aren't decoded."""
    texts: list[str] = []
    groups, parts = [], {17: 100, 19: 0, 20: 0}
    for k, v in fields(block):
        if k == 1:
            texts = [bytes(s).decode("utf-8", "replace") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        else:
            parts[k] = v
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    place = lambda n, k: 1e-9 * (signed(parts[k]) + parts[17] * n)
    tags = lambda m: [(texts[a], texts[b]) for a, b in zip(varints(m.get(2, b"")), varints(m.get(3, b"")))]
    for g in groups:
        for k, v in fields(g):
            if k == 1 and "node" in kinds:
                m = dict(fields(v))
                one = lambda n: (n >> 1) ^ -(n & 1)
                yield "node", one(m[1]), place(one(m[8]), 19), place(one(m[9]), 20), tags(m), None, None
            elif k == 2 and "node" in kinds:
                m = dict(fields(v))
                ids, lats, lons = (np.cumsum(unzigzag(varints(m.get(f, b"")))) for f in (1, 8, 9))
                pairs, at = varints(m.get(10, b"")).tolist(), 0
                for i, lat, lon in zip(ids.tolist(), place(lats, 19).tolist(), place(lons, 20).tolist()):
                    found = []
                    while at < len(pairs) and pairs[at]:
                        found.append((texts[pairs[at]], texts[pairs[at + 1]]))
                        at += 2
                    at += 1
                    yield "node", i, lat, lon, found, None, None
            elif k == 3 and "way" in kinds:
                m = dict(fields(v))
                yield "way", signed(m[1]), None, None, tags(m), np.cumsum(unzigzag(varints(m.get(8, b"")))).tolist(), None
            elif k == 4 and "relation" in kinds:
                m = dict(fields(v))
                refs = np.cumsum(unzigzag(varints(m.get(9, b"")))).tolist()
                members = [{"kind": KINDS[t], "ref": r, "role": texts[s]} for s, r, t in zip(varints(m.get(8, b"")), refs, varints(m.get(10, b"")))]
                yield "relation", signed(m[1]), None, None, tags(m), None, members


def pack(n: list[int], zigzag: bool = False, delta: bool = False) -> bytes:
    out, before = bytearray(), 0
    for v in n:
        v, before = (v - before if delta else v), v
        v = (v << 1) ^ (v >> 63) if zigzag else v & (1 << 64) - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return pack([number << 3]) + pack([value])
    return pack([number << 3 | 2]) + pack([len(value)]) + value


def blob(kind: str, data: bytes) -> bytes:
    body = field(2, len(data)) + field(3, zlib.compress(data))
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def block_of(rows: list[dict]) -> bytes:
    """A block of elements of one kind."""
    texts: dict[str, int] = {"": 0}
    of = lambda s: texts.setdefault(s, len(texts))
    pairs = lambda r: [(of(k), of(v)) for k, v in r["tags"] or ()]
    group = b""
    if rows[0]["kind"] == "node":
        unit = lambda c: [round(r[c] * UNITS) for r in rows]
        group = field(1, pack([r["id"] for r in rows], True, True)) + field(8, pack(unit("lat"), True, True)) + field(9, pack(unit("lon"), True, True))
        group = field(2, group + field(10, pack([n for r in rows for n in (*(x for p in pairs(r) for x in p), 0)])))
    else:
        for r in rows:
            found = pairs(r)
            m = field(1, r["id"]) + field(2, pack([k for k, _ in found])) + field(3, pack([v for _, v in found]))
            if r["kind"] == "way":
                group += field(3, m + field(8, pack(r["refs"] or [], True, True)))
            else:
                members = r["members"] or []
                group += field(4, m + field(8, pack([of(x["role"] or "") for x in members])) + field(9, pack([x["ref"] for x in members], True, True)) + field(10, pack([KINDS.index(x["kind"]) for x in members])))
    return field(1, b"".join(field(1, t.encode()) for t in texts)) + field(2, group)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that pyarrow knows, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:/") else "file://" + path[5:])


@dataclass
class Blobs(InputPartition):
    path: str
    spans: list[tuple[int, int, int]]  # where a blob's head begins, where its body begins, and how long that is
    wrong: tuple[int, str] | None = None


def walk(path: str, size: int = PARTITION) -> Iterator[Blobs]:
    """Blobs of a file in partitions of ``size`` bytes; only heads are read. What follows a broken head can't be found: it is named."""
    system, local = opened(path)
    with system.open_input_file(local) as f:
        at, end, spans, held = 0, f.size(), [], 0
        while at < end:
            try:
                f.seek(at)
                head = f.read(4)
                n = struct.unpack(">I", head)[0] if len(head) == 4 else MAX_HEAD + 1
                if n > MAX_HEAD or len(data := f.read(n)) < n:
                    raise ValueError("no blob begins here")
                parts = dict(fields(memoryview(data)))
                length = parts[3]
                if at + 4 + n + length > end:
                    raise ValueError("the file ends within a blob")
            except (ValueError, KeyError, IndexError) as e:
                yield Blobs(path, spans, (at, str(e)))
                return
            if bytes(parts[1]) == b"OSMData":
                spans.append((at, at + 4 + n, length))
                held += length
            at += 4 + n + length
            if held >= size:
                yield Blobs(path, spans)
                spans, held = [], 0
        if spans:
            yield Blobs(path, spans)


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION))
        self.kinds = set(options.get("kinds", ",".join(KINDS)).split(","))

    def partitions(self) -> list[Blobs]:
        system, local = opened(self.path)
        if system.get_file_info(local).type != fs.FileType.Directory:
            return list(walk(self.path, self.size)) or [Blobs(self.path, [])]
        names = sorted(x.base_name for x in system.get_file_info(fs.FileSelector(local)) if x.base_name.endswith(".pbf"))
        return [p for n in names for p in walk(f"{self.path.rstrip('/')}/{n}", self.size)] or [Blobs(self.path, [])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        batch = lambda rows, at: pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, (*r, partition.path, at, None))) for r in rows], schema=_ARROW)
        error = lambda at, e: pa.RecordBatch.from_pylist([{"file": partition.path, "at": at, "error": str(e)}], schema=_ARROW)
        if partition.spans:
            system, local = opened(partition.path)
            with system.open_input_file(local) as f:
                for at, body, n in partition.spans:
                    try:
                        f.seek(body)
                        rows = list(elements(unpack(memoryview(f.read(n))), self.kinds))
                    except (ValueError, KeyError, IndexError, zlib.error) as e:
                        yield error(at, e)
                        continue
                    for lo in range(0, len(rows), 2048):
                        yield batch(rows[lo : lo + 2048], at)
        if partition.wrong:
            yield error(*partition.wrong)


@dataclass
class Written(WriterCommitMessage):
    name: str


class PbfWriter(DataSourceArrowWriter):
    """A file for each task, under another name until the job commits; files of failed or repeated attempts go."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, local = opened(self.path)
        system.create_dir(local, recursive=True)
        name = f".{self.job}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{local}/{name}") as f:
            f.write(blob("OSMHeader", field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes") + field(16, b"addrloom")))
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK):
                    rows = b.slice(lo, BLOCK).to_pylist()
                    for kind in KINDS:
                        if some := [r for r in rows if r["kind"] == kind]:
                            f.write(blob("OSMData", block_of(some)))
        return Written(name)

    def _files(self) -> tuple[fs.FileSystem, str, list[str]]:
        system, local = opened(self.path)
        found = system.get_file_info(fs.FileSelector(local, allow_not_found=True))
        return system, local, [x.base_name for x in found if x.base_name.startswith(f".{self.job}-")]

    def commit(self, messages: list[Written | None]) -> None:
        system, local, there = self._files()
        done = [m.name for m in messages if m]
        for k, name in enumerate(done):
            system.move(f"{local}/{name}", f"{local}/part-{k:05}-{self.job}.osm.pbf")
        for name in set(there) - set(done):
            system.delete_file(f"{local}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        system, local, there = self._files()
        for name in there:
            system.delete_file(f"{local}/{name}")


class PbfSource(DataSource):
    """Format "osm_pbf". Options: path (a file or a folder), kinds (node,way,relation), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options)

    def writer(self, schema, overwrite: bool) -> PbfWriter:
        return PbfWriter(self.options)


def read_pbf(spark: SparkSession, path: str, *kinds: str, partition_bytes: int = PARTITION) -> DataFrame:
    """Elements of a PBF file or folder of files; ``kinds``: only these are decoded."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").options(path=path, kinds=",".join(kinds or KINDS), partitionBytes=partition_bytes).load()


def write_pbf(rows: DataFrame, path: str) -> None:
    """Writes elements (kind, id, lat, lon, tags, refs, members) to a folder of PBF files."""
    rows.sparkSession.dataSource.register(PbfSource)
    cols = [f.split(" ", 1) for f in SCHEMA.split(", ")]
    rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in cols]).write.format("osm_pbf").mode("append").save(path)


def tagged(key: str) -> Column:
    return F.coalesce(F.map_contains_key("tags", key), F.lit(False))


def address_elements(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """The elements of an extract with a house number or an interpolation in ``box`` (south, west, north, east), and counts.

    type, id, lat, lon (of nodes; of ways and multipolygon relations with a house number the middle of their box), the box, nodes (of
    ways), tags. First only relations are decoded; then ways, of which those with a number, an interpolation or as a
    member of such a relation go on; their nodes' places come from a join. Ways and relations count where their box meets ``box``.
    """
    from addrloom.plans.stage import materialize

    relations = read_pbf(spark, path, "relation").where(F.col("error").isNull() & tagged("addr:housenumber") & (F.try_element_at("tags", F.lit("type")) == "multipolygon"))
    relations = materialize(relations.select("id", "tags", F.expr("transform(filter(members, m -> m.kind = 'way'), m -> m.ref)").alias("ways")).where(F.size("ways") > 0), "relations")
    members = relations.select(F.col("id").alias("relation_id"), F.explode("ways").alias("way_id"))
    ways = read_pbf(spark, path, "way").where(F.col("error").isNull()).select("id", "tags", "refs").withColumns({"number": tagged("addr:housenumber"), "line": tagged("addr:interpolation")})
    asked = members.select(F.col("way_id").alias("id")).distinct().withColumn("member", F.lit(True))
    # Each way as it stands in the file: an id may occur more than once (merged extracts).
    ways = materialize(ways.join(asked, "id", "left").where("number OR line OR member").withColumn("way", F.monotonically_increasing_id()), "ways")
    nodes = read_pbf(spark, path, "node").where(F.col("error").isNull())
    # A place outside of the globe is none.
    located = nodes.where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
    sides = way_bounds(ways.select(F.col("way").alias("way_id"), F.explode("refs").alias("node_id")), located.select(F.col("id").alias("node_id"), "lat", "lon"))
    sides = materialize(sides, "way-bounds")

    here = in_box(F.col("lat"), F.col("lon"), box)
    none = F.lit(None).cast("double")
    n = located.where(tagged("addr:housenumber")).select(F.lit("node").alias("type"), "id", "lat", "lon", *[none.alias(s) for s in SIDES], F.lit(None).cast("array<bigint>").alias("nodes"), "tags", here.alias("_in"), F.lit("nodes").alias("_kind"))
    middle = lambda a, b, when: F.when(when, (F.col(a) + F.col(b)) / 2)
    meets = touches(F.lit("way"), none, none, tuple(F.col(s) for s in SIDES), box)
    w = ways.where("number OR line").join(sides, F.col("way") == F.col("way_id"))
    w = w.select(F.lit("way").alias("type"), "id", middle("minlat", "maxlat", F.col("number")).alias("lat"), middle("minlon", "maxlon", F.col("number")).alias("lon"), *SIDES, F.col("refs").alias("nodes"), "tags", meets.alias("_in"), F.when(F.col("number"), "ways").otherwise("interp_ways").alias("_kind"))
    of_members = ways.where("member").select("id", "way").join(sides, F.col("way") == F.col("way_id")).select(F.col("id").alias("way_id"), *SIDES)
    r = relations.join(relation_bounds(members, of_members), F.col("id") == F.col("relation_id"))
    r = r.select(F.lit("relation").alias("type"), "id", "lat", "lon", *SIDES, F.lit(None).cast("array<bigint>").alias("nodes"), "tags", F.when(F.col("has_geometry"), meets).alias("_in"), F.lit("relations").alias("_kind"))
    found = n.unionByName(w).unionByName(r)
    counts = found.groupBy(F.when(F.col("_in").isNull(), "relations_no_geometry").when(F.col("_in"), F.col("_kind")).otherwise("outside_bbox").alias("what")).agg(F.count("*").alias("n"))
    return found.where("_in").drop("_in", "_kind"), counts


def bad_blobs(spark: SparkSession, path: str) -> DataFrame:
    """file, at, error of the blobs that can't be read."""
    return read_pbf(spark, path).where("error IS NOT NULL").select("file", "at", "error")
