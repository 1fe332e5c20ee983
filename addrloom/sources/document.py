"""One JSON document from many tasks: each task writes its rows of each list, the commit joins them, and the file appears at once.

A document has plain fields, then lists, a list's rows in the order of the frame (a sorted one stays sorted). A sidecar beside
it names its size, digest and the length of each list. Until the commit there is no file, after a failed job none either;
rows that a task wrote more than once, in attempts, are taken from the attempt that Spark counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from addrloom.sources.pbf import opened

#: Bytes copied at a time when the parts are joined.
STEP = 1 << 20
#: Bytes of a document that a task reads.
PARTITION = 32 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    files: dict[str, str] = field(default_factory=dict)  # list: file
    rows: dict[str, int] = field(default_factory=dict)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.lists = options["path"], json.loads(options["lists"])
        self.head, self.meta = json.loads(options.get("head", "{}")), json.loads(options.get("meta", "{}"))
        system, local = opened(self.path)
        self.parts = f"{local}.parts-{uuid.uuid4().hex}"
        system.create_dir(self.parts, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        system, _ = opened(self.path)
        part = Part(TaskContext.get().partitionId())
        out: dict[str, pa.NativeFile] = {}
        for b in batches:
            for name, row in zip(b.column("list").to_pylist(), b.column("row").to_pylist()):
                if name not in out:
                    if name not in self.lists:
                        raise ValueError(f"{name!r} isn't a list of the document")
                    part.files[name] = f"{self.parts}/{uuid.uuid4().hex}"
                    out[name] = system.open_output_stream(part.files[name])
                    part.rows[name] = 0
                out[name].write((b",\n" if part.rows[name] else b"") + row.encode())
                part.rows[name] += 1
        for f in out.values():
            f.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        system, local = opened(self.path)
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        digest, size = hashlib.sha256(), 0
        with system.open_output_stream(f"{self.parts}/document") as f:

            def put(data: bytes) -> None:
                nonlocal size
                digest.update(data)
                size += len(data)
                f.write(data)

            put(b"{")
            for k, v in self.head.items():
                put(f"{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)},\n".encode())
            for i, name in enumerate(self.lists):
                put(f"{',' if i else ''}{json.dumps(name, ensure_ascii=False)}: [\n".encode())
                for j, part in enumerate(p.files[name] for p in done if name in p.files):
                    if j:
                        put(b",\n")
                    with system.open_input_stream(part) as rows:
                        while data := rows.read(STEP):
                            put(data)
                put(b"\n]")
            put(b"}\n")
        counts = {name: sum(p.rows.get(name, 0) for p in done) for name in self.lists}
        with system.open_output_stream(f"{self.parts}/meta") as f:
            f.write(json.dumps(self.meta | {"rows": counts, "bytes": size, "sha256": digest.hexdigest()}, ensure_ascii=False, indent=2).encode())
        system.move(f"{self.parts}/meta", f"{local}.meta.json")  # the document is last: where it is, all of it is
        system.move(f"{self.parts}/document", local)
        system.delete_dir(self.parts)

    def abort(self, messages: list[Part | None]) -> None:
        system, _ = opened(self.path)
        if system.get_file_info(self.parts).type == fs.FileType.Directory:
            system.delete_dir(self.parts)


@dataclass
class Span(InputPartition):
    low: int
    high: int


class LineReader(DataSourceReader):
    """The lines that begin in each span of bytes. A JSON text has no line break within a string, so a line of the writer is a row or a mark."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partitionBytes", PARTITION))

    def partitions(self) -> list[Span]:
        system, local = opened(self.path)
        size = system.get_file_info(local).size
        return [Span(lo, min(lo + self.size, size)) for lo in range(0, size, self.size)] or [Span(0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        system, local = opened(self.path)
        with system.open_input_file(local) as f:
            f.seek(max(0, partition.low - 1))
            left, at = b"", partition.low
            if partition.low:  # up to the first line that begins here
                while b"\n" not in (left := f.read(STEP)) and left:
                    at += len(left)
                if not left:
                    return
                cut = left.index(b"\n")
                at, left = at + cut, left[cut + 1 :]
            while at < partition.high:
                data = f.read(STEP)
                *lines, rest = (left + data).split(b"\n")
                if not data and rest:
                    lines, rest = [*lines, rest], b""
                places = []
                for line in lines:
                    if at >= partition.high:
                        break
                    places.append(at)
                    at += len(line) + 1
                yield pa.RecordBatch.from_pydict({"at": pa.array(places, pa.int64()), "line": pa.array(lines[: len(places)], pa.string())})
                left = rest
                if not data:
                    return


class DocumentSink(DataSource):
    """Format "json_document": writes rows (list, row), row a JSON text, and reads lines (at, line). Options: path, lists, head, meta (the last three JSON)."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def schema(self) -> str:
        return "at bigint, line string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(lists: dict[str, DataFrame], path: str, head: dict | None = None, meta: dict | None = None) -> None:
    """Writes ``lists`` (name: rows, sorted if they should be) and the fields of ``head`` to ``path``, ``meta`` and counts to path.meta.json."""
    frames = [df.select(F.lit(name).alias("list"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")) for name, df in lists.items()]
    spark = frames[0].sparkSession
    spark.dataSource.register(DocumentSink)
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.union(f)
    rows.write.format("json_document").mode("append").options(path=path, lists=json.dumps(list(lists)), head=json.dumps(head or {}), meta=json.dumps(meta or {})).save()


def read_list(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame | None:
    """The rows (``schema``) of a list that ``write_document`` wrote, read by spans of bytes; None where the sidecar doesn't tell that it did."""
    system, local = opened(path)
    if any(system.get_file_info(p).type != fs.FileType.File for p in (local, f"{local}.meta.json")):
        return None
    with system.open_input_stream(f"{local}.meta.json") as f:
        meta = json.loads(f.read())
    if name not in meta.get("rows", {}) or meta.get("bytes") != system.get_file_info(local).size:
        return None
    spark.dataSource.register(DocumentSink)
    lines = spark.read.format("json_document").options(path=path).load()
    # rows begin with a brace, a list's end with a bracket: a mark for each list and one for the end
    opens = [f"{before}{json.dumps(name, ensure_ascii=False)}: [" for before in ("{", "", "],")]
    marks = lines.where(F.startswith("line", F.lit("]")) | F.col("line").isin(*opens)).orderBy("at").collect()
    start = next(m.at for m in marks if m.line in opens)
    end = next(m.at for m in marks if m.at > start)
    rows = lines.where((F.col("at") > start) & (F.col("at") < end) & F.startswith("line", F.lit("{")))
    return rows.select(F.from_json(F.rtrim(F.col("line"), F.lit(",")), schema).alias("row")).select("row.*")


def write_tiles(tiles: DataFrame, statistics: DataFrame, path: str, threshold: int, snapshot: int) -> None:
    """Tiles.json (id, name, bbox, count; by id), with the row of ``statistics`` in its sidecar."""
    stats = statistics.first().asDict()
    write_document({"tiles": tiles.select("id", "name", "bbox", "count").orderBy("id")}, path, {"schema_version": 1, "source_snapshot_id": snapshot, "threshold": threshold}, stats)


def write_streets(streets: DataFrame, path: str) -> None:
    """Streets.json: totals, then the streets of ``coverage.street_match`` that are missing, extra and matched, most addresses first, then by name."""
    totals = streets.agg(
        F.count(F.when(F.col("kind") != "extra", 1)).alias("source_streets"), F.count(F.when(F.col("kind") != "missing", 1)).alias("osm_streets"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("missing", "extra", "matched")],
    ).first().asDict()
    most = F.greatest("n_source", "n_osm").desc()
    one = lambda k: streets.where(F.col("kind") == k).orderBy(most, "street_norm").select("street_norm", "n_source", "n_osm", "source_name", "osm_name")
    write_document({k: one(k) for k in ("missing", "extra", "matched")}, path, {"totals": totals})
