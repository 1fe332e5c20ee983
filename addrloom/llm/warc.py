"""WARC archives: a distributed writer and a sequential reader.

Each record is one gzip member. The reader decompresses member by member with an incremental zlib object,
frames blocks by Content-Length and verifies block and payload digests; it holds one chunk at a time
(and the payload, only if asked to keep it). Archives go through ``pyarrow.fs``, so the folder can be on
any store that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.llm.common import lookup, shared_dir, write_table

CHUNK = 1 << 18
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
#: Bytes of a record's own head, and of the HTTP head in its block, at most.
MOST_HEAD = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = "record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, digest_verified boolean"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def build_record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str, level: int = 3) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, which tells the payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _field(url) if url else "about:blank"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if refers_to:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head.append(("Content-Length", str(len(block))))
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(text) + z.compress(block) + z.compress(END) + z.flush()


class _Record:
    """Takes the bytes of one record in pieces of any size."""

    def __init__(self, keep: bool):
        self.head, self.fields, self.left, self.tail = b"", None, 0, b""
        self.http, self.in_payload, self.keep, self.parts = b"", False, keep, []
        self.block, self.payload, self.size = hashlib.sha1(), hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(END)
            if at < 0:
                if len(self.head) > MOST_HEAD:
                    raise ValueError("a WARC head without end")
                return
            lines = self.head[:at].split(b"\r\n")
            if not lines[0].startswith(b"WARC/1."):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            self.fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
            self.left = int(self.fields["content-length"])
            self.in_payload = not self.fields.get("content-type", "").startswith("application/http")
            data, self.head = self.head[at + 4 :], b""
        block, self.tail = data[: self.left], self.tail + data[self.left :]
        if len(self.tail) > len(END):
            raise ValueError("Content-Length doesn't frame the record's block")
        self.left -= len(block)
        self.block.update(block)
        if not self.in_payload:
            self.http += block
            at = self.http.find(END)
            if at < 0:
                if len(self.http) > MOST_HEAD:
                    raise ValueError("an HTTP head without end")
                return
            block, self.http, self.in_payload = self.http[at + 4 :], self.http[: at + 4], True
        self.payload.update(block)
        self.size += len(block)
        if self.keep:
            self.parts.append(block)

    def finish(self) -> dict:
        if self.fields is None or self.left:
            raise ValueError("truncated WARC record")
        if self.tail != END:
            raise ValueError("Content-Length doesn't frame the record's block")
        f, revisit = self.fields, self.fields.get("warc-type") == "revisit"
        said = {k: f.get(f"warc-{k}-digest", "").removeprefix("sha1:") for k in ("block", "payload")}
        own = {k: base64.b32encode(getattr(self, k).digest()).decode() for k in ("block", "payload")}
        for k in ("block",) if revisit else ("block", "payload"):
            if said[k] and said[k] != own[k]:
                raise ValueError(f"{k} digest {own[k]} found, {said[k]} stated, in {f.get('warc-record-id')}")
        http = dict(x.lower().split(b":", 1) for x in self.http.split(b"\r\n") if b":" in x)
        size = int(http.get(b"content-length", b"0")) if revisit else self.size
        return {
            "record_id": f.get("warc-record-id", "").strip("<>"), "record_type": f.get("warc-type"), "target_uri": f.get("warc-target-uri"),
            "payload_bytes": size, "payload_digest": said["payload"] if revisit else own["payload"],
            "refers_to": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
            "digest_verified": bool(said["block"]) and (revisit or bool(said["payload"])),
        } | ({"payload": b"".join(self.parts)} if self.keep else {})


def read_records(stream, keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive, in order. ``stream`` needs ``read(n)`` only. Raises ValueError on bad framing or digests."""
    data = stream.read(CHUNK)
    while data:
        z, rec = zlib.decompressobj(31), _Record(keep_payload)
        while not z.eof:
            if not data and not (data := stream.read(CHUNK)):
                raise ValueError("truncated gzip member")
            rec.feed(z.decompress(data, CHUNK))
            data = z.unconsumed_tail
        yield rec.finish()
        data = z.unused_data or stream.read(CHUNK)


def plan_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload (binary), n_bytes and refers_to to rows of (page_id, url, html).

    Of pages with equal payloads of ``min_bytes`` at least, the largest page_id is the response and others
    refer to it; rows that repeat that very page_id are responses too. Null ids count as the smallest.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"n_bytes": F.length("payload").cast("long"), "sha": F.sha1("payload")})
    groups = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha", "n_bytes").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    groups = write_table(groups.where("n > 1"), "warc-groups")
    rows = lookup(rows, groups, ["sha", "n_bytes"], "n", ["page_id", "url"])
    return rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "2026-01-01T00:00:00Z", max_bytes: int = 1 << 28) -> DataFrame:
    """Writes rows of (page_id, url, payload, refers_to) into archives; returns the manifest, already written.

    Each task writes files of its own under names that no other attempt uses; only files in the manifest
    count, so a task that is run again leaves nothing but an unlisted file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, path, done, count, size = None, "", [], 0, 0
        for b in batches:
            for page, url, payload, refers in zip(*(c for c in (b.column(n) for n in ("page_id", "url", "payload", "refers_to")))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(path, compression=None), 0, 0
                ref = refers.as_py()
                record = build_record(f"urn:page:{page.as_py()}", url.as_py(), payload.as_py(), None if ref is None else f"urn:page:{ref}", date)
                out.write(record)
                count, size = count + 1, size + len(record)
                if size >= max_bytes:
                    out.close()
                    out = done.append((path, count, size))
        if out is not None:
            out.close()
            done.append((path, count, size))
        names = ("path", "records", "bytes")
        yield pa.RecordBatch.from_pydict({n: pa.array([d[i] for d in done], pa.string() if i == 0 else pa.int64()) for i, n in enumerate(names)})

    return write_table(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's archives, one task for each archive."""
    spark = manifest.sparkSession
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        types = [pa.int64() if n == "payload_bytes" else pa.bool_() if n == "digest_verified" else pa.string() for n in names]
        for b in batches:
            for path in b.column("path").to_pylist():
                found: list[dict] = []
                with store.open_input_stream(path, compression=None) as stream:
                    for rec in read_records(stream):
                        found.append(rec)
                        if len(found) == 5000:
                            yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in found], t) for n, t in zip(names, types)})
                            found = []
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in found], t) for n, t in zip(names, types)})

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(read, RECORDS) if files > 1 else spark.createDataFrame(manifest.select("path").collect(), "path string").mapInArrow(read, RECORDS)


def verify_revisits(records: DataFrame) -> DataFrame:
    """``records`` (a written table) with digest_verified of each revisit told from the response it refers to: it must be there,
    verified, with the digest and the length that the revisit states. Responses keep what the reader found.
    """
    wanted = records.where("record_type = 'revisit'").groupBy(F.col("refers_to").alias("_to")).agg(F.count("*").alias("_n"))
    same = F.struct("payload_digest", "payload_bytes", "digest_verified")
    found = records.where("record_type = 'response'").join(wanted, F.col("record_id") == F.col("_to")).groupBy(F.col("_to").alias("refers_to")).agg(F.max("_n").alias("_n"), F.collect_set(same).alias("_responses"))
    found = write_table(found, "warc-referred")
    rows = records.withColumn("_key", F.coalesce("refers_to", F.lit("")))
    rows = lookup(rows, found.withColumnRenamed("refers_to", "_key"), ["_key"], "_n", ["record_id", "target_uri"])
    stated = F.array_contains("_responses", F.struct("payload_digest", "payload_bytes", F.lit(True).alias("digest_verified")))
    verified = F.when(F.col("record_type") == "revisit", F.col("digest_verified") & F.coalesce(stated, F.lit(False))).otherwise(F.col("digest_verified"))
    return rows.withColumn("digest_verified", verified).select(*records.columns)


def op1_warc(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive every page and read the archives back.

    Null html is an empty payload, a null url becomes ``about:blank``, a null page_id stays null; repeated
    rows give a record each; an empty table gives no rows; other columns are ignored.
    """
    folder = shared_dir(spark, "warc")
    manifest = write_archives(plan_revisits(pages), folder)
    records = verify_revisits(write_table(read_archives(manifest, folder), "warc-records"))
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "target_uri", "digest_verified"
    )
