"""Token ids in binary files: each document compressed on its own with a shared zstandard dictionary, and an offset index.

File: magic; a frame for each document; the index, an entry for each document: doc_id, whether it is null, offset
and size of the frame, number of ids, ids before it in the file; a foot of fixed size: version, id width, number of
documents, dictionary hash (SHA-256), offset of the index, magic. So a file is written in one go, and any document can
be read from its entry with one short read. The dictionary is trained on serialised id arrays of a bounded sample and
lies beside the files.
"""

from __future__ import annotations

import hashlib
import json
import string
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from addrloom.llm.common import shared_dir, text_batches, write_table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"IDSTORE1"
FOOT = "<HHQ32sQ8s"
FOOT_BYTES = struct.calcsize(FOOT)
ENTRY = np.dtype([("doc", "<i8"), ("null", "u1"), ("at", "<u8"), ("size", "<u4"), ("ids", "<u8"), ("before", "<u8")])
LEVEL = 1
#: Words a worker remembers the ids of.
CACHE = 200000
#: ASCII punctuation that is taken off the end of a word, but for what special tokens are made of; apostrophes start contractions.
PUNCTUATION = string.punctuation.replace("'", "")
#: Documents and bytes of each that the dictionary is trained on, at most, in pieces from all over the text; its size.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_PIECE, DICT_BYTES = 1000, 16_384, 2048, 65_536
#: Bytes of text for a file, about; bytes of a file read at a time.
FILE_BYTES, READ_BYTES = 1 << 28, 4 << 20
MANIFEST = "file int, path string, docs bigint, ids bigint, bytes bigint"


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict.fromkeys(plain) | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


BYTE_CHARS = {b: c or chr(b) for b, c in _byte_chars().items()}


class _Words(dict):
    """Serialised ids by word; a word that is missing is taken from the generation before or encoded."""

    def __init__(self, encode, old: dict):
        self.encode, self.old = encode, old

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self[word] = found
        return found


class WordTokenizer:
    """The library's tokenizer, asked once for each word.

    That is exact where the tokenizer lower-cases, drops white space and splits runs of letters from all
    else: no token then crosses white space or the border between letters and ASCII punctuation, and runs of
    ASCII letters go to the library's BPE model as they are. Words with a special token's text, marks or
    other letters go through the whole tokenizer. A tokenizer of another kind gets whole texts.
    """

    def __init__(self, path: str, cache: int = CACHE):
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.type = np.dtype("<u4" if self.lib.get_vocab_size() > 1 << 16 else "<u2")
        self.by_word = self._splits_words(json.loads(self.lib.to_str()))
        special = {c for t in self.lib.get_added_tokens_decoder().values() for c in t.content}
        self.model, self.cache, self.punctuation = self.lib.model, cache, "".join(c for c in PUNCTUATION if c not in special).encode()
        self.parts, self.words = _Words(self._part, {}), _Words(self._word, {})

    @staticmethod
    def _splits_words(spec: dict) -> bool:
        """Whether the steps are exactly those for which words can be encoded alone; one step more or less, and whole texts go to the library."""

        def steps(part: dict | None, inner: str) -> list[dict]:
            return part[inner] if part and inner in part else [part] if part else []

        normal, pre = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
        if [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"]:
            return False
        cut = pre[0]
        same = normal[1]["pattern"].get("Regex") == r"\s+" and normal[1]["content"] == " " and not pre[1]["add_prefix_space"]
        return same and cut["behavior"] == "Removed" and cut["invert"] is True and cut["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.lib.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.type).tobytes()

    def _part(self, part: bytes) -> bytes:
        """Ids of a run of lower-case Latin letters, or of one of punctuation."""
        if part[0] in self.punctuation:
            return self._whole(part)
        return np.array([t.id for t in self.model.tokenize(part.decode("latin-1").translate(BYTE_CHARS))], self.type).tobytes()

    def _word(self, word: bytes) -> bytes:
        stem = word.rstrip(self.punctuation)
        tail = word[len(stem) :]
        if stem.isalpha():
            stem = stem.lower()
        else:
            # precomposed Latin letters: normalisation keeps them, and each has a lower case of its own
            letters = stem.decode("utf-8", "replace")
            if not letters.isalpha() or max(letters) >= "\u0250" or "\u0130" in letters:
                return self._whole(word)
            stem = letters.lower().encode()
        return self.parts[stem] + self.parts[tail] if tail else self.parts[stem]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Serialised ids of each text."""
        if not self.by_word:
            return [self._whole(t) for t in texts]
        out = []
        for t in texts:
            for name in ("parts", "words"):
                if len(table := getattr(self, name)) > self.cache:  # what was met since the last time stays, the rest goes
                    table.old = {}
                    setattr(self, name, _Words(table.encode, dict(table)))
            out.append(b"".join(map(self.words.__getitem__, t.split())))
        return out


@lru_cache(2)
def tokenizer(path: str = TOKENIZER) -> WordTokenizer:
    return WordTokenizer(path if "/" in path else public_tokenizers.path(path))


def _texts(b: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """ids and texts of a batch, some at a time."""
    for at in range(0, b.num_rows, 256):
        part = b.slice(at, 256)
        yield part.column("doc_id").to_pylist(), [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _pieces(data: bytes, width: int) -> bytes:
    """SAMPLE_BYTES at most of ``data``: all of it, or pieces at even distances from its start to its end."""
    if len(data) <= SAMPLE_BYTES:
        return data
    n = SAMPLE_BYTES // SAMPLE_PIECE
    starts = [(len(data) - SAMPLE_PIECE) * i // (n - 1) // width * width for i in range(n)]
    return b"".join(data[a : a + SAMPLE_PIECE] for a in starts)


def train_dictionary(docs: DataFrame, rows: int, path: str = TOKENIZER) -> bytes:
    """A dictionary from the serialised ids of some documents, drawn by a hash of doc_id and text; empty if there is too little.

    About 1.5 x SAMPLE_DOCS are drawn; of distinct ones the SAMPLE_DOCS with the smallest hashes count. Rows that repeat are one,
    so the sample is the same in every run, whatever the order of the rows.
    """
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31))
    few = docs.select("text", drawn.alias("drawn")).where(F.col("drawn") <= int(min(1.0, 1.5 * SAMPLE_DOCS / max(rows, 1)) * (1 << 31)))
    few = few.dropDuplicates(["drawn"]).orderBy("drawn").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"ids": pa.array([_pieces(x, tok.type.itemsize) for x in tok.encode(texts)], pa.binary())})

    sample = [bytes(r.ids) for r in few.select("text").mapInArrow(run, "ids binary").collect() if r.ids]
    try:
        return zstandard.train_dictionary(DICT_BYTES, sorted(sample)).as_bytes()
    except zstandard.ZstdError:  # too few samples for a dictionary of any use
        return b""


def write_store(docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of (doc_id, text) in ascending doc_id order (null first), then text hash; returns the manifest, already written.

    There are as many files as the texts' bytes ask for, four for each core at least. The range shuffle deals out texts, before
    they are encoded, so that the pass that draws its bounds encodes nothing; its key has the text's hash, so rows of one doc_id
    are dealt out too. A file is named anew by every attempt; those in the manifest count.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    trained = train_dictionary(docs, rows, path)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/ids.dict", compression=None) as out:
        out.write(trained)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, (store, base), part = tokenizer(path), fs.FileSystem.from_uri(folder), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        end, name = np.array([end_id], tok.type).tobytes(), f"{base}/{part:06d}-{uuid.uuid4().hex}.ids"
        out, entries, at, before, docs = None, [], len(MAGIC), 0, 0
        for b in batches:
            for ids, texts in _texts(b):
                if not texts:
                    continue
                if out is None:
                    out = store.open_output_stream(name, compression=None)
                    out.write(MAGIC)
                block, told = [], []
                for doc, data in zip(ids, tok.encode(texts)):
                    data += end
                    frame, n = press.compress(data), len(data) // tok.type.itemsize
                    told.append((doc or 0, doc is None, at, len(frame), n, before))
                    at, before = at + len(frame), before + n
                    block.append(frame)
                out.write(b"".join(block))
                entries.append(np.array(told, ENTRY).tobytes())
                docs += len(told)
        if out is not None:
            for block in entries:
                out.write(block)
            out.write(struct.pack(FOOT, 1, tok.type.itemsize, docs, hashlib.sha256(trained).digest(), at, MAGIC))
            out.close()
        rows = [(part, name, docs, before, at + docs * ENTRY.itemsize + FOOT_BYTES)] if docs else []
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_pydict({"file": pa.array(cols[0], pa.int32()), "path": pa.array(cols[1], pa.string()), **{k: pa.array(c, pa.int64()) for k, c in zip(("docs", "ids", "bytes"), cols[2:])}})

    key = [F.col("doc_id").asc_nulls_first(), F.col("th")]
    files = max(-(-size // file_bytes), 4 * spark.sparkContext.defaultParallelism)
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).repartitionByRange(files, *key).sortWithinPartitions(*key, "text")
    return write_table(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "ids-manifest")


class StoreFile:
    """One file: its index, any document from its entry, or all documents in turn."""

    def __init__(self, store: fs.FileSystem, path: str, trained: bytes):
        self.file = store.open_input_file(path)
        self.bytes = self.file.size()
        _, width, n, told, index_at, magic = struct.unpack(FOOT, self.file.read_at(FOOT_BYTES, self.bytes - FOOT_BYTES))
        if magic != MAGIC or told != hashlib.sha256(trained).digest():
            raise ValueError(f"{path}: not an id file, or one of another dictionary")
        self.type, self.index = np.dtype(f"<u{width}"), np.frombuffer(self.file.read_at(n * ENTRY.itemsize, index_at), ENTRY)
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)

    def _ids(self, frame: bytes, n: int) -> np.ndarray:
        return np.frombuffer(self.press.decompress(frame, max_output_size=n * self.type.itemsize), self.type)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the file's document k, from its frame alone."""
        e = self.index[k]
        return self._ids(self.file.read_at(int(e["size"]), int(e["at"])), int(e["ids"]))

    def scan(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Runs of documents, the first one's place and the ids of each, from long reads."""
        at, ends = self.index["at"].astype(np.int64), (self.index["at"] + self.index["size"]).astype(np.int64)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, at[lo] + READ_BYTES, "right")))
            hi = min(hi, lo + 10_000)
            block = memoryview(self.file.read_at(int(ends[hi - 1] - at[lo]), int(at[lo])))
            yield lo, [self._ids(block[a:b], n) for a, b, n in zip((at[lo:hi] - at[lo]).tolist(), (ends[lo:hi] - at[lo]).tolist(), self.index["ids"][lo:hi].tolist())]
            lo = hi


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files: a task for each."""
    spark: SparkSession = manifest.sparkSession
    files, before = [], 0
    for r in manifest.orderBy("file").collect():  # one row for each file
        files.append((r.path, before))
        before += r.ids
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("base", T.LongType())])
    paths = spark.createDataFrame(files, schema).repartition(max(1, len(files)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{base}/ids.dict", compression=None) as f:
            trained = f.read()
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                one = StoreFile(store, path, trained)
                for lo, found in one.scan():
                    part = one.index[lo : lo + len(found)]
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in found]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(part["doc"], mask=part["null"].astype(bool)), "start": pa.array(part["before"].astype(np.int64) + first), "n_tokens": pa.array(part["ids"].astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())})

    return paths.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op10_token_store(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Encode and store every whole text; return what the files say of each document.

    Null and empty texts have the end id only; null ids come first and stay null, repeated rows follow one
    another by the text's hash; an empty table gives no rows; other columns are ignored.
    """
    folder = shared_dir(spark, "ids")
    return read_store(write_store(docs, folder), folder)
