"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton over the pieces yields, at each position, the pieces that end there: the longest from the
state itself, shorter ones along its output links. Each of them relaxes the position from the one where it
starts: it takes over if its sum of scores is higher than the best so far.

* Unigram models: nothing else; the best sum wins.
* BPE models: the scores order merges, and the best sum over all segmentations is not what the model stands for.
  But a prefix of a BPE encoding is the encoding of the prefix, and a row of pieces is an encoding if and only
  if every two neighbours are the encoding of their concatenation. So a piece may relax a position only if it is
  stable behind the piece that the position where it starts was relaxed with. Runs of white space, where pieces
  of equal scores meet, are encoded by the definition.

Both kinds give the ids of the library. Texts are cut in chunks (white space in front of a word) that no
piece crosses; bounded tables keep the ids of chunks already met.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as pb

from addrloom.llm.common import freed, text_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Chunks a worker remembers, twice at most, and half as many pairs of pieces.
CACHE = 300_000
#: Characters of a text from which on its chunks are taken some at a time.
LONG = 1 << 20
MODEL = "piece_bpe_32k.model"


class _Chunks(dict):
    """Serialised ids by chunk; one that is missing is taken from the generation before or encoded. Long ones aren't kept."""

    def __init__(self, encode, old: dict):
        self.encode, self.old = encode, old

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.encode(chunk)
        if len(chunk) <= 32:
            self[chunk] = found
        return found


class PieceCodec:
    """Encoder and decoder for a model with identity normalisation and byte fallback."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True, cache: int = CACHE):
        self.kind, self.dummy_prefix, self.cache = kind, dummy_prefix, cache
        self.text = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        #: What each id stands for in UTF-8.
        self.raw = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else p.encode("utf-8", "surrogatepass") for p, _, t in pieces]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has white space inside: chunks can't be encoded on their own")
        self.whole = any("\n" in p for p in self.ids)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.whole else f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+")
        self.known = _Chunks(self._chunk_ids, {})
        self.stable: dict[int, bool] = {}
        self.relaxed = 0  # times a piece has taken over a position
        self.auto = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if kind == UNIGRAM or self.merge(p) == [i]:
                self.auto.add_word(p, (i, len(p), self.score[i]))
        self.auto.make_automaton()
        self.floor = min(self.score, default=0.0) - 10.0

    @classmethod
    def load(cls, path: str) -> PieceCodec:
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only identity normalisation is read")
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type, model.normalizer_spec.add_dummy_prefix)

    def merge(self, s: str) -> list[int]:
        """BPE by its definition: the adjacent pair with the best score merges first, the leftmost among equals."""
        if len(s) <= 64:
            return self._merge_short(list(s))
        parts: list[str | None] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(s) and (k := self.ids.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, both))

        for i in range(len(s) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(s) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(s):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.ids.get(p, -1) for p in parts if p is not None]

    def _merge_short(self, parts: list[str]) -> list[int]:
        ids, score, never = self.ids, self.score, float("inf")
        order = lambda p: -score[k] if (k := ids.get(p)) is not None else never
        ranks = [order(a + b) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = order(parts[i] + parts[i + 1])
            if i:
                ranks[i - 1] = order(parts[i - 1] + parts[i])
        return [ids.get(p, -1) for p in parts]

    def _stable(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.stable.get(key)
        if found is None:
            if len(self.stable) >= self.cache:
                self.stable.clear()
            found = self.stable[key] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return found

    def _segment(self, s: str) -> list[int]:
        """Piece ids of a chunk, -1 - position for a character that no piece covers."""
        n, never = len(s), float("-inf")
        best, last, size = [0.0] + [never] * n, [-1] * (n + 1), [0] * (n + 1)
        found = self.auto.iter(s)
        if any(c not in self.ids for c in s):  # such a character is relaxed behind the pieces that end with it
            alone = [(i, (-1 - i, 1, self.floor)) for i, c in enumerate(s) if c not in self.ids]
            found = heapq.merge(found, alone, key=lambda x: x[0])
        bpe, stable, took = self.kind == BPE, self.stable, 0
        for end, (k, length, score) in found:
            end += 1
            start = end - length
            score += best[start]
            if score > best[end]:
                if bpe:
                    if k < 0:
                        if last[end] >= 0:
                            continue
                    elif start and (p := last[start]) >= 0 and not (ok if (ok := stable.get(p << 32 | k)) is not None else self._stable(p, k)):
                        continue
                best[end], last[end], size[end] = score, k, length
                took += 1
        self.relaxed += took
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _chunk_ids(self, s: str) -> bytes:
        found = self._segment(s) if self.kind == UNIGRAM or s[1:2] != SPACE else self._by_definition(s)
        if min(found) < 0:
            out: list[int] = []
            for k in found:
                if k >= 0:
                    out.append(k)
                else:
                    raw = s[-k - 1].encode("utf-8", "surrogatepass")
                    out += [self.bytes[b] for b in raw] if self.bytes else [self.unknown]
            found = out
        return array("i", found).tobytes()

    def _by_definition(self, s: str) -> list[int]:
        out, at = [], 0
        for k in self.merge(s):
            out.append(k if k >= 0 else -at - 1)
            at += len(self.text[k]) if k >= 0 else 1
        return out

    def _met(self) -> _Chunks:
        """The table of chunks; once it is full, what was met since the last time stays and the rest goes."""
        if len(self.known) > self.cache:
            self.known.old = {}
            self.known = _Chunks(self._chunk_ids, dict(self.known))
        return self.known

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; none for an empty one."""
        if not text:
            return np.zeros(0, np.int32)
        text, parts = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE), []
        if len(text) <= LONG:
            return np.frombuffer(b"".join(map(self._met().__getitem__, self.chunk.findall(text))), np.int32)
        chunks = map(re.Match.group, self.chunk.finditer(text))
        while block := list(islice(chunks, LONG // 8)):
            parts.append(b"".join(map(self._met().__getitem__, block)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        """The text of ``ids``: bytes together form characters, one leading space (the dummy prefix) goes."""
        text = b"".join(map(self.raw.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


@lru_cache(2)
def codec(model: str = MODEL) -> PieceCodec:
    """The codec of a model file, loaded once by each worker. ``model`` is a public tokenizer's name or a path."""
    return PieceCodec.load(model if "/" in model else public_tokenizers.path(model))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, null for null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                ids = [None if t is None else c.encode(t) for t in s.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": s.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, model: str = MODEL, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), n_bytes (of the decoded text), decoded_equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        c.cache = cache
        for b in batches:
            rows = []
            for t in (t for lo in range(0, b.num_rows, 256) for t in b.column("text").slice(lo, 256).to_pylist()):
                ids = c.encode(t or "")
                back = c.decode(ids)
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back.encode("utf-8", "replace")), back == (t or "")))
            n, crc, size, same = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "decoded_equal": pa.array(same, pa.bool_())})

    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(freed(run), "doc_id bigint, n_tokens bigint, ids_crc32 bigint, n_bytes bigint, decoded_equal boolean")


def op7_sentencepiece(docs: DataFrame) -> DataFrame:
    """Encode every whole text and decode it again.

    Null and empty texts have no ids; characters no piece covers become byte pieces; a text with U+2581
    decodes to spaces there, so decoded_equal is false; repeated rows and null ids keep their rows.
    """
    return round_trip(docs)
