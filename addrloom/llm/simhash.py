"""SimHash near-duplicates: fingerprints linked within a Hamming radius through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank, so neighbours share bits. Each run of RUN neighbours forms a group that
keeps the masked pattern its members share; a run of groups forms a group of the next level, which takes the
bits common to all of them out of its members. So a bit is looked at once, at the highest level where it is
shared. A search goes down from the root and carries the differences met so far; as soon as they exceed the
radius, the whole group goes.

Over the cluster the index has one more level: nodes, ranges of Gray ranks of about the same size. Their
patterns are all that is broadcast, MAX_NODES of them at most whatever the input. A fingerprint goes to its own
node and to those of higher rank that the search through the nodes' patterns cannot rule out; there it meets the
node's own index. Nothing is compared that a pattern rules out, and no two fingerprints within the radius are
missed.

Only a spanning set of links leaves a task: every fingerprint to the smallest one it is connected with
in the node. That keeps each component and no more rows than fingerprints and visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.llm.common import drop_tables, freed, keep_first, lookup, text_batches, write_table

#: Members of a group.
RUN = 8
#: Fingerprints of a node, about, and nodes at most: beyond 2**30 fingerprints the nodes grow. A fingerprint visits about as many
#: nodes as there are values within the radius of the bits that a node's members share, so fewer, larger nodes mean less to send.
NODE_CODES, MAX_NODES = 1 << 16, 1 << 14
#: Groups opened at a time in a search.
SLICE = 1 << 14
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle in turn, A-Z lower-cased; a text of fewer words is one shingle, one without words none."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    view = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    n = len(words) - k + 1
    del words
    starts = np.concatenate(([0], ends[: n - 1]))
    return np.fromiter((digest(view[a:b], 42) for a, b in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist())), np.uint64, n)


def fold(hashes: np.ndarray) -> int:
    """The SimHash: a bit is 1 if it is set in over half the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the word shingles, repeats included; 0 without words."""
    return fold(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp) of each row of ``docs``; fp holds the 64 bits as a signed long, th the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for lo in range(0, b.num_rows, 256) for t in b.column("text").slice(lo, 256).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "th": b.column("th"), "fp": pa.array(fps.view(np.int64))})

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


def gray_rank(fp):
    """Rank of a code in the reflected Gray sequence, as a column; the sign bit is flipped so that signed order is unsigned order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """A tree over leaves in Gray order, each a code or, with ``ors``, the bits that a set of codes share.

    For each level, leaves first: the shared values and the bits that are shared there but not one level up.
    ``opened`` and ``pruned`` count groups that a search went into and dropped, ``compared`` leaves it tested.
    """

    def __init__(self, ands: np.ndarray, ors: np.ndarray | None = None):
        fixed = ~(ands ^ (ands if ors is None else ors))
        ors, self.levels = ands if ors is None else ors, []
        while len(ands) > 1:
            at = np.arange(0, len(ands), RUN)
            above = np.bitwise_and.reduceat(ands, at), np.bitwise_or.reduceat(ors, at)
            shared = ~(above[0] ^ above[1])
            self.levels.append((ands, fixed & ~np.repeat(shared, RUN)[: len(ands)]))
            (ands, ors), fixed = above, shared
        self.levels.append((ands, fixed))
        self.opened = self.pruned = self.compared = 0

    def search(self, queries: np.ndarray, radius: int, after: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, leaf) that differ in ``radius`` bits at most, in pieces; with ``after``, leaves beyond that index only."""
        top = len(self.levels)
        if not len(self.levels[0][0]):
            return
        stack = [(top, np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.uint8))]
        while stack:
            k, who, node, differ = stack.pop()
            if len(who) > SLICE:
                stack.append((k, who[SLICE:], node[SLICE:], differ[SLICE:]))
                who, node, differ = who[:SLICE], node[:SLICE], differ[:SLICE]
            k -= 1
            value, rest = self.levels[k]
            if k < top - 1:  # the members of the groups
                node = (node[:, None] * RUN + np.arange(RUN)).reshape(-1)
                who, differ = np.repeat(who, RUN), np.repeat(differ, RUN)
                inside = node < len(value)
                if not inside.all():
                    who, node, differ = who[inside], node[inside], differ[inside]
            if after is not None:
                beyond = (node + 1) * RUN**k > after[who] + 1
                who, node, differ = who[beyond], node[beyond], differ[beyond]
            differ = differ + np.bitwise_count((queries[who] ^ value[node]) & rest[node])
            near = differ <= radius
            who, node, differ = who[near], node[near], differ[near]
            if k == 0:
                self.compared += len(near)
                if len(who):
                    yield who, node
            else:
                self.opened, self.pruned = self.opened + len(who), self.pruned + len(near) - len(who)
                if len(who):
                    stack.append((k, who, node, differ))


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j in ``root``, where every index points to the smallest of its set."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        i, j = i[differ], j[differ]
        low, high = np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


class _Node:
    """The fingerprints of one node and, after them, the visitors; gathers a spanning set of their links."""

    def __init__(self, radius: int):
        self.radius, self.own, self.index = radius, [], None
        self.a, self.b = [], []
        self.pairs, self.waiting = [], 0

    def _later(self, i: np.ndarray, j: np.ndarray) -> None:
        self.pairs.append((i, j))
        self.waiting += len(i)
        if self.waiting > 1 << 20:
            self._unite()

    def _unite(self) -> None:
        if self.pairs:
            unite(self.root, *(np.concatenate(x) for x in zip(*self.pairs)))
        self.pairs, self.waiting = [], 0

    def _ready(self) -> None:
        if self.index is None:
            self.codes = np.concatenate(self.own)
            self.index, self.root = GrayIndex(self.codes), np.arange(len(self.codes))
            for i, j in self.index.search(self.codes, self.radius, np.arange(len(self.codes))):
                self._later(i, j)

    def add(self, own: np.ndarray, fp: np.ndarray) -> None:
        n = int(own.sum())
        if n:
            self.own.append(fp[:n])
        if n < len(fp):
            self._ready()
            visitors = fp[n:]
            for who, at in self.index.search(visitors, self.radius):
                who, first, back = np.unique(who, return_index=True, return_inverse=True)
                self.a.append(visitors[who])
                self.b.append(self.codes[at[first]])
                self._later(at[first][back], at)

    def links(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        self._ready()
        self._unite()
        linked = self.root != np.arange(len(self.root))
        return [*self.a, self.codes[self.root[linked]]], [*self.b, self.codes[linked]]


def links(fps: DataFrame, radius: int = 2, node_codes: int = NODE_CODES, max_nodes: int = MAX_NODES) -> DataFrame:
    """(a, b): a spanning set of the links within ``radius`` between the distinct values of ``fps`` (column fp)."""
    ranked = fps.select("fp", gray_rank(F.col("fp")).alias("gray"))
    nodes = min(max_nodes, ceil(ranked.count() / node_codes))
    cuts = ranked.agg(F.percentile_approx("gray", [i / nodes for i in range(1, nodes)], 4 * nodes + 100)).first()[0] if nodes > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    values = lambda b, *names: [b.column(n).to_numpy(zero_copy_only=False) for n in names]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, gray = values(b, "fp", "gray")
            order = np.argsort(gray)
            fp, node = fp[order], np.searchsorted(bounds, gray[order], "right")
            node, at = np.unique(node, return_index=True)
            if len(node):
                yield pa.RecordBatch.from_pydict({"node": pa.array(node.astype(np.int32)), "ands": pa.array(np.bitwise_and.reduceat(fp, at)), "ors": pa.array(np.bitwise_or.reduceat(fp, at))})

    found = ranked.mapInArrow(shared, "node int, ands bigint, ors bigint").groupBy("node").agg(F.bit_and("ands").alias("ands"), F.bit_or("ors").alias("ors"))
    patterns = sorted(found.collect())  # a row for each node
    numbers = np.array([r.node for r in patterns], np.int64)
    ands, ors = (np.array([r[k] for r in patterns], np.int64).view(np.uint64) for k in ("ands", "ors"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = GrayIndex(ands, ors)
        for b in batches:
            fp, gray = values(b, "fp", "gray")
            fp = fp.view(np.uint64)
            home = np.searchsorted(numbers, np.searchsorted(bounds, gray, "right"))
            for who, node in upper.search(fp, radius, home - 1):
                yield pa.RecordBatch.from_pydict({"node": pa.array(node.astype(np.int32)), "own": pa.array(node == home[who]), "fp": pa.array(fp[who].view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(x or [np.zeros(0, np.uint64)]).view(np.int64)) for k, x in (("a", a), ("b", b))})

        at, held = None, None
        for b in batches:
            node, own, fp = values(b, "node", "own", "fp")
            fp = fp.view(np.uint64)
            edges = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if held is None or node[lo] != at:
                    if held is not None:
                        yield batch(*held.links())
                    at, held = node[lo], _Node(radius)
                held.add(own[lo:hi], fp[lo:hi])
        if held is not None:
            yield batch(*held.links())

    routed = ranked.mapInArrow(freed(visit), "node int, own boolean, fp bigint").repartition("node")
    return routed.sortWithinPartitions("node", F.desc("own"), gray_rank(F.col("fp"))).mapInArrow(freed(run), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes that have a link.

    Alternating large-star and small-star rounds on tables in the shared folder, until the links form stars, each
    node under the smallest of its component. Hot nodes are looked up through a bounded broadcast, so no node's
    links meet in one task.
    """
    edges = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write_table(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "star")
        large = lookup(both, low, ["u"], "n", ["v"]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = write_table(large.distinct(), "large")
        drop_tables(edges, low)
        low = write_table(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "star")
        small = lookup(large, low, ["u"], "n", ["v"])
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = write_table(small.where("u <> v").distinct(), "links")
        drop_tables(large, low)
        # stars: one link up from each node, and none from a root
        sides = edges.groupBy("u").agg(F.count("*").alias("up")).union(edges.select("v").distinct().select("v", F.lit(0).alias("up")))
        if not sides.groupBy("u").agg(F.count("*").alias("sides"), F.max("up").alias("up")).where("sides > 1 OR up > 1").take(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, th, fp, component_id, root) for each row of ``docs``: the smallest doc_id reachable over links.

    A null or empty text has fingerprint 0 and links like any other; null doc_ids keep their row and never
    are a component's id unless all its ids are null; repeated rows repeat; an empty table gives no rows.
    ``root``, the smallest fingerprint of the component, tells components apart whose ids are null or repeat.
    """
    fps = write_table(fingerprints(docs, shingle), "fingerprints")
    distinct = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "codes")
    comp = components(links(distinct, radius))
    named = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    low = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    low = write_table(low, "component-ids")
    codes = write_table(lookup(named, low, ["root"], "members", ["fp"]).select("fp", "n", "component_id", "root"), "code-components")
    return lookup(fps, codes, ["fp"], "n", ["doc_id", "th"]).select("doc_id", "th", "fp", "component_id", "root")


def op5_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lower-case hex digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id (null last), then text hash.

    Components count by their fingerprints, so rows whose doc_id is null or repeats are lost only to a row they are linked with.
    """
    return keep_first(docs, near_duplicates(docs, shingle, radius))
