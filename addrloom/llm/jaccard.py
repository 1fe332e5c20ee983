"""Near-copies by exact Jaccard similarity of word shingles, over whole texts; no pair at or above the limit is missed.

SimHash fingerprints (of the same shingles, through the Gray-order index) give the first candidates. Two sets as
similar as the limit differ in some ten of 64 bits, more than an index can search at scale, so the rest comes from
prefixes: with all shingles in one order, two sets that overlap enough share one of their first
``n - ceil(0.8 n) + 1``. Any order will do; frequent shingles of a sample of fixed size come last, which keeps the
groups small. Shingles that share the same sets make one group. Of a pair of candidates, sizes and parity maps (their
distance never exceeds that of the sets), of 512 bits and then of a bit or two for each shingle, and histograms of the
hashes of large sets (likewise) rule out most; the rest is counted shingle by shingle.

Counting a pair moves a whole set, so the most promising pair of each set is counted first: of its SimHash partners and
the one set that its groups have in common with it. Only where such links leave several components in a group are its
other pairs looked at: those of different components, in blocks of bounded size, the nearest few of each set first, more of
them in each further round for the groups that have more, as long as components differ, until none is left. So a group of many copies gives about as many pairs as it has members, and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.llm.common import drop_tables, freed, keep_first, lookup, small, text_batches, write_table
from addrloom.llm.simhash import LOWER, components, fold, links

SHINGLE = 5
#: Similarity as a fraction: 4/5.
SAME, OF = 4, 5
#: Differing bits of fingerprints within which pairs are candidates before any prefix is looked at.
RADIUS = 3
#: Words of a parity map; documents sampled for frequent shingles, and how many of these are set apart.
MAP_WORDS = 8
SAMPLE_DOCS, FREQUENT = 40_000, 400_000
#: Rows of a block of a group, about; pairs of a set that are looked at in the first round after the hubs, and how many times as many in each next one.
BLOCK, PICKS = 4096, 4
#: Times in the sample from which on a shingle's rows are aggregated before they are shuffled.
HOT_SEEN = 20
#: Bytes of a text hashed at a time.
SPAN = 1 << 20
MAPS = [f"m{k}" for k in range(MAP_WORDS)]
#: Residues counted in the histograms of sets of so many shingles or more, for which 512 parities say too little.
BUCKETS, COUNTED = 256, 512
#: Ratio of sizes of a band; sets of two bands that don't touch can't be similar, as OF / SAME is less.
BAND = 1.2501


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: A random value for each byte, A-Z as a-z, and the white-space bytes between words.
VALUES = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)[np.frombuffer(LOWER, np.uint8)]
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
#: Powers of an odd base and of its inverse, for each place of a span; factors for the words of a shingle.
BASE = 0x9E3779B97F4A7C15
POWERS, INVERSE = _powers(BASE, 1 << 12), _powers(pow(BASE, -1, 1 << 64), 1 << 12)
FACTORS = _powers(0xD6E8FEB86659FD93, SHINGLE + 3)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit polynomial hash of each word (a run of other bytes than white space), from running sums over the bytes."""
    global POWERS, INVERSE
    data = np.frombuffer(text, np.uint8)
    if len(data) > SPAN:  # in spans that end before a white-space byte
        parts, at = [], 0
        while at < len(data):
            end = min(len(data), at + SPAN)
            while end < len(data) and not SPACE[data[end]]:
                end += 1
            parts.append(_hash_words(data[at:end]))
            at = end
        return np.concatenate(parts)
    return _hash_words(data)


def _hash_words(data: np.ndarray) -> np.ndarray:
    global POWERS, INVERSE
    if len(data) > len(POWERS):
        POWERS, INVERSE = _powers(BASE, 2 * len(data)), _powers(pow(BASE, -1, 1 << 64), 2 * len(data))
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * POWERS[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * INVERSE[starts]


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles, sorted; a text of fewer words is one shingle."""
    h = word_hashes(text or b"")
    if not len(h):
        return h
    h = (h ^ (h >> np.uint64(32))) * FACTORS[1]
    h ^= h >> np.uint64(29)
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out += h[j : len(out) + j] * FACTORS[j + 2]
    out = (out ^ (out >> np.uint64(33))) * FACTORS[1]
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def similar(common, n, m):
    """Whether sets of n and m shingles, ``common`` of them shared, have a Jaccard similarity of SAME / OF at least."""
    return (SAME + OF) * common >= SAME * (n + m)


def parity_map(found: np.ndarray, words: int = MAP_WORDS) -> np.ndarray:
    """A bit for each residue of the hashes: whether an odd number of them falls there."""
    odd = np.bincount((found % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_map(found: np.ndarray) -> bytes | None:
    """The parity map of a set that is large for MAP_WORDS: with a bit or two for each shingle; None for others."""
    words = 1 << max(0, (len(found) - 1).bit_length() - 6)
    return parity_map(found, words).tobytes() if words > 2 * MAP_WORDS else None


def histogram(found: np.ndarray) -> bytes | None:
    """How many of the hashes of a large set fall on each residue, as 16-bit numbers; None for others."""
    if len(found) < COUNTED:
        return None
    counts = np.bincount((found >> np.uint64(48)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return np.minimum(counts, 0xFFFF).astype(np.uint16).tobytes()


def maps_differ(a: bytes, b: bytes) -> int:
    """Bits in which two maps differ, the longer one folded to the length of the other: residues that meet there add up."""
    x, y = sorted((np.frombuffer(m, np.uint64) for m in (a, b)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of which two similar sets share one, rare ones first, then by hash: those seen HOT_SEEN times in the sample apart."""
    n = len(found)
    take = n - -(-SAME * n // OF) + 1 if n else 0
    if not len(frequent):
        return found[:take], found[:0]
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    seen = np.where(frequent[at] == found, counts[at], 0)
    rare = found[seen == 0]
    if len(rare) >= take:
        return rare[:take], found[:0]
    order = np.lexsort((found, seen))[:take]
    hot = seen[order] >= HOT_SEEN
    return found[order[~hot]], found[order[hot]]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            yield part, [shingles(t) for t in part.column("text").cast(pa.binary()).to_pylist()]


def _sid(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7)


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), _signed(np.concatenate(values)))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, th, sid, n, fp, m0 to m7, wide, hist, prefix, hot): the text's hash; its set's hash, size, SimHash, parity maps, histogram and prefix, hot shingles apart."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))  # FREQUENT pairs of numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for b, found in _texts(batches):
            maps = np.stack([parity_map(s) for s in found])
            cold, hot = zip(*(prefix(s, frequent, counts) for s in found))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "th": b.column("th"), "sid": _signed([_sid(s) for s in found]), "n": pa.array([len(s) for s in found], pa.int64()),
                "fp": _signed([fold(s) for s in found]), **{m: pa.array(maps[:, k].copy()) for k, m in enumerate(MAPS)}, "wide": pa.array([wide_map(s) for s in found], pa.binary()), "hist": pa.array([histogram(s) for s in found], pa.binary()), "prefix": _lists(cold), "hot": _lists(hot),
            })

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(freed(run), "doc_id bigint, th bigint, sid bigint, n bigint, fp bigint, " + ", ".join(f"{m} bigint" for m in MAPS) + ", wide binary, hist binary, prefix array<bigint>, hot array<bigint>")


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in two or more documents of a sample, sorted, and their counts: the FREQUENT most frequent ones at most, so it is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _texts(batches):
            yield pa.RecordBatch.from_pydict({"s": _signed(np.concatenate(found))})

    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    top = docs.select("text").sample(share, seed=1).mapInArrow(freed(run), "s bigint").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    rows = top.orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    values, counts = rows.column("s").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(values)
    return values[order], counts[order]


def _far() -> Column:
    """Bits in which the parity maps a_m0 to a_m7 and b_m0 to b_m7 differ."""
    return sum((F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))) for k in MAPS), F.lit(0))


def _may_be_similar() -> Column:
    """False for pairs (n, m, far) that cannot reach the limit: the sets differ in n + m - 2 common shingles and share the smaller size at most."""
    n, m = F.col("n"), F.col("m")
    return similar(F.least(n, m), n, m) & (2 * SAME * (n + m) <= (SAME + OF) * (n + m - F.col("far")))


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b), a the partner of b: sets whose fingerprints are equal or linked within RADIUS, a spanning choice of them."""
    reps = write_table(distinct.groupBy("fp").agg(F.min("sid").alias("rep"), F.count("*").alias("sets")), "set-codes")
    same = lookup(distinct.select("sid", "fp"), reps.where("sets > 1"), ["fp"], "sets", ["sid"]).where("rep <> sid").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
    rep = lambda side: reps.select(F.col("fp").alias(f"_{side}"), F.col("rep").alias(side))
    linked = links(reps.select("fp"), RADIUS).withColumnsRenamed({"a": "_a", "b": "_b"})
    return same.union(linked.join(rep("a"), "_a").join(rep("b"), "_b").select("a", "b"))


def shared_tokens(sets: DataFrame) -> DataFrame:
    """(token, sid): the prefix shingles that two sets at least have. Hot ones are reduced to sets before the shuffle, others pass it once."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, False  # the row before, and whether its token is known to be shared
        for b in batches:
            token, sid = (b.column(c).to_numpy() for c in ("token", "sid"))
            if last is not None:
                token, sid = np.append(last[0], token), np.append(last[1], sid)
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            new = np.concatenate(([True], ~same | (sid[1:] != sid[:-1])))
            # of each token's rows with other sets than the row before: all, if there are two
            token, sid = token[new], sid[new]
            same = token[1:] == token[:-1]
            keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            shared = bool(keep[-1]) or (len(token) == 1 and told)
            if told:  # its first row, the one carried over, has been given
                keep[0] = False
            last, told = (token[-1], sid[-1]), shared
            yield pa.RecordBatch.from_pydict({"token": pa.array(token[keep]), "sid": pa.array(sid[keep])})

    rows = sets.select("sid", F.explode("prefix").alias("token")).repartition("token").sortWithinPartitions("token", "sid")
    cold = rows.select("token", "sid").mapInArrow(freed(share), "token bigint, sid bigint")
    hot = sets.select("sid", F.explode("hot").alias("token")).distinct()
    return cold.union(hot.select("token", "sid"))


def groups_of(shared: DataFrame) -> DataFrame:
    """(token, members, hub, sid): the sets of each group, one token for all that share the same sets; hub is the one with the smallest hash."""
    groups = shared.groupBy("token").agg(F.count("*").alias("members"), F.min("sid").alias("hub"), F.bit_xor(F.xxhash64("sid")).alias("code")).where("members > 1")
    groups = write_table(groups.groupBy("members", "hub", "code").agg(F.min("token").alias("token")).select("token", "members", "hub"), "prefix-groups")
    return lookup(shared, groups, ["token"], "members", ["sid"]).where("members is not null")


def open_rows(groups: DataFrame, labels: DataFrame, maps: DataFrame) -> DataFrame:
    """The members of groups with different labels, written: token, sid, n, maps, label, and whether a member asks.

    Members outside the group's largest label ask; they are compared with all that may be as large as they. Sizes fall into bands; a member
    whose band and the two beside it hold no other is similar to none of the group and left out. In large groups a member has one band
    (``band``, 0 in other groups) and a member that asks visits those beside it too (``bands``), if they hold any. Both are dealt into
    blocks of a band by hash, a task gets one block of each, so a large band is the work of many tasks.
    """
    labelled = groups.select("token", "sid").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    labelled = write_table(labelled, "labelled-groups")
    sizes = labelled.groupBy("token", "label").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("token").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    open_ = write_table(open_.select("token", "members", F.col("most.label").alias("most"), (F.col("members") - F.col("most.n")).alias("rest")), "open-groups")
    rows = lookup(labelled, open_, ["token"], "members", ["sid"]).where("most is not null")
    band = F.when(F.col("n") > 0, F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")).otherwise(0)
    rows = write_table(rows.join(maps.select("sid", "n"), "sid").withColumn("band", band), "banded-rows")
    held = rows.groupBy("token", "band").agg(F.count("*").alias("_m"), F.count_if(F.col("label") != F.col("most")).alias("_a"))
    bands = held.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("_m", "_a")))).alias("_bands"), F.sum("_m").alias("_all"))
    bands = write_table(bands, "group-bands")
    own, large = F.col("band"), F.col("rest") > BLOCK
    at = lambda b: F.try_element_at("_bands", b)
    about = lambda b, c: sum((F.coalesce(at(b + k)[c], F.lit(0)) for k in (-1, 0, 1)), F.lit(0))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    dealt = lambda b, n, parts: F.struct(b.alias("band"), F.struct(blocks(n).alias("blocks"), parts.alias("parts")).alias("of"))
    near = F.filter(F.array(*[own + k for k in (-1, 0, 1)]), lambda b: at(b).isNotNull())
    near = F.when(large, F.transform(near, lambda b: dealt(b, at(b)["_m"], blocks(about(b, "_a"))))).otherwise(F.array(dealt(F.lit(0), F.col("_all"), F.lit(1))))
    found = lookup(rows, bands, ["token"], "_all", ["sid"]).where(about(own, "_m") > 1)
    found = found.withColumns({"bands": near, "parts": F.when(large, blocks(about(own, "_a"))).otherwise(1), "band": F.when(large, own).otherwise(0)}).drop("_bands", "_all")
    out = write_table(found.join(maps.drop("n"), "sid"), "open-rows")
    drop_tables(labelled, open_, rows, bands)
    return out


def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of the groups whose members still have different labels, with these as ``now``; written."""
    now = rows.join(labels.select(F.col("node").alias("sid"), F.col("root").alias("_root")), "sid", "left").withColumn("now", F.coalesce("_root", "sid")).drop("_root")
    now = write_table(now, "labelled-rows")
    tokens = now.groupBy("token").agg(F.min("now").alias("_low"), F.max("now").alias("_high"), F.count("*").alias("_members")).where("_low <> _high")
    tokens = write_table(tokens, "live-groups")
    out = write_table(lookup(now, tokens, ["token"], "_members", ["sid"]).where("_low is not null").drop("_low", "_high", "_members"), "live-rows")
    drop_tables(now, tokens)
    return out


def other_pairs(rows: DataFrame, after: int, upto: int) -> DataFrame:
    """(a, b, more): pairs of a group that may be similar and carry different labels, of each asking member those from the ``after``-th on to the ``upto``-th.

    A member's candidates in a block (with other first labels) are in order of what the maps say of their distance, an order that
    doesn't change, so that in the end all are looked at. ``more`` is true in rows without a pair: a is a group some members of which have more, b the rows of a block of it.
    """
    deal = lambda n, salt: F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["token", "sid", "n", "label", "now", *MAPS, "hist"]
    mine = rows.withColumn("blocks", F.element_at(F.filter("bands", lambda b: b["band"] == F.col("band")), 1)["of"]["blocks"])
    members = mine.select(*own, "band", F.lit(False).alias("asks"), deal("blocks", 1).alias("block"), spread("parts").alias("part"))
    visiting = rows.where("label <> most").select(*own, F.explode("bands").alias("_b")).select(*own, F.col("_b.band").alias("band"), F.col("_b.of.blocks").alias("blocks"), F.col("_b.of.parts").alias("parts"))
    asking = visiting.select(*own, "band", F.lit(True).alias("asks"), spread("blocks").alias("block"), deal("parts", 2).alias("part"))
    key = ["token", "band", "block", "part"]
    dealt = members.union(asking).repartition(*key).sortWithinPartitions(*key)

    def compare(asks, sid, n, label, now, has, hist, maps) -> tuple[np.ndarray, np.ndarray, bool]:
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        step = max(1, (1 << 18) // max(1, len(m)))
        none = [np.zeros(0, np.int64)]
        out_a, out_b, more = [], [], False
        for s in (q[i : i + step] for i in range(0, len(q), step)):
            total, far = n[s, None] + n[None, m], np.zeros((len(s), len(m)), np.int64)
            for k in range(MAP_WORDS):
                far += np.bitwise_count(maps[k][s, None] ^ maps[k][None, m])
            near = similar((total - far) / 2, total, 0) & similar(np.minimum(n[s, None], n[None, m]), total, 0) & (label[s, None] != label[None, m])
            i, j = np.nonzero(near)
            apart = far[i, j]
            i, j = s[i], m[j]
            counted = np.flatnonzero(has[i] & has[j])
            for k in (counted[lo : lo + (1 << 12)] for lo in range(0, len(counted), 1 << 12)):
                a, b = i[k], j[k]
                apart[k] = np.maximum(apart[k], np.abs(hist[a].astype(np.int32) - hist[b].astype(np.int32)).sum(axis=1))  # of n + m shingles so many aren't common, at least
            keep = similar((n[i] + n[j] - apart) / 2, n[i] + n[j], 0)
            i, j, apart = i[keep], j[keep], apart[keep]
            order = np.lexsort((sid[j], apart, i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            more |= bool((place >= upto).any())
            keep = (place >= after) & (place < upto) & (now[i] != now[j])
            out_a.append(sid[i[keep]])
            out_b.append(sid[j[keep]])
        return np.concatenate(out_a or none), np.concatenate(out_b or none), more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
            values = [t.column(c).to_numpy() for c in key]
            rest = [t.column(c).to_numpy() for c in ("asks", "sid", "n", "label", "now")]
            counts = t.column("hist").combine_chunks()
            has, hist = counts.is_valid().to_numpy(zero_copy_only=False), np.zeros((len(t), BUCKETS), np.uint16)
            hist[has] = np.frombuffer(b"".join(counts.drop_null().to_pylist()), np.uint16).reshape(-1, BUCKETS)
            rest += [has, hist]
            maps = [t.column(m).to_numpy().view(np.uint64) for m in MAPS]
            cuts = [0, *(np.flatnonzero(np.logical_or.reduce([v[1:] != v[:-1] for v in values])) + 1).tolist(), len(values[0])]
            found = [compare(*(v[lo:hi] for v in rest), [m[lo:hi] for m in maps]) for lo, hi in zip(cuts, cuts[1:])]
            a, b = (np.concatenate(x) for x in list(zip(*found))[:2])
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)  # many groups hold the same pair
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy()), "more": pa.array(np.zeros(len(pairs), bool))})
            left = np.array([more for *_, more in found])
            token, size = values[0][cuts[:-1]][left], np.diff(cuts)[left]
            yield pa.RecordBatch.from_pydict({"a": pa.array(token), "b": pa.array(size, pa.int64()), "more": pa.array(np.ones(len(token), bool))})

        held: list[pa.RecordBatch] = []  # the rows of the block that is still open
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            same = np.logical_and.reduce([(v := b.column(c).to_numpy()) == v[-1] for c in key])
            if (cut := b.num_rows - int(same.sum())) or any(held[0].column(c)[0] != b.column(c)[0] for c in key):
                yield from emit(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held = [b.slice(cut)]
        if held:
            yield from emit(pa.Table.from_batches(held))

    return dealt.select(*key, "asks", "sid", "n", "label", "now", *MAPS, "hist").mapInArrow(freed(run), "a bigint, b bigint, more boolean").distinct()


def less_wide(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (written; a, b, n, m, far) less those that the wide maps of ``rows`` (sid, wide) rule out; far is then their distance."""
    wanted = write_table(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "wanted-maps")
    wide = rows.where("wide is not null").select("sid", "wide").join(small(wanted), "sid", "left_semi").groupBy("sid").agg(F.min("wide").alias("wide"))
    wide = write_table(wide, "wide-maps")
    side = lambda c: wide.select(F.col("sid").alias(c), F.col("wide").alias(f"_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, far = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "m", "far"))
            for k, (x, y) in enumerate(zip(b.column("_a"), b.column("_b"))):
                if x.is_valid and y.is_valid:
                    far[k] = max(far[k], maps_differ(x.as_py(), y.as_py()))
            keep = similar((n + m - far) / 2, n, m)
            out = [b.column("a").to_numpy(), b.column("b").to_numpy(), n, m, far]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in out], names=["a", "b", "n", "m", "far"])

    joined = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return joined.mapInArrow(freed(run), "a bigint, b bigint, n bigint, m bigint, far bigint")


def set_values(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(sid, found): the whole sets of the texts whose hash is in ``texts`` (th, one for each set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _texts(batches):
            yield pa.RecordBatch.from_pydict({"sid": _signed([_sid(s) for s in found]), "found": _lists(found)})

    # rows of one text are reduced to one before their sets are built
    rows = docs.select(F.xxhash64("text").alias("th"), "text").join(small(texts), "th", "left_semi").dropDuplicates(["th"])
    return rows.select("text").mapInArrow(freed(run), "sid bigint, found array<bigint>")


def verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b), written: the pairs (a, b, n, m) whose exact similarity reaches the limit."""
    pairs = write_table(pairs.select("a", "b", "n", "m"), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts = write_table(distinct.select("sid", "th").join(wanted, "sid", "left_semi").select("th"), "wanted-texts")
    values = write_table(set_values(docs, texts), "set-values")
    j = pairs.join(values.select(F.col("sid").alias("a"), F.col("found").alias("_a")), "a").join(values.select(F.col("sid").alias("b"), F.col("found").alias("_b")), "b")
    out = write_table(j.where(similar(F.size(F.array_intersect("_a", "_b")), F.col("n"), F.col("m"))).select("a", "b"), "similar-sets")
    drop_tables(pairs, texts, values)
    return out


def settle(pairs: DataFrame, labels: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``labels`` after all links among ``pairs`` (written, dropped): the best pairs of each set first, then only those whose labels still differ."""
    most = PICKS
    while True:
        label = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"_root_{c}"))
        open_ = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(F.coalesce("_root_a", "a") != F.coalesce("_root_b", "b")).select(*pairs.columns)
        open_ = write_table(open_, "open-candidates")
        drop_tables(pairs)
        if not open_.take(1):
            drop_tables(open_)
            return labels
        picked = write_table(best(open_, most), "picked")
        more = check(picked)
        pairs = write_table(open_.join(picked.select("a", "b"), ["a", "b"], "left_anti"), "other-candidates")
        drop_tables(open_, picked)
        if more.take(1):
            labels = write_table(components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "labels")
        most *= PICKS


def best(pairs: DataFrame, most: int) -> DataFrame:
    """For each b the pairs with the nearest maps."""
    place = F.row_number().over(Window.partitionBy("b").orderBy("far", "a"))
    return pairs.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, th, component_id, root) for each row of ``docs``: the smallest doc_id reachable over links of similar texts.

    Texts without words form one group. Null doc_ids and repeated rows keep their row, as in near_duplicates.
    """
    sets = write_table(shingle_sets(docs), "shingle-sets")
    firsts = [F.min(c).alias(c) for c in ("n", "fp", *MAPS, "hist")]  # the same in all rows of a set
    distinct = write_table(sets.groupBy("sid").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"), F.min("th").alias("th"), *firsts), "distinct-sets")
    shared = write_table(shared_tokens(sets), "shared-shingles")
    rows = write_table(sets.select("doc_id", "th", "sid", "wide"), "set-rows")
    drop_tables(sets)
    groups = write_table(groups_of(shared), "groups")
    drop_tables(shared)

    def filtered(pairs: DataFrame) -> DataFrame:
        """(a, b, n, m, far): the distinct pairs with both sizes and the distance of the maps, less those that these rule out."""
        side = lambda c, n: distinct.select(F.col("sid").alias(c), F.col("n").alias(n), *[F.col(m).alias(f"{c}_{m}") for m in MAPS])
        near = pairs.distinct().join(side("a", "n"), "a").join(side("b", "m"), "b").withColumn("far", _far()).where(_may_be_similar()).select("a", "b", "n", "m", "far")
        return less_wide(write_table(near, "near-maps"), rows)

    hubs = groups.where("hub <> sid").select(F.col("hub").alias("a"), F.col("sid").alias("b"))
    linked = verified(best(filtered(fingerprint_pairs(distinct).union(hubs)), 1), docs, distinct)
    labels = write_table(components(linked), "labels")
    rows_left = open_rows(groups, labels.withColumnsRenamed({"node": "sid", "root": "label"}), distinct.select("sid", "n", *MAPS, "hist"))
    drop_tables(groups)
    after, upto, more = 0, PICKS, True
    while more:
        live = still_open(rows_left, labels)
        drop_tables(rows_left)
        found = write_table(other_pairs(live, after, upto), "block-pairs")
        # only groups that have more candidates are dealt again
        left = write_table(found.where("more").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("_size")), "groups-left")
        more = bool(left.take(1))
        pairs = write_table(filtered(found.where("not more").select("a", "b")), "other-candidates")
        drop_tables(found)
        labels = settle(pairs, labels, lambda picked: verified(picked, docs, distinct))
        rows_left = write_table(lookup(live, left, ["token"], "_size", ["sid"]).where("_size is not null").drop("_size", "now"), "rows-left")
        drop_tables(live, left)
        after, upto = upto, (upto + 1) * PICKS if upto < BLOCK else 1 << 62
    drop_tables(rows_left)
    comp = labels
    named = distinct.join(comp, F.col("sid") == F.col("node"), "left").select("sid", "low", "rows", F.coalesce("root", "sid").alias("root"))
    low = write_table(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members")), "component-ids")
    named = write_table(lookup(named, low, ["root"], "members", ["sid"]).select("sid", "rows", "component_id", "root"), "set-components")
    drop_tables(distinct, low)
    return lookup(rows.drop("wide"), named, ["sid"], "rows", ["doc_id", "th"]).select("doc_id", "th", "component_id", "root")


def keep_one_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest doc_id (null last), then text hash; see keep_first."""
    return keep_first(docs, near_copies(docs))
