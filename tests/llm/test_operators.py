"""Each operator against brute force, round trips and its edge cases: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import base64
import hashlib
import io
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers

from addrloom.llm import jaccard, jpeg_media, langid, line_dedup, mixing, quality, simhash, sp_codec, token_store, url_filter, warc
from addrloom.llm.common import shared_dir, write_table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, h1 string, size string, sites int"
LONG = "the quick brown fox jumps over the lazy dog\n" * 6000
TEXTS = ["Hello world, this is a text.", None, "", " \n\t", "été à la plage", LONG, "Hello world, this is a text.", "日本語 text\x00 \U0001f600", "a" * 5000, "one two three four five six seven eight nine ten eleven"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["a", "b", None][i % 3], 1, 7, "x", "y", 3) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "a", None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_warc(spark):
    html = ["<p>x</p>", None, "", "<p>x</p>", "é" * 300_000, "<p>x</p>", "y"]
    pages = spark.createDataFrame([(i, [None, "http://a.b/ c\nd"][i % 2], h, "z") for i, h in enumerate(html)] + [(None, "u", "<p>x</p>", "z")], "page_id bigint, url string, html string, keep string")
    got = {r.page_id: r for r in warc.op1_warc(spark, pages).collect()}
    payload = {i: (h or "").encode() for i, h in enumerate(html)} | {None: b"<p>x</p>"}
    assert set(got) == set(payload)
    for i, p in payload.items():
        top = max(k for k, q in payload.items() if q == p and k is not None)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))
    assert all(r.digest_verified for r in got.values())
    assert warc.op1_warc(spark, pages.limit(0)).count() == 0


def test_revisits_are_verified_against_their_response(spark):
    rows = [("r1", "response", "D", 5, None, True), ("v1", "revisit", "D", 5, "r1", True), ("v2", "revisit", "E", 5, "r1", True), ("v3", "revisit", "D", 4, "r1", True),
            ("v4", "revisit", "D", 5, "gone", True), ("v5", "revisit", "F", 1, "r2", True), ("r2", "response", "F", 1, None, False), ("v6", "revisit", "D", 5, None, True)]
    rows = [(i, kind, "u", n, d, to, ok) for i, kind, d, n, to, ok in rows]
    got = {r.record_id: r.digest_verified for r in warc.verify_revisits(spark.createDataFrame(rows, warc.RECORDS.replace("long", "bigint"))).collect()}
    assert got == {"r1": True, "v1": True, "v2": False, "v3": False, "v4": False, "v5": False, "r2": False, "v6": False}


def test_warc_reader_checks_frames_and_digests():
    good = warc.build_record("urn:a", "http://x", b"payload" * 99999, None, "2026-01-01T00:00:00Z")
    found = list(warc.read_records(io.BytesIO(good + good), keep_payload=True))
    assert [r["payload"] for r in found] == [b"payload" * 99999] * 2
    raw = zlib.decompress(good, 31)
    for bad in (raw.replace(b"payload" * 3, b"PAYLOAD" * 3, 1), raw[:-9] + raw[-4:], raw[:-4], raw + b"x" * 10_000_000, b"x" * 10_000_000):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(zlib.compress(bad, wbits=31))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:-20])))


def test_line_dedup(spark, docs, empty):
    rows = [(i, f"common line\nown {i}\n\n common line ", f"s{i}") for i in range(14)] + [(50, "rare\ncommon line", "s0"), (51, None, "s1"), (52, "rare", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n", F.lit("x"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n) for r in line_dedup.remove_boilerplate(d).collect()}
    assert got[0] == ("common line\nown 0\n", 4, 1, "x")
    assert got[3] == ("own 3\n", 4, 2, "x") and got[50] == ("rare", 2, 1, "x") and got[51] == (None, 0, 0, "x") and got[52] == ("rare", 1, 0, "x")
    assert line_dedup.op2_line_dedup(docs).count() == docs.count() and line_dedup.op2_line_dedup(empty).count() == 0
    clash = d.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("n_lines", "n_removed", "_gone", "_doc", "a.b", "h`1", "pos", "first"))])
    cut = {r.doc_id: r for r in line_dedup.clean(clash).collect()}
    assert line_dedup.clean(clash).columns == clash.columns and cut[3].text == "own 3\n" and tuple(cut[3])[4:] == tuple(range(8))
    assert line_dedup.remove_boilerplate(clash).where("doc_id = 3").first().n_removed == 2


def test_line_dedup_near_threshold(spark):
    rows = [(k * 100 + i, f"line {k}", f"s{i}") for k in range(5, 16) for i in range(k)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id for r in line_dedup.remove_boilerplate(d).where("n_removed > 0").collect()}
    assert got == {k * 100 + i for k in range(10, 16) for i in range(1, k)}


def test_jpeg(spark, docs, empty):
    got = jpeg_media.op3_jpeg(docs).collect()
    assert len(got) == docs.count() and jpeg_media.op3_jpeg(empty).count() == 0
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        p = jpeg_media.pad((t or "").encode())
        assert len(p) % 192 == 0 and len(p) > 0
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert by[0].media_sha256 == by[6].media_sha256 and by[0].feature == by[6].feature


def test_jpeg_decoder_reads_other_layouts():
    """A grey image with zero runs, end-of-block codes and no restarts, against coefficients put in by hand."""
    dht = lambda k, syms: jpeg_media._segment(0xC4, bytes([k, *[0] * 3, len(syms), *[0] * 12, *syms]))
    bits = "0000" + "0000" + "0"  # placeholders below
    dc, ac = [0, 2, 3], [0x00, 0x01, 0x52, 0xF0]
    code = lambda table, s: format(table.index(s), "04b")
    bits = code(dc, 2) + "11" + code(ac, 0x01) + "0" + code(ac, 0x52) + "10" + code(ac, 0x00)  # DC 3, AC1 -1, five zeros, AC7 2, end
    bits += code(dc, 3) + "011" + code(ac, 0xF0) + code(ac, 0x01) + "1" + code(ac, 0x00)  # DC diff -4, sixteen zeros, AC17 1, end
    bits += "1" * (-len(bits) % 8)
    data = b"".join((b"\xff\xd8", jpeg_media._segment(0xDB, b"\0" + b"\x08" * 64), jpeg_media._segment(0xC0, b"\x08\0\x08\0\x10\x01\x01\x22\0"), dht(0, dc), dht(16, ac), jpeg_media._segment(0xDA, b"\1\1\0\0\x3f\0")))
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    p, (coefs,) = jpeg_media.decode([data + raw + b"\xff\xd9"])[0]
    want = np.zeros((2, 64), int)
    want[0, [0, 1, 7]], want[1, [0, 17]] = (3, -1, 2), (-1, 1)
    assert (coefs == want).all() and (p["width"], p["height"]) == (16, 8)
    assert jpeg_media.thumbnail(p, [coefs]).tolist() == [[131, 127]]
    with pytest.raises(ValueError):
        jpeg_media.parse(data.replace(b"\xff\xc0", b"\xff\xc2"))


def pixels(block, quant):
    """A block's 8 x 8 samples by the inverse cosine transform's definition, before they are clipped."""
    natural = np.zeros(64)
    natural[jpeg_media.ZIGZAG] = block * quant
    x, u = np.arange(8)[:, None], np.arange(8)[None]
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, 1 / np.sqrt(2), 1) / 2
    return basis @ natural.reshape(8, 8) @ basis.T + 128


def test_jpeg_in_several_scans_and_its_thumbnail():
    """Three components in scans of their own, luminance at twice the resolution; the thumbnail is the mean of each block's pixels."""
    rng = np.random.default_rng(4)
    values = jpeg_media.VALUE_OF_BYTE.astype(int)
    table = bytes(sum(n == k for n in jpeg_media.CODE_BITS) for k in range(1, 17)) + bytes(range(1, 9))
    quant = rng.integers(1, 9, 64)
    head = b"\xff\xd8" + jpeg_media._segment(0xDB, b"\0" + bytes(quant.tolist())) + jpeg_media._segment(0xC0, b"\x08\0\x1c\0\x2c\x03\x01\x22\0\x02\x11\0\x03\x11\0") + jpeg_media._segment(0xC4, b"\0" + table + b"\x10" + table)
    sizes, blocks = [24, 6, 6], []  # 44 x 28 pixels: 6 x 4 blocks of luminance, 3 x 2 of colour
    for c, n in enumerate(sizes, 1):
        data = rng.integers(0, 60, (n, 64))
        bits = "".join(format(int(jpeg_media.BITS[b]), f"0{jpeg_media.LENGTHS[b]}b") for b in data.reshape(-1))
        bits += "1" * (-len(bits) % 8)
        head += jpeg_media._segment(0xDA, bytes([1, c, 0, 0, 63, 0])) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
        found = values[data]
        found[:, 0] = np.cumsum(found[:, 0])
        blocks.append(found)
    image = head + b"\xff\xd9"
    p, coefs = jpeg_media.decode([image])[0]
    assert (p["width"], p["height"]) == (44, 28) and all((a == b).all() for a, b in zip(coefs, blocks))
    want = np.array([pixels(b, quant).mean() for b in blocks[0]]).reshape(4, 6)
    assert abs(jpeg_media.thumbnail(p, coefs) - np.clip(want, 0, 255)).max() < 0.5 + 1e-9 and jpeg_media.payload(p, coefs) is None
    thumb = rng.integers(0, 256, (19, 11)).astype(np.uint8)
    cut = [[thumb[19 * i // 8 : 19 * (i + 1) // 8, 11 * j // 8 : 11 * (j + 1) // 8].mean() for j in range(8)] for i in range(8)]
    assert jpeg_media.thumb_hash(thumb) == np.packbits((np.array(cut) > np.mean(cut)).reshape(-1)).tobytes().hex()


def test_jpeg_bad_images_keep_their_rows(spark, monkeypatch):
    texts = [bytes(np.random.default_rng(k).integers(0, 256, 400 * k, dtype=np.uint8)) for k in range(1, 30)]
    good = jpeg_media.encode(texts)
    for chunk in (700, 5000):  # long texts and images are cut into runs of restart segments
        monkeypatch.setattr(jpeg_media, "ENCODE_CHUNK", chunk)
        monkeypatch.setattr(jpeg_media, "DECODE_CHUNK", chunk)
        monkeypatch.setattr(jpeg_media, "PAYLOAD_STEP", chunk // 100)
        assert jpeg_media.encode(texts) == good
        assert [jpeg_media.payload(*x) for x in jpeg_media.decode(good)] == [(len(t), jpeg_media.pad(t)) for t in texts]
    whole = good[5]
    rows = [(1, whole), (2, whole[: len(whole) // 2]), (3, whole[: len(whole) // 2] + b"\xff\xd9"), (4, b"no image"), (5, None), (6, whole.replace(b"\xff\xc0", b"\xff\xc2")), (None, good[6]), (7, whole[:30] + bytes(200))]
    got = jpeg_media.read_media(spark.createDataFrame(rows, jpeg_media.MEDIA)).collect()
    assert {r.doc_id for r in got if r.error is None} == {1, None} and len(got) == len(rows)
    assert all((r.thumb_hash is None) == (r.error is not None) and r.media_sha256 for r in got)


def brute_mix(rows):
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    by = defaultdict(list)
    for i, _, s in rows:
        by[s].append(i)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in by[s]) for s in names}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            return size, total, target | share, by
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.discard(s)
    return size, total, target, by


def test_mix(spark, docs, empty):
    rows = [(i, "w " * (i % 13), ["a", "b", "c", "d", None, "a", "a"][i % 7]) for i in range(400)] + [(900, None, "b")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("target", F.lit("clash")).withColumn("slot", F.lit(1))
    size, total, target, by = brute_mix(rows)
    got = {r.doc_id: r for r in mixing.op4_mix(d).collect()}
    source = {i: s for s, m in by.items() for i in m}
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], total[source[i]]) and abs(r.target - target[source[i]]) < 1e-6 and r.taken in (0, size[i], 2 * size[i])
    for s, members in by.items():
        assert abs(sum(got[i].taken for i in members) - target[s]) <= 6.01
    again = {r.doc_id: r.taken for r in mixing.op4_mix(d.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.op4_mix(docs).count() == docs.count() and mixing.op4_mix(empty).count() == 0
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: r.taken // r.size for i, r in got.items() if r.taken})


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, empty):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50)]
    texts = []
    for g in range(12):
        base = list(rng.choice(words, 150))
        for _ in range(9):
            t = list(base)
            for _ in range(rng.integers(0, 3)):
                t[rng.integers(150)] = "new"
            texts.append(" ".join(t))
    texts += ["", None, "one", "One", "one two"]
    fps = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = {r.doc_id: r for r in simhash.op5_simhash(d).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == root
    assert sorted(r.doc_id for r in simhash.keep_one(d).collect()) == sorted(set(root))
    assert simhash.op5_simhash(docs).count() == docs.count() and simhash.op5_simhash(empty).count() == 0


def in_gray_order(codes):
    gray = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    return codes[np.argsort(gray)]


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    codes = in_gray_order(np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) for b in base])))
    for radius in (0, 2, 5):
        want = {(i, j) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= radius) + i + 1}
        found = [(int(i), int(j)) for a, b in simhash.GrayIndex(codes).search(codes, radius, np.arange(len(codes))) for i, j in zip(a, b)]
        assert len(found) == len(want) and set(found) == want
    # over shared patterns: every group that holds a near code is found
    at = np.arange(0, len(codes), 50)
    upper = simhash.GrayIndex(np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at))
    found = {(int(i), int(j)) for a, b in upper.search(codes, 2) for i, j in zip(a, b)}
    assert {(i, j // 50) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 2)} <= found
    for n in range(12):
        one = in_gray_order(codes[:n].copy())
        assert sum(len(i) for i, _ in simhash.GrayIndex(one).search(one, 64)) == n * n


def test_gray_index_prunes_real_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    codes = in_gray_order(np.unique(np.array([r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()], np.int64)).view(np.uint64))
    index = simhash.GrayIndex(codes)
    list(index.search(codes, 2, np.arange(len(codes))))
    assert len(index.levels) > 3 and index.pruned > index.opened > 0
    assert index.compared < 0.4 * len(codes) ** 2 / 2  # of so few; the share falls as they get more


def test_links_over_many_nodes(spark):
    """Nodes of 20 fingerprints, most visited by others' fingerprints, give the components of all pairs."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    flips = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    codes = np.unique(np.concatenate([b ^ flips(12) ^ flips(12) ^ flips(12) for b in base]))
    root = np.arange(len(codes))
    for i in range(len(codes)):
        near = np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 2)
        simhash.unite(root, np.full(len(near), i), near)
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp bigint")
    want = {frozenset(codes.view(np.int64)[root == r].tolist()) for r in set(root.tolist()) if (root == r).sum() > 1}
    for nodes in (20, 10_000):
        sets = defaultdict(set)
        for r in simhash.components(simhash.links(fps, 2, node_codes=nodes)).collect():
            sets[r.root] |= {r.node, r.root}
        assert {frozenset(s) for s in sets.values()} == want


def test_one_row_of_each_component_stays(spark):
    """Null and repeated ids lose no row that isn't linked with another; repeated rows are one."""
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4])]
    make = lambda rows: spark.createDataFrame([(i, t, "s", "clash", 3) for i, t in rows], "doc_id bigint, text string, source string, root string, `_th.x` int")
    for keep in (simhash.keep_one, jaccard.keep_one_similar):
        assert sorted(map(str, keep(make(rows)).collect())) == sorted(map(str, make(rows).collect()))
        got = keep(make(rows + rows + [(None, texts[4]), (6, texts[0])])).select("doc_id", "text").collect()
        assert sorted(map(str, got)) == sorted(map(str, make([(6, texts[0]), *rows[1:]]).select("doc_id", "text").collect()))
        assert keep(make(rows).limit(0)).count() == 0


def test_url_filter(spark):
    urls = ["http://a.example.com/en/1", "https://EXAMPLE.com/en/7?x", "ftp://x.net/de/#f", "http://example.net/de/88", "http://z.org/es", "http://z.org/es/", None, "no scheme", "http://netx/de/", "a://b://c/d", "http://h?x://y/z", ""]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[0], "h"), (0, urls[0], "h")], "page_id bigint, url string, rule string")
    got = {r.page_id: r for r in url_filter.op6_url_filter(spark, pages, listed=spark.createDataFrame([(h,) for h in ("z.org", "netx", "", "b:", None, "z.org", "not.there")], "host string")).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["com/en/", "example.com/en/7", "net/de/", "example.net/de/8", None, "org/es/", None, None, None, None, None, None]
    assert [got[i].verdict for i in range(len(urls))] == ["block", "allow", "block", "allow", "block", "block", "allow", "allow", "block", "block", "allow", "allow"]
    assert (got[1].host, got[1].path, got[9].host, got[9].path, got[10].host, got[10].path) == ("example.com", "/en/7", "b:", "//c/d", "h", "")
    assert url_filter.op6_url_filter(spark, pages.limit(0)).count() == 0


def test_url_filter_deals_a_hot_host_over_tasks(spark, monkeypatch):
    """A third of the pages on one host, many shards: the answers stay exact and the host's rows are in many partitions."""
    hosts = [f"h{i}.com" for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://{'hot.org' if i % 3 == 0 else hosts[i % 300]}/p{i}") for i in range(3000)], "page_id bigint, url string")
    rows = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    keys = rows.select(F.col("host").alias("key")).distinct().withColumn("listed", F.md5("key") > "8")
    folder = shared_dir(spark, "test-cascade")
    shards, manifest = url_filter.write_cascades(keys, folder, shard_keys=20)
    assert shards > 4 and manifest.agg(F.sum("keys")).first()[0] == 201
    judged = url_filter.is_listed(rows, "host", folder, shards, ("page_id",), held=4).withColumn("p", F.spark_partition_id())
    assert judged.where(F.col("listed") != (F.md5("host") > "8")).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert judged.where("host = 'hot.org'").select("p").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with pytest.raises(ValueError):
        url_filter.build_cascade(np.array([5, 5], np.uint64), np.array([7, 7], np.uint64), np.array([True, False]))


def test_cascade_is_exact():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 1 << 63, (2, 50_000), dtype=np.uint64)
    for share in (0, 0.001, 0.1, 0.5, 0.9, 1):
        listed = rng.random(50_000) < share
        levels = url_filter.unpack(url_filter.pack(url_filter.build_cascade(h1, h2, listed)))
        assert (url_filter.in_cascade(levels, h1, h2) == listed).all()


def test_sentencepiece_equals_the_library(spark, docs, empty):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp_codec.MODEL))
    odd = ["  a   b ", "▁▁ x", "\n\n", "<s> <unk>", "x" * 300, "日本語のテキスト", " " * 40]
    c = sp_codec.codec()
    for t in [t or "" for t in TEXTS] + odd:
        assert c.encode(t).tolist() == lib.encode(t)
        assert c.decode(c.encode(t)) == t.replace("▁", " ")
    got = {r.doc_id: r for r in sp_codec.op7_sentencepiece(docs).collect()}
    assert all(got[i].decoded_equal and got[i].n_tokens == len(lib.encode(t or "")) for i, t in enumerate(TEXTS))
    assert sp_codec.op7_sentencepiece(empty).count() == 0


def test_bpe_relaxation_over_the_tables_chunks(spark, monkeypatch):
    """Each chunk of the documents goes through the relaxation, and what it gives is the encoding by definition."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    c = sp_codec.PieceCodec.load(public_tokenizers.path(sp_codec.MODEL))
    ids = [c.encode(t).tolist() for t in texts]
    n, relaxed = len(c.known), c.relaxed
    assert n > 1000 and relaxed > 2 * n
    for chunk in list(c.known)[::7]:
        before = c.relaxed
        got = c._segment(chunk)
        assert got == c._by_definition(chunk) and c.relaxed - before >= len(got)
    monkeypatch.setattr(sp_codec, "LONG", 50)  # chunks of long texts are taken some at a time
    assert [c.encode(t).tolist() for t in texts] == ids
    c.cache = 10
    assert [c.encode(t).tolist() for t in texts] == ids and len(c.known) < n


def test_unigram_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    pieces = [("<unk>", 0.0, 2)] + [(p, -float(rng.random() * 5 + 1), 1) for p in ("▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "bca")]
    c = sp_codec.PieceCodec(pieces, sp_codec.UNIGRAM)
    score = {p: s for p, s, t in pieces if t == 1}

    def best(s):
        return 0.0 if not s else max(score[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in score)

    for _ in range(50):
        t = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
        assert abs(sum(c.score[i] for i in c.encode(t)) - best("▁" + t)) < 1e-9


def test_language_id(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.op8_language_id(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.98
    got = {x.doc_id: x for x in langid.op8_language_id(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and all(0 <= x.score <= 1 for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items() if i is not None)
    assert langid.op8_language_id(empty).count() == 0 and langid.keep_known(docs).columns == docs.columns


def brute_language(counts, langs, text):
    """The score by its definition, from (language, word) counts, in plain loops."""
    grams = [Counter() for _ in range(6)]
    for (lang, word), n in counts.items():
        for k in range(1, 6):
            padded = f" {word} " if k > 1 else word
            for i in range(len(padded) - k + 1):
                grams[k][lang, padded[i : i + k]] += n
    log = lambda table, lang, key: np.log((table[lang, key] + 0.1) / (sum(n for (a, _), n in table.items() if a == lang) + 1))
    known = lambda table, key: any(table[lang, key] for lang in langs)
    words, open_ = [], False
    for c in text.lower():  # a letter begins or goes on, a mark or joiner only goes on
        kind = unicodedata.category(c)[0]
        goes_on = open_ and (kind in "LM" or c in "\u200c\u200d")
        if goes_on:
            words[-1] += c
        elif kind == "L":
            words.append(c)
        open_ = goes_on or kind == "L"
    total = dict.fromkeys(langs, 0.0)
    for w in words:
        for lang in langs:
            if known(counts, w):
                total[lang] += log(counts, lang, w)
                continue
            for k in range(5, 0, -1):
                padded = f" {w} " if k > 1 else w
                own = [g for g in (padded[i : i + k] for i in range(len(padded) - k + 1)) if known(grams[k], g)]
                if own:
                    total[lang] += np.mean([log(grams[k], lang, g) for g in own])
                    break
    p = {lang: x / len(words) * min(len(words), langid.EVIDENCE) for lang, x in total.items()}
    best = max(p, key=p.get)
    return best, 1 / sum(np.exp(x - p[best]) for x in p.values())


def test_language_scores_against_brute_force(spark):
    nfd = lambda t: unicodedata.normalize("NFD", t)
    texts = [("en", "the cat sat on the mat and the dog"), ("en", "there is a house on the hill"), ("de", "der Hund und die Katze auf dem Haus"), ("fr", "le chat est sur la table été"), ("de", "ein Haus am Berg"),
             ("fr", nfd("été à la forêt où naît l'hérisson")), ("hi", "हिन्दी में यह वाक्य लिखा गया है"), ("mr", "मराठी मध्ये हे वाक्य लिहिले आहे"), ("hi", "क्षेत्र र्\u200dय और किताब"), ("ja", "日本語の文章です")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts * 4)] + [(99, "nothing learned here", None)], "doc_id bigint, text string, lang string")
    seen = [(lang, t) for i, (lang, t) in enumerate(texts * 4) if zlib.crc32(str(i).encode()) % 3 != 1]
    split = lambda t: re.findall(r"[^\s']+", t.lower())  # noqa: E731  these texts have no other separators
    counts = Counter((lang, w) for lang, t in seen for w in split(t))
    model = langid.fit(docs, max_docs=10_000)
    assert model.langs == sorted({lang for lang, _ in seen}) and len(model.words.keys) == len({w for _, w in counts})
    asked = ["the cat", "die Katze sat", "chats tables unter", "xyzzy the", "q", "Hausboot am See the mat est " * 9, "हिन्दी वाक्य", "मराठी वाक्य लिहिले", nfd("l'été naît"), "été naît", "क्ष", "日本", "1 \u0301 2", "\u0301\u0301a\u0301", "x" * 3000, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id bigint, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows, model).collect()}
    for i, t in enumerate(asked):
        if t is None or not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        want, score = brute_language(counts, model.langs, t)
        assert got[i][0] == want and abs(got[i][1] - score) < 1e-4, t
    assert got[6][0] == "hi" and got[7][0] == "mr" and got[8][0] == "fr"
    known, _ = model.words.find(langid.word_keys(langid.pa.array(["हिन्दी", nfd("été"), "ह"])))
    assert known.tolist() == [True, True, False]  # whole words, marks included


def test_steps_do_not_change_language_scores(spark, docs, monkeypatch):
    rows = docs.select("doc_id", langid.words_of(F.col("text")).alias("w")).toArrow()
    model = langid.Model([("en", "quick", 3), ("en", "brown", 2), ("fr", "plage", 1), ("fr", "à", 5)])
    words = rows.column("w").combine_chunks()
    want = model.predict(words)
    monkeypatch.setattr(langid, "STEP", 7)
    got = model.predict(words)
    assert got[0] == want[0] and np.allclose(got[1], want[1])
    assert langid.Model([]).predict(words)[0] == ["und"] * len(words)


def test_repeats_of_long_texts_are_counted_alike(monkeypatch):
    rng = np.random.default_rng(6)
    for _ in range(200):
        words = [bytes([97 + x]) for x in rng.integers(0, rng.integers(1, 6), rng.integers(5, 60))]
        assert quality._repeat_words_of_many(words, 5) == quality.repeat_words(words)


def brute_quality(t):
    words = (t or "").encode().split()
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup, met = (t or "").split("\n"), 0, set()
    for x in lines:
        dup += bool(x.strip(" \t\n\v\f\r")) and x in met
        met.add(x)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), dup, len(inside)


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality.op9_quality(docs).collect()}
    for i, t in enumerate(TEXTS):
        r, want = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and (not r.base_failed or not r.kept)
    assert got[9].kept and quality.op9_quality(empty).count() == 0
    press = quality.zstandard.ZstdCompressor(level=quality.LEVEL)
    rng = np.random.default_rng(0)
    assert not quality.band_verdict(rng.bytes(5000), press)[0] and not quality.band_verdict(b"abc " * 3000, press)[0]


def test_token_store(spark, docs, empty):
    lib = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    got = token_store.op10_token_store(spark, docs).collect()
    want, start = [], 0
    for i, t in sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    # rows of one doc_id follow one another by their texts' hash: as sets of (doc_id, n_tokens, crc) and as starts they are the same
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), n, c) for i, _, n, c in want)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist() and [str(r.doc_id) for r in got] == [str(w[0]) for w in want]
    assert token_store.op10_token_store(spark, empty).count() == 0


def test_token_store_random_access_and_other_tokenizers(spark, docs, tmp_path, monkeypatch):
    lib = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    folder = shared_dir(spark, "test-ids")
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    hot = rows.union(spark.range(3000).select(F.lit(5).cast("bigint"), F.concat(F.lit("hot "), "id"), *[F.lit(None)] * (len(rows.columns) - 2)))
    manifest = token_store.write_store(hot, folder)
    files = manifest.orderBy("file").collect()
    assert sum(f.docs for f in files) == hot.count() and max(f.docs for f in files) < 1500  # a hot doc_id is dealt out
    store, base = token_store.fs.FileSystem.from_uri(folder)
    trained = store.open_input_stream(f"{base}/ids.dict", compression=None).read()
    texts = {r.doc_id: r.text for r in rows.collect()}
    for f in files:
        one = token_store.StoreFile(store, f.path, trained)
        whole = [x.tolist() for _, found in one.scan() for x in found]
        monkeypatch.setattr(token_store, "READ_BYTES", 100)
        assert [x.tolist() for _, found in one.scan() for x in found] == whole
        for k, e in enumerate(one.index):
            assert one.ids(k).tolist() == whole[k]
            if e["doc"] != 5:
                assert whole[k] == lib.encode(texts[int(e["doc"])] or "", add_special_tokens=False).ids + [2]
    with pytest.raises(ValueError):
        token_store.StoreFile(store, files[0].path, b"another dictionary")
    data = bytes(range(256)) * 400
    assert len(token_store._pieces(data, 2)) == token_store.SAMPLE_BYTES and token_store._pieces(data, 2).endswith(data[-2:]) and token_store._pieces(data[:99], 2) == data[:99]
    # one normalisation step more: no shortcut by words
    accents = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase(), normalizers.NFD(), normalizers.StripAccents()])
    other = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    other.normalizer = accents
    other.save(str(tmp_path / "other.json"))
    assert token_store.tokenizer().by_word
    own = token_store.WordTokenizer(str(tmp_path / "other.json"))
    assert not own.by_word and own.encode(["été plage".encode()]) == [np.array(other.encode("été plage").ids, own.type).tobytes()]


def brute_lines(rows, min_sites=10):
    """(doc_id, text, source) rows with cross-site lines cut, by plain sets."""
    sites, first = defaultdict(set), {}
    for i, t, site in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((t or "").split("\n")):
            if (k := line.strip(" ")) and t is not None:
                sites[k] |= {site} - {None}
                first.setdefault(k, (i, pos))
    gone = lambda i, pos, k: k and len(sites[k]) >= min_sites and first[k] != (i, pos)
    return [(i, None if t is None else "\n".join(x for pos, x in enumerate(t.split("\n")) if not gone(i, pos, x.strip(" "))), site) for i, t, site in rows]


def test_pipeline_against_a_plain_chain(spark):
    """Every stage again in loops over all rows and pairs; only the language model is the operator's own, tested by itself."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mix_sources", "sentencepiece"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = [(r.doc_id, r.text, r.source) for r in langid.predict(docs, langid.fit(docs)).collect() if r.lang_pred != "und" and r.score >= 0.35]
    kept = brute_lines(kept)
    sets = []
    for _, t, _ in kept:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    root = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    best = {}
    for (i, t, site), r in zip(kept, root):
        best[r] = min(best.get(r, (i, t, site)), (i, t, site))
    kept = list(best.values())
    size, total, target, by = brute_mix(kept)
    text = {i: t for i, t, _ in kept}
    want = Counter()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp_codec.MODEL))
    for s, members in by.items():
        order = lambda i: hashlib.md5(":".join([str(i), *([hashlib.md5(text[i].encode()).hexdigest()] if text[i] is not None else [])]).encode()).hexdigest()
        before = 0
        for i in sorted(members, key=order):
            times = sum(size[i] > 0 and 2 * (p * total[s] + before) + size[i] <= 2 * target[s] for p in range(2))
            before += size[i]
            if times:
                ids = lib.encode(text[i])
                want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] = times
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert all(r.decoded_equal for r in out)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want


def test_stages_take_columns_of_any_name(spark):
    """Nulls, clashing and dotted names, repeated rows and an empty table through every stage."""
    import corpus_pipeline

    rows = [(i, f"the shared line of all\nthe words of text {i} are here and there and it goes on for a while {i % 7}", ["en", None][i % 2], f"s{i % 12}", 5) for i in range(40)]
    rows += [(None, None, None, None, None), (None, "the words of a text without an id", "en", None, 1), rows[0], (7, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("n_removed", "_gone", "a.b", "root", "_th", "_id", "lang_pred", "size", "_at", "token", "h`1"):
        docs = docs.withColumn(c, F.lit(1))
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        docs = write_table(stage(spark, docs, ""), f"test-{name}")
        assert empty.count() == 0 and docs.count() > 0
        assert docs.columns == empty.columns and (name == "sentencepiece" or docs.columns == cols)
