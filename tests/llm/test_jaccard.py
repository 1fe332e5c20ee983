"""The pipeline's near-copy stage against brute force over all pairs."""

import random

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from addrloom.llm import jaccard

N = "doc_id bigint, text string, n bigint, sid string"


def brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_pipeline_near_copies_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one two", "One  two", "two one", "a b c d e", "a b c d e f"]
    common = rng.sample(words, 40)
    for size in (12, 30, 60, 150, 400):
        for _ in range(6):
            base = rng.choices(words, k=size)
            for changed in (0, 0, 1, 1, 2, 3, size // 40, size // 25):
                copy = list(base)
                for at in rng.sample(range(size), changed):
                    copy[at] = rng.choice(words)
                texts.append(" ".join(copy[: size - rng.randrange(3)]))
            texts.append(" ".join(common + base[:20]))
    # a group of copies of which many pairs are about as similar as the limit
    base = rng.choices(words, k=150)
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    root = brute(texts)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], N)
    got = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root)) and got[0].sid == "x"
    assert corpus_pipeline.simhash_dedup(spark, docs.limit(0), "").count() == 0
    odd = spark.createDataFrame([(None, "a b c", 1, "x"), (None, "a b c", 1, "x"), (4, "p q", 1, "x"), (4, "p q", 1, "x"), (None, "p q", 1, "x")], N)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.simhash_dedup(spark, odd, "").collect()) == ["4", "None"]


def test_histograms_never_say_too_much():
    rng = np.random.default_rng(8)
    for n in (512, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 64, n + 50, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.85], rng.integers(0, 1 << 64, n // 6, dtype=np.uint64))))
        x, y = (np.frombuffer(jaccard.histogram(s), np.uint16).astype(int) for s in (a, b))
        apart = len(np.setxor1d(a, b))
        assert x.sum() == len(a) and np.abs(x - y).sum() <= apart
        other = np.unique(rng.integers(0, 1 << 64, n + 50, dtype=np.uint64))  # nothing in common: told apart
        z = np.frombuffer(jaccard.histogram(other), np.uint16).astype(int)
        assert not jaccard.similar((len(a) + len(other) - np.abs(x - z).sum()) / 2, len(a), len(other))
    assert jaccard.histogram(np.arange(511, dtype=np.uint64)) is None


def test_rounds_lose_no_link(spark, monkeypatch):
    """Small blocks and one candidate a round: a group whose members share a prefix, some similar, most not."""
    monkeypatch.setattr(jaccard, "PICKS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(70)]
    texts = []
    for k in range(26):
        own = [f"o{k}x{i}" for i in range(rng.randrange(14, 22))]
        texts.append(" ".join(passage + own))
    texts += [" ".join(passage + [f"c{i}" for i in range(k)]) for k in range(0, 17, 2)]  # a chain: neighbours are similar
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], N)
    seen = []
    old = jaccard.other_pairs
    monkeypatch.setattr(jaccard, "other_pairs", lambda rows, after, upto: seen.append((after, upto)) or old(rows, after, upto))
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert len(seen) > 1 and all(a[1] == b[0] for a, b in zip(seen, seen[1:]))


def test_large_groups_meet_by_size(spark, monkeypatch):
    """Members of a large group are repeated for the askers of their size, not for all of the group; sizes that may be similar still meet."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    sizes = [int(5 * 1.2**k) for k in range(40) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "sid bigint, n bigint").repartition(3)
    maps = rows.select("sid", "n", *[F.lit(0).cast("bigint").alias(m) for m in jaccard.MAPS], F.lit(None).cast("binary").alias("hist"))
    groups, labels = rows.select(F.lit(1).cast("bigint").alias("token"), "sid"), rows.limit(0).select("sid", F.col("sid").alias("label"))
    got = jaccard.open_rows(groups, labels, maps)
    assert got.count() == 80 and got.agg(F.sum("parts")).first()[0] <= 2 * 80  # 10 * 80 by the whole group
    found = jaccard.other_pairs(got.withColumn("now", F.col("label")), 0, 1 << 30).where("not more")
    want = {(a, b) for b in range(80) for a in range(b) if jaccard.similar(min(sizes[a], sizes[b]), sizes[a], sizes[b])}
    assert {(r.a, r.b) for r in found.collect()} == want


def test_members_without_company_are_not_dealt(spark):
    """A member to which no other of its group is near in size is left out; those of other groups stay."""
    sizes = [100, 118, 300, 600, 1000, 1200]
    rows = spark.createDataFrame(list(enumerate(sizes)), "sid bigint, n bigint").repartition(3)
    maps = rows.select("sid", "n", *[F.lit(0).cast("bigint").alias(m) for m in jaccard.MAPS], F.lit(None).cast("binary").alias("hist"))
    pairs = [(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (3, 5)]
    groups, labels = spark.createDataFrame(pairs, "token bigint, sid bigint"), rows.limit(0).select("sid", F.col("sid").alias("label"))
    got = jaccard.open_rows(groups, labels, maps)
    assert {(r.token, r.sid) for r in got.collect()} == {(1, 0), (1, 1), (3, 4), (3, 5)}
    found = jaccard.other_pairs(got.withColumn("now", F.col("label")), 0, 1 << 30)
    assert {(r.a, r.b, r.more) for r in found.collect()} == {(0, 1, False), (4, 5, False)}


def test_rounds_name_the_groups_that_have_more(spark):
    """Only groups whose members have more candidates than the round looks at are dealt again."""
    rows = spark.createDataFrame([(k, 100) for k in range(6)], "sid bigint, n bigint").repartition(3)
    maps = rows.select("sid", "n", *[F.lit(0).cast("bigint").alias(m) for m in jaccard.MAPS], F.lit(None).cast("binary").alias("hist"))
    groups = spark.createDataFrame([(7, 0), (7, 1), (7, 2), (7, 3), (8, 4), (8, 5)], "token bigint, sid bigint")
    got = jaccard.open_rows(groups, rows.limit(0).select("sid", F.col("sid").alias("label")), maps)
    found = jaccard.other_pairs(got.withColumn("now", F.col("label")), 0, 1).collect()
    assert {r.a for r in found if r.more} == {7} and (4, 5) in {(r.a, r.b) for r in found if not r.more}
