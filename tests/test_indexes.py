"""Ranges as tree nodes, running sums, interval counts, the log's ids and back-scans against brute force."""

import random

from pyspark.sql import functions as F

from addrloom.functions import spans
from addrloom.operators import backfill, coverage, maintenance, orphans, sums
from addrloom.streaming import audit


def test_nodes_are_exactly_the_range(spark):
    rnd = random.Random(1)
    cases = [(0, 0), (5, 4), (-20, 300), (15, 16), (0, 255), (1, 4096), (-5000, -4990), *((a := rnd.randrange(-3000, 3000), a + rnd.randrange(2000)) for _ in range(40))]
    rows = spark.createDataFrame(cases, "lo bigint, hi bigint").select("lo", "hi", spans.nodes(F.col("lo"), F.col("hi")).alias("n")).collect()
    for r in rows:
        held = [v for x in r.n for v in range(x.node << 4 * x.level, x.node + 1 << 4 * x.level)]
        assert sorted(held) == list(range(r.lo, r.hi + 1))
    big = spark.sql("SELECT 1L AS lo, 100000000L AS hi").select(F.size(spans.nodes(F.col("lo"), F.col("hi"))).alias("k")).first().k
    assert big <= 30 * 7
    up = spark.sql("SELECT -17L AS n").select(spans.above(F.col("n"), 3).alias("a")).first().a
    assert [(x.level, x.node) for x in up] == [(k, -17 >> 4 * k) for k in range(4)]


def test_hits_and_lookups_of_long_ranges(spark):
    rnd = random.Random(2)
    ranges = [(f"c{i}", rnd.choice("AB"), lo := rnd.randrange(-5, 400), lo + rnd.choice([-3, 0, 1, 2, 7, 20, 301])) for i in range(60)] + [("long", "A", 1, 99_999_999), ("longer", "B", 2, 200_000_001)]
    feats = [(rnd.choice("AB"), rnd.choice([str(rnd.randrange(450)), "12A", "007", f"{rnd.randrange(400)};{rnd.randrange(400)}", ""])) for _ in range(200)]
    found = coverage.range_hits(spark.createDataFrame(ranges, "candidate_id string, street_norm string, lo_num bigint, hi_num bigint"), spark.createDataFrame(feats, "street_norm string, housenumber string")).collect()
    known = {s: {int(t) for st, h in feats if st == s for t in h.split(";") if t.isdigit() and str(int(t)) == t} for s in "AB"}
    want = {i: (s, lo, hi) for i, s, lo, hi in ranges if lo <= hi}
    assert {r.candidate_id for r in found} == set(want)
    for r in found:
        s, lo, hi = want[r.candidate_id]
        step = 2 if (hi - lo) % 2 == 0 else 1
        hits = sorted(n for n in known[s] if lo <= n <= hi and (n - lo) % step == 0)
        assert (r.hits, r.total) == (len(hits), (hi - lo) // step + 1)
        assert len(r.missing) <= len(hits) + 1 and sum((m.last - m.first) // step + 1 for m in r.missing) == r.total - r.hits
        if r.total < 1000:
            assert [n for m in r.missing for n in range(m.first, m.last + 1, step)] == [n for n in range(lo, hi + 1, step) if n not in hits]

    src = "number string, street string, lo_num int, hi_num int, lo_num_suf string, hi_num_suf string"
    rows = [("1-99999999", "Oak St", 1, 99_999_999, None, None), ("4-5", "Oak St", 4, 5, None, None), ("7", "Oak St", 7, 7, None, None), ("7A", "Oak St", 7, 7, "A", None)]
    index = orphans.source_index(spark.createDataFrame(rows, src))
    assert index.count() < 220
    asked = spark.createDataFrame([("OAK ST", t) for t in ("1", "2", "4", "7", "7A", "07", "99999999", "100000001", "x")] + [("ELM ST", "7")], "street_norm string, token string")
    assert {r.token: r.n_rows for r in orphans.index_counts(index, asked).collect()} == {"1": 1, "4": 1, "7": 3, "7A": 1, "99999999": 1}


def test_ordered_sums(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(40), i, rnd.randrange(-3, 9)) for i in range(3000)]
    got = sums.ordered(spark.createDataFrame(rows, "k int, i int, v bigint").repartition(7), [F.col("k"), F.col("i")], {"before": "v"}).collect()
    total = 0
    for rank, (r, want) in enumerate(zip(sorted(got), sorted(rows)), 1):
        assert (r.k, r.i, r["rank"], r.before) == (want[0], want[1], rank, total)
        total += want[2]
    assert sums.ordered(spark.createDataFrame([], "k int"), [F.col("k")]).count() == 0


def test_counts_between(spark):
    rnd = random.Random(4)
    points = [(rnd.randrange(3), rnd.randrange(50), rnd.randrange(4)) for _ in range(400)]
    intervals = [(i, rnd.randrange(4), lo := rnd.randrange(-2, 52), lo + rnd.randrange(0, 60)) for i in range(300)]
    got = {r.key: r.n for r in sums.counts_between(spark.createDataFrame(points, "grp bigint, at int, n bigint"), spark.createDataFrame(intervals, "key int, grp bigint, low int, high int"), "key").collect()}
    assert got == {i: sum(n for g2, at, n in points if g2 == g and lo < at <= hi) for i, g, lo, hi in intervals}


def test_maintenance_windows(spark):
    rnd = random.Random(5)
    rows = [(f"i{rnd.randrange(60)}", a := rnd.randrange(1, 10), rnd.randrange(a, 11), rnd.choice(["1", "2", None]), rnd.choice(["A", "B"])) for _ in range(150)]
    windows = [(i, lo := rnd.randrange(0, 10), rnd.randrange(lo, 12)) for i in range(80)]
    src = spark.createDataFrame(rows, "identity_key string, min_snapshot_id int, max_snapshot_id int, number string, street string")
    got = {r.run_id: (r.new_count, r.retired_count) for r in maintenance.window_counts(src, spark.createDataFrame(windows, "run_id int, low int, high int")).collect()}
    first, last = {}, {}
    for k, a, b, *_ in rows:
        first[k], last[k] = min(first.get(k, 99), a), max(last.get(k, 0), b)
    want = {}
    for i, lo, hi in windows:
        new = sum(b == hi and first[k] > lo for k, a, b, *_ in rows)
        gone = sum(b == last[k] and lo <= last[k] < hi and not any(b2 == hi and n is not None and n2 == n and s2 == s and k2 != k for k2, _, b2, n2, s2 in rows) for k, a, b, n, s in rows)
        want[i] = (new, gone)
    assert got == want


def test_many_windows_are_one_sweep(spark):
    src = spark.range(3000).selectExpr("CAST(id AS STRING) AS identity_key", "CAST(id % 900 AS INT) AS min_snapshot_id", "CAST(id % 900 + id % 7 AS INT) AS max_snapshot_id", "CAST(id AS STRING) AS number", "'A' AS street")
    windows = spark.range(100_000).selectExpr("id AS run_id", "CAST(id % 500 AS INT) AS low", "CAST(id % 500 + id % 300 AS INT) AS high")
    out = maintenance.window_counts(src, windows)
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString() and "CartesianProduct" not in out._jdf.queryExecution().toString()
    r = out.where("run_id = 40123").first()
    rows = [(i, i % 900, i % 900 + i % 7) for i in range(3000)]
    low, high = 40123 % 500, 40123 % 500 + 40123 % 300
    assert (r.new_count, r.retired_count) == (sum(b == high and a > low for _, a, b in rows), sum(low <= b < high for *_, b in rows))
    assert out.count() == 100_000


def test_log_ids_have_no_gap_and_replays_add_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = lambda lo, hi: spark.createDataFrame([(i % 5, f"e{i}") for i in range(lo, hi)], "ts int, what string").repartition(6)
    for number, (lo, hi) in enumerate([(0, 700), (700, 700), (700, 1500), (1500, 1600)]):
        audit.append_batch(rows(lo, hi), number, path, ["ts", "what"])
    audit.append_batch(rows(700, 1500), 2, path, ["ts", "what"])  # once more
    log = spark.read.parquet(f"{path}/events").orderBy("event_id").collect()
    assert [r.event_id for r in log] == list(range(1, 1601)) and len({r.what for r in log}) == 1600
    assert [(r.ts, r.what) for r in log[700:1500]] == sorted((i % 5, f"e{i}") for i in range(700, 1500))
    old = spark.createDataFrame([(9, 1, "a"), (4, 1, "b")], "event_id bigint, ts int, what string")
    got = audit.append(old, rows(0, 300), ["ts", "what"]).orderBy("event_id").collect()
    assert [r.event_id for r in got] == [4, 9, *range(10, 310)]


def test_stream_appends_once(spark, tmp_path):
    spark.createDataFrame([(i, f"e{i}") for i in range(50)], "ts int, what string").write.parquet(f"{tmp_path}/in/a")
    for _ in range(2):
        audit.append_stream(audit.watch(spark, f"{tmp_path}/in/*", "ts int, what string"), f"file://{tmp_path}/out", ["ts"], f"{tmp_path}/ck").awaitTermination()
    spark.createDataFrame([(99, "late")], "ts int, what string").write.parquet(f"{tmp_path}/in/b")
    audit.append_stream(audit.watch(spark, f"{tmp_path}/in/*", "ts int, what string"), f"file://{tmp_path}/out", ["ts"], f"{tmp_path}/ck").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/out/events").orderBy("event_id").collect()
    assert [r.event_id for r in log] == list(range(1, 52)) and log[-1].what == "late"


def test_only_the_version_asked_for_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    assert backfill.stored(spark, path, "x", 2).count() == 0
    rows = spark.createDataFrame([(r, f"c{i}", "x", v, "FLAG" if i else "SKIP") for r, v in ((1, 1), (2, 1), (2, 2), (3, 1)) for i in range(3)], "run_id bigint, candidate_id string, check_id string, version int, verdict string")
    backfill.store(rows, path)
    now = backfill.stored(spark, path, "x", 2)
    assert now.count() == 2
    plan = now._jdf.queryExecution().executedPlan().toString()
    assert "version" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(now.inputFiles()) > 0 and [r.run_id for r in backfill.lagging_runs(rows, spark, path, "x", 2).orderBy("run_id").collect()] == [1, 3]
