"""What may not grow faster than the rows: tables sent to the driver, cells of a row, meetings of far addresses."""

from pyspark.sql import functions as F

from addrloom.functions import geo
from addrloom.operators import backfill, checks, conflate, features, reports, review
from addrloom.plans import queries
from addrloom.plans.stage import materialize


def test_checks_broadcast_no_candidates(spark):
    d = "/root/testdata/sf0.001"
    c, f = materialize(queries.conflated(spark, d), "conflation"), materialize(queries.feats(spark, d), "features")
    plan = checks.stages(c, checks.run_checks(c, f))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_reports_broadcast_no_candidates(spark):
    d = "/root/testdata/sf0.001"
    c, f = materialize(queries.conflated(spark, d), "conflation"), materialize(queries.feats(spark, d), "features")
    results = materialize(checks.run_checks(c, f), "results")
    items = c.select(*checks.KEY, F.lit("OPEN").alias("status"), F.lit("range").alias("reason_code"))
    runs = spark.createDataFrame([(0,)], "run_id bigint")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for found in (review.detail(c, results, f), reports.drift_by_street(results, c), checks.pending(results, results.select("run_id", "candidate_id", "check_id", "version")), checks.rerouted(items.withColumn("opened_at", F.lit("t0")), checks.stages(c, results), F.lit("t1"))[0]):
        assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    # uploaded runs and the states of streets may be broadcast
    for found in (backfill.route(results, c.withColumn("stage", F.lit("CHECKED")), items, runs), backfill.street_detail(results, c, f, runs), backfill.dashboard(results, c, runs, spark.createDataFrame([], "street_norm string, status string"))):
        assert plan(found).count("SortMergeJoin") >= 1 and plan(found).count("BroadcastExchange") <= 2


def test_only_rows_alone_at_their_place_join_for_siblings(spark, monkeypatch):
    seen, write = {}, conflate.materialize
    monkeypatch.setattr(conflate, "materialize", lambda df, name: seen.setdefault(name, write(df, name)))
    c = queries.cands(spark, "/root/testdata/sf0.001")
    assert conflate.land_siblings(c).count() > 0
    assert seen["addresses"].count() == c.count() and 0 < seen["siblings"].count() < c.count() / 5


def test_wide_cells_miss_no_pair_and_are_few(spark):
    p = spark.range(400).select("id", (43.6 + (F.col("id") * 37 % 101) * 2e-4).alias("lat"), (-79.5 + (F.col("id") * 53 % 97) * 3e-4).alias("lon"))
    q = p.select(F.col("id").alias("other"), F.col("lat").alias("a"), F.col("lon").alias("b"))
    near = geo.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")) <= 100.0
    want = p.crossJoin(q).where(near).count()
    around = geo.with_cells(p, 100.0, around=True, wide=8)
    assert around.join(geo.with_cells(q, 100.0, "a", "b", wide=8), ["cy", "cx"]).where(near).select("id", "other").distinct().count() == want
    assert around.count() < 2 * p.count()


def test_conflation_moves_only_what_is_wanted(spark, monkeypatch):
    seen, write = {}, conflate.materialize
    monkeypatch.setattr(conflate, "materialize", lambda df, name: seen.setdefault(name, write(df, name)))
    d = "/root/testdata/sf0.001"
    c, f = queries.cands(spark, d), materialize(queries.feats(spark, d), "features")
    wanted = checks.columns(("match_far",))
    got = conflate.conflate(c, f, wanted)
    assert tuple(got.columns) == wanted and not {"street", "stage", "lo_num", "tags"} & {*seen["addresses"].columns}
    assert "to_json" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(conflate, "materialize", write)
    full = conflate.conflate(c, f)
    for check in checks.VERSIONS:  # each from its own columns gives what it gives from all
        few = conflate.conflate(c, f, checks.columns((check,)))
        few, all_ = (checks.run_checks(x, f, (check,)) for x in (few, full))
        assert few.exceptAll(all_).count() == 0 and all_.exceptAll(few).count() == 0


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_conflation_deals_candidates_to_features_once(spark):
    d = "/root/testdata/sf0.001"
    c, f = queries.cands(spark, d), materialize(queries.feats(spark, d), "features")
    plan = _plan(conflate.conflate(c, f, checks.columns(("match_far",))))
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan


def test_found_features_are_the_nearest_for_each_row(spark):
    at = [(i, 43.6 + i % 11 * 4e-4, -79.5 + i % 7 * 9e-4) for i in range(150)]
    c = spark.createDataFrame([(0, str(i % 90), "1" if i % 4 else None, "A" if i % 3 else "", a, b if i % 13 else None) for i, a, b in at], "run_id bigint, candidate_id string, housenumber string, street_norm string, lat double, lon double")
    f = spark.createDataFrame([(i % 60, "node" if i % 2 else "way", "1", "A" if i % 5 else "", a + 3e-4 * (i % 2), b, {"addr:postcode": str(i)}, i % 4 == 1) for i, a, b in at], "osm_id bigint, osm_type string, num string, street_norm string, lat double, lon double, tags map<string,string>, is_poi boolean")
    dist = geo.haversine(F.col("c.lat"), F.col("c.lon"), F.col("f.lat"), F.col("f.lon"))
    rows = c.withColumn("row", F.monotonically_increasing_id())
    pairs = rows.alias("c").join(f.alias("f"), (F.col("housenumber") == F.col("num")) & (F.col("c.street_norm") == F.col("f.street_norm")), "left").withColumn("dist", dist)
    near = lambda poi: F.min(F.when((F.col("dist") <= 100.0) & (F.col("is_poi") == poi), F.struct("dist", "osm_id", "osm_type")))
    want = pairs.groupBy("row", "c.candidate_id").agg(near(False).alias("b"), near(True).alias("p")).select("candidate_id", "b.osm_id", "b.osm_type", F.round("b.dist", 6).alias("m"), F.col("p.osm_id").alias("poi"))
    got = conflate._with_found(c, f, 100.0).select("candidate_id", "_best.osm_id", "_best.osm_type", F.round("_best.dist", 6).alias("m"), F.col("_poi.osm_id").alias("poi"))
    assert got.count() == c.count() and want.where("osm_id IS NOT NULL AND poi IS NOT NULL").count() > 20
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_features_do_not_move_for_ends_of_interpolation_ways(spark, monkeypatch):
    f = queries.feats(spark, "/root/testdata/sf0.001")
    assert "Exchange hashpartitioning" not in _plan(f) and f.count() > 0
    monkeypatch.setattr(features, "ENDS", 0)
    shuffled = queries.feats(spark, "/root/testdata/sf0.001")
    assert "SortMergeJoin" in _plan(shuffled)
    f, shuffled = (x.withColumn("tags", F.to_json("tags")) for x in (f, shuffled))
    assert f.exceptAll(shuffled).count() == 0 and shuffled.exceptAll(f).count() == 0


def test_drift_looks_no_farther_than_the_match(spark):
    p = spark.range(400).select("id", (43.6 + (F.col("id") * 37 % 101) * 2e-4).alias("lat"), (-79.5 + (F.col("id") * 53 % 97) * 3e-4).alias("lon"), F.when(F.col("id") % 9 == 0, 100.0).otherwise(1.0).alias("own"))
    q = p.select(F.col("id").alias("other"), F.col("lat").alias("a"), F.col("lon").alias("b"))
    near = geo.haversine(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")) <= F.col("own")
    around = geo.with_cells(p, 100.0, around=True, wide=4, within=F.col("own"))
    assert around.join(geo.with_cells(q, 100.0, "a", "b", wide=4), ["cy", "cx"]).where(near).select("id", "other").distinct().count() == p.crossJoin(q).where(near).count() > p.count()
    assert around.count() < 1.3 * p.count()


def test_stages_are_written_small(spark, tmp_path):
    from urllib.parse import urlparse

    written = materialize(spark.range(10), "small").inputFiles()
    assert written and all(".zstd." in urlparse(x).path for x in written)


def test_reports_of_flags_do_not_join_candidates_again(spark):
    d = "/root/testdata/sf0.001"
    c, f = materialize(queries.conflated(spark, d), "conflation"), materialize(queries.feats(spark, d), "features")
    one = checks.run_checks(c, f, ("match_number_drift",))
    beside = checks.run_checks(c, f, ("match_number_drift",), keep=("street_norm", "street", "stage"))
    joined, direct = reports.drift_by_street(one, c), reports.drift_by_street(beside)
    assert _plan(direct).count("SortMergeJoin") == _plan(joined).count("SortMergeJoin") - 1
    assert direct.count() > 0 and direct.exceptAll(joined).count() == 0 and joined.exceptAll(direct).count() == 0
    items, runs = c.limit(20).select(*checks.KEY, F.lit("OPEN").alias("status"), F.lit("range").alias("reason_code")), c.where("run_id % 2 = 0").select("run_id").distinct()
    items = materialize(items, "items")
    joined, direct = backfill.route(one, c, items, runs), backfill.route(beside, None, items, runs)
    assert _plan(direct).count("SortMergeJoin") == _plan(joined).count("SortMergeJoin") - 1
    assert direct.exceptAll(joined).count() == 0 and joined.exceptAll(direct).count() == 0
