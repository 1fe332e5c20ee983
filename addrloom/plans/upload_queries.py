"""Registered queries of uploads, the detail page, orders and guards, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from addrloom.functions import text
from addrloom.operators import checks, coverage, reports, review, state, uploads
from addrloom.plans.oracle import CAND, CHECKS, FEAT, hav
from addrloom.plans.queries import SNAPSHOTS, STAGED, cands, conflated_and_features, events, feats, query, results, src, staged
from addrloom.plans.stage import materialize
from addrloom.sources.lattice import LATTICE
from addrloom.sources.recipes import Recipe
from addrloom.streaming import audit

_GUARDED = f"""{STAGED}, won AS (SELECT DISTINCT candidate_id, run_id FROM stg WHERE stage = 'UPLOADED'),
one AS (SELECT s.*, s.stage = 'APPROVED' AND EXISTS (SELECT 1 FROM won w WHERE w.candidate_id = s.candidate_id AND w.run_id <> s.run_id) AS crossed FROM stg s),
two AS (SELECT *, stage = 'APPROVED' AND NOT crossed AND address_full IS NOT NULL AS left_over FROM one),
thr AS (SELECT *, left_over AND row_number() OVER (PARTITION BY run_id, address_full, muni, left_over ORDER BY CASE WHEN regexp_full_match(candidate_id, '[0-9]+') THEN CAST(candidate_id AS BIGINT) END NULLS LAST, candidate_id) > 1 AS twin FROM two),
guarded AS (SELECT run_id, candidate_id, CASE WHEN crossed OR twin THEN 'SKIPPED' ELSE stage END AS stage, CASE WHEN twin THEN 'intra_run' WHEN crossed THEN 'cross_run' END AS skipped_as FROM thr)"""


@query("R04_guards", f"{_GUARDED} SELECT * FROM guarded")
def _(spark, d):
    return uploads.guarded(materialize(staged(spark, d), "staged")).select("run_id", "candidate_id", "stage", "skipped_as")


@query("R05_uploaded_outside", f"{_GUARDED} SELECT run_id, candidate_id, CASE WHEN stage = 'APPROVED' AND run_id % 3 = 0 THEN 'UPLOADED' ELSE stage END AS stage FROM guarded")
def _(spark, d):
    c = materialize(staged(spark, d), "staged")
    return uploads.uploaded_outside(c, c.where("run_id % 3 = 0").select("run_id").distinct()).select("run_id", "candidate_id", "stage")


_SENT = f"{CAND}, sent AS (SELECT run_id, candidate_id, lo_num FROM cand WHERE lo_num % 2 = 1), back AS (SELECT run_id, candidate_id AS old_id FROM sent WHERE run_id % 2 = 0 OR lo_num % 5 <> 1)"


@query("R05_outcome", f"""{_SENT}, m AS (SELECT run_id, COUNT(*) AS k FROM sent s WHERE NOT EXISTS (SELECT 1 FROM back b WHERE b.run_id = s.run_id AND b.old_id = s.candidate_id) GROUP BY 1), n AS (SELECT run_id, COUNT(*) AS n FROM back GROUP BY 1)
SELECT r.run_id, CASE WHEN k IS NULL THEN 'uploaded' ELSE 'needs_attention' END AS upload_status, CASE WHEN k IS NOT NULL THEN 'partial upload: ' || k || ' of ' || (k + COALESCE(n, 0)) || ' items unmapped' END AS message FROM (SELECT DISTINCT run_id FROM sent) r LEFT JOIN m USING (run_id) LEFT JOIN n USING (run_id)""")
def _(spark, d):
    sent = cands(spark, d).where("lo_num % 2 = 1").select("run_id", F.col("candidate_id").alias("local_node_id"), "lo_num")
    back = sent.where("run_id % 2 = 0 or lo_num % 5 <> 1").select("run_id", F.col("local_node_id").alias("old_id"), F.col("lo_num").alias("new_id"))
    return uploads.outcome(sent, back)


@query("P12_changeset_tags", f"""{CAND}, r AS (SELECT DISTINCT run_id, 'tile-' || run_id AS name, 'c' || run_id * 7 AS token FROM cand)
SELECT run_id, 'Addresses of ' || name || ', Springfield' AS comment, 'City & Co' AS source, 'yes' AS import, 'no' AS bot, 'addrloom' AS created_by, token AS client_token, 'Import/Plan' AS import_plan FROM r""")
def _(spark, d):
    runs = cands(spark, d).select("run_id").distinct().select("run_id", F.concat(F.lit("tile-"), "run_id").alias("name"), F.concat(F.lit("c"), F.col("run_id") * 7).alias("client_token"))
    t = uploads.changeset_tags(runs, "Addresses of {run_name}, {city}", "Springfield", "City & Co", "Import/Plan")
    value = lambda k: F.col("tags")[k].alias(k.rpartition(":")[2])
    return t.select("run_id", *map(value, ("comment", "source", "import", "bot", "created_by", "import:client_token", "import_plan")))


_DIFF = f"CASE WHEN {{o}} = '' THEN 'ADD' WHEN {{p}} = '' THEN 'MISSING_PROPOSED' WHEN {{same}} THEN 'SAME' ELSE 'CHANGE' END"


@query("P14_detail", f"""{CHECKS}, told AS (SELECT run_id, candidate_id, string_agg(check_id || ':' || verdict, ',' ORDER BY check_id || ':' || verdict) AS checks, MAX(CASE WHEN check_id = 'nearby_street_mismatch' AND verdict = 'FLAG' THEN split_part(details, '@', 1) END) AS near FROM checks GROUP BY ALL),
c AS (SELECT conf.*, checks, CASE WHEN verdict = 'MISSING' THEN near END AS near FROM conf LEFT JOIN told USING (run_id, candidate_id)),
e AS (SELECT c.*, COALESCE(c.osm_type, split_part(near, '/', 1)) AS compared_type, COALESCE(c.osm_id, TRY_CAST(split_part(near, '/', 2) AS BIGINT)) AS compared_id FROM c),
t AS (SELECT e.run_id, e.candidate_id, COALESCE(e.housenumber, '') AS ph, COALESCE(f.housenumber, '') AS oh, COALESCE(f.street, '') AS os, e.street_norm AS ps, f.street_norm AS fs, COALESCE(f.postcode, '') AS oc FROM e JOIN feat f ON f.osm_id = e.compared_id AND f.osm_type = e.compared_type),
u AS (SELECT run_id, candidate_id, 'addr:housenumber' AS tag, {_DIFF.format(o='oh', p='ph', same='upper(trim(ph)) = upper(trim(oh))')} AS s FROM t WHERE ph <> '' OR oh <> ''
  UNION ALL SELECT run_id, candidate_id, 'addr:street', {_DIFF.format(o='os', p='ps', same='ps = fs')} FROM t WHERE ps <> '' OR os <> '' UNION ALL SELECT run_id, candidate_id, 'addr:postcode', 'MISSING_PROPOSED' FROM t WHERE oc <> ''),
d AS (SELECT run_id, candidate_id, string_agg(tag || ':' || s, ',' ORDER BY tag || ':' || s) AS differs FROM u WHERE s <> 'SAME' GROUP BY ALL)
SELECT e.run_id, e.candidate_id, e.verdict, compared_type, compared_id, e.sibling_id, s.verdict AS sibling_verdict, checks, differs FROM e LEFT JOIN d USING (run_id, candidate_id) LEFT JOIN conf s ON s.run_id = e.run_id AND s.candidate_id = e.sibling_id""")
def _(spark, d):
    c, f = conflated_and_features(spark, d)
    return review.detail(c, checks.run_checks(c, f), f).drop("stage")


@query("P04_street_fallback", f"""{LATTICE} SELECT identity_key, CASE WHEN k % 2 = 0 THEN street WHEN k % 3 = 0 THEN split_part(street, ' ', 1) || ' ' || split_part(street, ' ', 2) ELSE trim(split_part(street, ' ', 1) || CASE WHEN split_part(street, ' ', 3) <> '' THEN ' ' || split_part(street, ' ', 3) ELSE '' END) END AS name FROM src""")
def _(spark, d):
    part = lambda i: F.get(F.split("street", " "), F.lit(i))
    k = F.col("k")
    full = F.when(k % 2 == 0, F.col("street")).when(k % 5 == 0, F.lit(""))
    return src(spark, d).select("identity_key", text.street_fallback(full, part(0), F.when(k % 3 == 0, part(1)), F.when(k % 3 != 0, part(2)).otherwise("")).alias("name"))


_STREETS = f"""{FEAT}, a AS (SELECT street_norm, COUNT(*) AS n FROM cand WHERE street_norm <> '' GROUP BY 1), b AS (SELECT street_norm, COUNT(*) AS n FROM feat WHERE street_norm <> '' GROUP BY 1),
s AS (SELECT COALESCE(a.street_norm, b.street_norm) AS street_norm, GREATEST(COALESCE(a.n, 0), COALESCE(b.n, 0)) AS n, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'matched' END AS kind FROM a FULL JOIN b ON a.street_norm = b.street_norm)"""


@query("O02_street_lists", f"{_STREETS} SELECT kind, street_norm, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, street_norm) AS INTEGER) AS place FROM s")
def _(spark, d):
    return coverage.street_lists(coverage.street_match(cands(spark, d), feats(spark, d))).select("kind", "street_norm", "place")


@query("O03_entry_order", rf"{FEAT} SELECT osm_id, lower(COALESCE(street, '')) AS street_key, COALESCE(TRY_CAST(regexp_extract(housenumber, '(\d+)', 1) AS BIGINT), 0) AS number_key, housenumber FROM feat WHERE contains(housenumber, ';') OR contains(housenumber, ',')")
def _(spark, d):
    f = feats(spark, d).where("contains(housenumber, ';') or contains(housenumber, ',')")
    return coverage.in_list_order(f).select("osm_id", "street_key", "number_key", "housenumber")


@query("O07_drift_order", rf"{CHECKS} SELECT k.run_id, k.candidate_id, housenumber, COALESCE(TRY_CAST(regexp_extract(housenumber, '^\s*([+-]?\d+)', 1) AS BIGINT), 0) AS number_key FROM checks k JOIN cand c USING (run_id, candidate_id) WHERE check_id = 'match_number_drift' AND k.verdict = 'FLAG'")
def _(spark, d):
    flags = results(spark, d, ("match_number_drift",)).where("verdict = 'FLAG'").select("run_id", "candidate_id")
    return coverage.in_drift_order(flags.join(cands(spark, d), ["run_id", "candidate_id"])).select("run_id", "candidate_id", "housenumber", "number_key")


@query("A08_flag_reasons", f"{CHECKS} SELECT DISTINCT run_id, reason_code FROM checks WHERE verdict = 'FLAG'")
def _(spark, d):
    return reports.flag_reasons(results(spark, d))


@query("K03_pending", f"{CHECKS} SELECT run_id, candidate_id, check_id, version FROM checks WHERE NOT (check_id IN ('match_far', 'suffix_range') OR (check_id = 'city_duplicate' AND run_id % 2 = 0))")
def _(spark, d):
    """Results whose check and version aren't stored yet; an older version of a check doesn't count."""
    r = materialize(results(spark, d), "results")
    stored = r.where("check_id in ('match_far', 'suffix_range') or check_id = 'city_duplicate' and run_id % 2 = 0").select("run_id", "candidate_id", "check_id", "version")
    old = r.where("check_id = 'potential_amenity'").select("run_id", "candidate_id", "check_id", (F.col("version") - 1).alias("version"))
    return checks.pending(r, stored.union(old)).select("run_id", "candidate_id", "check_id", "version")


@query("F22_available_checks", f"{CHECKS} SELECT check_id, verdict, COUNT(*) AS n FROM checks WHERE check_id NOT IN ('suffix_range', 'intra_source_duplicate') GROUP BY ALL")
def _(spark, d):
    bare = Recipe(street_from="street", full_from="full", lo_num="props:LO")
    return reports.counts(results(spark, d, checks.available(bare)), "check_id", "verdict")


_VERDICTS = f"{CAND}, v AS (SELECT candidate_id, 'fix' AS verdict, CASE WHEN lo_num % 3 = 0 THEN 't1' END AS exported_at FROM cand)"


@query("K12_exported", f"{_VERDICTS} SELECT v.candidate_id, verdict, COALESCE(exported_at, CASE WHEN lo_num % 2 = 1 THEN 't2' END) AS exported_at FROM v JOIN cand USING (candidate_id)")
def _(spark, d):
    c = cands(spark, d)
    v = c.select("candidate_id", F.lit("fix").alias("verdict"), F.when(F.col("lo_num") % 3 == 0, "t1").alias("exported_at"))
    return state.mark_exported(v, c.where("lo_num % 2 = 1").select("candidate_id", F.lit("t2").alias("at")), ["candidate_id"])


@query("K05_append", "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 <> 0), n AS (SELECT row_number() OVER (ORDER BY ts, event_id) + (SELECT MAX(event_id) FROM l) AS event_id, user_id FROM events WHERE event_id % 3 = 0) SELECT event_id, user_id FROM l UNION ALL SELECT event_id, user_id FROM n")
def _(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ts")
    return audit.append(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0"), ["ts", "event_id"]).select("event_id", "user_id")


@query("M07_replay", "WITH h AS (SELECT MIN(ts) + (MAX(ts) - MIN(ts)) / 2 AS t FROM events) SELECT user_id, COUNT(*) AS n, arg_max(event_type, {'t': ts, 'i': event_id}) AS state FROM events, h WHERE ts <= h.t GROUP BY 1")
def _(spark, d):
    e = events(spark, d)
    low, high = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    return audit.replay(e, F.timestamp_micros(F.lit(low + (high - low) // 2))).select("user_id", "n", "state")


@query("F16_last_events", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(spark, d):
    return reports.last_events(events(spark, d), F.col("event_type") == "click").select("event_id", "user_id", "event_type")


@query("M06_runnable", f"""{CAND}, r AS (SELECT DISTINCT run_id, CASE WHEN run_id % 3 = 0 THEN 9 ELSE 10 END AS snapshot_id, CASE run_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN '2026-03-01 03:00:00' ELSE '2026-03-19 03:00:00' END AS extract_at FROM cand),
x AS (SELECT run_id, snapshot_id <> (SELECT MAX(id) FROM {SNAPSHOTS} WHERE skipped = 0) AS snapshot_changed, CASE WHEN extract_at IS NULL THEN 'missing' WHEN TRY_CAST(extract_at AS TIMESTAMP) IS NULL OR epoch(TIMESTAMP '2026-03-20 03:00:00') - epoch(TRY_CAST(extract_at AS TIMESTAMP)) > 14 * 86400 THEN 'stale' ELSE 'fresh' END AS extract FROM r)
SELECT *, NOT snapshot_changed AND extract = 'fresh' AS may_run FROM x""")
def _(spark, d):
    k = F.col("run_id") % 4
    at = F.when(k == 1, "soon").when(k == 2, "2026-03-01 03:00:00").when(k == 3, "2026-03-19 03:00:00")
    runs = cands(spark, d).select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 3 == 0, 9).otherwise(10).alias("snapshot_id"), at.alias("extract_at"))
    return uploads.runnable(runs, spark.sql(f"SELECT * FROM {SNAPSHOTS}"), F.lit("2026-03-20 03:00:00").cast("timestamp"))


#: Points of three datasets: those of a municipality, some of them published by its neighbour too, up to 220 m away.
_PTS = f"""{CAND}, pts AS (SELECT muni AS dataset, housenumber AS number, street_norm, muni, lat, lon FROM cand UNION ALL SELECT 'M9', housenumber, street_norm, CASE WHEN lo_num % 3 = 0 THEN 'X' ELSE muni END, lat + (lo_num % 3) * 1e-3, lon FROM cand WHERE lo_num % 7 = 0),
k AS (SELECT dataset, number, street_norm, MAX({{'lat': lat, 'lon': lon, 'muni': muni}}) AS p FROM pts WHERE number <> '' AND street_norm <> '' GROUP BY ALL),
b AS (SELECT dataset, MIN(p.lat) AS a, MIN(p.lon) AS b, MAX(p.lat) AS c, MAX(p.lon) AS d FROM k GROUP BY 1),
j AS (SELECT x.dataset, y.dataset AS other, {hav('x.p.lat', 'x.p.lon', 'y.p.lat', 'y.p.lon')} < 150 AS near, x.p.muni || '=' || y.p.muni AS label FROM k x JOIN k y ON x.number = y.number AND x.street_norm = y.street_norm AND x.dataset < y.dataset),
l0 AS (SELECT dataset, other, label, COUNT(*) FILTER (WHERE near) AS c FROM j GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY dataset, other ORDER BY c DESC, label) AS r FROM l0),
t AS (SELECT dataset, other, string_agg(label || ':' || c, ', ' ORDER BY r) FILTER (WHERE r <= 3 AND c > 0) AS labels FROM l GROUP BY ALL),
n AS (SELECT dataset, other, COUNT(*) AS shared, COUNT(*) FILTER (WHERE near) AS colocated FROM j GROUP BY ALL)"""


@query("J32_overlap_census", f"""{_PTS}, o AS (SELECT n.*, labels, GREATEST(LEAST(x.c, y.c) - GREATEST(x.a, y.a), 0) * GREATEST(LEAST(x.d, y.d) - GREATEST(x.b, y.b), 0) / LEAST((x.c - x.a) * (x.d - x.b), (y.c - y.a) * (y.d - y.b)) AS overlap FROM n JOIN t USING (dataset, other) JOIN b x ON x.dataset = n.dataset JOIN b y ON y.dataset = n.other)
SELECT dataset, other, shared, colocated, round(overlap, 6) AS overlap, labels FROM o WHERE overlap >= 0.001 AND colocated > 0""")
def _(spark, d):
    c = cands(spark, d)
    own = c.select(F.col("muni").alias("dataset"), F.col("housenumber").alias("number"), "street_norm", "muni", "lat", "lon")
    m = F.col("lo_num") % 3
    more = c.where("lo_num % 7 = 0").select(F.lit("M9").alias("dataset"), F.col("housenumber").alias("number"), "street_norm", F.when(m == 0, "X").otherwise(F.col("muni")).alias("muni"), (F.col("lat") + m * 1e-3).alias("lat"), "lon")
    return reports.overlap_census(own.unionByName(more)).withColumn("overlap", F.round("overlap", 6))
