"""Registered queries of audits, the reverse sweep, back-fills and extracts, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from addrloom.functions import datasets, geo, text
from addrloom.operators import backfill, checks, coverage, extract, orphans, range_audit, state
from addrloom.plans.more_queries import WORK, work
from addrloom.plans.oracle import CHECKS, CONF, FEAT, norm
from addrloom.plans.queries import _TOKENS, BOX, INDEX, SNAPSHOT, SQL, cands, conflated_and_features, feats, indexed, osm, query, src
from addrloom.plans.stage import materialize, shared
from addrloom.sources import history
from addrloom.sources.lattice import LATTICE, lattice

#: Active rows with letters on both ends, reversed ranges and two kinds of dashes.
AUDIT = """a0 AS (SELECT identity_key, k, lo_num, CASE WHEN hi_num > lo_num AND k % 7 = 0 THEN lo_num - 2 ELSE hi_num END AS hi_num, lo_num_suf, CASE WHEN k % 4 = 0 THEN 'B' ELSE 'None' END AS hi_num_suf, number, street, muni, cls FROM src WHERE max_snapshot_id = 10),
a AS (SELECT *, CASE WHEN lo_num_suf = 'None' THEN '' ELSE lo_num_suf END AS ls, CASE WHEN hi_num_suf = 'None' THEN '' ELSE hi_num_suf END AS hs, CASE WHEN lo_num <> hi_num THEN CAST(lo_num AS VARCHAR) || CASE WHEN k % 2 = 0 THEN '–' ELSE '-' END || CAST(hi_num AS VARCHAR) ELSE number END || ' ' || street AS address_full FROM a0),
r AS (SELECT *, hi_num - lo_num AS span, abs(lo_num % 2) + abs(hi_num % 2) AS odd FROM a WHERE lo_num <> hi_num)"""


def audited(spark, d):
    s = history.active(src(spark, d), SNAPSHOT)
    s = s.withColumns({"hi_num": F.when((F.col("hi_num") > F.col("lo_num")) & (F.col("k") % 7 == 0), F.col("lo_num") - 2).otherwise(F.col("hi_num")), "hi_num_suf": F.when(F.col("k") % 4 == 0, "B").otherwise("None")})
    both = F.concat(F.col("lo_num").cast("string"), F.when(F.col("k") % 2 == 0, "–").otherwise("-"), F.col("hi_num").cast("string"))
    return s.withColumn("address_full", F.concat(F.when(F.col("lo_num") != F.col("hi_num"), both).otherwise(F.col("number")), F.lit(" "), "street"))


@query("A14_counts", f"""{LATTICE}, {AUDIT}, u AS (SELECT 'rows' AS section, 'active' AS item FROM a UNION ALL SELECT 'rows', 'range' FROM r UNION ALL SELECT 'rows', 'suffix_only' FROM a WHERE lo_num = hi_num AND ls <> hs UNION ALL SELECT 'rows', 'reversed' FROM a WHERE lo_num > hi_num
UNION ALL SELECT 'class', COALESCE(cls, '?') FROM r UNION ALL SELECT 'form', CASE WHEN ls || hs <> '' THEN 'lettered' ELSE 'numeric' END FROM r
UNION ALL SELECT 'span', CASE WHEN span = 1 THEN '1' WHEN span = 2 THEN '2' WHEN span <= 10 THEN '3-10' WHEN span <= 100 THEN '11-100' ELSE '>100' END FROM r
UNION ALL SELECT 'parity', CASE odd WHEN 0 THEN 'both even' WHEN 2 THEN 'both odd' ELSE 'mixed' END FROM r UNION ALL SELECT 'dash', CASE WHEN contains(address_full, '–') THEN '–' ELSE '-' END FROM r)
SELECT section, item, COUNT(*) AS n FROM u GROUP BY ALL""")
def _(spark, d):
    return range_audit.audit_counts(audited(spark, d))


@query("A14_suffix_pairs", f"{LATTICE}, {AUDIT} SELECT ls AS lo_suf, hs AS hi_suf, COUNT(*) AS n FROM r WHERE ls || hs <> '' GROUP BY ALL ORDER BY n DESC, lo_suf, hi_suf LIMIT 10")
def _(spark, d):
    return range_audit.suffix_pairs(audited(spark, d))


@query("A14_widest", f"{LATTICE}, {AUDIT} SELECT span, address_full, muni, identity_key FROM r ORDER BY span DESC, address_full, muni, identity_key LIMIT 10")
def _(spark, d):
    return range_audit.widest(audited(spark, d))


@query("A14_busiest_streets", f"{LATTICE}, {AUDIT} SELECT street, muni, COUNT(*) AS n FROM r GROUP BY ALL ORDER BY n DESC, street, muni LIMIT 5")
def _(spark, d):
    return range_audit.busiest_streets(audited(spark, d))


_NUMBERS = "UNNEST(CASE WHEN lo_num <= hi_num THEN generate_series(lo_num, hi_num, CASE WHEN lo_num % 2 = hi_num % 2 THEN 2 ELSE 1 END) ELSE [] END)"
_COVER = "SELECT identity_key, present, expected, CASE WHEN present = 0 THEN 'none' WHEN present = expected THEN 'full' ELSE 'partial' END AS cover FROM g"


@query("A14_sibling_cover", f"""{LATTICE}, {AUDIT}, x AS (SELECT identity_key, street, muni, {_NUMBERS} AS n FROM r), s AS (SELECT DISTINCT street, muni, lo_num AS n FROM a WHERE lo_num = hi_num),
g AS (SELECT r.identity_key, COUNT(s.n) AS present, COUNT(x.n) AS expected FROM r LEFT JOIN x ON r.identity_key = x.identity_key LEFT JOIN s ON s.street = x.street AND s.muni IS NOT DISTINCT FROM x.muni AND s.n = x.n GROUP BY 1) {_COVER}""")
def _(spark, d):
    return range_audit.sibling_cover(audited(spark, d))


@query("A14_feature_cover", rf"""{FEAT}, {AUDIT}, fp AS (SELECT street, trim(UNNEST(string_split_regex(housenumber, '[;,]'))) AS p FROM feat WHERE housenumber <> '' AND street <> ''),
fa AS (SELECT *, TRY_CAST(regexp_extract(p, '^(\d+)', 1) AS BIGINT) AS lead, TRY_CAST(regexp_extract(p, '^\d+\s*[-–]\s*(\d+)$', 1) AS BIGINT) AS tail FROM fp),
fn AS (SELECT DISTINCT street, UNNEST(CASE WHEN tail IS NOT NULL THEN CASE WHEN lead <= tail AND tail - lead < 200 THEN generate_series(lead, tail) ELSE [] END WHEN lead IS NOT NULL THEN [lead] ELSE [] END) AS n FROM fa),
x AS (SELECT identity_key, osm_name AS street, {_NUMBERS} AS n FROM r JOIN st ON st.src_name = r.street WHERE src_name NOT IN ('DEANE FIELD CRES', 'KATHLEEN AVE')),
y AS (SELECT identity_key, street, {_NUMBERS} AS n FROM r WHERE street IN ('DEANE FIELD CRES', 'KATHLEEN AVE')),
g AS (SELECT r.identity_key, COUNT(fn.n) AS present, COUNT(z.n) AS expected FROM r LEFT JOIN (SELECT * FROM x UNION ALL SELECT * FROM y) z ON z.identity_key = r.identity_key LEFT JOIN fn ON fn.street = z.street AND fn.n = z.n GROUP BY 1) {_COVER}""")
def _(spark, d):
    return range_audit.feature_cover(audited(spark, d).withColumn("street", F.initcap("street")), feats(spark, d))


@query("A18_source_index", f"{LATTICE}, {INDEX} SELECT * FROM ks")
def _(spark, d):
    return orphans.listed(indexed(spark, d))


AREA = (43.60, -79.60, 43.70, -79.0)
_IN = f"(lat > {AREA[0]}::DOUBLE AND lat < {AREA[2]}::DOUBLE AND lon > {AREA[1]}::DOUBLE AND lon < {AREA[3]}::DOUBLE)"
ORPHANS = f"""{FEAT}, {INDEX}, nd AS (SELECT *, CASE WHEN entrance IS NOT NULL THEN 'entrance' ELSE 'pure' END AS bucket, {_IN} AS inn FROM feat WHERE osm_type = 'node' AND NOT is_poi),
t AS (SELECT osm_id, street_norm, UNNEST(tk) AS token, UNNEST(range(len(tk))) AS pos FROM (SELECT osm_id, street_norm, {_TOKENS} AS tk FROM nd WHERE inn AND street_norm <> '')),
g AS (SELECT osm_id, string_agg(CASE WHEN ks.token IS NULL THEN t.token END, ';' ORDER BY pos) AS mp, string_agg(CASE WHEN ks.token IS NOT NULL THEN t.token END, ';' ORDER BY pos) AS hp, COUNT(*) AS parts, COUNT(ks.token) AS hits FROM t LEFT JOIN ks ON t.street_norm = ks.street_norm AND t.token = ks.token GROUP BY 1),
orph AS (SELECT bucket, CASE WHEN NOT inn THEN 'outside' WHEN street_norm = '' THEN 'no_addr_street' WHEN parts = hits THEN 'matched' ELSE 'missing_in_source' END AS reason, osm_type, nd.osm_id, housenumber AS addr_housenumber, COALESCE(street, '') AS addr_street, COALESCE(entrance, '') AS entrance, COALESCE(name, '') AS name, '' AS building, lat, lon, COALESCE(mp, '') AS missing_parts, COALESCE(hp, '') AS matched_parts, street_norm FROM nd LEFT JOIN g USING (osm_id)
  UNION ALL SELECT 'buildings_no_street', CASE WHEN {_IN} THEN 'no_addr_street_polygon' ELSE 'outside' END, osm_type, osm_id, housenumber, '', '', COALESCE(name, ''), CASE WHEN osm_id % 4 = 0 THEN 'house' ELSE '' END, lat, lon, '', '', '' FROM feat WHERE osm_type <> 'node' AND trim(COALESCE(street, '')) = '')"""


def swept(spark, d):
    ring = [(AREA[1], AREA[0]), (AREA[3], AREA[0]), (AREA[3], AREA[2]), (AREA[1], AREA[2])]
    inside = geo.in_ring(F.col("lon"), F.col("lat"), ring)
    f = feats(spark, d)
    house = F.when((F.col("osm_type") != "node") & (F.col("osm_id") % 4 == 0), F.create_map(F.lit("building"), F.lit("house"))).otherwise(F.create_map().cast("map<string,string>"))
    return orphans.node_rows(f, indexed(spark, d), inside), orphans.no_street_polygons(f.withColumn("tags", F.map_concat("tags", house)), inside)


@query("K08_orphans", f"{ORPHANS} SELECT * EXCLUDE (street_norm) FROM orph WHERE reason NOT IN ('matched', 'outside')")
def _(spark, d):
    return orphans.file_rows(*swept(spark, d))


@query("A17_orphan_totals", f"""{ORPHANS} SELECT bucket, COUNT(*) FILTER (WHERE reason <> 'outside') AS total, COUNT(*) FILTER (WHERE reason = 'matched') AS matched, COUNT(*) FILTER (WHERE reason = 'missing_in_source') AS missing,
  COUNT(*) FILTER (WHERE reason LIKE 'no_addr_street%') AS no_street, COUNT(*) FILTER (WHERE reason = 'outside') AS outside FROM orph GROUP BY 1""")
def _(spark, d):
    nodes, polygons = swept(spark, d)
    return orphans.totals(nodes.unionByName(polygons))


@query("A16_building_values", f"{ORPHANS} SELECT CASE WHEN building = '' THEN '(no building tag)' ELSE building END AS label, osm_type, COUNT(*) AS n FROM orph WHERE bucket = 'buildings_no_street' AND reason <> 'outside' GROUP BY ALL")
def _(spark, d):
    return orphans.building_values(swept(spark, d)[1])


@query("O04_orphan_table", f"{ORPHANS} SELECT osm_id, addr_housenumber, street_norm, missing_parts FROM orph WHERE bucket = 'pure' AND reason = 'missing_in_source' ORDER BY street_norm, COALESCE(TRY_CAST(regexp_extract(addr_housenumber, '(\\d+)', 1) AS BIGINT), 0), addr_housenumber, osm_id LIMIT 500")
def _(spark, d):
    return orphans.table(swept(spark, d)[0], "pure", "missing_in_source").select("osm_id", "addr_housenumber", "street_norm", "missing_parts")


_LATER = f"{CHECKS}{WORK[len(CONF):]}, fl AS (SELECT k.run_id, k.candidate_id, k.verdict, w.stage, w.street_norm, w.lo_num FROM checks k JOIN work w USING (run_id, candidate_id) WHERE check_id = 'match_number_drift' AND k.verdict <> 'SKIP')"


#: What the later drift check and its routes look at.
_DRIFT = (*checks.columns(("match_number_drift",)), "lo_num")


def drift(spark, d, *more):
    c, items = work(spark, d, (*_DRIFT, *more))
    c = materialize(c, "work")
    return c, items, checks.run_checks(c, feats(spark, d), ("match_number_drift",), keep=("stage",))


@query("R07_drift_routes", f"""{_LATER}, j AS (SELECT f.*, i.status, i.reason_code AS old, CASE WHEN f.verdict <> 'FLAG' THEN 'passed' WHEN f.run_id % 5 = 0 OR stage IN ('APPROVED', 'REJECTED', 'UPLOADED') OR COALESCE(i.status IN ('APPROVED', 'REJECTED'), FALSE) THEN 'recorded_only' WHEN i.status IS NULL THEN 'new' ELSE 'merged' END AS route
  FROM fl f LEFT JOIN items i USING (run_id, candidate_id) WHERE lo_num % 4 <> 1)
SELECT run_id, candidate_id, route, CASE route WHEN 'new' THEN 'match_number_drift' WHEN 'merged' THEN CASE WHEN old = 'range' THEN 'match_number_drift,range' ELSE 'match_far,match_number_drift,range' END END AS reason_code FROM j""")
def _(spark, d):
    c, items, found = drift(spark, d)
    stored = c.where("lo_num % 4 = 1").select("run_id", "candidate_id", F.lit("match_number_drift").alias("check_id"), F.lit(checks.VERSIONS["match_number_drift"]).alias("version"))
    return backfill.route(backfill.fresh(found, stored), None, items, c.where("run_id % 5 = 0").select("run_id").distinct())


@query("J36_backscan", f"{CHECKS} SELECT run_id, candidate_id, verdict, reason_code FROM checks WHERE check_id = 'match_number_drift' AND verdict <> 'SKIP' AND run_id % 3 <> 0")
def _(spark, d):
    """Every third run has results of this version, all have some of the one before."""
    c = materialize(work(spark, d, _DRIFT)[0], "work")
    path, version = f"{shared(spark)}/results-{uuid.uuid4().hex}", checks.VERSIONS["match_number_drift"]
    old = c.select("run_id", "candidate_id", F.lit("PASS").alias("verdict"), F.lit("match_number_drift").alias("check_id"), F.lit(version - 1).alias("version"))
    backfill.store(old.unionByName(old.where("run_id % 3 = 0").withColumn("version", F.lit(version))), path)
    backfill.backscan(c, feats(spark, d), path, "match_number_drift")
    found = backfill.stored(spark, path, "match_number_drift", version)
    return found.where("run_id % 3 <> 0").select("run_id", "candidate_id", "verdict", "reason_code")


_STREETS = f"""{_LATER}, s AS (SELECT street_norm, COUNT(*) AS flags, COUNT(*) FILTER (WHERE run_id % 5 = 0) AS uploaded_flags, COUNT(DISTINCT run_id) AS run_count, CASE street_norm WHEN 'KING ST W' THEN 'fixed' WHEN 'OAK CRES' THEN 'dismissed' ELSE 'open' END AS status FROM fl WHERE verdict = 'FLAG' GROUP BY 1)"""


def streets(spark, d):
    c, _, found = drift(spark, d, "street")
    status = spark.createDataFrame([("KING ST W", "fixed"), ("OAK CRES", "dismissed")], "street_norm string, status string")
    return backfill.dashboard(found.where("verdict = 'FLAG'"), c, c.where("run_id % 5 = 0").select("run_id").distinct(), status)


@query("J21_dashboard", f"{_STREETS} SELECT street_norm, flags, uploaded_flags, flags - uploaded_flags AS pending_flags, run_count, status FROM s")
def _(spark, d):
    return streets(spark, d).drop("street")


@query("A06_dashboard_totals", f"{_STREETS} SELECT status, COUNT(*) AS streets, CAST(SUM(flags) AS BIGINT) AS flags, CAST(SUM(uploaded_flags) AS BIGINT) AS uploaded_flags FROM s GROUP BY 1")
def _(spark, d):
    return backfill.dashboard_totals(streets(spark, d))


@query("J22_street_detail", f"""{CHECKS}, k AS (SELECT run_id, candidate_id, split_part(split_part(details, '|', 1), '@', 1) AS closest FROM checks WHERE check_id = 'match_number_drift' AND verdict = 'FLAG')
SELECT k.run_id, k.candidate_id, k.closest, c.street_norm, c.housenumber, c.osm_type AS matched_type, c.osm_id AS matched_id, CAST(round(f.lat * 1e7) AS BIGINT) AS closest_lat, k.run_id % 5 = 0 AS uploaded
  FROM k JOIN conf c USING (run_id, candidate_id) LEFT JOIN feat f ON f.osm_type || '/' || f.osm_id = k.closest AND f.street_norm = c.street_norm""")
def _(spark, d):
    c, f = conflated_and_features(spark, d, (*checks.columns(("match_number_drift",)), "osm_type", "osm_id"))
    flags = checks.run_checks(c, f, ("match_number_drift",)).where("verdict = 'FLAG'")
    detail = backfill.street_detail(flags, c, backfill.first_of_runs(f.select("osm_type", "osm_id", "street_norm", "lat", "lon"), F.lit(0)), c.where("run_id % 5 = 0").select("run_id").distinct())
    return detail.select("run_id", "candidate_id", "closest", "street_norm", "housenumber", "matched_type", "matched_id", F.round(F.col("closest_lat") * 1e7).cast("bigint").alias("closest_lat"), "uploaded")


@query("O05_suffixed", f"{LATTICE} SELECT identity_key, street, lo_num, row_number() OVER (ORDER BY street NULLS FIRST, lo_num NULLS FIRST, identity_key) AS place FROM src WHERE max_snapshot_id = {SNAPSHOT} AND lo_num_suf = 'A'")
def _(spark, d):
    return range_audit.with_suffix(history.active(src(spark, d), SNAPSHOT), "A").select("identity_key", "street", "lo_num", F.col("place").cast("bigint").alias("place"))


@query("K12_street_states", """WITH o AS (SELECT c_custkey % 500 AS street, CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'dismissed' ELSE 'fixed' END AS value, 't' || c_custkey AS updated_at FROM customer),
a AS (SELECT street, max({'t': updated_at, 'v': value}) AS l FROM o WHERE street % 2 = 0 GROUP BY 1), b AS (SELECT street, max({'t': updated_at || 'x', 'v': value}) AS l FROM o WHERE street % 3 = 0 GROUP BY 1)
SELECT COALESCE(b.street, a.street) AS street, COALESCE(b.l.v, a.l.v) AS value, COALESCE(b.l.t, a.l.t) AS updated_at FROM a FULL JOIN b ON a.street = b.street""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") % 500).alias("street"), F.element_at(F.array(*map(F.lit, state.STREET_STATES)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("value"), F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("updated_at"))
    old = state.put(rows.limit(0), rows.where("street % 2 = 0"), "street", state.STREET_STATES)
    return state.put(old, rows.where("street % 3 = 0").withColumn("updated_at", F.concat("updated_at", F.lit("x"))), "street", state.STREET_STATES)


@query("U06_first_of_runs", f"{FEAT} SELECT osm_type, osm_id, CASE WHEN osm_id % 2 = 0 THEN 'old' ELSE street END AS street FROM feat")
def _(spark, d):
    f = feats(spark, d).select("osm_type", "osm_id", "street", (F.col("osm_id") % 3).alias("run_id"))
    older = f.select("osm_type", "osm_id", F.lit("old").alias("street"), (F.col("osm_id") % 2 * 10 - 5).alias("run_id"))
    return backfill.first_of_runs(f.unionByName(older), F.col("run_id")).select("osm_type", "osm_id", "street")


@query("J15_upload_items", f"{WORK} SELECT run_id, candidate_id, verdict, proposed_postcode FROM work WHERE stage = 'APPROVED'")
def _(spark, d):
    c = materialize(work(spark, d)[0], "work")
    return backfill.upload_items(c.select("run_id", "candidate_id", "stage"), c.select("run_id", "candidate_id", "verdict", "proposed_postcode")).drop("stage")


@query("K09_manifest", f"{WORK} SELECT run_id, candidate_id, address_full, lo_num + 900 AS osm_node_id, run_id + 7000 AS changeset_id FROM work WHERE stage = 'APPROVED' AND lo_num % 3 <> 1 AND run_id % 4 <> 2")
def _(spark, d):
    c = work(spark, d)[0].withColumns({"stage": F.when(F.col("stage") == "APPROVED", "UPLOADED"), "osm_node_id": F.when(F.col("lo_num") % 3 != 1, F.col("lo_num") + 900)})
    runs = cands(spark, d).select("run_id").distinct().withColumn("changeset_id", F.when(F.col("run_id") % 4 != 2, F.col("run_id") + 7000))
    return backfill.manifest(c, runs)


@query("O06_partials", f"SELECT candidate_id, total - hits AS missing_count, CASE WHEN total - hits <= 1 THEN 'few' ELSE 'many' END AS part, CASE WHEN total - hits <= 1 THEN total - hits ELSE hits - total END AS sort_key FROM ({SQL['J24_range_hits']}) WHERE hits > 0 AND total > hits")
def _(spark, d):
    found = coverage.range_hits(cands(spark, d).where("is_range"), feats(spark, d))
    return backfill.pending_work(found, 1).select("candidate_id", "missing_count", "part", "sort_key")


_NAMED = "named AS (SELECT DISTINCT lower(replace(src_name, ' ', '-')) || CASE b % 3 WHEN 0 THEN '-batch' WHEN 1 THEN '-' || b ELSE '' END || CASE b % 5 WHEN 0 THEN '' ELSE '-2026-0' || (b % 9 + 1) || '-1' || b % 10 END AS run FROM base)"


@query("P15_tile_of_run", rf"{LATTICE}, {_NAMED} SELECT run, regexp_replace(run, '(-batch)?-\d{{4}}-\d{{2}}-\d{{2}}$', '') AS tile FROM named")
def _(spark, d):
    b = F.col("b")
    mark = F.when(b % 3 == 0, "-batch").when(b % 3 == 1, F.concat(F.lit("-"), b)).otherwise("")
    date = F.when(b % 5 == 0, "").otherwise(F.concat(F.lit("-2026-0"), b % 9 + 1, F.lit("-1"), b % 10))
    run = F.concat(F.lower(F.replace("src_name", F.lit(" "), F.lit("-"))), mark, date)
    return lattice(spark, d, "base").select(run.alias("run")).distinct().select("run", backfill.tile_of_run(F.col("run")).alias("tile"))


#: The lattice's addresses as combined texts: places behind the street, after a comma or not.
_PLACED = "CASE k % 4 WHEN 1 THEN ' BLENHEIM TOWN' WHEN 2 THEN ', Emily Twp' WHEN 3 THEN ' Blenheim, ON' ELSE '' END"
_WAYS = ", ".join(f"'{x}'" for x in sorted({*text.DIRECTIONS, *text.DIRECTIONS.values()}))


@query("N11_resolve", f"{LATTICE} SELECT identity_key, upper(number) AS number, street, COALESCE(list_last(list_filter(string_split(street, ' '), lambda t: t NOT IN ({_WAYS}))), '') AS suffix FROM src")
def _(spark, d):
    none = F.lit(None).cast("string")
    combined = F.concat("number", F.lit(" "), "street", F.expr(_PLACED))
    number, street = datasets.resolve(none, combined, none, [], F.array(F.lit("Blenheim"), F.lit("Town")))
    return src(spark, d).select("identity_key", number.alias("number"), street.alias("street"), datasets.suffix_token(street).alias("suffix"))


@query("N06_split_numbers", rf"""{LATTICE} SELECT osm_id, array_to_string(list_transform(list_filter(list_transform(range(len(p)), lambda i: CASE WHEN list_position(p, p[i + 1]) = i + 1 THEN p[i + 1] END), lambda x: x IS NOT NULL), lambda x: x), '|') AS parts FROM (SELECT osm_id,
  flatten(list_transform(list_filter(list_transform(string_split_regex(housenumber, '[,;]'), lambda x: trim(x)), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '\d+[A-Za-z]*(/\d+[A-Za-z]*)+') THEN string_split(x, '/') ELSE [x] END)) AS p FROM osm)""")
def _(spark, d):
    return osm(spark, d).select("osm_id", F.array_join(text.split_housenumbers(F.col("housenumber")), "|").alias("parts"))



@query("N04_override_street", f"{LATTICE} SELECT DISTINCT street, CASE street WHEN 'DEANE FIELD CRES' THEN 'Deanefield Cres' WHEN 'KATHLEEN AVE' THEN 'Kathleen Cres' ELSE street END AS override FROM src")
def _(spark, d):
    return src(spark, d).select("street", text.override_street(F.col("street")).alias("override")).distinct()


_WAYS = f"""{LATTICE}, wn AS (SELECT osm_id AS way_id, n1 AS node_id FROM interp UNION ALL SELECT osm_id, n2 FROM interp),
wb AS (SELECT way_id, MIN(lat) AS minlat, MIN(lon) AS minlon, MAX(lat) AS maxlat, MAX(lon) AS maxlon FROM wn JOIN osm ON osm.osm_id = wn.node_id GROUP BY 1)"""


def ways(spark, d):
    w = lattice(spark, d, "interp").select(F.col("osm_id").alias("way_id"), F.explode(F.array("n1", "n2")).alias("node_id"))
    return w, extract.way_bounds(w, osm(spark, d).select(F.col("osm_id").alias("node_id"), "lat", "lon"))


@query("A31_relation_bounds", f"{_WAYS} SELECT r.relation_id, MIN(minlat) AS minlat, MAX(maxlon) AS maxlon, (MIN(minlat) + MAX(maxlat)) / 2 AS lat, (MIN(minlon) + MAX(maxlon)) / 2 AS lon, MIN(minlat) IS NOT NULL AS has_geometry FROM (SELECT osm_id AS way_id, osm_id % 3 AS relation_id FROM interp UNION ALL SELECT 0, 9) r LEFT JOIN wb USING (way_id) GROUP BY 1")
def _(spark, d):
    w, bounds = ways(spark, d)
    members = w.select("way_id", (F.col("way_id") % 3).alias("relation_id")).distinct().unionByName(spark.createDataFrame([(0, 9)], "way_id bigint, relation_id bigint"))
    return extract.relation_bounds(members, bounds).select("relation_id", "minlat", "maxlon", "lat", "lon", "has_geometry")


@query("F02_touching", f"{_WAYS} SELECT 'way' AS osm_type, way_id AS osm_id FROM wb WHERE minlat <= {BOX[2]}::DOUBLE AND maxlat >= {BOX[0]}::DOUBLE AND minlon <= {BOX[3]}::DOUBLE AND maxlon >= {BOX[1]}::DOUBLE UNION ALL SELECT osm_type, osm_id FROM osm WHERE lat BETWEEN {BOX[0]}::DOUBLE AND {BOX[2]}::DOUBLE AND lon BETWEEN {BOX[1]}::DOUBLE AND {BOX[3]}::DOUBLE")
def _(spark, d):
    b = extract.with_centre(ways(spark, d)[1]).select(F.lit("way").alias("osm_type"), F.col("way_id").alias("osm_id"), "lat", "lon", *extract.SIDES)
    e = osm(spark, d).select("osm_type", "osm_id", "lat", "lon", *[F.lit(None).cast("double").alias(s) for s in extract.SIDES]).unionByName(b)
    return e.where(extract.touches(F.col("osm_type"), F.col("lat"), F.col("lon"), tuple(F.col(s) for s in extract.SIDES), BOX)).select("osm_type", "osm_id")


@query("R08_verdicts", f"""{LATTICE}, o AS (SELECT osm_id, CASE WHEN osm_id % 3 = 0 THEN 'normalize' ELSE 'skip' END AS verdict, 't1' AS updated_at, CASE WHEN osm_id % 5 = 0 THEN 'x1' END AS exported_at FROM osm WHERE osm_id % 2 = 0),
n AS (SELECT osm_id, CASE WHEN osm_id % 7 < 4 THEN 'normalize' ELSE 'reverse' END AS v FROM osm WHERE osm_id % 4 < 2)
SELECT osm_id, COALESCE(v, verdict) AS verdict, CASE WHEN v IS NOT NULL AND v IS DISTINCT FROM verdict THEN 't2' ELSE updated_at END AS updated_at, CASE WHEN v IS NULL OR v = verdict THEN exported_at END AS exported_at FROM o FULL JOIN n USING (osm_id)""")
def _(spark, d):
    o = osm(spark, d).select("osm_id")
    m = F.col("osm_id")
    old = o.where("osm_id % 2 = 0").select("osm_id", F.when(m % 3 == 0, "normalize").otherwise("skip").alias("verdict"), F.lit("t1").alias("updated_at"), F.when(m % 5 == 0, "x1").alias("exported_at"))
    new = o.where("osm_id % 4 < 2").select("osm_id", F.when(m % 7 < 4, "normalize").otherwise("reverse").alias("verdict"), F.lit("t2").alias("updated_at"))
    return state.upsert_verdicts(old, new, ["osm_id"])
