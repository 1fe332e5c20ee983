"""SQL of the same queries for DuckDB, over the lattice."""

from __future__ import annotations

from addrloom.functions.text import DIRECTIONS, STREET_SUFFIXES
from addrloom.sources.lattice import LATTICE, RUN_BLOCKS

_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (STREET_SUFFIXES | DIRECTIONS).items()) + "}"


def norm(x: str) -> str:
    return rf"array_to_string(list_transform(list_filter(string_split_regex(upper(replace(COALESCE({x}, ''), '.', '')), '\s+'), lambda t: t <> ''), lambda t: COALESCE({_MAP}[t], t)), ' ')"


def hav(a: str, b: str, c: str, d: str) -> str:
    s = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(6371000.0::DOUBLE * 2 * atan2(sqrt({s}), sqrt(1 - {s})))"


def order(x: str) -> str:
    digits = f"regexp_replace({x}, '^0+', '')"
    return f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN '0' || lpad(CAST(length({digits}) AS VARCHAR), 10, '0') || {digits} || ' ' || {x} ELSE '1' || {x} END"


CAND = f"""{LATTICE},
cand AS (SELECT CAST(FLOOR(b / {RUN_BLOCKS}) AS BIGINT) AS run_id, identity_key AS candidate_id, NULLIF(upper(trim(number)), '') AS housenumber,
  {norm("CASE street WHEN 'DEANE FIELD CRES' THEN 'Deanefield Cres' WHEN 'KATHLEEN AVE' THEN 'Kathleen Cres' WHEN 'MC CAUL ST' THEN 'McCAUL ST' ELSE street END")} AS street_norm,
  number || ' ' || street AS address_full, muni, cls, lo_num, hi_num, lo_num_suf, lat, lon, COALESCE(lo_num <> hi_num, FALSE) AS is_range
  FROM src WHERE max_snapshot_id = 10 AND cls IS DISTINCT FROM 'Land Entrance')"""
FEAT = f"""{CAND},
feat AS (SELECT osm_id, osm_type, upper(housenumber) AS num, {norm("street")} AS street_norm, housenumber, street, lat, lon, poi_key, postcode, name, entrance,
  COALESCE(poi_key IN ('amenity', 'disused:shop'), FALSE) AND osm_type = 'node' AS is_poi
  FROM osm WHERE NOT (osm_type = 'node' AND osm_id IN (SELECT n1 FROM interp UNION SELECT n2 FROM interp)))"""
CONF = f"""{FEAT},
land AS (SELECT *, {order("candidate_id")} AS o FROM cand WHERE cls = 'Land'),
sib AS (SELECT a.run_id, a.candidate_id, a.o < MIN(s.o) AS is_canonical, MIN({hav("a.lat", "a.lon", "s.lat", "s.lon")}) AS sibling_dist,
  arg_min(s.candidate_id, {{'d': {hav("a.lat", "a.lon", "s.lat", "s.lon")}, 'o': s.o}}) AS sibling_id
  FROM land a JOIN land s ON a.run_id = s.run_id AND a.address_full = s.address_full AND a.muni IS NOT DISTINCT FROM s.muni AND a.candidate_id <> s.candidate_id GROUP BY a.run_id, a.candidate_id, a.o),
sk AS (SELECT c.*, sibling_id, sibling_dist, is_canonical, c.is_range OR (c.cls IS DISTINCT FROM 'Land' AND EXISTS (SELECT 1 FROM land l WHERE l.run_id = c.run_id AND l.address_full = c.address_full AND l.muni IS NOT DISTINCT FROM c.muni))
    OR COALESCE(sibling_dist <= 5 AND NOT is_canonical, FALSE) AS skipped FROM cand c LEFT JOIN sib USING (run_id, candidate_id)),
hits AS (SELECT c.run_id, c.candidate_id, f.osm_id, f.osm_type, f.is_poi, f.postcode, f.name, f.poi_key, {hav("c.lat", "c.lon", "f.lat", "f.lon")} AS dist FROM sk c JOIN feat f ON c.housenumber = f.num AND c.street_norm = f.street_norm WHERE NOT c.skipped),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, candidate_id, is_poi ORDER BY dist, osm_id) AS rn FROM hits WHERE dist <= 100) WHERE rn = 1),
conf0 AS (SELECT s.*, m.osm_id, m.osm_type, m.dist, m.name AS m_name, m.poi_key AS m_poi,
    CASE WHEN s.skipped THEN 'SKIPPED' WHEN m.osm_id IS NULL THEN 'MISSING' WHEN m.dist <= 15 THEN 'MATCH' ELSE 'MATCH_FAR' END AS verdict, p.osm_id AS p_id, p.postcode AS p_code
  FROM sk s LEFT JOIN best m ON s.run_id = m.run_id AND s.candidate_id = m.candidate_id AND NOT m.is_poi LEFT JOIN best p ON s.run_id = p.run_id AND s.candidate_id = p.candidate_id AND p.is_poi),
grp AS (SELECT run_id, address_full, muni, bool_and(verdict = 'MATCH') AS group_all_match FROM conf0 WHERE cls = 'Land' GROUP BY ALL HAVING COUNT(*) > 1),
conf AS (SELECT c.*, CASE WHEN verdict = 'MISSING' THEN p_id END AS poi_id, CASE WHEN verdict = 'MISSING' THEN NULLIF(trim(p_code), '') END AS proposed_postcode, g.group_all_match
  FROM conf0 c LEFT JOIN grp g ON c.cls = 'Land' AND c.run_id = g.run_id AND c.address_full = g.address_full AND c.muni IS NOT DISTINCT FROM g.muni)"""
#: CRC-32 of an ASCII text, bit by bit.
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, CAST(i AS BIGINT), 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"
ORDINAL = f"CASE WHEN regexp_full_match(candidate_id, '[0-9]+') THEN CAST(candidate_id AS BIGINT) ELSE {CRC.format(x='candidate_id')} END"
LIST = "array_to_string(list_slice(list(id || '@' || printf('%d.%02d', cm // 100, cm % 100) ORDER BY {order}), 1, 5), '|')"
PAIR = hav("c.lat", "c.lon", "f.lat", "f.lon")
CHECKS = f"""{CONF},
open AS (SELECT * FROM conf WHERE verdict <> 'SKIPPED'),
dup0 AS (SELECT c.run_id, c.candidate_id, CAST(round({PAIR} * 100) AS BIGINT) AS cm, f.candidate_id AS id, {order("f.candidate_id")} AS o FROM cand c JOIN cand f ON c.run_id = f.run_id AND c.candidate_id <> f.candidate_id AND abs(c.lat - f.lat) < 1e-4 AND abs(c.lon - f.lon) < 1e-4 WHERE {PAIR} <= 3),
dupn AS (SELECT run_id, candidate_id, COUNT(*) AS n, {LIST.format(order="cm, o")} AS t FROM dup0 GROUP BY ALL),
mis0 AS (SELECT c.run_id, c.candidate_id, CAST(round({PAIR} * 100) AS BIGINT) AS cm, f.osm_type AS k, f.osm_id AS no, f.osm_type || '/' || f.osm_id AS id FROM open c JOIN feat f ON c.housenumber = f.num AND NOT f.is_poi AND f.street_norm <> '' AND f.street_norm <> c.street_norm AND abs(c.lat - f.lat) < 1e-3 WHERE c.verdict = 'MISSING' AND {PAIR} <= 20),
misn AS (SELECT run_id, candidate_id, COUNT(*) AS n, {LIST.format(order="cm, k, no")} AS t FROM mis0 GROUP BY ALL),
dri0 AS (SELECT c.run_id, c.candidate_id, CAST(round({PAIR} * 100) AS BIGINT) AS cm, f.osm_type AS k, f.osm_id AS no, f.osm_type || '/' || f.osm_id AS id FROM open c JOIN feat f ON c.street_norm = f.street_norm AND NOT f.is_poi AND c.housenumber <> f.num AND FLOOR(c.lat * 500) BETWEEN FLOOR(f.lat * 500) - 1 AND FLOOR(f.lat * 500) + 1 AND abs(c.lon - f.lon) < 2e-3
  WHERE c.verdict IN ('MATCH', 'MATCH_FAR') AND c.street_norm <> '' AND {PAIR} <= c.dist - 2),
drin AS (SELECT run_id, candidate_id, COUNT(*) AS n, {LIST.format(order="cm, k, no")} AS t FROM dri0 GROUP BY ALL),
res AS (
  SELECT run_id, candidate_id, 'match_far' AS check_id, 2 AS version, CASE WHEN verdict = 'MATCH_FAR' THEN 'FLAG' ELSE 'SKIP' END AS v, 'warn' AS sev, 'match_far' AS flag, 'ok' AS pass, 0 AS n, NULL AS t FROM open
  UNION ALL SELECT run_id, candidate_id, 'suffix_range', 2, CASE WHEN verdict <> 'MISSING' THEN 'SKIP' WHEN is_range OR upper(CASE WHEN lo_num_suf <> 'None' THEN lo_num_suf ELSE regexp_extract(housenumber, '^[0-9]+\\s*([A-Za-z])\\b', 1) END) IN ('I', 'O', 'Q') THEN 'FLAG' ELSE 'PASS' END, 'info', CASE WHEN is_range THEN 'range' ELSE 'suspicious_suffix' END, 'ok', 0, NULL FROM open
  UNION ALL SELECT o.run_id, o.candidate_id, 'city_duplicate', 1, CASE WHEN n > 0 THEN 'FLAG' ELSE 'PASS' END, 'info', 'city_duplicate', 'unique_location', COALESCE(n, 0), t FROM open o LEFT JOIN dupn USING (run_id, candidate_id)
  UNION ALL SELECT run_id, candidate_id, 'intra_source_duplicate', 2, CASE WHEN sibling_id IS NOT NULL AND NOT COALESCE(group_all_match, FALSE) THEN 'FLAG' ELSE 'SKIP' END, 'info', 'intra_source_duplicate', 'ok', 0, sibling_id || '@' || printf('%.2f', round(sibling_dist * 100) / 100) FROM open
  UNION ALL SELECT run_id, candidate_id, 'missing_sample', 1, CASE WHEN verdict <> 'MISSING' THEN 'SKIP' WHEN ({ORDINAL}) % 50 = 0 THEN 'FLAG' ELSE 'PASS' END, 'info', 'spot_check', 'not_sampled', 0, NULL FROM open
  UNION ALL SELECT o.run_id, o.candidate_id, 'nearby_street_mismatch', 2, CASE WHEN verdict <> 'MISSING' THEN 'SKIP' WHEN n > 0 THEN 'FLAG' ELSE 'PASS' END, 'warn', 'nearby_street_mismatch', 'no_nearby_mismatch', COALESCE(n, 0), t FROM open o LEFT JOIN misn USING (run_id, candidate_id)
  UNION ALL SELECT o.run_id, o.candidate_id, 'match_number_drift', 2, CASE WHEN verdict NOT IN ('MATCH', 'MATCH_FAR') OR street_norm = '' THEN 'SKIP' WHEN n > 0 THEN 'FLAG' ELSE 'PASS' END, 'warn', 'match_number_drift', 'no_number_drift', COALESCE(n, 0), t FROM open o LEFT JOIN drin USING (run_id, candidate_id)
  UNION ALL SELECT run_id, candidate_id, 'potential_amenity', 4, CASE WHEN verdict NOT IN ('MATCH', 'MATCH_FAR') OR osm_type <> 'node' THEN 'SKIP' WHEN m_name IS NOT NULL OR m_poi IS NOT NULL THEN 'FLAG' ELSE 'PASS' END, 'info', 'potential_amenity', 'pure_address',
    CASE WHEN m_name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN m_poi IS NOT NULL THEN 1 ELSE 0 END, array_to_string(list_sort(list_filter([m_poi, CASE WHEN m_name IS NOT NULL THEN 'name' END], lambda x: x IS NOT NULL)), ',') FROM open),
checks AS (SELECT run_id, candidate_id, check_id, CAST(version AS INTEGER) AS version, v AS verdict, CASE WHEN v = 'FLAG' THEN sev END AS severity, CASE v WHEN 'SKIP' THEN 'not_applicable' WHEN 'FLAG' THEN flag ELSE pass END AS reason_code,
  CAST(CASE WHEN v = 'FLAG' THEN n ELSE 0 END AS BIGINT) AS n_details, CASE WHEN v = 'FLAG' THEN t END AS details FROM res)"""
