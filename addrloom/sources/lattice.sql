WITH st(sid, src_name, osm_name) AS (VALUES
  (0,'MAIN ST','Main Street'), (1,'KING ST W','King Street West'), (2,'ST CLAIR AVE E','St Clair Avenue East'),
  (3,'MC CAUL ST','McCaul Street'), (4,'OAK CRES','Oak Crescent'), (5,'DEANE FIELD CRES','Deanefield Crescent'),
  (6,'ELM BV','Elm Boulevard'), (7,'LAKE SHORE DR','Lake Shore Drive'), (8,'PINE CRT','Pine Court'),
  (9,'THE KINGSWAY','The Kingsway'), (10,'KATHLEEN AVE','Kathleen Crescent'), (11,'BIRCH PKWY N','Birch Parkway North')),
k0 AS (SELECT o_orderkey AS k, CAST(FLOOR(o_orderkey / 40) AS BIGINT) AS b, o_orderkey % 40 AS p FROM orders),
k1 AS (SELECT k, b, p, b % 12 AS sid, CAST(FLOOR(b / 12) AS BIGINT) % 3 AS mid,
         CASE WHEN k % 97 = 5 OR k % 101 = 7 THEN p - 1 ELSE p END AS hp,
         CASE WHEN k % 97 = 5 THEN p - 85e-2 ELSE p * 1e0 END AS xp
       FROM k0 WHERE p > 0),
base AS (SELECT k, b, p, src_name, osm_name, 'M' || CAST(mid AS STRING) AS muni,
         CASE WHEN mid = 1 THEN 1000000 ELSE 0 END + 100 * (CAST(FLOOR(b / 36) AS BIGINT) % 500) + 2 * hp + 1 AS n,
         4360e-2 + (b % 200) * 9e-4 AS lat,
         -7960e-2 + CAST(FLOOR(b / 200) AS BIGINT) * 8e-3 + xp * 15e-5 AS lon,
         CASE k % 20 WHEN 17 THEN 'Structure' WHEN 18 THEN 'Structure Entrance' WHEN 19 THEN 'Land Entrance' ELSE 'Land' END AS cls,
         CASE WHEN k % 31 = 4 THEN 'A' WHEN k % 211 = 9 THEN 'I' ELSE 'None' END AS suf,
         CASE WHEN k % 53 = 11 THEN 6 WHEN k % 53 = 12 THEN 3 ELSE 0 END AS span
       FROM k1 JOIN st USING (sid)),
src AS (
  SELECT CAST(k AS STRING) AS identity_key, k, b, p,
         CASE WHEN k % 37 = 8 THEN 8 ELSE 1 END AS min_snapshot_id, CASE WHEN k % 29 = 6 THEN 6 ELSE 10 END AS max_snapshot_id,
         CAST(n AS STRING) || CASE WHEN suf = 'None' THEN '' ELSE suf END AS number, src_name AS street,
         CASE WHEN k % 3 = 0 THEN 'None' WHEN k % 3 = 1 THEN '' ELSE NULL END AS unit,
         n AS lo_num, CASE WHEN span > 0 THEN n + span WHEN k % 2 = 0 THEN NULL ELSE n END AS hi_num, suf AS lo_num_suf,
         muni, cls, CASE k % 43 WHEN 9 THEN 'Pending' WHEN 10 THEN NULL ELSE 'Current' END AS status, lat, lon
    FROM base
  UNION ALL  -- re-issued identity, same civic address
  SELECT 'syn:r' || CAST(k AS STRING), k, b, p, 7, 10, CAST(n AS STRING) || CASE WHEN suf = 'None' THEN '' ELSE suf END, src_name,
         NULL, n, NULL, suf, muni, cls, 'Current', lat + 1e-5, lon FROM base WHERE k % 58 = 6
  UNION ALL  -- stacked units
  SELECT 'syn:u' || CAST(k AS STRING) || '-' || CAST(u AS STRING), k, b, p, 1, 10, CAST(n AS STRING) || CASE WHEN suf = 'None' THEN '' ELSE suf END, src_name,
         CAST(u AS STRING), n, NULL, suf, muni, cls, 'Current', lat, lon FROM base CROSS JOIN (VALUES (101), (102)) AS un(u) WHERE k % 61 = 12),
osm AS (SELECT 1000000 + k AS osm_id, CASE WHEN k % 50 = 0 THEN 'relation' WHEN k % 5 = 0 THEN 'way' ELSE 'node' END AS osm_type, k, b, p,
         CASE k % 41 WHEN 1 THEN CAST(n AS STRING) || ';' || CAST(n+2 AS STRING) WHEN 2 THEN CAST(n AS STRING) || ',' || CAST(n+2 AS STRING)
              WHEN 3 THEN CAST(n AS STRING) || '-' || CAST(n+4 AS STRING) WHEN 4 THEN CAST(n+4 AS STRING) || '-' || CAST(n AS STRING)
              WHEN 5 THEN '12-' || CAST(n+500 AS STRING) WHEN 6 THEN CAST(n AS STRING) || '/' || CAST(n+2 AS STRING)
              WHEN 7 THEN CAST(n AS STRING) || ' 1/2' WHEN 8 THEN CAST(n AS STRING) || 'A-' || CAST(n+4 AS STRING) || 'A'
              WHEN 9 THEN CAST(n AS STRING) || ',' || CAST(n+2 AS STRING) || ';' || CAST(n+4 AS STRING)
              ELSE CAST(CASE WHEN k % 19 = 3 THEN n + 2 ELSE n END AS STRING) || CASE WHEN suf = 'A' THEN 'a' ELSE '' END END AS housenumber,
         CASE WHEN k % 67 = 9 THEN '' WHEN k % 71 = 3 THEN osm_name || ';Oak Crescent' WHEN k % 71 = 5 THEN osm_name || ', Unit 5'
              WHEN k % 17 = 4 THEN osm_name || ' Old' ELSE osm_name END AS street,
         CASE WHEN k % 11 = 6 THEN 'amenity' WHEN k % 11 = 8 THEN 'disused:shop' END AS poi_key,
         CASE WHEN k % 11 IN (6, 8) AND k % 2 = 0 THEN 'M5V ' || CAST(k % 10 AS STRING) || 'A1' END AS postcode,
         CASE WHEN k % 7 = 2 THEN 'Name ' || CAST(k AS STRING) END AS name, CASE WHEN k % 13 = 4 THEN 'yes' END AS entrance,
         CASE WHEN k % 10 IN (7, 8) THEN lat + 36e-5 ELSE lat + 3e-5 END AS lat, lon
       FROM base WHERE k % 3 <> 0),
interp AS (SELECT 5000000 + b AS osm_id, 1000000 + 40 * b + 1 AS n1, 1000000 + 40 * b + 38 AS n2 FROM base WHERE p = 1 AND b % 25 = 0)
