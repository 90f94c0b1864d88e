"""Sources and sinks as statements over tables: typed reads, lookups, alignment, materialisation keys."""

from ..sources.ranks import placed

PLANS = {
    "src_01_area_polygons": "SELECT trim(CAST(area_id AS STRING)) AS area_key, seq, x, y FROM t_ring WHERE county_id = 2",
    "src_07_destinations_or_literals": "SELECT dest_id, dest_type FROM t_dest WHERE dest_type = 'grocery' UNION ALL SELECT l.dest_id, l.dest_type FROM (SELECT CAST(-1 AS BIGINT) AS dest_id, 'grocery' AS dest_type UNION ALL SELECT -2, 'school') l LEFT ANTI JOIN (SELECT DISTINCT dest_type FROM t_dest) d ON l.dest_type = d.dest_type",
    "src_09_road_polylines": "SELECT src AS road_id, row_number() OVER (PARTITION BY src ORDER BY dst) AS seq, n.x, n.y, CASE WHEN length > 500e0 THEN 'primary' ELSE 'local' END AS road_type FROM t_road r JOIN t_node n ON r.dst = n.node",
    "src_12_footprints": """
SELECT area_id, round(0.5e0 * abs(sum(x * y2 - x2 * y)), 6) AS area, round(sum((x + x2) * (x * y2 - x2 * y)) / (3e0 * sum(x * y2 - x2 * y)), 6) AS cx, round(sum((y + y2) * (x * y2 - x2 * y)) / (3e0 * sum(x * y2 - x2 * y)), 6) AS cy, count(*) AS vertices FROM (
 SELECT a.area_id, a.x, a.y, b.x AS x2, b.y AS y2 FROM t_ring a JOIN t_ring b ON a.area_id = b.area_id AND b.seq = (a.seq + 1) % 4) GROUP BY area_id""",
    "src_13_flood_zones": "SELECT zone_id, flood_zone, in_sfha, CAST(NULL AS DOUBLE) AS depth FROM t_zone",
    "src_02_area_attributes": """
SELECT area_id, county, CASE WHEN raw = -999e0 THEN NULL ELSE raw END AS value FROM (
 SELECT n.n_nationkey AS area_id, lower(trim(r.r_name)) AS county, CASE WHEN n.n_nationkey % 6 = 0 THEN -999e0 ELSE CAST(n.n_nationkey AS DOUBLE) / 25e0 END AS raw
 FROM t_nation n JOIN t_region r ON n.n_regionkey = r.r_regionkey) WHERE county = lower('ASIA') OR county = 'europe'""",
    "src_03_county_lookup": """
SELECT r.r_name AS county, count(DISTINCT n.n_regionkey) AS codes, count(DISTINCT n.n_regionkey) = 1 AS is_unique FROM t_nation n JOIN t_region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""",
    "src_04_property_values": """
WITH p AS (SELECT o_custkey AS hash, min_by(o_totalprice, o_orderkey) AS v FROM t_orders WHERE o_totalprice IS NOT NULL GROUP BY o_custkey)
SELECT p.hash, round((p.v - r.lo) / (CASE WHEN r.hi = r.lo THEN 1e0 ELSE r.hi - r.lo END), 6) AS norm FROM p CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM p) r""",
    "src_05_job_blocks": """
SELECT b.block, substring(b.block, length(b.block) - 3, 4) AS label, b.jobs, round(b.pay, 2) AS pay, round(b.taxes, 4) AS taxes, round(b.discounts, 4) AS discounts, round(d.x, 6) AS x, round(d.y, 6) AS y FROM (
 SELECT '37' || substring(CAST(1000000 + l_suppkey AS STRING), 2, 6) AS block, min(l_suppkey) AS k, CAST(sum(l_quantity) AS BIGINT) AS jobs, sum(l_extendedprice) AS pay, sum(l_tax) AS taxes, sum(l_discount) AS discounts FROM t_lineitem WHERE l_returnflag LIKE 'A%' GROUP BY 1) b
JOIN t_dest d ON b.k = d.dest_id WHERE b.jobs >= 10""",
    "src_06_poi": f"""
SELECT below + 1 AS dest_id, name, lon, lat FROM ({placed("""(SELECT p_partkey, coalesce(nullif(trim(p_name), ''), 'poi') AS name, round(coalesce(lon, longitude), 6) AS lon, round(coalesce(lat, latitude), 6) AS lat FROM (
 SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN p_retailprice / 1000e0 END AS lon, CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS DOUBLE) END AS longitude, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) / 10e0 END AS lat, CASE WHEN p_size % 2 = 1 THEN p_retailprice / 100e0 END AS latitude FROM t_part WHERE p_type = 'ECONOMY'))""", "p_partkey")})""",
    "src_08_point_enrichment": """
SELECT p.point_id, p.area_id, a.n_orders, round(a.mean_price, 1) AS mean_price FROM t_point p LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM t_orders GROUP BY o_custkey) a ON p.point_id = a.o_custkey""",
    "src_10_chunk_merge": """
SELECT coalesce(a.k, b.k) AS geoid, a.v AS quantity, b.v AS orders FROM t_chunk_1 a FULL OUTER JOIN t_chunk_2 b ON a.k = b.k""",
    "src_11_external_target": """
SELECT count(*) AS points, count(v) AS matched, count(*) - count(v) AS missing, count(v) > 0 AS any_match, CAST(count(v) AS DOUBLE) / count(*) < 0.8e0 AS warn, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean
FROM t_point p LEFT JOIN (SELECT doc_id, CAST(min(quality) AS DOUBLE) AS v FROM t_labels GROUP BY doc_id) l ON p.point_id = l.doc_id""",
    "src_14_tag_extraction": """
SELECT event_id, coalesce(event_type, 'yes') AS building, CAST(get_json_object(props, '$.k') AS BIGINT) AS tag FROM t_events WHERE get_json_object(props, '$.k') IS NOT NULL AND event_type <> 'error'""",
    "src_15_raster_sample": """
SELECT p.point_id, coalesce(c.cover, -1) AS cover FROM (SELECT point_id, CAST(floor((x - 0.5e0) / (5e0 / w)) AS BIGINT) AS col, CAST(floor((y - 0.5e0) / (5e0 / w)) AS BIGINT) AS row_ FROM t_point CROSS JOIN t_lattice) p
LEFT JOIN (SELECT p_partkey % w AS col, CAST(floor(CAST(p_partkey AS DOUBLE) / w) AS BIGINT) AS row_, p_size AS cover FROM t_part CROSS JOIN t_lattice) c ON p.col = c.col AND p.row_ = c.row_""",
    "src_16_ledger": """
SELECT parcel, count(DISTINCT bill_year) AS years, min(bill_year) AS first_year FROM (SELECT upper(trim('m' || CAST(o_custkey % 10 AS STRING))) || '|' || CAST(o_custkey AS STRING) AS parcel, year(o_orderdate) AS bill_year FROM t_orders)
WHERE bill_year BETWEEN 1995 AND 1997 GROUP BY parcel""",
    "src_17_access_log": """
SELECT operation, cache_type, cache_key, hit, CAST(get_json_object(props, '$.k') AS BIGINT) AS depth FROM t_log WHERE operation = 'get'""",
    "snk_03_feature_matrix": """
SELECT point_id, max(CASE WHEN feature = 'ancillary' THEN round(value, 6) END) AS ancillary, max(CASE WHEN feature = 'east' THEN round(value, 6) END) AS east, max(CASE WHEN feature = 'north' THEN round(value, 6) END) AS north,
 max(CASE WHEN feature = 'block_count' THEN value END) AS block_count FROM t_feature GROUP BY point_id HAVING count(DISTINCT area_id) = 1""",
    "snk_04_trial_ledger": """
SELECT m.method, m.area_id, round(m.rmse, 6) AS rmse FROM t_metric m LEFT ANTI JOIN t_done_trial done ON m.method = done.method AND m.area_id = done.area_id""",
    "snk_05_content_key": """
SELECT area_id, md5(string_agg(h, ',') WITHIN GROUP (ORDER BY cell, h)) AS content_key FROM (SELECT area_id, cell, md5(string_agg(k, ',') WITHIN GROUP (ORDER BY k)) AS h FROM (SELECT area_id, CAST(floor(x * 64e0) AS BIGINT) * 100000 + CAST(floor(y * 64e0) AS BIGINT) AS cell, CAST(CAST(round(x * 1e6, 0) AS BIGINT) AS STRING) || ':' || CAST(CAST(round(y * 1e6, 0) AS BIGINT) AS STRING) AS k FROM t_point) GROUP BY area_id, cell) GROUP BY area_id""",
}
