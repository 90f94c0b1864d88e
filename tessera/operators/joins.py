"""Joins: keys, containment, nearest neighbours, anti and semi joins, set operations."""

_CELL = "CAST(floor({0} * 10e0) AS BIGINT)"
PLANS = {
    "join_01_area_attributes": "SELECT a.area_id, r.r_name, round(a.target, 6) AS target FROM t_area a JOIN t_region r ON a.county_id = r.r_regionkey",
    "join_02_subarea_demographics": "SELECT s.subarea_id, s.area_id, c.total, c.income FROM t_subarea s LEFT JOIN t_counts c ON s.subarea_id = c.subarea_id",
    "join_03_points_in_polygon": "SELECT i.point_id FROM t_inside i JOIN t_subarea s ON i.poly_id = s.subarea_id WHERE s.area_id = $area",
    # t_inside: cells as equi-join key, then a ray's crossings of the rings
    "join_04_point_in_polygon_left": "SELECT p.point_id, i.poly_id AS subarea_id, i.poly_id IS NULL AS unmatched FROM t_point p LEFT JOIN t_inside i ON p.point_id = i.point_id",
    "join_05_one_polygon_per_point": "SELECT point_id, subarea_id FROM (SELECT point_id, poly_id AS subarea_id, row_number() OVER (PARTITION BY point_id ORDER BY poly_id) AS nth FROM t_inside) WHERE nth = 1",
    "join_06_first_match": """
SELECT p.point_id, min_by(z.flood_zone, i.poly_id) AS zone, coalesce(min_by(z.in_sfha, i.poly_id), false) AS in_sfha FROM t_point p LEFT JOIN t_inside i ON p.point_id = i.point_id LEFT JOIN t_zone z ON i.poly_id = z.zone_id GROUP BY p.point_id""",
    # cells of the search radius: each destination is copied to its 3 x 3 neighbours, then it is an equi join
    "join_07_nearest_within": f"""
SELECT point_id, min_by(dest_id, dist) AS dest_id, round(min(dist), 6) AS dist FROM (
 SELECT p.point_id, d.dest_id, sqrt((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y)) AS dist FROM t_point p JOIN (SELECT dest_id, x, y, {_CELL.format("x")} + i AS cx, {_CELL.format("y")} + j AS cy FROM t_dest
  CROSS JOIN (SELECT -1 AS i UNION ALL SELECT 0 UNION ALL SELECT 1) CROSS JOIN (SELECT -1 AS j UNION ALL SELECT 0 UNION ALL SELECT 1)) d ON {_CELL.format("p.x")} = d.cx AND {_CELL.format("p.y")} = d.cy) WHERE dist <= 0.1e0 GROUP BY point_id""",
    "join_08_knn_in_group": "SELECT src, dst, round(d, 9) AS d FROM t_near",
    "join_09_node_snap": """
SELECT point_id, CASE WHEN metres <= 500e0 THEN node END AS node, round(metres, 3) AS metres FROM (SELECT s.point_id, s.node, 2e0 * 6371000e0 * asin(sqrt(
 sin(radians((n.y - p.y) / 100e0) / 2e0) * sin(radians((n.y - p.y) / 100e0) / 2e0) + cos(radians(35e0 + p.y / 100e0)) * cos(radians(35e0 + n.y / 100e0)) * sin(radians((n.x - p.x) / 100e0) / 2e0) * sin(radians((n.x - p.x) / 100e0) / 2e0))) AS metres
 FROM t_snap s JOIN t_point p ON s.point_id = p.point_id JOIN t_node n ON s.node = n.node)""",
    "join_10_od_pairs": "SELECT dest_type, count(*) AS pairs, round(avg(km), 6) AS mean_km FROM t_od_all GROUP BY dest_type",
    "join_11_mode_merge": """
SELECT d.point_id, d.dest_id, CASE WHEN w.t IS NOT NULL AND (d.t IS NULL OR w.t < d.t) THEN 'walk' WHEN d.t IS NOT NULL THEN 'drive' END AS best_mode, round(CASE WHEN w.t < d.t THEN w.t ELSE coalesce(d.t, w.t) END, 6) AS combined
FROM (SELECT point_id, dest_id, drive_time + 4e0 AS t FROM t_od WHERE km < 6e0) d LEFT JOIN (SELECT point_id, dest_id, walk_time AS t FROM t_od WHERE km < 1.5e0) w ON d.point_id = w.point_id AND d.dest_id = w.dest_id""",
    "join_12_neighbouring_areas": """
SELECT area_id, other, nth FROM (SELECT a.area_id, b.area_id AS other, row_number() OVER (PARTITION BY a.area_id ORDER BY greatest(abs(a.minx - b.minx) - 1e0, 0e0) + greatest(abs(a.miny - b.miny) - 1e0, 0e0), CASE WHEN a.area_id = b.area_id THEN 0 ELSE 1 END, b.area_id) AS nth FROM t_area a CROSS JOIN t_area b) WHERE nth <= 5""",
    "join_13_anti": "SELECT a.area_id, a.county_id FROM t_area a LEFT ANTI JOIN (SELECT n_nationkey FROM t_nation WHERE n_regionkey = 2) e ON a.area_id = e.n_nationkey",
    "join_14_semi": "SELECT p.point_id, p.area_id FROM t_point p LEFT SEMI JOIN (SELECT n_nationkey FROM t_nation WHERE n_regionkey = 1) e ON p.area_id = e.n_nationkey",
    "join_15_gap_pairs": """
SELECT subarea_id, CAST(sum(n) AS BIGINT) AS pairs FROM (SELECT subarea_id, step, sum(step) OVER (PARTITION BY subarea_id ORDER BY place, step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (
 SELECT subarea_id, truth + 0.3e0 AS place, 1 AS step FROM t_point WHERE truth IS NOT NULL UNION ALL SELECT subarea_id, truth, 0 FROM t_point WHERE truth IS NOT NULL)) WHERE step = 0 GROUP BY subarea_id HAVING sum(n) > 0""",
    "join_16_idw": """
SELECT point_id, round(sum(target / (d2 + 1e-6)) / sum(1e0 / (d2 + 1e-6)), 6) AS idw FROM (SELECT p.point_id, a.target, (p.x - a.minx - 0.5e0) * (p.x - a.minx - 0.5e0) + (p.y - a.miny - 0.5e0) * (p.y - a.miny - 0.5e0) AS d2 FROM t_point p CROSS JOIN t_area a WHERE a.target IS NOT NULL) GROUP BY point_id""",
    "join_17_alignment_check": """
SELECT count_if(a.point_id IS NULL) AS only_right, count_if(b.point_id IS NULL) AS only_left, count(*) AS keys FROM (SELECT point_id FROM t_pred WHERE method = 'naive') a FULL OUTER JOIN (SELECT point_id FROM t_pred WHERE method = 'dasymetric') b ON a.point_id = b.point_id""",
    "join_18_metric_lift": "SELECT m.area_id, round(m.rmse - b.rmse, 6) AS lift FROM t_metric m LEFT JOIN t_metric b ON m.area_id = b.area_id AND b.method = 'naive' WHERE m.method = 'dasymetric'",
    "set_01_union": "SELECT area_id, 'east' AS half FROM t_area WHERE minx >= 2e0 UNION ALL SELECT area_id, 'west' FROM t_area WHERE minx < 3e0",
    "set_02_feature_sets": """
SELECT coalesce(a.f, b.f) AS feature, CASE WHEN b.f IS NULL THEN 'first only' WHEN a.f IS NULL THEN 'second only' WHEN a.s = b.s THEN 'same sign' ELSE 'opposite' END AS kind FROM
 t_set_1 a FULL OUTER JOIN t_set_2 b ON a.f = b.f""",
    "set_03_top_overlap": """
SELECT count(*) AS shared FROM ((SELECT area_id FROM (SELECT area_id, row_number() OVER (ORDER BY rmse, area_id) AS n FROM t_metric WHERE method = 'naive') WHERE n <= 10) INTERSECT (SELECT area_id FROM (SELECT area_id, row_number() OVER (ORDER BY rmse, area_id) AS n FROM t_metric WHERE method = 'gradient') WHERE n <= 10))""",
}
