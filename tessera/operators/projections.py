"""Scalar expressions over points, areas and counts."""

PLANS = {
    "prj_01_socioeconomic_defaults": """
SELECT subarea_id, round(coalesce(n_f * 100e0 / nullif(orders_n, 0), 10e0), 6) AS pct_no_vehicle, round(coalesce(n_o * 100e0 / nullif(orders_n, 0), 15e0), 6) AS pct_poverty, round(coalesce(n_urgent * 100e0 / nullif(orders_n, 0), 5e0), 6) AS pct_unemployed,
 round(coalesce(n_high * 100e0 / nullif(orders_n, 0), 10e0), 6) AS pct_no_hs_diploma, round(coalesce(n_medium * 100e0 / nullif(orders_n, 0), 12e0), 6) AS pct_uninsured, round(coalesce(n_cheap * 100e0 / nullif(orders_n, 0), 5e0), 6) AS pct_mobile_homes,
 round(coalesce(n_p * 100e0 / nullif(orders_n, 0), 2e0), 6) AS pct_crowded, coalesce(CAST(nullif(total, 0) AS DOUBLE), 2000e0) AS population, coalesce(CAST(nullif(orders_n, 0) AS DOUBLE), 800e0) AS housing_units FROM t_counts""",
    "prj_02_area_target": """
SELECT n.n_nationkey AS area_id, round(CASE WHEN a.target IS NULL OR a.target < 0e0 THEN 0.5e0 ELSE a.target END, 6) AS target FROM t_nation n LEFT JOIN t_gap_target a ON n.n_nationkey = a.area_id""",
    "prj_03_target_dispatch": """
SELECT 'svi' AS kind, area_id, round(target, 6) AS target FROM t_area UNION ALL
SELECT 'property_value', a.area_id, round(coalesce(avg(p.ancillary / 100e0), 0.5e0), 6) FROM t_area a LEFT JOIN t_point p ON p.area_id = a.area_id GROUP BY a.area_id""",
    "prj_04_truth_vector": "SELECT p.point_id, round(t.truth, 6) AS truth FROM t_point p LEFT JOIN (SELECT point_id, truth FROM t_point WHERE truth > 0.3e0) t ON p.point_id = t.point_id",
    "prj_05_area_context": "SELECT p.point_id, round(a.target, 6) AS target, CAST(a.n_points AS DOUBLE) / 10000e0 AS population FROM t_point p JOIN t_area a ON p.area_id = a.area_id",
    "prj_06_rates": """
SELECT subarea_id, round(CASE WHEN orders_n > 0 THEN (n_f) / orders_n * 100e0 END, 6) AS f_rate, round(CASE WHEN orders_n > 0 THEN (n_o) / orders_n * 100e0 END, 6) AS o_rate, round(CASE WHEN orders_n > 0 THEN (n_p) / orders_n * 100e0 END, 6) AS p_rate, round(CASE WHEN orders_n > 0 THEN (n_urgent) / orders_n * 100e0 END, 6) AS urgent_rate, round(CASE WHEN orders_n > 0 THEN (n_high) / orders_n * 100e0 END, 6) AS high_rate, round(CASE WHEN orders_n > 0 THEN (n_medium) / orders_n * 100e0 END, 6) AS medium_rate, round(CASE WHEN orders_n > 0 THEN (n_low) / orders_n * 100e0 END, 6) AS low_rate, round(CASE WHEN orders_n > 0 THEN (n_urgent + n_high) / orders_n * 100e0 END, 6) AS pressing_rate, round(CASE WHEN orders_n > 0 THEN (n_high + n_medium + n_low) / orders_n * 100e0 END, 6) AS calm_rate, round(CASE WHEN orders_n > 0 THEN (n_cheap) / orders_n * 100e0 END, 6) AS cheap_rate, round(CASE WHEN orders_n > 0 THEN (n_dear) / orders_n * 100e0 END, 6) AS dear_rate, round(CASE WHEN total > 0 THEN (orders_n) / total * 100e0 END, 6) AS per_point FROM t_counts""",
    "prj_07_minority_share": "SELECT subarea_id, round(least((1e0 - n_f / nullif(orders_n, 0)) * 100e0 + coalesce(n_urgent / nullif(total, 0) * 100e0, 0e0), 100e0), 6) AS share FROM t_counts",
    "prj_08_building_encoder": """
SELECT p_partkey, round(ln(1e0 + coalesce(area, 0e0)), 6) AS log_area, coalesce(vertices, m.v, 6e0) AS vertices, round(coalesce(ratio, r.r, 1e0), 6) AS build_land_ratio, round(coalesce(acres, 0e0), 6) AS acres, CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 1e0 ELSE 0e0 END AS residential FROM t_building LEFT JOIN t_cut_vertices m ON m.g = 0 LEFT JOIN t_cut_ratio r ON r.g = 0""",
    "prj_09_land_use_bins": """
SELECT p_partkey, CASE WHEN code >= 100 AND code < 200 THEN 1e0 ELSE 0e0 END AS lu_1, CASE WHEN code >= 200 AND code < 300 THEN 1e0 ELSE 0e0 END AS lu_2, CASE WHEN code >= 300 AND code < 400 THEN 1e0 ELSE 0e0 END AS lu_3,
 CASE WHEN code IS NULL OR code < 100 OR code >= 400 THEN 1e0 ELSE 0e0 END AS lu_other FROM t_land_use""",
    "prj_10_one_hot": """
SELECT c_custkey AS point_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 1e0 ELSE 0e0 END AS is_building, CASE WHEN c_mktsegment = 'MACHINERY' THEN 1e0 ELSE 0e0 END AS is_machinery, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1e0 ELSE 0e0 END AS is_automobile,
 CASE WHEN c_mktsegment = 'FURNITURE' THEN 1e0 ELSE 0e0 END AS is_furniture, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1e0 ELSE 0e0 END AS is_household FROM t_customer""",
    "prj_11_parcel_features": "SELECT p_partkey, round(ln(1e0 + coalesce(p_retailprice, 0e0)), 6) AS log_value, round(p_retailprice / nullif(p_size % 5, 0), 6) AS ratio FROM t_part",
    "prj_13_coordinate_features": "SELECT point_id, round((x - mx) / sx, 6) AS zx, round((y - my) / sy, 6) AS zy FROM t_point CROSS JOIN (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM t_point)",
    "prj_14_non_finite_repair": """
SELECT p_partkey, CASE WHEN isnan(v) THEN 0e0 WHEN v = CAST('Infinity' AS DOUBLE) THEN 999e0 WHEN v = CAST('-Infinity' AS DOUBLE) THEN -999e0 ELSE v END AS v FROM t_non_finite""",
    "prj_15_canonical_key": "SELECT s_suppkey, upper(trim(coalesce(s_name, ''))) || '|' || coalesce(nullif(trim(group_key), ''), '') AS parcel_key FROM t_parcel_group",
    "prj_16_expected_sign": """
SELECT DISTINCT feature, CASE WHEN feature LIKE '%count%' THEN 'NEGATIVE' WHEN feature LIKE '%anc%' OR feature LIKE '%time%' THEN 'POSITIVE' ELSE 'UNKNOWN' END AS expected FROM t_feature""",
    "prj_17_range_predicates": "SELECT point_id FROM t_point WHERE CAST(subarea_id AS STRING) LIKE '1%' AND truth BETWEEN 0.2e0 AND 0.8e0",
    "prj_18_uncertainty": """
SELECT point_id, round(sd, 6) AS sd, round(least(greatest(value - 1.96e0 * sd, 0e0), 1e0), 6) AS q025, round(least(greatest(value + 1.96e0 * sd, 0e0), 1e0), 6) AS q975 FROM (
 SELECT point_id, value, least(greatest(0.05e0 + 0.1e0 * abs(value - target) + 0.03e0 * d / nullif(max(d) OVER (PARTITION BY area_id), 0e0), 0.02e0), 0.15e0) AS sd FROM (
  SELECT *, sqrt((x - avg(x) OVER (PARTITION BY area_id)) * (x - avg(x) OVER (PARTITION BY area_id)) + (y - avg(y) OVER (PARTITION BY area_id)) * (y - avg(y) OVER (PARTITION BY area_id))) AS d FROM t_pred WHERE method = 'dasymetric'))""",
    "prj_19_distances": """
SELECT point_id, round(sqrt((x - 2.5e0) * (x - 2.5e0) + (y - 2.5e0) * (y - 2.5e0)) * 111e0, 6) AS planar_km,
 round(111e0 * sqrt((y - 2.5e0) * (y - 2.5e0) + (x - 2.5e0) * (x - 2.5e0) * cos(radians(2.5e0)) * cos(radians(2.5e0))), 6) AS equirect_km,
 round(2e0 * 6371e0 * asin(sqrt(sin(radians(y - 2.5e0) / 2e0) * sin(radians(y - 2.5e0) / 2e0) + cos(radians(y)) * cos(radians(2.5e0)) * sin(radians(x - 2.5e0) / 2e0) * sin(radians(x - 2.5e0) / 2e0))), 6) AS haversine_km FROM t_point""",
    "prj_20_string_hash": "SELECT c_custkey, CAST(conv(substring(md5(c_name), 1, 8), 16, 10) AS BIGINT) AS h FROM t_customer",
    "prj_21_differential": "SELECT point_id, dest_id, round(walk_time / drive_time, 6) AS ratio, round(walk_time - drive_time, 6) AS diff, round(CASE WHEN drive_time > 0e0 AND walk_time / drive_time > 0e0 THEN ln(walk_time / drive_time) END, 6) AS log_ratio FROM t_od WHERE drive_time > 0e0",
    "prj_22_grades": """
SELECT method, area_id, CASE WHEN 100e0 * gap / target < 5e0 THEN 'excellent' WHEN 100e0 * gap / target < 15e0 THEN 'good' ELSE 'poor' END AS grade, CASE WHEN target < 0.3e0 THEN 'low' WHEN target < 0.7e0 THEN 'medium' ELSE 'high' END AS bucket FROM t_metric""",
    "prj_12_drop_list": """
SELECT regexp_extract(line, '^([a-z_]+) +(-[0-9.]+)%', 1) AS feature FROM (SELECT feature || '  ' || CAST(round(100e0 * r, 2) AS STRING) || '%' AS line FROM (SELECT f.feature, corr(f.value, p.truth) AS r FROM t_feature f JOIN t_point p ON f.point_id = p.point_id WHERE p.truth IS NOT NULL AND f.feature <> 'flat' GROUP BY f.feature)) WHERE regexp_extract(line, '^([a-z_]+) +(-[0-9.]+)%', 1) <> ''""",
    "prj_13_noise_features": """
SELECT point_id, round((x - mx) / sx, 6) AS zx, round((y - my) / sy, 6) AS zy, round(sqrt(-2e0 * ln(u)) * cos(2e0 * pi() * v), 6) AS noise_1, round(sqrt(-2e0 * ln(u)) * sin(2e0 * pi() * v), 6) AS noise_2 FROM (
 SELECT point_id, x, y, (CAST(CAST(conv(substring(md5('u-' || CAST(point_id AS STRING)), 1, 8), 16, 10) AS BIGINT) AS DOUBLE) + 1e0) / 4294967297e0 AS u, CAST(CAST(conv(substring(md5('v-' || CAST(point_id AS STRING)), 1, 8), 16, 10) AS BIGINT) AS DOUBLE) / 4294967296e0 AS v FROM t_point) CROSS JOIN (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM t_point)""",
}
