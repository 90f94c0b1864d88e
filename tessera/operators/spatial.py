"""Spatial weights and autocorrelation over edge tables."""

_W, _Z = "SELECT * FROM t_weight", "SELECT * FROM t_centred"
_MORAN = "SELECT w.area_id, sum(w.w * a.z * b.z) / sum(w.w) AS top FROM ({w}) w JOIN ({z}) a ON w.src = a.point_id JOIN ({z}) b ON w.dst = b.point_id GROUP BY w.area_id"
_VAR = f"SELECT area_id, avg(z * z) AS v, count(*) AS n FROM ({_Z}) GROUP BY area_id"
PLANS = {
    "sps_01_knn_weights": f"SELECT src, dst, round(w, 9) AS w FROM ({_W})",
    "sps_02_threshold_weights": "SELECT src, dst, round(1e0 / count(*) OVER (PARTITION BY src), 9) AS w FROM t_band WHERE d > 0e0",
    "sps_03_inverse_distance_weights": "SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 0.5e0 / d AS w FROM t_near WHERE d > 0e0 UNION ALL SELECT dst, src, 0.5e0 / d FROM t_near WHERE d > 0e0) GROUP BY src, dst)",
    "sps_04_moran": f"SELECT m.area_id, round(CASE WHEN v.v < 1e-12 THEN 0e0 ELSE m.top / v.v END, 6) AS moran FROM ({_MORAN.format(w=_W, z=_Z)}) m JOIN ({_VAR}) v ON m.area_id = v.area_id",
    "sps_05_moran_permutations": """
WITH observed AS (SELECT w.area_id, sum(w.w * a.z * b.z) AS top FROM t_weight w JOIN t_centred a ON w.src = a.point_id JOIN t_centred b ON w.dst = b.point_id GROUP BY w.area_id)
SELECT o.area_id, round((count_if(abs(d.top) >= abs(o.top) - 1e-9) + 1e0) / (count(*) + 1e0), 6) AS p, round((max(o.top) - avg(d.top)) / nullif(round(stddev_pop(d.top), 9), 0e0), 4) AS zscore FROM observed o JOIN t_permuted_top d ON o.area_id = d.area_id GROUP BY o.area_id""",
    "sps_06_local_moran": f"""
WITH v AS ({_VAR}), lag AS (SELECT w.src, sum(w.w * b.z) AS lag FROM t_weight w JOIN t_centred b ON w.dst = b.point_id GROUP BY w.src)
SELECT s.point_id, round(s.z * l.lag / v.v, 6) AS local_i, round(t.p, 6) AS p, CASE WHEN t.p >= $alpha THEN 'Not Sig' WHEN s.z > 0e0 AND l.lag > 0e0 THEN 'High-High' WHEN s.z > 0e0 THEN 'High-Low' WHEN l.lag > 0e0 THEN 'Low-High' ELSE 'Low-Low' END AS cluster
FROM t_centred s JOIN lag l ON s.point_id = l.src JOIN t_local_p t ON s.point_id = t.point_id JOIN v ON s.area_id = v.area_id""",
    "sps_07_residual_moran": """
WITH w AS (SELECT src, dst, area_id, w / sum(w) OVER (PARTITION BY src) AS w FROM (SELECT src, dst, area_id, 1e0 AS w FROM t_near)), z AS (SELECT point_id, area_id, r - avg(r) OVER (PARTITION BY area_id) AS z FROM (SELECT point_id, area_id, coalesce(value - truth, 0e0) AS r FROM t_pred WHERE method = 'gradient'))
SELECT w.area_id, round(sum(w.w * a.z * b.z) / sum(w.w) / max(v.v), 6) AS moran FROM w JOIN z a ON w.src = a.point_id JOIN z b ON w.dst = b.point_id JOIN (SELECT area_id, avg(z * z) AS v FROM z GROUP BY area_id) v ON w.area_id = v.area_id GROUP BY w.area_id""",
    "sps_08_mean_moran": f"SELECT count(*) AS areas, round(avg(m.top / v.v), 6) AS mean_moran FROM ({_MORAN.format(w=_W, z=_Z)}) m JOIN ({_VAR}) v ON m.area_id = v.area_id WHERE v.n >= 9 AND v.v > 1e-12",
    "sps_09_exponential_weights": "SELECT a, b, round(avg(w), 6) AS w FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, exp(-d / 0.3e0) AS w FROM t_near WHERE d <= 1e0) GROUP BY a, b",
    "sps_10_centrality": "SELECT area_id, round(corr(d, truth), 6) AS r FROM (SELECT area_id, truth, sqrt((x - avg(x) OVER (PARTITION BY area_id)) * (x - avg(x) OVER (PARTITION BY area_id)) + (y - avg(y) OVER (PARTITION BY area_id)) * (y - avg(y) OVER (PARTITION BY area_id))) AS d FROM t_point) WHERE truth IS NOT NULL GROUP BY area_id",
    "sps_12_distance_decay": "SELECT dest_type, round(corr(m, truth), 6) AS r FROM (SELECT o.dest_type, o.point_id, min(o.km) AS m, min(p.truth) AS truth FROM t_od o JOIN t_point p ON o.point_id = p.point_id WHERE p.truth IS NOT NULL GROUP BY o.dest_type, o.point_id) GROUP BY dest_type",
    "sps_13_destination_dispersion": "SELECT a.dest_type, round(avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS mean_distance, count(*) AS pairs FROM t_dest a JOIN t_dest b ON a.dest_type = b.dest_type AND a.dest_id < b.dest_id GROUP BY a.dest_type",
}
