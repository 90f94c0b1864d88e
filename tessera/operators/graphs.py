"""Neighbour and road graphs as edge tables."""

_BOTH = "SELECT src, dst, w FROM ({0}) UNION ALL SELECT dst, src, w FROM ({0})"
_PAIRS = "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, 1e0 AS w FROM t_near"
PLANS = {
    "grf_01_knn_graph": _BOTH.format(_PAIRS),
    "grf_02_geographic_edges": "SELECT src, dst, round(exp(-d * $metres / 300e0), 6) AS w FROM t_near WHERE nth <= 6 AND d * $metres < 1000e0",
    "grf_03_geographic_fallback": """
SELECT n.src, n.dst, round(CASE WHEN n.d * $metres < 1000e0 THEN exp(-n.d * $metres / 300e0) ELSE 1e0 END, 6) AS w FROM t_near16 n JOIN (SELECT area_id, CASE WHEN count(*) < 100 THEN 8 WHEN count(*) < 500 THEN 12 ELSE 16 END AS k FROM t_point GROUP BY area_id) a ON n.area_id = a.area_id
JOIN (SELECT src, min(d) AS first_d FROM t_near16 GROUP BY src) f ON f.src = n.src WHERE n.nth <= a.k AND (n.d * $metres < 1000e0 OR f.first_d * $metres >= 1000e0 AND n.nth = 1)""",
    "grf_04_road_segments": """
SELECT road, seq, round(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) * 111000e0, 3) AS length FROM (SELECT road, seq, x, y, lead(x) OVER (PARTITION BY road ORDER BY seq) AS nx, lead(y) OVER (PARTITION BY road ORDER BY seq) AS ny FROM (
 SELECT point_id % 40 AS road, point_id AS seq, x, y FROM t_point)) WHERE nx IS NOT NULL""",
    "grf_08_merge_graphs": """
SELECT a, b, kind, round(w, 6) AS w FROM (SELECT a, b, kind, w, row_number() OVER (PARTITION BY a, b ORDER BY rank_, w) AS nth FROM (
 SELECT least(src, dst) AS a, greatest(src, dst) AS b, 'network' AS kind, 1 AS rank_, length AS w FROM t_road UNION ALL SELECT least(src, dst), greatest(src, dst), 'geographic', 2, d FROM t_near)) WHERE nth = 1""",
    "grf_09_self_loops_and_ring": """
SELECT point_id AS src, point_id AS dst, 'self' AS kind FROM t_point UNION ALL
SELECT a.point_id, b.point_id, 'ring' FROM (SELECT point_id, area_id, row_number() OVER (PARTITION BY area_id ORDER BY point_id) - 1 AS i, count(*) OVER (PARTITION BY area_id) AS n FROM t_point) a
JOIN (SELECT point_id, area_id, row_number() OVER (PARTITION BY area_id ORDER BY point_id) - 1 AS i FROM t_point) b ON a.area_id = b.area_id AND b.i = (a.i + 1) % a.n WHERE a.n > 1""",
    "grf_11_neighbour_mean": "SELECT e.src, round(avg(p.truth), 6) AS lag FROM t_near e JOIN t_point p ON e.dst = p.point_id GROUP BY e.src",
    "grf_11_normalised_mean": "SELECT e.src, round(sum(coalesce(p.truth, 0e0) / sqrt(a.n * b.n)), 6) AS lag FROM t_near e JOIN t_point p ON e.dst = p.point_id JOIN (SELECT src, CAST(count(*) AS DOUBLE) AS n FROM t_near GROUP BY src) a ON e.src = a.src JOIN (SELECT dst, CAST(count(*) AS DOUBLE) AS n FROM t_near GROUP BY dst) b ON e.dst = b.dst GROUP BY e.src",
    "grf_12_graph_statistics": "SELECT count(DISTINCT src) AS nodes, count(*) AS edges, round(CAST(count(*) AS DOUBLE) / count(DISTINCT src), 6) AS mean_degree, count_if(src = dst) AS loops FROM t_road",
}
