"""Mean-preserving allocation of area values to points."""

#: The bounded projection's limit: the shift s with mean(clip(v + s, 0, 1)) = t. The mean is piecewise linear in s with
#: breaks where a value meets 0 or 1; the segment that holds t is found from running sums, and s is interpolated there.
_SHIFT = """
breaks AS (SELECT g, s, sum(step) AS step FROM (SELECT g, -v AS s, 1 AS step FROM src UNION ALL SELECT g, 1e0 - v, -1 FROM src) GROUP BY g, s),
runs AS (SELECT b.g, b.s, sum(b.step) OVER (PARTITION BY b.g ORDER BY b.s) AS active, lead(b.s) OVER (PARTITION BY b.g ORDER BY b.s) AS s2 FROM breaks b),
walk AS (SELECT g, s, s2, active, coalesce(sum(active * (s2 - s)) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS mass FROM runs WHERE s2 IS NOT NULL),
goal AS (SELECT g, max(t) * count(*) AS goal FROM src GROUP BY g),
shift AS (SELECT w.g, min(w.s + (o.goal - w.mass) / w.active) AS s FROM walk w JOIN goal o ON w.g = o.g WHERE w.active > 0 AND o.goal >= w.mass AND o.goal <= w.mass + w.active * (w.s2 - w.s) + 1e-12 GROUP BY w.g)"""


def projected(source: str, keys: str) -> str:
    """SQL that shifts and clips v to the mean t in each group g; source gives g, v, t and the keys."""
    return f"WITH src AS ({source}), {_SHIFT} SELECT {keys}, round(least(greatest(src.v + coalesce(shift.s, 0e0), 0e0), 1e0), 6) AS p FROM src LEFT JOIN shift ON src.g = shift.g"


_CENTROIDS = "SELECT area_id, target, minx + 0.5e0 AS cx, miny + 0.5e0 AS cy FROM t_area WHERE target IS NOT NULL"
IDW = f"""SELECT point_id, area_id, t, sum(target / d2) / sum(1e0 / d2) AS v FROM (SELECT p.point_id, p.area_id, a0.target AS t, c.target, (p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) + 1e-9 AS d2,
 row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy), c.area_id) AS nth FROM t_point p JOIN t_area a0 ON p.area_id = a0.area_id JOIN ({_CENTROIDS}) c ON c.area_id <> p.area_id) WHERE nth <= 8 GROUP BY point_id, area_id, t"""


#: The seed of the pycnophylactic method (functions.paths smooths it): inverse squared distance to all known centroids, then the area mean restored.
SEED = f"""SELECT point_id, area_id, t, v + t - avg(v) OVER (PARTITION BY area_id) AS v FROM (SELECT p.point_id, p.area_id, min(a0.target) AS t,
 sum(c.target / ((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) + 1e-9)) / sum(1e0 / ((p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) + 1e-9)) AS v
 FROM t_point p JOIN t_area a0 ON p.area_id = a0.area_id CROSS JOIN ({_CENTROIDS}) c GROUP BY p.point_id, p.area_id)"""

PLANS = {
    "dis_01_uniform": "SELECT point_id, round(value, 6) AS value FROM t_pred WHERE method = 'naive'",
    "dis_02_bounded_projection": projected("SELECT p.point_id, p.area_id AS g, least(greatest(coalesce(p.ancillary, 0e0) / 100e0, 0e0), 1e0) AS v, a.target AS t FROM t_point p JOIN t_area a ON p.area_id = a.area_id", "src.point_id"),
    "dis_03_dasymetric": "SELECT point_id, round(value, 6) AS value FROM t_pred WHERE method = 'dasymetric'",
    "dis_05_idw": f"SELECT point_id, round(v * t / nullif(avg(v) OVER (PARTITION BY area_id), 0e0), 6) AS p FROM ({IDW})",
    "dis_07_affine_correction": """
SELECT p.point_id, round(least(greatest(c.b * p.value + c.a, 0e0), 1e0), 5) AS value FROM t_raw p CROSS JOIN (SELECT regr_slope(t, m) AS b, regr_intercept(t, m) AS a FROM (SELECT area_id, avg(value) AS m, min(target) AS t FROM t_raw GROUP BY area_id)) c""",
    "dis_08_by_construction": "SELECT point_id, round(target + value - avg(value) OVER (PARTITION BY area_id), 6) AS value FROM t_pred WHERE method = 'gradient'",
    "dis_09_subarea_rescale": projected("SELECT s.subarea_id, s.area_id AS g, s.m AS v, least(a.target + 0.05e0, 1e0) AS t FROM (SELECT subarea_id, area_id, avg(truth) AS m FROM t_point GROUP BY subarea_id, area_id) s JOIN t_area a ON s.area_id = a.area_id", "src.subarea_id"),
    "dis_10_qualifying_subareas": """
SELECT s.subarea_id, count(*) AS n FROM t_subarea s JOIN t_counts c ON s.subarea_id = c.subarea_id JOIN t_area a ON s.area_id = a.area_id JOIN t_split t ON s.area_id = t.area_id AND t.part = 'train' JOIN t_point p ON p.subarea_id = s.subarea_id WHERE c.income IS NOT NULL AND a.target IS NOT NULL GROUP BY s.subarea_id HAVING count(*) >= $least_points""",
    "dis_11_method_comparison": f"""
WITH p AS (SELECT method, point_id, area_id, target, truth, value FROM t_pred UNION ALL
 SELECT 'idw', i.point_id, i.area_id, i.t, q.truth, least(greatest(i.v * i.t / nullif(avg(i.v) OVER (PARTITION BY i.area_id), 0e0), 0e0), 1e0) FROM ({IDW}) i JOIN t_point q ON i.point_id = q.point_id),
m AS (SELECT method, area_id, abs(avg(value) - min(target)) AS gap, stddev_pop(value) AS sd, sqrt(avg((value - truth) * (value - truth))) AS rmse FROM p GROUP BY method, area_id)
SELECT method, count(*) AS areas, round(avg(gap), 6) AS gap, round(avg(sd), 6) AS sd, round(avg(rmse), 6) AS rmse, rank() OVER (ORDER BY round(avg(rmse), 6)) AS place FROM m GROUP BY method""",
    "dis_12_property_means": "SELECT a.area_id, round(coalesce(avg(p.value), max(m.middle)), 6) AS mean FROM t_area a LEFT JOIN t_property p ON p.area_id = a.area_id CROSS JOIN (SELECT median(v) AS middle FROM (SELECT area_id, avg(value) AS v FROM t_property GROUP BY area_id)) m GROUP BY a.area_id",
    "dis_14_soft_bands": "SELECT p.point_id, b.band FROM t_point p JOIN (SELECT 'low' AS band, 0e0 AS lo, 0.4e0 AS hi UNION ALL SELECT 'medium', 0.3e0, 0.7e0 UNION ALL SELECT 'high', 0.55e0, 1.01e0) b ON p.truth >= b.lo AND p.truth <= b.hi",
    "dis_15_gated_blend": """
WITH g AS (SELECT p.point_id, p.area_id, exp(-abs(coalesce(p.ancillary, 0e0) / 100e0 - 0.5e0)) AS e1, exp(-abs(p.x - floor(p.x) - 0.5e0)) AS e2, exp(-0.5e0) AS e3 FROM t_point p),
b AS (SELECT g.point_id, g.area_id, g.e1 / (g.e1 + g.e2 + g.e3) AS g1, g.e2 / (g.e1 + g.e2 + g.e3) AS g2, g.e3 / (g.e1 + g.e2 + g.e3) AS g3, m.d, m.r, m.n FROM g JOIN (SELECT point_id, max(CASE WHEN method = 'dasymetric' THEN value END) AS d, max(CASE WHEN method = 'gradient' THEN value END) AS r, max(CASE WHEN method = 'naive' THEN value END) AS n FROM t_pred GROUP BY point_id) m ON g.point_id = m.point_id)
SELECT b.point_id, round(b.g1 * b.d + b.g2 * b.r + b.g3 * b.n, 6) AS value, CASE WHEN round(b.g1 - b.g2, 9) >= 0e0 AND round(b.g1 - b.g3, 9) >= 0e0 THEN 'dasymetric' WHEN round(b.g2 - b.g3, 9) >= 0e0 THEN 'gradient' ELSE 'naive' END AS dominant, round(greatest(b.g1, b.g2, b.g3), 6) AS confidence,
 round(a.m1, 6) AS area_gate_1, round(a.m2, 6) AS area_gate_2, round(a.m3, 6) AS area_gate_3 FROM b JOIN (SELECT area_id, avg(g1) AS m1, avg(g2) AS m2, avg(g3) AS m3 FROM b GROUP BY area_id) a ON b.area_id = a.area_id""",
}
