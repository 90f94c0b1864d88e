"""Data-quality rules and validation roll-ups."""

from .spatial import _MORAN, _W
from .statistics import _corr
from .windows import average_rank

_ALLOCATED = "SELECT point_id, area_id, value - avg(value) OVER (PARTITION BY area_id) AS z FROM t_pred WHERE method = '{0}'"
_INDEX = "SELECT point_id, avg(1e0 / (1e0 + mean_time)) AS idx FROM t_access GROUP BY point_id"


def _verdict(method: str) -> str:
    """SQL for the five indicators of one method: structure, relation to access, scale, variation, bias."""
    z = _ALLOCATED.format(method)
    moran = f"SELECT avg(m.top / v.v) AS i FROM ({_MORAN.format(w=_W, z=z)}) m JOIN (SELECT area_id, avg(z * z) AS v FROM ({z}) GROUP BY area_id) v ON m.area_id = v.area_id WHERE v.v > 1e-12"
    noise = f"SELECT avg(m.top / v.v) AS i FROM ({_MORAN.format(w=_W, z='SELECT * FROM t_noise')}) m JOIN (SELECT area_id, avg(z * z) AS v FROM t_noise GROUP BY area_id) v ON m.area_id = v.area_id WHERE v.v > 1e-12"
    return f"""SELECT '{method}' AS method, m.i AS moran, b.i AS random_moran, c.r, s.mean, s.sd, s.bias FROM ({moran}) m CROSS JOIN ({noise}) b CROSS JOIN (SELECT corr(p.value, i.idx) AS r FROM t_pred p JOIN ({_INDEX}) i ON p.point_id = i.point_id WHERE p.method = '{method}') c
CROSS JOIN (SELECT avg(value) AS mean, stddev_pop(value) AS sd, abs(avg(value) - avg(target)) / avg(target) AS bias FROM t_pred WHERE method = '{method}') s"""


PLANS = {
    "val_01_time_realism": """
SELECT dest_type, feature, count_if(v < 0e0) AS negative, count_if(v = 0e0) AS zero, count_if(v > 180e0) AS over_180, count_if(v > 300e0) AS over_300, count_if(v BETWEEN 1e0 AND 120e0) AS plausible, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most FROM (
 SELECT dest_type, 'walk' AS feature, walk_time AS v FROM t_od UNION ALL SELECT dest_type, 'drive', drive_time FROM t_od UNION ALL SELECT dest_type, 'transit', transit_time FROM t_od) GROUP BY dest_type, feature""",
    "val_02_time_distance": """
SELECT dest_type, count(*) AS n, round(min(km), 6) AS least_km, round(corr(km, transit_time), 6) AS r, round(avg(greatest(km, 0.1e0) / 5e0 * 60e0), 6) AS expected_walk, round(avg(greatest(km, 0.1e0) / 30e0 * 60e0), 6) AS expected_drive, round(avg(CASE WHEN transit_time / (greatest(km, 0.1e0) * 10e0) BETWEEN 0.5e0 AND 5e0 THEN 1e0 ELSE 0e0 END), 6) AS share_ok FROM (
 SELECT *, row_number() OVER (PARTITION BY dest_type ORDER BY md5(CAST(point_id AS STRING) || '-' || CAST(dest_id AS STRING)), point_id, dest_id) AS nth FROM t_od) WHERE nth <= 100 GROUP BY dest_type""",
    "val_03_ordering": "SELECT count_if(min_time > mean_time) AS min_over_mean, count_if(mean_time > p90) AS mean_over_p90, round(avg(CASE WHEN min_time <= mean_time AND mean_time <= p90 THEN 1e0 ELSE 0e0 END), 6) AS rate FROM t_access",
    "val_04_count_plausibility": """
SELECT a.dest_type, count_if(a.count_5 < 0) AS negative, count_if(a.count_5 = 0) AS zero, count_if(a.count_15 > 100) AS over_100, count_if(a.count_15 > d.n) AS over_available, count_if(a.count_5 > a.count_10 OR a.count_10 > a.count_15) AS not_growing FROM t_access a JOIN (SELECT dest_type, count(*) AS n FROM t_dest GROUP BY dest_type) d ON a.dest_type = d.dest_type GROUP BY a.dest_type""",
    "val_05_scaling_issues": """
WITH f AS (SELECT feature, stddev_pop(value) AS s, max(value) - min(value) AS span, avg(value) AS m FROM t_feature GROUP BY feature), k AS (SELECT t.feature, avg((t.value - f.m) * (t.value - f.m) * (t.value - f.m)) AS m3 FROM t_feature t JOIN f ON t.feature = f.feature GROUP BY t.feature),
g AS (SELECT max(span) / nullif(min(CASE WHEN span > 0e0 THEN span END), 0e0) AS ratio FROM f)
SELECT f.feature, f.s < 1e-8 AS constant, coalesce(abs(k.m3 / nullif(round(f.s * f.s * f.s, 12), 0e0)) > 5e0, false) AS skewed, f.span > 1000e0 AS wide, g.ratio > 100e0 AS uneven_group FROM f JOIN k ON f.feature = k.feature CROSS JOIN g""",
    "val_06_missing_profile": """
SELECT coalesce(feature, 'all') AS feature, count_if(v IS NULL) AS missing, count_if(v IS NOT NULL AND isnan(v)) AS nan, count_if(abs(v) = CAST('Infinity' AS DOUBLE)) AS infinite, count_if(v = 0e0) AS zero, count(*) AS n FROM (
 SELECT 'ancillary' AS feature, ancillary AS v FROM t_point UNION ALL SELECT 'truth', truth FROM t_point UNION ALL SELECT 'x', x FROM t_point UNION ALL SELECT 'y', y FROM t_point UNION ALL SELECT 'min_time', min_time FROM t_access UNION ALL SELECT 'mean_time', mean_time FROM t_access) GROUP BY ROLLUP (feature)""",
    "val_07_expected_directions": """
SELECT pair, round(r, 6) AS r, CASE WHEN (r < 0e0) = wanted THEN 'expected' ELSE 'reversed' END AS direction, CASE WHEN abs(r) > 0.5e0 THEN 'strong' WHEN abs(r) > 0.2e0 THEN 'moderate' ELSE 'weak' END AS strength FROM (
 SELECT dest_type || ' time-count' AS pair, corr(mean_time, CAST(count_10 AS DOUBLE)) AS r, true AS wanted FROM t_base GROUP BY dest_type UNION ALL
 SELECT a.dest_type || '-' || b.dest_type || ' percentile', corr(a.percentile, b.percentile), false FROM t_base a JOIN t_base b ON a.point_id = b.point_id AND a.dest_type < b.dest_type GROUP BY a.dest_type, b.dest_type) WHERE r IS NOT NULL AND NOT isnan(r)""",
    "val_08_centre_periphery": "SELECT a.dest_type, round(corr(sqrt((p.x - 2.5e0) * (p.x - 2.5e0) + (p.y - 2.5e0) * (p.y - 2.5e0)), a.mean_time), 6) AS r FROM t_access a JOIN t_point p ON a.point_id = p.point_id GROUP BY a.dest_type",
    "val_09_quality_score": "SELECT round(score, 6) AS score, CASE WHEN score >= 0.9e0 THEN 'A' WHEN score >= 0.8e0 THEN 'B' WHEN score >= 0.7e0 THEN 'C' WHEN score >= 0.6e0 THEN 'D' ELSE 'F' END AS grade FROM (SELECT (avg(CASE WHEN mean_time BETWEEN 1e0 AND 120e0 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN p90 IS NOT NULL THEN 1e0 ELSE 0e0 END) + greatest(0e0, -corr(mean_time, CAST(count_15 AS DOUBLE)))) / 3e0 AS score FROM t_access)",
    "val_10_root_causes": """
WITH t AS (SELECT count_if(v > 300e0) AS unreal FROM t_times), d AS (SELECT count_if(r < 0.3e0) AS poor FROM (SELECT dest_type, corr(km, drive_time) AS r FROM t_od GROUP BY dest_type)),
e AS (SELECT count_if(a.count_15 > k.n) AS over FROM t_access a JOIN (SELECT dest_type, count(*) AS n FROM t_dest GROUP BY dest_type) k ON a.dest_type = k.dest_type), w AS (SELECT count_if(r >= 0e0) AS wrong FROM (SELECT dest_type, corr(mean_time, CAST(count_10 AS DOUBLE)) AS r FROM t_access GROUP BY dest_type)),
q AS (SELECT (avg(CASE WHEN mean_time BETWEEN 1e0 AND 120e0 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN p90 IS NOT NULL THEN 1e0 ELSE 0e0 END) + greatest(0e0, -corr(mean_time, CAST(count_15 AS DOUBLE)))) / 3e0 AS score FROM t_access),
c AS (SELECT 'travel_time_computation' AS cause, 'Travel time calculation errors' AS issue, 0.9e0 AS confidence, unreal > 0 AS holds FROM t UNION ALL SELECT 'distance_time_mismatch', 'Distance-time relationship broken', 0.8e0, poor > 0 FROM d
 UNION ALL SELECT 'destination_counting_error', 'Destination accessibility counting logic error', 0.9e0, over > 0 FROM e UNION ALL SELECT 'wrong_correlation_direction', 'Feature engineering produces wrong relationships', 0.8e0, wrong > 0 FROM w
 UNION ALL SELECT 'poor_data_quality', 'Systematic data quality issues', 1e0 - score, score < 0.7e0 FROM q)
SELECT cause, issue, round(confidence, 6) AS confidence, holds, CASE WHEN holds AND confidence > 0.8e0 THEN 'HIGH' WHEN holds AND confidence > 0.6e0 THEN 'MEDIUM' END AS priority, CASE WHEN cause IN ('travel_time_computation', 'destination_counting_error') THEN 'HIGH' ELSE 'MEDIUM' END AS impact,
 row_number() OVER (ORDER BY CASE WHEN holds THEN 0 ELSE 1 END, round(confidence, 6) DESC, cause) AS place FROM c""",
    "val_11_distance_time_check": """
SELECT l.mode, count(*) AS n, round(corr(l.km, l.v), 6) AS r, count(*) >= 10 AND round(corr(l.km, l.v), 9) >= 0.4e0 AS ok FROM t_times l JOIN t_time_quartile q ON l.mode = q.g WHERE l.v BETWEEN q.q1 - 1.5e0 * (q.q3 - q.q1) AND q.q3 + 1.5e0 * (q.q3 - q.q1) GROUP BY l.mode""",
    "val_12_pair_counts": "SELECT round(avg(CAST(n AS DOUBLE)), 6) AS mean, max(n) AS most, min(n) AS least, count_if(n > 10) AS over_10, round(avg(CASE WHEN n < 2 THEN 1e0 ELSE 0e0 END), 6) AS under_2 FROM (SELECT point_id, count(DISTINCT dest_id) AS n FROM t_od WHERE km < 5e0 GROUP BY point_id)",
    "val_13_feature_check": "SELECT dest_type, round(stddev_pop(min_time), 6) AS sd, round(max(min_time) - min(min_time), 6) AS spread, count_if(count_5 <= 6) AS few, corr(min_time, CAST(count_5 AS DOUBLE)) <= 0.1e0 AS ok FROM t_access GROUP BY dest_type",
    "val_14_matrix_check": """
SELECT f.features, f.flat, f.flat * 1e0 / f.features <= 0.3e0 AS few_flat, round(a.r, 6) AS r_time_count, a.r <= 0.1e0 AS ordered FROM (SELECT count(*) AS features, count_if(s < 0.01e0) AS flat FROM (SELECT feature, stddev_pop(value) AS s FROM t_feature GROUP BY feature)) f CROSS JOIN (SELECT corr(min_time, CAST(count_5 AS DOUBLE)) AS r FROM t_access) a""",
    "val_15_spatial_verdict": f"""
SELECT method, round(q, 2) AS quality, CASE WHEN q > 0.8e0 THEN 'excellent' WHEN q > 0.6e0 THEN 'good' WHEN q > 0.4e0 THEN 'poor' ELSE 'failing' END AS verdict FROM (SELECT method, (CASE WHEN moran > random_moran + 0.05e0 THEN 1e0 ELSE 0e0 END + CASE WHEN abs(r) > 0.1e0 THEN 1e0 ELSE 0e0 END + CASE WHEN mean BETWEEN 0e0 AND 1e0 THEN 1e0 ELSE 0e0 END
 + CASE WHEN sd > 0.005e0 AND sd < 0.15e0 THEN 1e0 ELSE 0e0 END + CASE WHEN bias < 0.5e0 THEN 1e0 ELSE 0e0 END) / 5e0 AS q FROM ({_verdict("dasymetric")} UNION ALL {_verdict("gradient")}))""",
    "val_16_direction_index": """
WITH s AS (SELECT dest_type, min(count_10) AS lo, max(count_10) AS hi FROM t_access GROUP BY dest_type),
i AS (SELECT a.point_id, avg((1e0 / (1e0 + a.mean_time) + CASE WHEN s.hi > s.lo THEN (a.count_10 - s.lo) * 1e0 / (s.hi - s.lo) ELSE 0e0 END) / 2e0) AS idx FROM t_access a JOIN s ON a.dest_type = s.dest_type GROUP BY a.point_id)
SELECT f.feature, round(corr(i.idx, f.value), 6) AS r FROM i JOIN t_feature f ON i.point_id = f.point_id WHERE f.feature <> 'flat' GROUP BY f.feature""",
    "val_17_reproducibility": """
SELECT m.seed, m.area_id, abs(m.sd - p.sd) / greatest(p.sd, 1e-6) <= 0.05e0 AS spread_within_5_pct, abs(m.gap_pct - p.gap_pct) <= 1e0 AS error_within_1_pp, coalesce(round(abs(m.r - p.r), 9) <= 0.005e0, false) AS r_within_tolerance FROM t_run m JOIN t_run p ON m.area_id = p.area_id AND p.seed = 42 WHERE m.seed <> 42""",
    "val_18_non_finite": "SELECT count_if(rmse IS NULL OR isnan(rmse)) AS bad, count_if(rmse IS NULL OR isnan(rmse)) = 0 AS ok FROM t_metric",
    "val_19_validation_pipeline": """
WITH assigned AS (SELECT p.method, p.point_id, p.area_id, i.poly_id AS subarea_id, p.value, p.truth FROM t_pred p LEFT JOIN t_inside i ON p.point_id = i.point_id),
sub AS (SELECT method, subarea_id, count(*) AS n, avg(value) AS predicted, stddev_samp(value) AS sd, avg(truth) AS actual FROM assigned WHERE subarea_id IS NOT NULL GROUP BY method, subarea_id HAVING count(*) >= $least_points),
merged AS (SELECT s.*, c.income, c.n_f, c.n_urgent FROM sub s JOIN t_counts c ON s.subarea_id = c.subarea_id WHERE s.actual IS NOT NULL),
lost AS (SELECT method, count_if(subarea_id IS NULL) AS unmatched FROM assigned GROUP BY method)
SELECT m.method, count(*) AS subareas, CAST(sum(m.n) AS BIGINT) AS points, max(l.unmatched) AS unmatched, round(corr(m.predicted, m.actual), 6) AS r, round(sqrt(avg((m.predicted - m.actual) * (m.predicted - m.actual))), 6) AS rmse, round(corr(m.predicted, m.income), 6) AS r_income, round(corr(m.predicted, CAST(m.n_f AS DOUBLE)), 6) AS r_component_1, round(corr(m.predicted, CAST(m.n_urgent AS DOUBLE)), 6) AS r_component_2,
 round(stddev_pop(m.predicted), 6) AS spread, stddev_pop(m.predicted) < 0.01e0 AS low_spread, round(avg(m.predicted - m.actual), 6) AS bias FROM merged m JOIN lost l ON m.method = l.method GROUP BY m.method""",
    "val_19_method_correlation": "SELECT method, count(*) AS subareas, round(corr(predicted, actual), 6) AS r, round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse FROM (SELECT method, subarea_id, avg(value) AS predicted, avg(truth) AS actual FROM t_pred WHERE truth IS NOT NULL GROUP BY method, subarea_id HAVING count(*) >= 10) GROUP BY method",
    "val_20_pooled_parity": """
WITH s AS (SELECT method, area_id, subarea_id, avg(value) AS p, avg(truth) AS a FROM t_pred WHERE method <> 'naive' AND truth IS NOT NULL GROUP BY method, area_id, subarea_id),
g AS (SELECT method, corr(p, a) AS r, sqrt(avg((p - a) * (p - a))) AS rmse FROM s GROUP BY method),
e AS (SELECT method, area_id, corr(p, a) AS r, sqrt(avg((p - a) * (p - a))) AS rmse FROM s GROUP BY method, area_id HAVING count(*) >= 3),
b AS (SELECT /*+ BROADCAST(d) */ e.method, d.draw, e.area_id, row_number() OVER (PARTITION BY e.method, d.draw ORDER BY e.area_id) AS i, count(*) OVER (PARTITION BY e.method, d.draw) AS n FROM e CROSS JOIN t_draw d),
k AS (SELECT method, area_id, r, row_number() OVER (PARTITION BY method ORDER BY area_id) AS i FROM e),
m AS (SELECT /*+ MERGE(k) */ b.method, b.draw, median(k.r) AS mid FROM b JOIN k ON k.method = b.method AND k.i = 1 + CAST(conv(substring(md5(CAST(b.draw AS STRING) || '-' || CAST(b.i AS STRING)), 1, 8), 16, 10) AS BIGINT) % b.n GROUP BY b.method, b.draw),
c AS (SELECT method, percentile_cont(0.025) WITHIN GROUP (ORDER BY mid) AS lo, percentile_cont(0.975) WITHIN GROUP (ORDER BY mid) AS hi FROM m GROUP BY method)
SELECT g.method, round(max(g.r), 6) AS pooled_r, round(max(g.rmse), 6) AS pooled_rmse, round(median(e.r), 6) AS median_r, round(median(e.rmse), 6) AS median_rmse, round(max(c.lo), 6) AS median_lo, round(max(c.hi), 6) AS median_hi FROM g JOIN e ON g.method = e.method JOIN c ON g.method = c.method GROUP BY g.method""",
    "val_20_pairwise": f"""
WITH s AS (SELECT method, area_id, subarea_id, avg(value) AS p, avg(truth) AS a FROM t_pred WHERE truth IS NOT NULL GROUP BY method, area_id, subarea_id),
g AS (SELECT method, {_corr('p', 'a')} AS r, sqrt(avg((p - a) * (p - a))) AS rmse FROM s GROUP BY method),
e AS (SELECT method, area_id, {_corr('p', 'a')} AS r, sqrt(avg((p - a) * (p - a))) AS rmse FROM s GROUP BY method, area_id HAVING count(*) >= 3)
SELECT g.method AS first, h.method AS second, round(max(g.r - h.r), 6) AS pooled_r, round(max(g.rmse - h.rmse), 6) AS pooled_rmse, round(median(x.r - y.r), 6) AS area_r, round(median(x.rmse - y.rmse), 6) AS area_rmse, count_if(round(x.rmse - y.rmse, 9) < 0e0) AS first_better
FROM g JOIN g h ON g.method < h.method JOIN e x ON x.method = g.method JOIN e y ON y.method = h.method AND y.area_id = x.area_id GROUP BY g.method, h.method""",
    "val_21_convergent_validity": f"""
WITH c AS (SELECT p.method, p.area_id, p.point_id, round(p.value, 9) AS v, CAST(coalesce(o.n, 0) AS DOUBLE) AS n, p.x FROM t_pred p LEFT JOIN (SELECT o_custkey, count(*) AS n FROM t_orders GROUP BY o_custkey) o ON p.point_id = o.o_custkey WHERE p.method <> 'naive'),
k AS (SELECT method, area_id, n, {average_rank("v", "method, area_id")} AS rv, {average_rank("n", "method, area_id")} AS rn, {average_rank("x", "method, area_id")} AS rx, CASE WHEN n > 0e0 THEN 1e0 ELSE 0e0 END AS any_ FROM c),
r AS (SELECT method, area_id, {_corr('rv', 'rn')} AS xy, {_corr('rv', 'rx')} AS xz, {_corr('rn', 'rx')} AS yz, {_corr('rv', 'any_')} AS flag FROM k GROUP BY method, area_id HAVING count(*) >= 20),
p AS (SELECT method, area_id, CASE WHEN (1e0 - xz * xz) * (1e0 - yz * yz) > 1e-9 THEN (xy - xz * yz) / sqrt((1e0 - xz * xz) * (1e0 - yz * yz)) END AS rho, flag FROM r)
SELECT method, count(rho) AS areas, round(median(rho), 6) AS middle, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY rho) - percentile_cont(0.25) WITHIN GROUP (ORDER BY rho), 6) AS iqr, count_if(rho > 0e0) AS positive, round(median(flag), 6) AS flag_middle FROM p WHERE rho IS NOT NULL GROUP BY method""",
    "val_22_suite_checklist": f"""
WITH a AS (SELECT corr(p.truth, i.idx) AS r FROM t_point p JOIN ({_INDEX}) i ON p.point_id = i.point_id WHERE p.truth IS NOT NULL),
b AS (SELECT percentile_cont(0.025) WITHIN GROUP (ORDER BY d) AS lo, percentile_cont(0.975) WITHIN GROUP (ORDER BY d) AS hi FROM (SELECT draw, avg(r2 - r1) AS d FROM t_boot WHERE r1 IS NOT NULL AND r2 IS NOT NULL GROUP BY draw)),
o AS (SELECT sum(w.w * x.z * y.z) AS top FROM t_weight w JOIN t_centred_pred x ON w.src = x.point_id JOIN t_centred_pred y ON w.dst = y.point_id), g AS (SELECT draw, sum(top) AS top FROM t_permuted_pred_top GROUP BY draw),
m AS (SELECT max(o.top) AS top, (count_if(abs(g.top) >= abs(o.top) - 1e-9) + 1e0) / (count(*) + 1e0) AS p FROM g CROSS JOIN o), s AS (SELECT count(DISTINCT area_id) AS n FROM t_metric),
k AS (SELECT 'access alone: r over 0.85' AS name, coalesce(r > 0.85e0, false) AS passed FROM a UNION ALL SELECT 'dasymetric over gradient significant by bootstrap', coalesce(lo > 0e0, false) FROM b UNION ALL SELECT 'allocations autocorrelated by permutation', coalesce(top > 0e0 AND p < $alpha, false) FROM m
 UNION ALL SELECT 'all areas scored', s.n = t.n FROM s CROSS JOIN (SELECT count(*) AS n FROM t_area) t)
SELECT name, passed, passes, CASE WHEN passes = 4 THEN 'ready' WHEN passes = 3 THEN 'nearly ready' ELSE 'needs work' END AS status FROM k CROSS JOIN (SELECT count_if(passed) AS passes FROM k)""",
    "val_23_area_list": "SELECT area_key, n, n = 13 AS exact FROM (SELECT trim(area_key) AS area_key, count(*) OVER () AS n FROM t_listed_area)",
}
