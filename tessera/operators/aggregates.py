"""Grouped roll-ups of predictions, features and logs."""

from .spatial import _MORAN, _W

_VALUES = "SELECT point_id, area_id, value - avg(value) OVER (PARTITION BY area_id) AS z FROM t_pred WHERE method = 'gradient'"
PLANS = {
    "agg_01_subarea_aggregate": "SELECT method, subarea_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most, round(max(value) - min(value), 6) AS spread, round(median(value), 6) AS middle FROM t_pred GROUP BY method, subarea_id",
    "agg_02_minimum_support": "SELECT p.method, p.subarea_id, p.n, round(p.mean, 6) AS mean, c.income FROM (SELECT method, subarea_id, count(*) AS n, avg(value) AS mean FROM t_pred GROUP BY method, subarea_id HAVING count(*) >= 10) p JOIN t_counts c ON p.subarea_id = c.subarea_id",
    "agg_03_area_statistics": "SELECT method, area_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(CASE WHEN avg(value) > 0e0 THEN stddev_pop(value) / avg(value) ELSE 0e0 END, 6) AS cv, round(max(value) - min(value), 6) AS spread, round(abs(avg(value) - min(target)), 6) AS gap, round(CASE WHEN min(target) > 0e0 THEN 100e0 * abs(avg(value) - min(target)) / min(target) ELSE 0e0 END, 6) AS gap_pct FROM t_pred GROUP BY method, area_id",
    "agg_04_weighted_constraint_error": "SELECT method, round(sum(n * err) / sum(n), 6) AS error FROM (SELECT method, area_id, CAST(count(*) AS DOUBLE) AS n, 100e0 * abs(avg(value) - min(target)) / (CASE WHEN abs(min(target)) < 1e-6 THEN 1e0 ELSE abs(min(target)) END) AS err FROM t_pred GROUP BY method, area_id) GROUP BY method",
    "agg_05_recovery_metrics": """
SELECT method, area_id, n, round(r, 6) AS pearson, round(rho, 6) AS spearman, round(rmse, 6) AS rmse, round(err, 6) AS constraint_pct FROM (
 SELECT method, area_id, count(*) AS n, CASE WHEN stddev_pop(value) > 1e-9 AND stddev_pop(truth) > 1e-9 THEN (avg(value * truth) - avg(value) * avg(truth)) / (stddev_pop(value) * stddev_pop(truth)) END AS r, CASE WHEN stddev_pop(rv) > 1e-9 AND stddev_pop(rt) > 1e-9 THEN (avg(rv * rt) - avg(rv) * avg(rt)) / (stddev_pop(rv) * stddev_pop(rt)) END AS rho, sqrt(avg((value - truth) * (value - truth))) AS rmse, CASE WHEN abs(min(target)) > 1e-10 THEN 100e0 * abs(avg(value) - min(target)) / abs(min(target)) END AS err FROM (
  SELECT *, rank() OVER (PARTITION BY method, area_id ORDER BY value) + (count(*) OVER (PARTITION BY method, area_id, value) - 1) / 2e0 AS rv, rank() OVER (PARTITION BY method, area_id ORDER BY truth) + (count(*) OVER (PARTITION BY method, area_id, truth) - 1) / 2e0 AS rt FROM t_pred WHERE truth IS NOT NULL) GROUP BY method, area_id HAVING count(*) >= 2)""",
    "agg_06_truth_metrics": "SELECT method, area_id, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(CASE WHEN sd > 1e-9 THEN r END, 6) AS r, round(sd, 6) AS sd FROM t_metric WHERE n >= 10",
    "agg_07_method_rollup": "SELECT method, round(avg(rmse), 6) AS mean_rmse, round(median(rmse), 6) AS median_rmse, round(avg(mae), 6) AS mean_mae, round(median(mae), 6) AS median_mae FROM t_metric GROUP BY method",
    "agg_08_bucket_rollup": "SELECT CASE WHEN target <= $target_low THEN 'low' WHEN target <= $target_high THEN 'medium' ELSE 'high' END AS bucket, method, count(DISTINCT area_id) AS areas, round(avg(rmse), 6) AS rmse FROM t_metric GROUP BY 1, 2",
    "agg_09_quintile_rollup": """
SELECT method, bin, count(*) AS areas, round(min(target), 6) AS lo, round(max(target), 6) AS hi, round(avg(rmse), 6) AS mean_err, round(median(rmse), 6) AS median_err, round(stddev_samp(rmse) / sqrt(CAST(count(*) AS DOUBLE)), 6) AS se FROM (
 SELECT m.*, CASE WHEN target <= q1 THEN 1 WHEN target <= q2 THEN 2 WHEN target <= q3 THEN 3 WHEN target <= q4 THEN 4 ELSE 5 END AS bin FROM t_metric m CROSS JOIN (SELECT percentile_cont(0.2) WITHIN GROUP (ORDER BY target) q1, percentile_cont(0.4) WITHIN GROUP (ORDER BY target) q2, percentile_cont(0.6) WITHIN GROUP (ORDER BY target) q3, percentile_cont(0.8) WITHIN GROUP (ORDER BY target) q4 FROM t_area)) GROUP BY method, bin""",
    "agg_10_variance_split": """
SELECT round(sum(w * (m - g) * (m - g)) / sum(w), 6) AS between_var, round(sum(w * v) / sum(w), 6) AS within_var FROM (SELECT m, v, w, sum(w * m) OVER () / sum(w) OVER () AS g FROM (
 SELECT subarea_id, sum(n * x) / sum(n) AS m, sum(n * x * x) / sum(n) - (sum(n * x) / sum(n)) * (sum(n * x) / sum(n)) AS v, sum(n) AS w FROM (SELECT subarea_id, truth AS x, 1e0 + point_id % 5 AS n FROM t_point WHERE truth IS NOT NULL) GROUP BY subarea_id))""",
    "agg_11_eta_squared": """
SELECT feature, round(CASE WHEN max(ss_total) < 1e-12 THEN NULL ELSE sum(n * (m - g) * (m - g)) / max(ss_total) END, 6) AS eta_sq, max(ss_total) < 1e-12 AS zero_variance FROM (
 SELECT a.feature, a.area_id, a.n, a.m, g.g, g.ss_total FROM (SELECT feature, area_id, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m FROM t_feature GROUP BY feature, area_id) a JOIN (SELECT feature, avg(value) AS g, var_pop(value) * count(*) AS ss_total FROM t_feature GROUP BY feature) g ON a.feature = g.feature) GROUP BY feature""",
    "agg_12_within_std_ratio": "SELECT a.feature, round(median(a.s) / nullif(max(g.s), 0e0), 6) AS ratio FROM (SELECT feature, area_id, stddev_pop(value) AS s FROM t_feature GROUP BY feature, area_id) a JOIN (SELECT feature, stddev_samp(value) AS s FROM t_feature GROUP BY feature) g ON a.feature = g.feature GROUP BY a.feature",
    "agg_13_class_summary": """
SELECT class, round(median(e), 6) AS middle, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY e), 6) AS q1, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY e), 6) AS q3, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY e) - percentile_cont(0.25) WITHIN GROUP (ORDER BY e), 6) AS iqr FROM (
 SELECT CASE WHEN feature LIKE '%count%' THEN 'count' WHEN feature LIKE '%anc%' THEN 'building' ELSE 'position' END AS class, feature, area_id, stddev_pop(value) AS e FROM t_feature GROUP BY 1, 2, 3) GROUP BY class""",
    "agg_14_within_variance_ratio": "SELECT round(sum(n * v) / sum(n) / max(t), 6) AS ratio FROM (SELECT area_id, CAST(count(*) AS DOUBLE) AS n, var_pop(truth) AS v FROM t_point WHERE truth IS NOT NULL GROUP BY area_id) a CROSS JOIN (SELECT var_pop(truth) AS t FROM t_point)",
    "agg_15_area_inventory": """
SELECT s.area_id, CAST(sum(s.n) AS BIGINT) AS points, CAST(sum(s.known) AS BIGINT) AS non_null, count_if(s.n >= $least_points) AS qualifying, round(max(s.m) - min(s.m), 6) AS spread, round(sum(s.known * s.m * s.m) / sum(s.known) - (sum(s.known * s.m) / sum(s.known)) * (sum(s.known * s.m) / sum(s.known)), 6) AS weighted_variance, round(sum(s.known * s.m) / sum(s.known) - max(a.target), 6) AS shift
FROM (SELECT area_id, subarea_id, count(*) AS n, CAST(count(truth) AS DOUBLE) AS known, coalesce(avg(truth), 0e0) AS m FROM t_point GROUP BY area_id, subarea_id) s JOIN t_area a ON s.area_id = a.area_id GROUP BY s.area_id""",
    "agg_16_coverage_status": """
SELECT a.area_id, round(a.target, 6) AS target, count(p.point_id) AS n, CASE WHEN count(p.point_id) >= $complete_points THEN 'good' WHEN count(p.point_id) > 0 THEN 'sparse' ELSE 'empty' END AS status FROM t_area a LEFT JOIN t_point p ON a.area_id = p.area_id GROUP BY a.area_id, a.target""",
    "agg_17_weighted_mean_check": "SELECT s.area_id, round(sum(m * n) / sum(n), 6) AS weighted, round(100e0 * abs(sum(m * n) / sum(n) - max(a.target)) / max(a.target), 4) AS gap_pct FROM (SELECT area_id, subarea_id, CAST(count(truth) AS DOUBLE) AS n, avg(truth) AS m FROM t_point GROUP BY area_id, subarea_id) s JOIN t_area a ON s.area_id = a.area_id GROUP BY s.area_id",
    "agg_18_importance_rollup": """
SELECT feature, round(m, 6) AS mean_drop, round(s, 6) AS sd_drop, areas, row_number() OVER (ORDER BY round(m, 6) DESC, feature) AS place FROM (SELECT feature, avg(loss) AS m, stddev_samp(loss) AS s, count(loss) AS areas FROM t_importance WHERE NOT isnan(loss) GROUP BY feature)""",
    "agg_19_seed_rollup": "SELECT metric, count(*) AS seeds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM (SELECT metric, seed, avg(value) AS v FROM t_ledger WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY metric, seed) GROUP BY metric",
    "agg_20_method_comparison": "SELECT method, row_number() OVER (ORDER BY round(gap, 9), method) AS by_gap, row_number() OVER (ORDER BY round(sd, 9) DESC, method) AS by_spread, round(sd - max(CASE WHEN method = 'naive' THEN sd END) OVER (), 6) AS over_naive FROM (SELECT method, avg(gap) AS gap, avg(sd) AS sd FROM t_metric GROUP BY method)",
    "agg_21_wide_rollup": "SELECT area_id, round(max(CASE WHEN method = 'naive' THEN sd END), 6) AS naive_sd, round(max(CASE WHEN method = 'dasymetric' THEN sd END), 6) AS dasymetric_sd, round(max(CASE WHEN method = 'dasymetric' THEN gap END), 6) AS dasymetric_gap, round(max(CASE WHEN method = 'gradient' THEN sd END), 6) AS gradient_sd FROM t_metric GROUP BY area_id",
    "agg_22_metric_summary": "SELECT method, round(median(r), 6) AS middle, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, count_if(r > 0.3e0) AS over_30, count_if(r > 0.5e0) AS over_50, round(median(rmse), 6) AS err FROM t_metric WHERE sd > 1e-9 GROUP BY method",
    "agg_23_lift_summary": "SELECT m.method, round(median(m.rmse - b.rmse), 6) AS lift, count_if(m.rmse < b.rmse) AS beats FROM t_metric m JOIN t_metric b ON m.area_id = b.area_id AND b.method = 'naive' WHERE m.method <> 'naive' GROUP BY m.method",
    "agg_24_log_hit_rate": "SELECT cache_type, count(*) AS n, round(avg(CASE WHEN hit THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM t_log WHERE operation = 'get' GROUP BY cache_type",
    "agg_24_log_top_keys": "SELECT cache_key, count(*) AS n FROM t_log GROUP BY cache_key ORDER BY n DESC, cache_key LIMIT 10",
    "agg_24_log_hourly": "SELECT date_trunc('hour', ts) AS hour, operation, count(*) AS n FROM t_log GROUP BY 1, 2",
    "agg_25_pair_preflight": """
SELECT subarea_id, count_if(step = 0) AS n, round(min(lo), 6) AS lo, round(max(lo), 6) AS hi, CAST(sum(CASE WHEN step = 0 AND lo IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS pairs FROM (SELECT subarea_id, step, lo, sum(step) OVER (PARTITION BY subarea_id ORDER BY place, step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (
 SELECT subarea_id, truth + 0.25e0 AS place, 1 AS step, CAST(NULL AS DOUBLE) AS lo FROM t_point WHERE truth IS NOT NULL UNION ALL SELECT subarea_id, truth, 0, truth FROM t_point)) GROUP BY subarea_id""",
    "agg_26_ordering_compliance": "SELECT method, area_id, round(sum(higher) * 1e0 / sum(pairs), 6) AS compliance FROM t_ordered GROUP BY method, area_id",
    "agg_27_segment_profiles": """
WITH seg AS (SELECT area_id, CASE WHEN target <= q1 THEN 'Low' WHEN target <= q2 THEN 'Medium' ELSE 'High' END AS segment FROM t_area CROSS JOIN (SELECT percentile_cont(0.3333) WITHIN GROUP (ORDER BY target) AS q1, percentile_cont(0.6667) WITHIN GROUP (ORDER BY target) AS q2 FROM t_area)),
f AS (SELECT s.segment, f.feature, avg(f.value) AS m, var_pop(f.value) AS v FROM t_feature f JOIN seg s ON f.area_id = s.area_id GROUP BY s.segment, f.feature)
SELECT one, other, feature, round(effect, 6) AS effect, nth FROM (SELECT a.segment AS one, b.segment AS other, a.feature, abs(a.m - b.m) / nullif(sqrt((a.v + b.v) / 2e0), 0e0) AS effect, row_number() OVER (PARTITION BY a.segment, b.segment ORDER BY round(abs(a.m - b.m) / nullif(sqrt((a.v + b.v) / 2e0), 0e0), 9) DESC NULLS LAST, a.feature) AS nth FROM f a JOIN f b ON a.feature = b.feature AND a.segment < b.segment) WHERE nth <= 10""",
    "agg_27_segment_features": """
WITH seg AS (SELECT area_id, CASE WHEN target <= q1 THEN 'Low' WHEN target <= q2 THEN 'Medium' ELSE 'High' END AS segment FROM t_area CROSS JOIN (SELECT percentile_cont(0.3333) WITHIN GROUP (ORDER BY target) AS q1, percentile_cont(0.6667) WITHIN GROUP (ORDER BY target) AS q2 FROM t_area))
SELECT s.segment, f.feature, count(*) AS n, round(avg(f.value), 6) AS mean, round(stddev_pop(f.value), 6) AS sd FROM t_feature f JOIN seg s ON f.area_id = s.area_id GROUP BY s.segment, f.feature""",
    "agg_28_counterintuitive": """
SELECT c.point_id, round(c.truth, 6) AS target, c.segment FROM (SELECT s.point_id, s.truth, CASE WHEN s.m <= q.q1 THEN 'Low' WHEN s.m <= q.q2 THEN 'Medium' ELSE 'High' END AS segment FROM t_reached s CROSS JOIN t_cut_reached q) c
WHERE (c.truth < $target_low AND c.segment = 'High') OR (c.truth > $target_high AND c.segment = 'Low')""",
    "agg_29_metric_slope": "SELECT method, round(regr_slope(rmse, target), 5) AS slope FROM t_metric GROUP BY method HAVING count(*) >= 3",
    "agg_30_reference_delta": """
WITH l AS (SELECT seed, metric, avg(value) AS v FROM t_ledger WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY seed, metric)
SELECT a.seed, a.metric, round(a.v, 4) AS value, round(b.v, 4) AS reference, round(a.v - b.v, 4) AS delta FROM l a JOIN l b ON a.metric = b.metric AND b.seed = 42 WHERE a.seed <> 42""",
    "agg_31_disaggregation_drift": "SELECT method, count(*) AS areas, round(avg(m - target), 6) AS shift, round(corr(m, target) * corr(m, target), 6) AS r2 FROM (SELECT method, area_id, avg(value) AS m, min(target) AS target FROM t_pred GROUP BY method, area_id) GROUP BY method",
    "agg_32_cross_method_agreement": "SELECT method_a, method_b, round(avg(r), 6) AS r FROM (SELECT a.method AS method_a, b.method AS method_b, a.area_id, corr(a.value, b.value) AS r FROM t_pred a JOIN t_pred b ON a.point_id = b.point_id WHERE a.method <> 'naive' AND b.method <> 'naive' GROUP BY 1, 2, 3) GROUP BY method_a, method_b",
    "agg_33_subarea_agreement": "SELECT a.subarea_id, count(*) AS n, round(corr(a.value, b.value), 5) AS r FROM t_pred a JOIN t_pred b ON a.point_id = b.point_id AND a.method = 'dasymetric' AND b.method = 'gradient' GROUP BY a.subarea_id HAVING count(*) >= 3",
    "agg_34_supervision_density": "SELECT round(corr(i, spread), 6) AS by_spread, round(corr(i, n), 6) AS by_n FROM (SELECT m.area_id, b.rmse - m.rmse AS i, CAST(m.n AS DOUBLE) AS n, s.spread FROM t_metric m JOIN t_metric b ON m.area_id = b.area_id AND m.method = 'gradient' AND b.method = 'naive' JOIN (SELECT area_id, max(truth) - min(truth) AS spread FROM t_point GROUP BY area_id) s ON m.area_id = s.area_id)",
    "agg_35_run_summary": f"""
SELECT n.n_nationkey AS area_id, round(m.target, 6) AS target, m.n, round(100e0 * m.gap / m.target, 6) AS error_pct, round(m.sd, 6) AS sd, round(m.least, 6) AS least, round(m.most, 6) AS most, round(i.moran, 6) AS moran, CASE WHEN m.area_id IS NULL THEN 'failed' ELSE 'ok' END AS status FROM t_nation n
LEFT JOIN (SELECT area_id, count(*) AS n, min(target) AS target, abs(avg(value) - min(target)) AS gap, stddev_pop(value) AS sd, min(value) AS least, max(value) AS most FROM t_pred WHERE method = 'gradient' GROUP BY area_id HAVING count(*) >= $complete_points) m ON n.n_nationkey = m.area_id
LEFT JOIN (SELECT m.area_id, m.top / nullif(v.v, 0e0) AS moran FROM ({_MORAN.format(w=_W, z=_VALUES)}) m JOIN (SELECT area_id, avg(z * z) AS v FROM ({_VALUES}) GROUP BY area_id) v ON m.area_id = v.area_id) i ON n.n_nationkey = i.area_id""",
    "agg_36_closest_features": "SELECT area_id, feature FROM (SELECT a.area_id, a.feature, row_number() OVER (PARTITION BY a.area_id ORDER BY round(abs(a.m - s.m) / s.s, 9), a.feature) AS nth FROM (SELECT area_id, feature, avg(value) AS m FROM t_feature GROUP BY area_id, feature) a JOIN (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM t_feature GROUP BY feature) s ON a.feature = s.feature WHERE s.s > 0e0) WHERE nth <= 3",
    "agg_24_log_types": "SELECT operation, cache_type, coalesce(get_json_object(props, '$.k'), 'none') AS kind, count(*) AS n FROM t_log GROUP BY 1, 2, 3",
    "agg_27_segment_statistics": """
SELECT CASE WHEN m.target <= q1 THEN 'Low' WHEN m.target <= q2 THEN 'Medium' ELSE 'High' END AS segment, count(*) AS n, round(avg(m.target), 6) AS mean, round(stddev_pop(m.target), 6) AS sd, round(min(m.target), 6) AS least, round(max(m.target), 6) AS most, round(avg(m.rmse), 6) AS error FROM t_metric m
CROSS JOIN (SELECT percentile_cont(0.3333) WITHIN GROUP (ORDER BY target) AS q1, percentile_cont(0.6667) WITHIN GROUP (ORDER BY target) AS q2 FROM t_area) WHERE m.method = 'gradient' GROUP BY 1""",
}
