"""Correlation, rank and resampling statistics."""

from ..sources.fixtures import correlation as _corr
from .windows import average_rank


_CI = "percentile_cont(0.025) WITHIN GROUP (ORDER BY {0})", "percentile_cont(0.975) WITHIN GROUP (ORDER BY {0})"
_RANKS = f"SELECT area_id, {average_rank('ancillary', 'area_id')} AS ra, {average_rank('truth', 'area_id')} AS rt, {average_rank('x', 'area_id')} AS rx FROM t_point WHERE ancillary IS NOT NULL AND truth IS NOT NULL"
_USAGE = "SELECT f.feature, avg(f.value) AS m, stddev_pop(f.value) AS s, max(f.value) - min(f.value) AS spread, CASE WHEN stddev_pop(f.value) > 1e-9 AND stddev_pop(p.truth) > 1e-9 THEN (avg(f.value * p.truth) - avg(f.value) * avg(p.truth)) / (stddev_pop(f.value) * stddev_pop(p.truth)) END AS r FROM t_feature f JOIN t_point p ON f.point_id = p.point_id WHERE p.truth IS NOT NULL GROUP BY f.feature"
PLANS = {
    "sta_01_pearson": "SELECT method, area_id, count(*) AS n, round(corr(value, truth), 6) AS r FROM t_pred WHERE truth IS NOT NULL AND method <> 'naive' GROUP BY method, area_id HAVING count(*) >= 10",
    "sta_03_spearman": f"SELECT area_id, round(corr(ra, rt), 6) AS rho FROM ({_RANKS}) GROUP BY area_id",
    "sta_04_partial_spearman": f"SELECT area_id, round((xy - xz * yz) / nullif(sqrt(greatest((1e0 - xz * xz) * (1e0 - yz * yz), 0e0)), 0e0), 6) AS rho FROM (SELECT area_id, corr(ra, rt) AS xy, corr(ra, rx) AS xz, corr(rt, rx) AS yz FROM ({_RANKS}) GROUP BY area_id HAVING count(*) >= 20)",
    "sta_05_partial_pearson": "SELECT area_id, round((xy - xz * yz) / nullif(sqrt(greatest((1e0 - xz * xz) * (1e0 - yz * yz), 0e0)), 0e0), 6) AS r FROM (SELECT area_id, corr(ancillary, truth) AS xy, corr(ancillary, y) AS xz, corr(truth, y) AS yz FROM t_point WHERE ancillary IS NOT NULL AND truth IS NOT NULL GROUP BY area_id HAVING count(*) >= 20)",
    "sta_06_component_correlations": "SELECT name, round(corr(c, income), 6) AS r FROM (SELECT 'orders' AS name, CAST(orders_n AS DOUBLE) AS c, income FROM t_counts UNION ALL SELECT 'f', CAST(n_f AS DOUBLE), income FROM t_counts UNION ALL SELECT 'urgent', CAST(n_urgent AS DOUBLE), income FROM t_counts) WHERE income IS NOT NULL GROUP BY name",
    "sta_07_bootstrap_ci": f"SELECT area_id, count(*) AS draws, round({_CI[0].format('r1')}, 6) AS lo, round({_CI[1].format('r1')}, 6) AS hi FROM t_boot WHERE r1 IS NOT NULL GROUP BY area_id",
    "sta_08_bootstrap_difference": f"""
WITH seen AS (SELECT area_id, {_corr('v1', 'truth')} - {_corr('v2', 'truth')} AS diff FROM t_paired GROUP BY area_id),
ci AS (SELECT b.area_id, max(s.diff) AS diff, {_CI[0].format('b.r1 - b.r2')} AS lo, {_CI[1].format('b.r1 - b.r2')} AS hi, greatest(avg(CASE WHEN abs(b.r1 - b.r2 - s.diff) >= abs(s.diff) - 1e-9 THEN 1e0 ELSE 0e0 END), 1e0 / count(*)) AS p
 FROM t_boot b JOIN seen s ON b.area_id = s.area_id WHERE b.r1 IS NOT NULL AND b.r2 IS NOT NULL AND s.diff IS NOT NULL GROUP BY b.area_id)
SELECT area_id, round(diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p, lo > 0e0 OR hi < 0e0 AS significant FROM ci""",
    "sta_09_bootstrap_median": f"""
SELECT area_id, round({_CI[0].format('mid')}, 6) AS lo, round({_CI[1].format('mid')}, 6) AS hi, round({_CI[0].format('diff')}, 6) AS diff_lo, round({_CI[1].format('diff')}, 6) AS diff_hi FROM t_boot GROUP BY area_id""",
    "sta_10_interval_overlap": f"""
WITH ci AS (SELECT area_id, {_CI[0].format('r1')} AS lo1, {_CI[1].format('r1')} AS hi1, {_CI[0].format('r2')} AS lo2, {_CI[1].format('r2')} AS hi2 FROM t_boot WHERE r1 IS NOT NULL AND r2 IS NOT NULL GROUP BY area_id)
SELECT area_id, lo1 <= hi2 AND lo2 <= hi1 AS overlap, lo1 > 0e0 OR hi1 < 0e0 AS first_separable, lo2 > 0e0 OR hi2 < 0e0 AS second_separable FROM ci""",
    "sta_11_signal_bearing": """
SELECT area_id, feature, CASE WHEN s < 1e-10 THEN false WHEN flags = n THEN least(ones, n - ones) >= 0.05e0 * n WHEN abs(m) < 1e-8 THEN true ELSE s / abs(m) >= 0.05e0 END AS signal FROM (
 SELECT area_id, feature, stddev_pop(value) AS s, avg(value) AS m, count(*) AS n, count_if(value = 0e0 OR value = 1e0) AS flags, count_if(value = 1e0) AS ones FROM t_feature GROUP BY area_id, feature)""",
    "sta_12_feature_spearman": "SELECT area_id, feature, round(rho, 6) AS rho FROM t_rho",
    "sta_13_rank_consistency": "SELECT feature, count(*) AS areas, round(median(rho), 6) AS middle, round(avg(rho), 6) AS mean, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY rho) - percentile_cont(0.25) WITHIN GROUP (ORDER BY rho), 6) AS iqr, count_if(rho > 0e0) AS positive, count_if(rho < 0e0) AS negative FROM t_rho WHERE NOT isnan(rho) GROUP BY feature HAVING count(*) >= 5",
    "sta_14_sign_test": """
WITH k AS (SELECT feature, count_if(rho > 0e0) AS pos, count_if(rho <> 0e0) AS n FROM t_rho WHERE NOT isnan(rho) GROUP BY feature),
fact AS (SELECT CAST(0 AS BIGINT) AS i, 0e0 AS f UNION ALL SELECT CAST(i AS BIGINT), sum(ln(CAST(i AS DOUBLE))) OVER (ORDER BY i) FROM (SELECT explode(sequence(1, n)) AS i FROM (SELECT CAST(max(n) AS INT) AS n FROM k)))
SELECT /*+ BROADCAST(k) */ k.feature, max(k.pos) AS pos, max(k.n) AS n, round(least(1e0, 2e0 * sum(exp(a.f - b.f - c.f - k.n * ln(2e0)))), 6) AS p FROM k JOIN fact a ON a.i = k.n JOIN fact b ON b.i <= least(k.pos, k.n - k.pos) JOIN fact c ON c.i = k.n - b.i WHERE k.n > 0 GROUP BY k.feature""",
    "sta_15_wilcoxon_w": "SELECT method, round(sum(CASE WHEN d > 0e0 THEN place ELSE 0e0 END), 3) AS w_plus, round(sum(CASE WHEN d < 0e0 THEN place ELSE 0e0 END), 3) AS w_minus FROM (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2e0 AS place FROM (SELECT m.method, round(m.rmse - b.rmse, 9) AS d FROM t_metric m JOIN t_metric b ON m.area_id = b.area_id AND b.method = 'naive' WHERE m.method <> 'naive') WHERE d <> 0e0) GROUP BY method",
    "sta_16_summary": "SELECT method, round(median(rmse), 6) AS middle, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY rmse), 6) AS q1, round(percentile_cont(0.75) WITHIN GROUP (ORDER BY rmse), 6) AS q3, count_if(r > 0e0) AS positive FROM t_metric WHERE sd > 1e-9 GROUP BY method",
    "sta_17_pooled_t": "SELECT round((max(CASE WHEN g = 1 THEN m END) - max(CASE WHEN g = 0 THEN m END)) / sqrt((sum((n - 1e0) * v) / (sum(n) - 2e0)) * sum(1e0 / n)), 6) AS t FROM (SELECT CASE WHEN x - floor(x) >= 0.5e0 THEN 1 ELSE 0 END AS g, CAST(count(*) AS DOUBLE) AS n, avg(truth) AS m, var_samp(truth) AS v FROM t_point WHERE truth IS NOT NULL GROUP BY 1)",
    "sta_18_skewness": "SELECT feature, round(avg((value - m) * (value - m) * (value - m)) / (max(s) * max(s) * max(s)), 6) AS skew FROM (SELECT feature, value, avg(value) OVER (PARTITION BY feature) AS m, stddev_pop(value) OVER (PARTITION BY feature) AS s FROM t_feature WHERE feature <> 'flat') GROUP BY feature",
    "sta_19_correlation_matrix": "SELECT a.feature AS f1, b.feature AS f2, round(corr(a.value, b.value), 6) AS r, abs(corr(a.value, b.value)) > 0.95e0 AS high FROM t_feature a JOIN t_feature b ON a.point_id = b.point_id AND a.feature < b.feature WHERE a.feature <> 'flat' AND b.feature <> 'flat' GROUP BY a.feature, b.feature",
    "sta_21_feature_usage": f"SELECT feature, round(m, 6) AS mean, round(s, 6) AS sd, round(spread, 6) AS spread, round(r, 6) AS r, s < 0.01e0 AS low_variance, coalesce(abs(r) < 0.1e0, true) AS weak FROM ({_USAGE})",
    "sta_22_direction_check": f"SELECT feature, expected, CASE WHEN r > 0e0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS found, CASE WHEN expected = 'UNKNOWN' THEN NULL ELSE (r > 0e0) = (expected = 'POSITIVE') END AS correct FROM (SELECT u.*, CASE WHEN feature LIKE '%count%' THEN 'NEGATIVE' WHEN feature LIKE '%anc%' THEN 'POSITIVE' ELSE 'UNKNOWN' END AS expected FROM ({_USAGE}) u) WHERE r IS NOT NULL",
    "sta_23_area_mean_correlation": "SELECT feature, round(corr(m, target), 6) AS r, rank() OVER (ORDER BY round(abs(corr(m, target)), 6) DESC) AS place FROM (SELECT f.feature, f.area_id, avg(f.value) AS m, min(a.target) AS target FROM t_feature f JOIN t_area a ON f.area_id = a.area_id WHERE f.feature <> 'flat' GROUP BY f.feature, f.area_id) GROUP BY feature",
    "sta_24_rank_agreement": f"SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT {average_rank('a')} AS ra, {average_rank('b')} AS rb FROM (SELECT area_id, max(CASE WHEN method = 'naive' THEN round(rmse, 9) END) AS a, max(CASE WHEN method = 'gradient' THEN round(rmse, 9) END) AS b FROM t_metric GROUP BY area_id))",
    "sta_25_quadratic_fit": """
SELECT round(r, 6) AS r, round((rxy * rxy + rqy * rqy - 2e0 * rxy * rqy * rxq) / (1e0 - rxq * rxq), 5) AS r2_quadratic FROM (SELECT corr(x, truth) AS r, corr(x, truth) AS rxy, corr(x * x, truth) AS rqy, corr(x, x * x) AS rxq FROM (SELECT x - floor(x) AS x, truth FROM t_point WHERE truth IS NOT NULL))""",
    "sta_26_stability": """
SELECT metric, count(*) AS runs, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most, round(max(v) - min(v), 6) AS spread, max(v) - min(v) < CASE metric WHEN 'gap_pct' THEN 1e0 WHEN 'sd' THEN 0.01e0 ELSE 0.02e0 END AS stable
FROM (SELECT metric, seed, avg(value) AS v FROM t_ledger WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY metric, seed) GROUP BY metric""",
    "mlr_05_heldout_feature_target": """
SELECT f.area_id, round(avg((f.value - g.m) / g.s), 6) AS target_z, round(avg((f.value - g.m) / g.s) * max(g.s) + max(g.m), 6) AS target FROM t_feature f CROSS JOIN (SELECT avg(value) AS m, stddev_pop(value) AS s FROM t_feature WHERE feature = 'ancillary') g WHERE f.feature = 'ancillary' GROUP BY f.area_id""",
    "mlr_10_inductive_evaluation": """
SELECT part, count(*) AS areas, round(corr(m, t), 6) AS r, round(avg(abs(m - t)), 6) AS mae, round(sqrt(avg((m - t) * (m - t))), 6) AS rmse FROM (SELECT part, area_id, avg(value) AS m, min(target) AS t FROM t_raw GROUP BY part, area_id) WHERE t IS NOT NULL GROUP BY part HAVING count(*) >= 3""",
    "mlr_11_loss_terms": """
WITH area AS (SELECT method, area_id, avg(value) AS m, min(target) AS t, stddev_pop(value) AS s, max(value) - min(value) AS span, avg(greatest(value - 1e0, 0e0) + greatest(-value, 0e0)) AS over FROM t_pred GROUP BY method, area_id),
sub AS (SELECT method, avg((m - t) * (m - t)) AS mse FROM (SELECT method, subarea_id, avg(value) AS m, avg(truth) AS t FROM t_pred WHERE truth IS NOT NULL GROUP BY method, subarea_id) GROUP BY method),
pairs AS (SELECT method, sum(hinge) / sum(pairs) AS hinge FROM t_ordered GROUP BY method)
SELECT a.method, round(avg((a.m - a.t) * (a.m - a.t)), 9) AS constraint_mse, round(avg(greatest(0e0, 0.05e0 - a.s)), 6) AS variation_hinge, round(avg(a.over), 6) AS bounds, round(avg(greatest(0e0, 0.2e0 - a.span)), 6) AS range_hinge, round(max(p.hinge), 6) AS ordering_hinge, round(max(s.mse), 9) AS subarea_mse
FROM area a JOIN sub s ON a.method = s.method LEFT JOIN pairs p ON a.method = p.method GROUP BY a.method""",
    "mlr_12_convergence_check": """
SELECT p.method, round(max(c.mean_error), 6) AS mean_error, max(c.mean_error) < 20e0 AS converged, round(corr(p.value, f.m), 6) AS r_mean_feature FROM t_pred p JOIN (SELECT point_id, avg(value) AS m FROM t_feature GROUP BY point_id) f ON p.point_id = f.point_id
JOIN (SELECT method, avg(e) AS mean_error FROM (SELECT method, area_id, 100e0 * abs(avg(value) - min(target)) / min(target) AS e FROM t_pred GROUP BY method, area_id) GROUP BY method) c ON p.method = c.method GROUP BY p.method""",
}
