"""Ranks, scaling, quantile bins and top-k by window functions."""

from ..sources.ranks import placed


def average_rank(value: str, scope: str = "") -> str:
    """SQL for the percentile rank with ties averaged and nulls left out."""
    part = f"PARTITION BY {scope}, " if scope else "PARTITION BY "
    over = f"PARTITION BY {scope}" if scope else ""
    return f"CASE WHEN {value} IS NOT NULL THEN (rank() OVER ({over} ORDER BY CASE WHEN {value} IS NULL THEN 1 ELSE 0 END, {value}) + (count(*) OVER ({part}{value}) - 1) / 2e0) / count({value}) OVER ({over}) END"


#: Variables of a composite index by theme; a minus sign inverts the rank.
_THEMES = (("-income", "n_f", "n_cheap"), ("n_urgent", "n_high"), ("n_o", "n_p"), ("n_low", "n_dear"))
_CORE = ("income", "n_f", "n_urgent", "total")


def composite(themes: tuple[tuple[str, ...], ...], core: tuple[str, ...], key: str, source: str) -> str:
    """SQL for ranks of variables, their sums by theme, ranks of these, and the rank of their sum; null where one is."""
    names = [v.lstrip("-") for t in themes for v in t]
    ranks = ", ".join(f"{average_rank(v)} AS r_{v}" for v in names)
    sums = ", ".join("round(" + " + ".join(f"(1e0 - r_{v[1:]})" if v[0] == "-" else f"r_{v}" for v in t) + f", 9) AS sum_{i}" for i, t in enumerate(themes))
    placed = ", ".join(f"{average_rank(f'sum_{i}')} AS rank_{i}" for i in range(len(themes)))
    total = " + ".join(f"rank_{i}" for i in range(len(themes)))
    whole = " AND ".join(f"{c} IS NOT NULL" for c in core)
    return f"SELECT {key}, complete, {', '.join(f'round(rank_{i}, 6) AS theme_{i + 1}' for i in range(len(themes)))}, round({average_rank('total_rank')}, 6) AS overall FROM (SELECT *, round({total}, 9) AS total_rank FROM (SELECT *, {placed} FROM (SELECT *, {sums} FROM (SELECT *, {whole} AS complete, {ranks} FROM {source}))))"


PLANS = {
    "win_01_percentile_rank": f"SELECT p.point_id, round((r.below + 1 + (r.ties - 1) / 2e0) / r.n, 9) AS pctl FROM t_point p LEFT JOIN ({placed('t_point', 'truth')}) r ON p.point_id = r.point_id",
    "win_02_composite_index": composite(_THEMES, _CORE, "subarea_id", "t_counts"),
    "win_03_county_scope": f"SELECT c.subarea_id, round({average_rank('c.income', 'a.county_id')}, 6) AS in_county, round({average_rank('c.income')}, 6) AS national FROM t_counts c JOIN t_area a ON c.area_id = a.area_id",
    "win_04_cume_dist": "SELECT subarea_id, round(cume_dist() OVER (ORDER BY income), 9) AS share FROM t_counts",
    "win_05_diverse_sample": """
WITH b AS (SELECT area_id, CASE WHEN target <= q1 THEN 1 WHEN target <= q2 THEN 2 WHEN target <= q3 THEN 3 WHEN target <= q4 THEN 4 ELSE 5 END AS bin FROM t_area CROSS JOIN (
 SELECT percentile_cont(0.2) WITHIN GROUP (ORDER BY target) q1, percentile_cont(0.4) WITHIN GROUP (ORDER BY target) q2, percentile_cont(0.6) WITHIN GROUP (ORDER BY target) q3, percentile_cont(0.8) WITHIN GROUP (ORDER BY target) q4 FROM t_area) WHERE target IS NOT NULL),
r AS (SELECT area_id, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('7-' || CAST(area_id AS STRING)), area_id) AS nth FROM b)
SELECT area_id, bin, place <= 10 AND nth <= 2 AS from_bin FROM (SELECT area_id, bin, nth, row_number() OVER (ORDER BY CASE WHEN nth <= 2 THEN 0 ELSE 1 END, md5('top-' || CAST(area_id AS STRING)), area_id) AS place FROM r) WHERE place <= 12""",
    "win_06_percentile_positions": "SELECT DISTINCT p.p, t.area_id FROM (SELECT 5 + 10 * i AS p FROM (SELECT DISTINCT n_nationkey % 10 AS i FROM t_nation)) p JOIN (SELECT area_id, row_number() OVER (ORDER BY target, area_id) - 1 AS pos, count(*) OVER () AS n FROM t_area) t ON t.pos = CAST(floor(p.p / 100e0 * (t.n - 1) + 0.5e0) AS BIGINT)",
    "win_07_fixed_quintile": "SELECT point_id, CASE WHEN truth <= 0.2e0 THEN 'q1' WHEN truth <= 0.4e0 THEN 'q2' WHEN truth <= 0.6e0 THEN 'q3' WHEN truth <= 0.8e0 THEN 'q4' WHEN truth <= 1e0 THEN 'q5' END AS quintile FROM t_point",
    "win_08_access_quintile": f"SELECT point_id, CAST(least(floor((below + row_number() OVER (PARTITION BY g_, cell_, v_ ORDER BY point_id) - 1) / floor(n / 5e0)), 4e0) AS INT) AS quintile FROM ({placed('t_point', 'ancillary')})",
    "win_09_tercile": "SELECT point_id, CASE WHEN ancillary >= hi THEN 2 WHEN ancillary >= lo THEN 1 ELSE 0 END AS tercile FROM t_point CROSS JOIN t_cut_ancillary WHERE ancillary IS NOT NULL",
    "win_10_min_spread": "SELECT method, area_id, round(CASE WHEN count(*) < 4 THEN 0e0 ELSE greatest(0e0, 0.001e0 - avg(gap)) END, 9) AS hinge FROM (SELECT method, area_id, value - lag(value) OVER (PARTITION BY method, area_id ORDER BY value) AS gap FROM t_pred) GROUP BY method, area_id",
    "win_11_robust_scale": """
SELECT f.feature, f.point_id, round((f.value - s.q2) / (CASE WHEN s.q3 - s.q1 = 0e0 THEN 1e0 ELSE s.q3 - s.q1 END), 6) AS scaled FROM t_feature f JOIN t_quartile s ON f.feature = s.g""",
    "win_12_standard_scale": "SELECT f.feature, f.point_id, round((f.value - s.m) / (CASE WHEN s.s < 1e-12 THEN 1e0 ELSE s.s END), 6) AS scaled FROM t_feature f JOIN (SELECT feature, avg(value) m, stddev_pop(value) s FROM t_feature GROUP BY feature) s ON f.feature = s.feature",
    "win_13_area_zscore": "SELECT feature, point_id, round((value - m) / (CASE WHEN s < 1e-8 THEN 1e0 ELSE s END), 6) AS z FROM (SELECT *, avg(value) OVER (PARTITION BY area_id, feature) AS m, stddev_pop(value) OVER (PARTITION BY area_id, feature) AS s FROM t_feature)",
    "win_14_zero_variance": "SELECT area_id, feature FROM t_feature GROUP BY area_id, feature HAVING stddev_pop(value) < 1e-8",
    "win_15_top_k": "SELECT method, area_id FROM (SELECT method, area_id, row_number() OVER (PARTITION BY method ORDER BY round(rmse, 9) DESC, area_id) AS nth FROM t_metric) WHERE nth <= 5",
    "win_16_centre_edge": """
WITH g AS (SELECT CASE WHEN d <= p33 THEN 'centre' ELSE 'edge' END AS place, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, stddev_pop(value) AS s, var_samp(value) AS v FROM t_centre CROSS JOIN t_cut_centre WHERE d <= p33 OR d >= p67 GROUP BY 1)
SELECT c.n AS n_centre, e.n AS n_edge, round(c.m, 6) AS mean_centre, round(e.m, 6) AS mean_edge, round(c.s, 6) AS sd_centre, round(e.s, 6) AS sd_edge, round((c.m - e.m) / sqrt(((c.n - 1e0) * c.v + (e.n - 1e0) * e.v) / (c.n + e.n - 2e0) * (1e0 / c.n + 1e0 / e.n)), 5) AS t
FROM g c JOIN g e ON c.place = 'centre' AND e.place = 'edge'""",
    "win_17_fixed_bins": "SELECT point_id, CASE WHEN ancillary <= 5e0 THEN '0-5' WHEN ancillary <= 10e0 THEN '5-10' WHEN ancillary <= 20e0 THEN '10-20' ELSE '20-100' END AS bin FROM t_point WHERE ancillary IS NOT NULL",
}
