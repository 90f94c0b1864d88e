"""Accessibility features: grouped aggregations over origin-destination pairs.

t_od has every destination within reach by car ($reach minutes) and the nearest of a type that has none there, so
nearest times and counts up to the reach are over all destinations; means, quantiles and shares are over the pairs
within reach, over all with a large reach.
"""

from ..sources.ranks import placed

_TIMES = "(SELECT point_id, dest_type, least(walk_time, drive_time, transit_time) AS t, walk_time AS w, drive_time AS d, transit_time AS tr, dx, dy, km FROM t_od)"
_TYPES = ("employment", "healthcare", "grocery")
_BASE = ("min_time", "mean_time", "median_time", "count_5", "count_10", "count_15", "drive_advantage", "dispersion", "time_range", "percentile")
_MODAL = ("mean_near", "sd_near", "n10", "gap", "ratio")
_MODES = """SELECT point_id, dest_type, (mw + md) / 2e0 AS mean_near, abs(mw - md) / 2e0 AS sd_near, n10, abs(mw - md) AS gap, CASE WHEN md <= 0e0 THEN 1e0 ELSE mw / md END AS ratio FROM (
 SELECT point_id, dest_type, min(walk_time) AS mw, min(drive_time) AS md, count_if(least(drive_time, walk_time) <= 10e0) AS n10 FROM t_od GROUP BY point_id, dest_type)"""


def _pivoted(columns: tuple[str, ...], source: str) -> str:
    """SQL for one row a point with a column for each type and feature."""
    made = ", ".join(f"round(CAST(max(CASE WHEN dest_type = '{t}' THEN {c} END) AS DOUBLE), 6) AS {t}_{c}" for t in _TYPES for c in columns)
    return f"SELECT point_id, {made} FROM {source} GROUP BY point_id"


PLANS = {
    "acc_01_travel_times": """
SELECT point_id, dest_id, round(walk_time, 6) AS walk_time, round(drive_time, 6) AS drive_time, round(transit_time, 6) AS transit_time, round(least(walk_time, drive_time, transit_time), 6) AS combined_time,
 CASE WHEN walk_time <= drive_time AND walk_time <= transit_time THEN 'walk' WHEN drive_time <= transit_time THEN 'drive' ELSE 'transit' END AS best_mode FROM t_od""",
    "acc_02_base_features": """
SELECT point_id, dest_type, round(min(drive_time), 6) AS min_time, round(avg(drive_time), 6) AS mean_time, round(median(drive_time), 6) AS median_time, count_if(drive_time <= 5e0) AS count_5, count_if(drive_time <= 10e0) AS count_10, count_if(drive_time <= 15e0) AS count_15 FROM t_od GROUP BY point_id, dest_type""",
    "acc_03_drive_advantage": """
SELECT point_id, dest_type, round(least(greatest((aw - ad) / aw, -0.2e0), 1e0), 6) AS drive_advantage FROM (SELECT point_id, dest_type, avg(CASE WHEN walk_time > 0e0 AND drive_time > 0e0 THEN walk_time END) AS aw, avg(CASE WHEN walk_time > 0e0 AND drive_time > 0e0 THEN drive_time END) AS ad FROM t_od GROUP BY point_id, dest_type)""",
    "acc_04_dispersion": """
SELECT point_id, dest_type, round(CASE WHEN count(*) < 2 THEN 0e0 ELSE least(stddev_pop(drive_time) / (avg(drive_time) + 1e-8), 1e0) END, 6) AS dispersion, round(CASE WHEN count(*) < 2 THEN 0e0 ELSE least((max(drive_time) - min(drive_time)) / (avg(drive_time) + 1e-8), 2e0) END, 6) AS time_range FROM t_od GROUP BY point_id, dest_type""",
    "acc_05_strict_percentile": f"SELECT point_id, dest_type, round(CAST(below AS DOUBLE) / n, 6) AS percentile FROM ({placed('(SELECT point_id, dest_type, round(avg(drive_time), 6) AS m FROM t_od GROUP BY point_id, dest_type)', 'm', 'dest_type')})",
    "acc_06_fallback_row": """
SELECT p.point_id, round(coalesce(a.min_time, 120e0), 6) AS min_time, round(coalesce(a.mean_time, 120e0), 6) AS mean_time, round(coalesce(a.median_time, 120e0), 6) AS median_time, coalesce(a.count_5, 0) AS count_5, coalesce(a.count_10, 0) AS count_10, coalesce(a.count_15, 0) AS count_15,
 round(coalesce(a.drive_advantage, 0.5e0), 6) AS drive_advantage, round(coalesce(a.dispersion, 0.5e0), 6) AS dispersion, round(coalesce(a.time_range, 0e0), 6) AS time_range, round(coalesce(a.percentile, 0.5e0), 6) AS percentile FROM t_point p LEFT JOIN (SELECT * FROM t_base WHERE dest_type = 'grocery') a ON p.point_id = a.point_id""",
    "acc_07_legacy_features": f"""
SELECT point_id, dest_type, round(min(t), 6) AS min_time, round(avg(t), 6) AS mean_time, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY t), 6) AS p90, round(avg(CASE WHEN tr < d AND tr < w THEN 1e0 ELSE 0e0 END), 6) AS transit_share, round(sum(1e0 / greatest(t, 1e0)), 6) AS gravity, count_if(t <= 5e0) AS count_5, count_if(t <= 10e0) AS count_10, count_if(t <= 15e0) AS count_15 FROM {_TIMES} GROUP BY point_id, dest_type""",
    "acc_08_legacy_derived": """
SELECT point_id, round(total, 6) AS total, round(-sum_p, 6) AS balance, round(mean_transit, 6) AS mean_transit, round(total / (mean_transit + 1e0), 6) AS efficiency FROM (
 SELECT point_id, sum(c) AS total, sum(CASE WHEN all_c > 0e0 THEN greatest(c / all_c, 1e-8) * ln(greatest(c / all_c, 1e-8)) ELSE 0e0 END) AS sum_p, avg(mean_transit) AS mean_transit FROM (
  SELECT point_id, CAST(count_10 AS DOUBLE) AS c, sum(CAST(count_10 AS DOUBLE)) OVER (PARTITION BY point_id) AS all_c, mean_transit FROM t_access) GROUP BY point_id)""",
    "acc_09_directional_diversity": """
SELECT point_id, round(CASE WHEN sum(n) < 4 THEN 0e0 ELSE -sum(n / all_n * log2(n / all_n)) / 3e0 END, 6) AS diversity FROM (SELECT point_id, CAST(count(*) AS DOUBLE) AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY point_id) AS all_n FROM (
 SELECT point_id, least(CAST(floor((atan2(dy, dx) + pi()) / (2e0 * pi()) * 8e0) AS INT), 7) AS bin FROM t_od WHERE dest_type = 'employment') GROUP BY point_id, bin) GROUP BY point_id""",
    "acc_10_gradient": """
SELECT point_id, round(CASE WHEN n < 10 THEN 0.5e0 WHEN t10 = 0e0 THEN 1e0 ELSE least(greatest((t90 - t10) / t10 / 5e0, 0e0), 1e0) END, 6) AS gradient FROM (
 SELECT point_id, max(n) AS n, max(CASE WHEN nth = CAST(floor(n / 10) AS BIGINT) + 1 THEN t END) AS t10, max(CASE WHEN nth = least(n, CAST(floor(9 * n / 10) AS BIGINT) + 1) THEN t END) AS t90 FROM (
  SELECT point_id, drive_time AS t, row_number() OVER (PARTITION BY point_id ORDER BY drive_time, dest_id) AS nth, count(*) OVER (PARTITION BY point_id) AS n FROM t_od WHERE dest_type = 'healthcare') GROUP BY point_id)""",
    "acc_11_concentration": """
SELECT o.point_id, o.dest_type, round(n5 / nullif(n30, 0e0), 6) AS near_share, round(n5 / d.n, 6) AS all_share FROM (SELECT point_id, dest_type, CAST(count_if(drive_time <= 5e0) AS DOUBLE) AS n5, CAST(count_if(drive_time <= 30e0) AS DOUBLE) AS n30 FROM t_od GROUP BY point_id, dest_type) o
JOIN (SELECT dest_type, CAST(count(*) AS DOUBLE) AS n FROM t_dest GROUP BY dest_type) d ON o.dest_type = d.dest_type""",
    "acc_12_walkability": "SELECT point_id, dest_type, round(avg(CASE WHEN walk_time <= 20e0 THEN 1e0 ELSE 0e0 END), 6) AS share_20, max(CASE WHEN walk_time <= 15e0 THEN 1 ELSE 0 END) AS any_15, round(CAST(count_if(walk_time <= 15e0 AND drive_time <= 5e0) AS DOUBLE) / nullif(count_if(drive_time <= 5e0), 0), 6) AS viable FROM t_od GROUP BY point_id, dest_type",
    "acc_13_impedance": "SELECT point_id, dest_type, round(sum(exp(-0.1e0 * drive_time)), 6) AS access FROM t_od GROUP BY point_id, dest_type",
    "acc_14_connectivity": "SELECT point_id, dest_type, round(CASE count(*) WHEN 0 THEN 0.5e0 WHEN 1 THEN 0e0 ELSE least(greatest(stddev_pop(drive_time) / avg(drive_time), 0e0), 1e0) END, 6) AS connectivity FROM t_od GROUP BY point_id, dest_type",
    "acc_15_derived": """
SELECT point_id, CASE WHEN n = 3 THEN total ELSE 0.5e0 END AS total_5, round(CASE WHEN n = 3 THEN advantage ELSE 0.5e0 END, 6) AS drive_advantage, round(CASE WHEN n = 3 THEN 1e0 - sd ELSE 0.5e0 END, 6) AS evenness, round(CASE WHEN n = 3 THEN 1e0 - mean ELSE 0.5e0 END, 6) AS overall FROM (
 SELECT point_id, count(*) AS n, CAST(sum(count_5) AS DOUBLE) AS total, avg(least(greatest(drive_advantage, 0e0), 1e0)) AS advantage, stddev_pop(percentile) AS sd, avg(percentile) AS mean FROM t_base GROUP BY point_id)""",
    "acc_16_modal": """
SELECT point_id, dest_type, round((mw + md) / 2e0, 6) AS mean_near, round(abs(mw - md) / 2e0, 6) AS sd_near, n10, round(abs(mw - md), 6) AS gap, round(CASE WHEN md <= 0e0 THEN 1e0 ELSE mw / md END, 6) AS ratio FROM (
 SELECT point_id, dest_type, min(walk_time) AS mw, min(drive_time) AS md, count_if(least(drive_time, walk_time) <= 10e0) AS n10 FROM t_od GROUP BY point_id, dest_type)""",
    "acc_17_modal_fallback": "SELECT point_id, dest_type, round(CASE WHEN drive_advantage >= 1e0 THEN 5e0 * min_time ELSE min_time / (1e0 - drive_advantage + 1e-8) END, 6) AS walk_min FROM t_base",
    "acc_18_mode_summary": "SELECT p.point_id, round(coalesce(min(CASE WHEN o.drive_time > 0e0 THEN o.drive_time END), 120e0), 6) AS drive, round(coalesce(min(CASE WHEN o.walk_time > 0e0 THEN o.walk_time END), 120e0), 6) AS walk FROM t_point p LEFT JOIN t_od o ON p.point_id = o.point_id AND o.km < 3e0 GROUP BY p.point_id",
    "acc_19_euclidean_features": """
SELECT point_id, round(min(km), 6) AS d1, round(avg(km), 6) AS mean_km, round(median(km), 6) AS median_km, round(stddev_pop(km), 6) AS sd_km, count_if(km < 1e0) AS n1, count_if(km < 3e0) AS n3, count_if(km < 5e0) AS n5, count_if(km < 10e0) AS n10, round(min(km) / (max(km) + 0.01e0), 6) AS concentration, round(max(km) - min(km), 6) AS range_km
FROM (SELECT point_id, d * 1.11e0 * cos(radians(35e0)) AS km FROM t_near_dest) GROUP BY point_id""",
    "acc_20_distance_selection": """
SELECT point_id, dest_id FROM (SELECT point_id, dest_id, row_number() OVER (PARTITION BY point_id ORDER BY CASE WHEN h < p THEN 0 ELSE 1 END, km, dest_id) AS nth, h < p AS kept FROM (
 SELECT point_id, dest_id, km, CAST((point_id * 7907 + dest_id * 104723) % 1000 AS DOUBLE) / 1000e0 AS h, CASE WHEN km < 2e0 THEN 0.9e0 WHEN km < 5e0 THEN 0.5e0 ELSE 0.1e0 END AS p FROM t_od WHERE dest_type = 'grocery')) WHERE (kept AND nth <= 10) OR nth <= 3""",
    "acc_21_local_destinations": """
SELECT area_id, dest_id FROM (SELECT area_id, dest_id, row_number() OVER (PARTITION BY area_id ORDER BY d2, dest_id) AS nth FROM (
 SELECT l.area_id, min(l.dest_id) AS dest_id, min((l.x - e.cx) * (l.x - e.cx) + (l.y - e.cy) * (l.y - e.cy)) AS d2 FROM (
  SELECT area_id, dest_id, x, y FROM t_local UNION ALL SELECT area_id, -1 - 4 * area_id, x0, cy FROM t_extent UNION ALL SELECT area_id, -2 - 4 * area_id, x1, cy FROM t_extent UNION ALL SELECT area_id, -3 - 4 * area_id, cx, y0 FROM t_extent UNION ALL SELECT area_id, -4 - 4 * area_id, cx, y1 FROM t_extent) l
 JOIN t_extent e ON l.area_id = e.area_id GROUP BY l.area_id, l.x, l.y)) WHERE nth <= 20""",
    "acc_23_feature_matrix": f"""
SELECT p.point_id, round(ar.target, 6) AS target, {", ".join(f"b.{t}_{c}" for t in _TYPES for c in _BASE)}, {", ".join(f"m.{t}_{c}" for t in _TYPES for c in _MODAL)},
 s.total AS social_total, s.orders_n AS social_orders, s.n_f AS social_f, s.n_urgent AS social_urgent, coalesce(s.income, 50000e0) AS social_income, round(CASE WHEN s.orders_n > 0 THEN s.n_f * 100e0 / s.orders_n END, 6) AS social_f_rate, round(CASE WHEN s.orders_n > 0 THEN s.n_urgent * 100e0 / s.orders_n END, 6) AS social_urgent_rate,
 round(CASE WHEN s.total > 0 THEN s.orders_n * 1e0 / s.total END, 6) AS social_density, round(ln(1e0 + coalesce(s.income, 50000e0)), 6) AS social_log_income, round(ln(1e0 + coalesce(g.p_retailprice, 0e0)), 6) AS building_log_area, coalesce(g.p_size, 6) AS building_vertices,
 CASE WHEN g.p_type IN ('ECONOMY', 'STANDARD') THEN 1e0 ELSE 0e0 END AS building_residential,
 round(ln(1e0 + coalesce(g.p_retailprice * g.p_size, 0e0)), 6) AS parcel_log_value, round(coalesce(g.p_retailprice / nullif(g.p_size * 10e0, 0e0), 1e0), 6) AS parcel_ratio, round(ln(1e0 + coalesce(g.p_size / 50e0, 0e0)), 6) AS parcel_log_acres,
 {", ".join(f"CASE WHEN g.p_size * 10 >= {100 * i} AND g.p_size * 10 < {100 * i + 100} THEN 1e0 ELSE 0e0 END AS land_use_{i}" for i in (1, 2, 3))}, CASE WHEN g.p_size IS NULL OR g.p_size * 10 < 100 OR g.p_size * 10 >= 400 THEN 1e0 ELSE 0e0 END AS land_use_other,
 {", ".join(f"CASE WHEN c.c_mktsegment = '{k}' THEN 1e0 ELSE 0e0 END AS type_{k.lower()}" for k in ("BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"))},
 CASE WHEN z.in_sfha THEN 1e0 ELSE 0e0 END AS flood_sfha, {", ".join(f"CASE WHEN z.flood_zone = '{k}' THEN 1e0 ELSE 0e0 END AS flood_{k.lower()}" for k in ("AE", "A", "X"))}
FROM t_point p JOIN t_area ar ON p.area_id = ar.area_id LEFT JOIN ({_pivoted(_BASE, "t_base")}) b ON p.point_id = b.point_id LEFT JOIN ({_pivoted(_MODAL, f"({_MODES})")}) m ON p.point_id = m.point_id
LEFT JOIN t_counts s ON p.subarea_id = s.subarea_id LEFT JOIN t_part g ON p.point_id = g.p_partkey LEFT JOIN t_customer c ON p.point_id = c.c_custkey LEFT JOIN t_zone z ON p.subarea_id = z.zone_id""",
    "acc_24_importance_weights": "SELECT dest_id, round(CASE dest_type WHEN 'employment' THEN 0.2e0 + 0.8e0 * least(1e0, coalesce(employees, 1000) / 5000e0) WHEN 'healthcare' THEN 0.3e0 + 0.7e0 * least(1e0, coalesce(employees % 500, 100) / 400e0) ELSE 0.5e0 END, 6) AS weight FROM t_dest",
}
