"""Logical tables of the engine, built from a star schema: points in areas, destinations, edges, counts, logs.

Statements name their inputs with the prefix t_ and are bound to DataFrames when they run. Numbers are written
with an exponent so that they are doubles in every SQL dialect.
"""

from __future__ import annotations

from .ranks import placed

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents", "embeddings", "pages", "benchmark", "conversations")

def correlation(a: str, b: str) -> str:
    """SQL for a correlation that is null where a side does not vary."""
    return f"CASE WHEN stddev_pop({a}) > 1e-9 AND stddev_pop({b}) > 1e-9 THEN (avg({a} * {b}) - avg({a}) * avg({b})) / (stddev_pop({a}) * stddev_pop({b})) END"


#: Travel times of a pair from its distance in kilometres, and minutes by car of one coordinate unit (6 km).
TIMES = """point_id, dest_id, dest_type, dx, dy, km, km / 5e0 * 60e0 AS walk_time, km / 30e0 * 60e0 AS drive_time,
 CASE WHEN km >= 2e0 AND km <= 15e0 THEN km / 15e0 * 60e0 + 10e0 ELSE km / 5e0 * 60e0 * 1.5e0 END AS transit_time"""
MINUTES = 12.0

VIEWS = {
    # points with a known truth and an ancillary weight, both with gaps; the area is a unit square, the subarea a quadrant
    "point": """
SELECT c_custkey AS point_id, c_nationkey AS area_id,
 c_nationkey * 10 + CASE WHEN u >= 0.5e0 THEN 2 ELSE 0 END + CASE WHEN v >= 0.5e0 THEN 1 ELSE 0 END AS subarea_id,
 CAST(c_nationkey % 5 AS DOUBLE) + u AS x, CAST(CAST(floor(CAST(c_nationkey AS DOUBLE) / 5e0) AS INT) AS DOUBLE) + v AS y,
 CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE (c_acctbal + 1000e0) / 110e0 END AS ancillary,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 0.5e0 * (c_acctbal + 1000e0) / 11000e0 + 0.5e0 * u END AS truth
FROM (SELECT *, CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 10007e0 AS u, CAST((c_custkey * 104729) % 10009 AS DOUBLE) / 10009e0 AS v FROM t_customer)""",
    "area": """
SELECT n.n_nationkey AS area_id, n.n_regionkey AS county_id, t.target, t.n_points,
 CAST(n.n_nationkey % 5 AS DOUBLE) AS minx, CAST(CAST(floor(CAST(n.n_nationkey AS DOUBLE) / 5e0) AS INT) AS DOUBLE) AS miny
FROM t_nation n LEFT JOIN (SELECT area_id, avg(truth) AS target, count(*) AS n_points FROM t_point GROUP BY area_id) t ON n.n_nationkey = t.area_id""",
    "subarea": """
SELECT a.area_id * 10 + 2 * i.i + j.j AS subarea_id, a.area_id, a.minx + 0.5e0 * i.i AS minx, a.miny + 0.5e0 * j.j AS miny
FROM t_area a CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) i CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1) j""",
    # corners of each area, counter-clockwise
    "ring": """
SELECT a.area_id, a.county_id, c.seq, a.minx + c.dx AS x, a.miny + c.dy AS y FROM t_area a CROSS JOIN (SELECT 0 AS seq, 0e0 AS dx, 0e0 AS dy UNION ALL SELECT 1, 1e0, 0e0 UNION ALL SELECT 2, 1e0, 1e0 UNION ALL SELECT 3, 0e0, 1e0) c""",
    "lattice": """
SELECT CAST(ceil(sqrt(CAST(max(p_partkey) + 1 AS DOUBLE))) AS BIGINT) AS w FROM t_part""",
    # rings of polygons: a subarea has a notch in its upper side and a hole; their segments
    "corner": """
SELECT s.subarea_id AS poly_id, s.area_id, c.ring, c.seq, s.minx + c.dx AS x, s.miny + c.dy AS y FROM t_subarea s CROSS JOIN (
 SELECT 0 AS ring, 0 AS seq, 0e0 AS dx, 0e0 AS dy UNION ALL SELECT 0, 1, 0.5e0, 0e0 UNION ALL SELECT 0, 2, 0.5e0, 0.5e0 UNION ALL SELECT 0, 3, 0.3e0, 0.4e0 UNION ALL SELECT 0, 4, 0e0, 0.5e0
 UNION ALL SELECT 1, 0, 0.1e0, 0.1e0 UNION ALL SELECT 1, 1, 0.2e0, 0.1e0 UNION ALL SELECT 1, 2, 0.15e0, 0.2e0) c""",
    "segment": """
SELECT poly_id, area_id, x AS x1, y AS y1, coalesce(lead(x) OVER (PARTITION BY poly_id, ring ORDER BY seq), first_value(x) OVER (PARTITION BY poly_id, ring ORDER BY seq)) AS x2,
 coalesce(lead(y) OVER (PARTITION BY poly_id, ring ORDER BY seq), first_value(y) OVER (PARTITION BY poly_id, ring ORDER BY seq)) AS y2 FROM t_corner""",
    # points inside polygons: the parity of a ray's crossings, so holes and notches count
    "inside": """
SELECT p.point_id, s.poly_id FROM t_point p JOIN (SELECT poly_id, min(x) AS x0, max(x) AS x9, min(y) AS y0, max(y) AS y9 FROM t_corner GROUP BY poly_id) b ON p.x BETWEEN b.x0 AND b.x9 AND p.y BETWEEN b.y0 AND b.y9 JOIN t_segment s ON b.poly_id = s.poly_id
GROUP BY p.point_id, s.poly_id HAVING sum(CASE WHEN (s.y1 > p.y) <> (s.y2 > p.y) AND p.x < (s.x2 - s.x1) * (p.y - s.y1) / nullif(s.y2 - s.y1, 0e0) + s.x1 THEN 1 ELSE 0 END) % 2 = 1""",
    # known points with two allocations, numbered within areas
    "paired": """
SELECT area_id, truth, v1, v2, row_number() OVER (PARTITION BY area_id ORDER BY point_id) - 1 AS i, count(*) OVER (PARTITION BY area_id) AS n FROM (
 SELECT area_id, point_id, min(truth) AS truth, max(CASE WHEN method = 'gradient' THEN value END) AS v1, max(CASE WHEN method = 'dasymetric' THEN value END) AS v2 FROM t_pred WHERE truth IS NOT NULL GROUP BY area_id, point_id)""",
    # bootstrap: in each draw every place of an area takes the row that an md5 of draw, area and place points at
    "boot": f"""
SELECT p.draw, p.area_id, CASE WHEN max(p.n) >= 10 THEN {correlation("r.v1", "r.truth")} END AS r1, CASE WHEN max(p.n) >= 10 THEN {correlation("r.v2", "r.truth")} END AS r2, median(r.truth) AS mid, median(r.v1) - median(r.truth) AS diff
FROM (SELECT d.draw, r.area_id, r.n, CAST(conv(substring(md5(CAST(d.draw AS STRING) || '-' || CAST(r.area_id AS STRING) || '-' || CAST(r.i AS STRING)), 1, 8), 16, 10) AS BIGINT) % r.n AS i FROM t_paired r CROSS JOIN t_draw d WHERE r.n >= 2) p
JOIN t_paired r ON p.area_id = r.area_id AND p.i = r.i GROUP BY p.draw, p.area_id""",
    # neighbour weights, values about their area's mean, and relabellings: within an area, place i takes the value at place i of an md5 order
    "weight": """
SELECT src, dst, area_id, w / sum(w) OVER (PARTITION BY src) AS w FROM (SELECT src, dst, area_id, sum(w) AS w FROM (SELECT src, dst, area_id, 0.5e0 AS w FROM t_near UNION ALL SELECT dst, src, area_id, 0.5e0 FROM t_near) GROUP BY src, dst, area_id)""",
    "centred": """
SELECT point_id, area_id, coalesce(truth, 0.5e0) - avg(coalesce(truth, 0.5e0)) OVER (PARTITION BY area_id) AS z FROM t_point""",
    "permuted": """
SELECT i.draw, i.point_id, i.area_id, v.z FROM (SELECT d.draw, p.point_id, p.area_id, p.nth FROM (SELECT point_id, area_id, row_number() OVER (PARTITION BY area_id ORDER BY point_id) AS nth FROM t_centred) p CROSS JOIN t_shuffle d) i
JOIN (SELECT d.draw, p.area_id, p.z, row_number() OVER (PARTITION BY d.draw, p.area_id ORDER BY md5(CAST(d.draw AS STRING) || '-' || CAST(p.point_id AS STRING))) AS nth FROM t_centred p CROSS JOIN t_shuffle d) v ON i.draw = v.draw AND i.area_id = v.area_id AND i.nth = v.nth""",
    "permuted_top": """
SELECT a.draw, w.area_id, sum(w.w * a.z * b.z) AS top FROM t_weight w JOIN t_permuted a ON w.src = a.point_id JOIN t_permuted b ON w.dst = b.point_id AND a.draw = b.draw GROUP BY w.area_id, a.draw""",
    "local_p": """
SELECT s.point_id, (count_if(abs(s.z * d.lag) >= abs(s.z * s.lag) - 1e-12) + 1e0) / (count(*) + 1e0) AS p FROM (SELECT z.point_id, z.z, l.lag FROM t_centred z JOIN (SELECT w.src, sum(w.w * b.z) AS lag FROM t_weight w JOIN t_centred b ON w.dst = b.point_id GROUP BY w.src) l ON z.point_id = l.src) s
JOIN (SELECT w.src, b.draw, sum(w.w * b.z) AS lag FROM t_weight w JOIN t_permuted b ON w.dst = b.point_id GROUP BY w.src, b.draw) d ON s.point_id = d.src GROUP BY s.point_id""",
    # numbers of bootstrap draws and of permutations
    "draw": """
SELECT explode(sequence(1, $draws)) AS draw""",
    "shuffle": """
SELECT explode(sequence(1, $permutations)) AS draw""",
    # road nodes on a square lattice over the areas, one for each part
    "node": """
SELECT p.p_partkey AS node, CAST(p.p_partkey % g.w AS DOUBLE) * 5e0 / (g.w - 1e0) AS x, CAST(floor(CAST(p.p_partkey AS DOUBLE) / g.w) AS DOUBLE) * 5e0 / (g.w - 1e0) AS y FROM t_part p CROSS JOIN t_lattice g""",
    # the nearest road node of each point
    "snap": """
SELECT point_id, area_id, node, d FROM (SELECT p.point_id, p.area_id, n.node, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) AS d,
 row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y), n.node) AS nth FROM t_point p CROSS JOIN t_node n) WHERE nth = 1""",
    "dest": """
SELECT s_suppkey AS dest_id, CASE s_suppkey % 3 WHEN 0 THEN 'employment' WHEN 1 THEN 'healthcare' ELSE 'grocery' END AS dest_type,
 5e0 * CAST((s_suppkey * 6007 + 13) % 997 AS DOUBLE) / 997e0 AS x, 5e0 * CAST((s_suppkey * 7001 + 29) % 991 AS DOUBLE) / 991e0 AS y,
 CAST(50 + s_suppkey * 37 % 6000 AS BIGINT) AS employees FROM t_supplier""",
    # bounding boxes of areas, and the 20 destinations of each type nearest to their centres, within three extents across
    "extent": """
SELECT area_id, (min(x) + max(x)) / 2e0 AS cx, (min(y) + max(y)) / 2e0 AS cy, greatest(max(x) - min(x), max(y) - min(y)) AS extent, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM t_point GROUP BY area_id""",
    "local": """
SELECT area_id, dest_id, dest_type, x, y FROM (SELECT a.area_id, d.dest_id, d.dest_type, d.x, d.y, a.extent, sqrt((a.cx - d.x) * (a.cx - d.x) + (a.cy - d.y) * (a.cy - d.y)) AS d,
 row_number() OVER (PARTITION BY a.area_id, d.dest_type ORDER BY (a.cx - d.x) * (a.cx - d.x) + (a.cy - d.y) * (a.cy - d.y), d.dest_id) AS nth FROM t_extent a CROSS JOIN t_dest d) WHERE nth <= 20 AND d <= 1.5e0 * extent""",
    "od_all": f"""
SELECT {TIMES} FROM (SELECT p.point_id, d.dest_id, d.dest_type, d.x - p.x AS dx, d.y - p.y AS dy, sqrt((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y)) * 6e0 AS km FROM t_point p CROSS JOIN t_dest d)""",
    # all destinations within reach by car, and the nearest of a type that has none there
    "od": """
SELECT point_id, dest_id, dest_type, dx, dy, km, walk_time, drive_time, transit_time FROM (SELECT *, row_number() OVER (PARTITION BY point_id, dest_type ORDER BY dx * dx + dy * dy, dest_id) AS nth FROM t_od_all) WHERE drive_time <= $reach OR nth = 1""",
    "road": """
SELECT a.node AS src, b.node AS dst, 300e0 + CAST((least(a.node, b.node) * 37 + greatest(a.node, b.node) * 11) % 401 AS DOUBLE) AS length
FROM (SELECT p.p_partkey AS node, step_ AS step, p.p_partkey % g.w AS c, g.w FROM t_part p CROSS JOIN t_lattice g CROSS JOIN (SELECT 0 AS step_ UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)) a
JOIN (SELECT p_partkey AS node FROM t_part) b ON b.node = a.node + CASE a.step WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN a.w ELSE -a.w END AND (a.step > 1 OR a.step = 0 AND a.c < a.w - 1 OR a.step = 1 AND a.c > 0)""",
    "counts": """
SELECT p.subarea_id, min(p.area_id) AS area_id, count(DISTINCT p.point_id) AS total,
 count(o.o_orderkey) AS orders_n, CAST(sum(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_f,
 CAST(sum(CASE WHEN o.o_orderpriority LIKE '1%' THEN 1 ELSE 0 END) AS BIGINT) AS n_urgent,
 CAST(sum(CASE WHEN o.o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_o, CAST(sum(CASE WHEN o.o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS n_p, CAST(sum(CASE WHEN o.o_orderpriority LIKE '2%' THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
 CAST(sum(CASE WHEN o.o_orderpriority LIKE '3%' THEN 1 ELSE 0 END) AS BIGINT) AS n_medium, CAST(sum(CASE WHEN o.o_orderpriority LIKE '4%' OR o.o_orderpriority LIKE '5%' THEN 1 ELSE 0 END) AS BIGINT) AS n_low,
 CAST(sum(CASE WHEN o.o_totalprice < 100000e0 THEN 1 ELSE 0 END) AS BIGINT) AS n_cheap, CAST(sum(CASE WHEN o.o_totalprice >= 200000e0 THEN 1 ELSE 0 END) AS BIGINT) AS n_dear, round(avg(o.o_totalprice), 0) AS income
FROM t_point p LEFT JOIN t_orders o ON o.o_custkey = p.point_id GROUP BY p.subarea_id""",
    # flood zones are the subareas' polygons
    "zone": """
SELECT subarea_id AS zone_id, area_id, CASE WHEN n_f * 2 > orders_n THEN 'AE' WHEN n_urgent * 5 > orders_n THEN 'A' ELSE 'X' END AS flood_zone, n_f * 2 > orders_n AS in_sfha FROM t_counts""",
    "log": """
SELECT ts, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'get' ELSE 'set' END AS operation,
 CASE WHEN user_id % 2 = 0 THEN 'absolute' ELSE 'differential' END AS cache_type, user_id AS cache_key, value > 10e0 AS hit, value, props FROM t_events""",
    # allocations by several methods, long
    "pred": """
SELECT 'naive' AS method, p.point_id, p.area_id, p.subarea_id, p.x, p.y, p.truth, a.target, a.target AS value FROM t_point p JOIN t_area a ON p.area_id = a.area_id
UNION ALL
SELECT 'dasymetric', point_id, area_id, subarea_id, x, y, truth, target,
 least(greatest(CASE WHEN hi - lo < 1e-9 OR total < 1e-9 THEN target ELSE target + least((1e0 - target) / hi, target / abs(lo)) * dev END, 0e0), 1e0)
FROM (SELECT *, max(dev) OVER (PARTITION BY area_id) hi, min(dev) OVER (PARTITION BY area_id) lo, sum(w) OVER (PARTITION BY area_id) total
 FROM (SELECT p.*, a.target, coalesce(p.ancillary, 0e0) AS w, coalesce(p.ancillary, 0e0) - avg(coalesce(p.ancillary, 0e0)) OVER (PARTITION BY p.area_id) AS dev FROM t_point p JOIN t_area a ON p.area_id = a.area_id))
UNION ALL
SELECT 'gradient', p.point_id, p.area_id, p.subarea_id, p.x, p.y, p.truth, a.target, least(greatest(a.target + 0.4e0 * (p.x - a.minx - 0.5e0), 0e0), 1e0) FROM t_point p JOIN t_area a ON p.area_id = a.area_id""",
    # features of points, long
    "feature": """
SELECT area_id, point_id, 'ancillary' AS feature, coalesce(ancillary, 0e0) AS value FROM t_point
UNION ALL SELECT area_id, point_id, 'east', x FROM t_point
UNION ALL SELECT area_id, point_id, 'north', y FROM t_point
UNION ALL SELECT area_id, point_id, 'block_count', CAST(point_id % 7 AS DOUBLE) FROM t_point
UNION ALL SELECT area_id, point_id, 'flat', 1e0 FROM t_point""",
    # accessibility of each point by destination type
    "access": """
SELECT point_id, dest_type, min(drive_time) AS min_time, avg(drive_time) AS mean_time, median(drive_time) AS median_time, count_if(drive_time <= 5e0) AS count_5, count_if(drive_time <= 10e0) AS count_10, count_if(drive_time <= 15e0) AS count_15,
 percentile_cont(0.9) WITHIN GROUP (ORDER BY drive_time) AS p90, avg(transit_time) AS mean_transit, least(greatest((avg(walk_time) - avg(drive_time)) / avg(walk_time), -0.2e0), 1e0) AS drive_advantage,
 CASE WHEN count(*) < 2 THEN 0e0 ELSE least(stddev_pop(drive_time) / (avg(drive_time) + 1e-8), 1e0) END AS dispersion, CASE WHEN count(*) < 2 THEN 0e0 ELSE least((max(drive_time) - min(drive_time)) / (avg(drive_time) + 1e-8), 2e0) END AS time_range FROM t_od GROUP BY point_id, dest_type""",
    # the ten base features, with the strict percentile of the mean time among all points
    "base": f"""
SELECT point_id, dest_type, min_time, mean_time, median_time, count_5, count_10, count_15, p90, mean_transit, drive_advantage, dispersion, time_range, CAST(below AS DOUBLE) / n AS percentile FROM ({placed("t_access", "round(mean_time, 6)", "dest_type")})""",
    "near_dest": """
SELECT point_id, dest_id, d, nth FROM (SELECT p.point_id, d.dest_id, sqrt((p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y)) AS d,
 row_number() OVER (PARTITION BY p.point_id ORDER BY (p.x - d.x) * (p.x - d.x) + (p.y - d.y) * (p.y - d.y), d.dest_id) AS nth FROM t_point p CROSS JOIN t_dest d) WHERE nth <= 20""",
    "near16": """
SELECT src, dst, area_id, d, nth FROM (SELECT a.point_id AS src, b.point_id AS dst, a.area_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
 row_number() OVER (PARTITION BY a.point_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.point_id) AS nth
 FROM t_point a JOIN t_point b ON a.area_id = b.area_id AND a.point_id <> b.point_id) WHERE nth <= 16""",
    # the sixteen and the eight nearest points of the own area
    "near": """
SELECT src, dst, area_id, d, nth FROM t_near16 WHERE nth <= 8""",
    # all pairs of an area's points no further apart than the median distance to the eighth nearest point
    "band": """
SELECT src, dst, area_id, d FROM (SELECT a.point_id AS src, b.point_id AS dst, a.area_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM t_point a JOIN t_point b ON a.area_id = b.area_id AND a.point_id <> b.point_id) CROSS JOIN t_band_width WHERE d <= cut""",
    # pairs of a subarea's points whose truths lie $gap or more apart: how many, in how many the allocations stand in the same order, and by how much they miss it
    "ordered": """
SELECT a.method, a.area_id, a.subarea_id, count(*) AS pairs, count_if(b.value > a.value) AS higher, sum(greatest(0e0, 0.02e0 - (b.value - a.value))) AS hinge FROM t_pred a JOIN t_pred b ON a.method = b.method AND a.area_id = b.area_id AND a.subarea_id = b.subarea_id AND b.truth - a.truth >= $gap GROUP BY a.method, a.area_id, a.subarea_id""",
    # recovery of the truth by area and method
    "metric": """
SELECT method, area_id, min(target) AS target, count(*) AS n, CASE WHEN stddev_pop(value) > 1e-9 AND stddev_pop(truth) > 1e-9 THEN (avg(value * truth) - avg(value) * avg(truth)) / (stddev_pop(value) * stddev_pop(truth)) END AS r, sqrt(avg((value - truth) * (value - truth))) AS rmse, avg(abs(value - truth)) AS mae, stddev_pop(value) AS sd,
 abs(avg(value) - min(target)) AS gap FROM t_pred WHERE truth IS NOT NULL GROUP BY method, area_id""",
    # buildings with gaps; distances of allocated points from their area's centre; access of points; times of all modes
    "building": """
SELECT p_partkey, p_retailprice AS area, CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS vertices, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / (p_size * 10e0) END AS ratio, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 50e0 END AS acres, p_type FROM t_part""",
    "centre": """
SELECT value, sqrt((x - avg(x) OVER (PARTITION BY area_id)) * (x - avg(x) OVER (PARTITION BY area_id)) + (y - avg(y) OVER (PARTITION BY area_id)) * (y - avg(y) OVER (PARTITION BY area_id))) AS d FROM t_pred WHERE method = 'gradient'""",
    "reached": """
SELECT p.point_id, min(p.truth) AS truth, avg(1e0 / (1e0 + a.mean_time)) AS m FROM t_point p JOIN t_access a ON p.point_id = a.point_id GROUP BY p.point_id""",
    "times": """
SELECT 'walk' AS mode, km, walk_time AS v FROM t_od UNION ALL SELECT 'drive', km, drive_time FROM t_od UNION ALL SELECT 'transit', km, transit_time FROM t_od""",
    # test data with gaps, as their operators expect them: area targets missing or negative, areas without property values, two chunks of
    # columns for different keys, land-use codes, values that are not finite, blank group keys, features of two runs, trials done before
    "gap_target": "SELECT area_id, CASE WHEN area_id % 7 = 0 THEN -1e0 ELSE target END AS target FROM t_area WHERE area_id % 5 <> 0",
    "property": "SELECT area_id, point_id, CASE WHEN area_id % 9 = 0 THEN NULL ELSE ancillary END AS value FROM t_point",
    "chunk_1": "SELECT '9' || substring(CAST(10000000 + l_partkey AS STRING), 2, 7) AS k, CAST(sum(l_quantity) AS BIGINT) AS v FROM t_lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1",
    "chunk_2": "SELECT '9' || substring(CAST(10000000 + p_partkey AS STRING), 2, 7) AS k, CAST(p_size AS BIGINT) AS v FROM t_part WHERE p_partkey % 2 = 0",
    "land_use": "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size * 10 END AS code FROM t_part",
    "non_finite": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE p_retailprice END AS v FROM t_part",
    "parcel_group": "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN '  ' ELSE 'g' || CAST(s_nationkey AS STRING) END AS group_key FROM t_supplier",
    "set_1": "SELECT p_name AS f, CASE WHEN avg(CAST(p_size AS DOUBLE)) > 25e0 THEN 1 ELSE -1 END AS s FROM t_part WHERE p_partkey % 3 = 0 GROUP BY p_name",
    "set_2": "SELECT p_name AS f, CASE WHEN avg(CAST(p_size AS DOUBLE)) > 24e0 THEN 1 ELSE -1 END AS s FROM t_part WHERE p_partkey % 5 = 0 GROUP BY p_name",
    "done_trial": "SELECT 'naive' AS method, n_nationkey AS area_id FROM t_nation WHERE n_nationkey % 2 = 0",
    "listed_area": "SELECT ' ' || CAST(area_id AS STRING) || ' ' AS area_key FROM t_area WHERE area_id % 2 = 0",
    # areas split into training and test by a hash; predictions of a line fitted to the points of all training areas
    "split": """
SELECT area_id, CASE WHEN CAST(conv(substring(md5('part-' || CAST(area_id AS STRING)), 1, 8), 16, 10) AS BIGINT) % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM t_area""",
    "raw": """
SELECT p.point_id, p.area_id, s.part, p.truth, a.target, f.a + f.b * coalesce(p.ancillary, 0e0) / 100e0 AS value FROM t_point p JOIN t_split s ON p.area_id = s.area_id JOIN t_area a ON p.area_id = a.area_id CROSS JOIN (
 SELECT regr_slope(q.truth, coalesce(q.ancillary, 0e0) / 100e0) AS b, regr_intercept(q.truth, coalesce(q.ancillary, 0e0) / 100e0) AS a FROM t_point q JOIN t_split t ON q.area_id = t.area_id WHERE t.part = 'train' AND q.truth IS NOT NULL) f""",
    # repeated runs: in each a line is fitted to a random half of an area's points, and its values keep the area's mean; metrics by area
    "seed": """
SELECT 42 AS seed UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4""",
    "sampled": """
SELECT d.seed, d.point_id, d.area_id, d.truth, a.target, least(greatest(a.target + d.v - avg(d.v) OVER (PARTITION BY d.seed, d.area_id), 0e0), 1e0) AS value FROM (SELECT f.seed, p.point_id, p.area_id, p.truth, coalesce(f.a + f.b * coalesce(p.ancillary, 0e0) / 100e0, f.m) AS v FROM t_point p JOIN (
 SELECT s.seed, q.area_id, regr_slope(q.truth, coalesce(q.ancillary, 0e0) / 100e0) AS b, regr_intercept(q.truth, coalesce(q.ancillary, 0e0) / 100e0) AS a, avg(q.truth) AS m FROM t_point q CROSS JOIN t_seed s WHERE q.truth IS NOT NULL
  AND CAST(conv(substring(md5(CAST(s.seed AS STRING) || '-' || CAST(q.point_id AS STRING)), 1, 8), 16, 10) AS BIGINT) % 2 = 0 GROUP BY s.seed, q.area_id) f ON p.area_id = f.area_id) d JOIN t_area a ON d.area_id = a.area_id""",
    "run": f"""
SELECT seed, area_id, {correlation("value", "truth")} AS r, sqrt(avg((value - truth) * (value - truth))) AS rmse, 100e0 * abs(avg(value) - min(target)) / min(target) AS gap_pct, stddev_pop(value) AS sd FROM t_sampled WHERE truth IS NOT NULL GROUP BY seed, area_id""",
    "ledger": " UNION ALL ".join(f"SELECT 'seed-' || CAST(seed AS STRING) AS run, seed, area_id, '{m}' AS metric, {m} AS value FROM t_run" for m in ("r", "rmse", "gap_pct", "sd")),
    # growth of a line's squared error in an area when the feature's values change places in an md5 order
    "importance": """
SELECT o.feature, o.area_id, avg((o.y - f.a - f.b * m.v) * (o.y - f.a - f.b * m.v)) - avg((o.y - f.a - f.b * o.v) * (o.y - f.a - f.b * o.v)) AS loss FROM t_shuffled o JOIN t_shuffled m ON o.feature = m.feature AND o.area_id = m.area_id AND o.i = m.j
JOIN (SELECT feature, area_id, regr_slope(y, v) AS b, regr_intercept(y, v) AS a FROM t_shuffled GROUP BY feature, area_id) f ON o.feature = f.feature AND o.area_id = f.area_id GROUP BY o.feature, o.area_id""",
    "shuffled": """
SELECT f.feature, f.area_id, p.truth AS y, f.value AS v, row_number() OVER (PARTITION BY f.feature, f.area_id ORDER BY f.point_id) AS i, row_number() OVER (PARTITION BY f.feature, f.area_id ORDER BY md5(f.feature || '-' || CAST(f.point_id AS STRING)), f.point_id) AS j
FROM t_feature f JOIN t_point p ON f.point_id = p.point_id WHERE p.truth IS NOT NULL AND f.feature <> 'flat'""",
    # rank correlations of signal-bearing features with the truth in areas with enough points
    "rho": """
SELECT area_id, feature, corr(rv, rt) AS rho FROM (SELECT area_id, feature, rank() OVER (PARTITION BY area_id, feature ORDER BY value) + (count(*) OVER (PARTITION BY area_id, feature, value) - 1) / 2e0 AS rv, rank() OVER (PARTITION BY area_id, feature ORDER BY truth) + (count(*) OVER (PARTITION BY area_id, feature, truth) - 1) / 2e0 AS rt FROM (
 SELECT f.*, p.truth FROM t_feature f JOIN t_point p ON f.point_id = p.point_id JOIN (SELECT area_id, feature FROM t_feature GROUP BY area_id, feature HAVING stddev_pop(value) >= 1e-10 AND (abs(avg(value)) < 1e-8 OR stddev_pop(value) / abs(avg(value)) >= 0.05e0)) s
  ON f.area_id = s.area_id AND f.feature = s.feature WHERE p.truth IS NOT NULL)) GROUP BY area_id, feature HAVING count(*) >= $complete_points""",
    # allocated values about their area's mean, and uniform noise for comparison
    "centred_pred": """
SELECT point_id, area_id, value - avg(value) OVER (PARTITION BY area_id) AS z FROM t_pred WHERE method = 'gradient'""",
    "noise": """
SELECT point_id, area_id, u - avg(u) OVER (PARTITION BY area_id) AS z FROM (SELECT point_id, area_id, CAST(CAST(conv(substring(md5('noise-' || CAST(point_id AS STRING)), 1, 8), 16, 10) AS BIGINT) AS DOUBLE) / 4294967296e0 AS u FROM t_point)""",
}

VIEWS["permuted_pred"] = VIEWS["permuted"].replace("t_centred", "t_centred_pred")
VIEWS["permuted_pred_top"] = VIEWS["permuted_top"].replace("t_permuted", "t_permuted_pred")

#: Percentiles of large columns: rows (g, v), and the wanted ones by name; a table has a row (g, name, ...) for each g.
QUANTILES = {
    "band_width": ("SELECT 0 AS g, max(d) AS v FROM t_near GROUP BY src", {"cut": 0.5}),
    "cut_ancillary": ("SELECT 0 AS g, ancillary AS v FROM t_point", {"lo": 0.33, "hi": 0.67}),
    "cut_centre": ("SELECT 0 AS g, d AS v FROM t_centre", {"p33": 0.33, "p67": 0.67}),
    "cut_vertices": ("SELECT 0 AS g, vertices AS v FROM t_building", {"v": 0.5}),
    "cut_ratio": ("SELECT 0 AS g, ratio AS v FROM t_building", {"r": 0.5}),
    "cut_reached": ("SELECT 0 AS g, m AS v FROM t_reached", {"q1": 0.3333, "q2": 0.6667}),
    "quartile": ("SELECT feature AS g, value AS v FROM t_feature WHERE CAST(conv(substring(md5('split-' || CAST(area_id AS STRING)), 1, 8), 16, 10) AS BIGINT) % 5 <> 0", {"q1": 0.25, "q2": 0.5, "q3": 0.75}),
    "time_quartile": ("SELECT mode AS g, v FROM t_times", {"q1": 0.25, "q3": 0.75}),
}
for _name, (_source, _wanted) in QUANTILES.items():
    VIEWS[_name] = f"SELECT g, {', '.join(f'percentile_cont({f}) WITHIN GROUP (ORDER BY v) AS {n}' for n, f in _wanted.items())} FROM ({_source}) GROUP BY g"
