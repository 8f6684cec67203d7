"""Queries over detections, sites and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scoring as S
from ..operators import components, spatial, tracks
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


_IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"""
_PAIRS = f"""pairs AS (SELECT class_name, a.event_id AS a, b.event_id AS b, i / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i) AS iou, a.confidence AS ca, b.confidence AS cb
  FROM (SELECT a, b, class_name, {_IOU} AS i FROM det a JOIN det b USING (class_name) WHERE a.event_id < b.event_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2))"""


@query("box_iou_pairs", f"WITH {A.DETECTIONS_SQL}, {_PAIRS} SELECT class_name, a, b, round(iou, 6) AS iou FROM pairs")
def box_iou_pairs(spark, sf_dir):
    return spatial.box_pairs(A.detections(spark, sf_dir), "event_id", 64.0, ("class_name",)).withColumn("iou", F.round("iou", 6))


def _greedy_sql(group: str, order: str, conflict: str, out: str) -> str:
    """The greedy scan in SQL. Boxes stand on a 40 m lattice with sides below 12 m, so only those
    of one corner overlap; a recursion walks each corner's boxes in order with the sides kept."""
    return f"""WITH RECURSIVE {A.DETECTIONS_SQL}, r AS (SELECT *, x2 - x1 AS side, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS i FROM det),
k AS (SELECT r.*, [side] AS kept, true AS ok FROM r WHERE i = 1
  UNION ALL SELECT r.*, CASE WHEN len(list_filter(k.kept, lambda s: {conflict})) = 0 THEN list_append(k.kept, r.side) ELSE k.kept END, len(list_filter(k.kept, lambda s: {conflict})) = 0
  FROM k JOIN r ON r.i = k.i + 1 AND {' AND '.join(f'r.{g} = k.{g}' for g in group.split(', '))})
SELECT {out} FROM k WHERE ok"""


_SIDES = "least(s, r.side) * least(s, r.side) / (greatest(s, r.side) * greatest(s, r.side))"


@query("nms", _greedy_sql("class_name, x1, y1", "confidence DESC, event_id", f"{_SIDES} > 0.45", "event_id, class_name, round(confidence, 6) AS confidence"))
def nms(spark, sf_dir):
    return spatial.nms(A.detections(spark, sf_dir), "event_id", "confidence", 0.45, 64.0, ("class_name",)).select("event_id", "class_name", F.round("confidence", 6).alias("confidence"))


@query("iou_dedup", _greedy_sql("x1, y1", "area DESC, event_id", f"{_SIDES} >= 0.5", "event_id, class_name, area"))
def iou_dedup(spark, sf_dir):
    d = A.detections(spark, sf_dir).withColumn("area", G.box_area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return spatial.dedup_by_area(d, "event_id", "area").select("event_id", "class_name", "area")


@query("nearest_within", f"""WITH {A.SITES_SQL}, {A.MACHINES_SQL}, d AS (SELECT site, machine, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS distance FROM site, machine)
SELECT site, machine, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY distance, machine) AS n FROM d WHERE distance <= 400) WHERE n = 1""")
def nearest_within(spark, sf_dir):
    out = spatial.nearest(A.sites(spark, sf_dir), A.machines(spark, sf_dir), "site", "machine", ("x", "y"), ("mx", "my"), 400.0)
    return out.select("site", "machine", F.round("distance", 6).alias("distance"))


#: Machines within 500 m of a site's outline: of the nearer of its two bars.
_NEAR = f"""{A.squares_sql()}, met AS (SELECT DISTINCT site, machine, class_name FROM bar JOIN machine ON greatest(0, bx1 - mx, mx - bx2) ** 2 + greatest(0, by1 - my, my - by2) ** 2 <= 250000),
near AS (SELECT site, count(*) AS total, count(*) FILTER (WHERE class_name IN ('excavator', 'truck', 'water_pump')) AS active, count(*) FILTER (WHERE class_name IN ('settling_pond', 'pit')) AS infra,
  string_agg(class_name, ',' ORDER BY class_name) AS types FROM met GROUP BY 1)"""


@query("buffer_join", f"""WITH {A.SITES_SQL}, {A.MACHINES_SQL}, {_NEAR} SELECT site, coalesce(total, 0) AS equipment_total, coalesce(active, 0) AS active_equipment_count, coalesce(infra, 0) AS infrastructure_count, coalesce(types, '') AS equipment_types
FROM site LEFT JOIN near USING (site)""")
def buffer_join(spark, sf_dir):
    out = spatial.equipment_near_cells(A.sites(spark, sf_dir), A.site_squares(spark, sf_dir), A.machines(spark, sf_dir), "site", ("mx", "my"), 10.0, 500.0)
    types = F.array_join(F.transform("equipment_counts", lambda k: F.concat(k["class_name"], F.repeat(F.concat(F.lit(","), k["class_name"]), k["n"].cast("int") - 1))), ",")
    return out.select("site", "equipment_total", "active_equipment_count", "infrastructure_count", types.alias("equipment_types"))


_FUSED = f"""{A.SITES_SQL}, {A.MACHINES_SQL}, {_NEAR}, f AS (SELECT site.*, coalesce(total, 0) AS t, coalesce(active, 0) AS a, coalesce(infra, 0) AS i FROM site LEFT JOIN near USING (site)),
fused AS (SELECT *, CASE WHEN a >= 2 THEN 'ACTIVE' WHEN a = 1 OR (a = 0 AND i >= 1 AND confidence >= 0.5) THEN 'LIKELY_ACTIVE' WHEN i >= 1 OR confidence >= 0.6 THEN 'INACTIVE_INFRASTRUCTURE' ELSE 'UNKNOWN' END AS activity_fused,
  CASE WHEN t = 0 THEN confidence ELSE round(CASE WHEN a >= 1 THEN least(1, 0.6 * confidence + 0.4 * least(1, t / 3) + 0.05 * a) ELSE 0.6 * confidence + 0.4 * least(1, t / 3) END, 4) END AS confidence_fused FROM f)"""


def _fused(spark, sf_dir):
    s = spatial.equipment_near_cells(A.sites(spark, sf_dir), A.site_squares(spark, sf_dir), A.machines(spark, sf_dir), "site", ("mx", "my"), 10.0, 500.0)
    a, i, t, c = (F.col(n) for n in ("active_equipment_count", "infrastructure_count", "equipment_total", "confidence"))
    return s.withColumns({"activity_fused": S.activity_fused(a, i, c), "confidence_fused": S.confidence_fused(c, t, a)})


@query("fused_confidence_activity", f"WITH {_FUSED} SELECT site, activity_fused, round(confidence_fused, 4) AS confidence_fused FROM fused")
def fused_confidence_activity(spark, sf_dir):
    return _fused(spark, sf_dir).select("site", "activity_fused", F.round("confidence_fused", 4).alias("confidence_fused"))


def _priority_sql(source: str, equipment: str, confidence: str, activity: str) -> str:
    """Weights as the default configuration names them: area 0.30, equipment 0.25, water proximity
    0.20, confidence 0.15, activity 0.10."""
    return f"""sc AS (SELECT *, min(ln(1 + area_m2)) OVER (PARTITION BY date) AS lo, max(ln(1 + area_m2)) OVER (PARTITION BY date) AS hi FROM {source}),
p AS (SELECT *, round(0.3 * (CASE WHEN hi = lo THEN 1 ELSE (ln(1 + area_m2) - lo) / (hi - lo + 1e-8) END) + 0.25 / (1 + exp(-({equipment} - 1))) + 0.2 * water_proximity + 0.15 * {confidence} + 0.1 * ({activity}), 6) AS priority_score FROM sc)
SELECT site, date, priority_score, row_number() OVER (PARTITION BY date ORDER BY priority_score DESC, site)::INTEGER AS priority_rank FROM p"""


@query("priority_rank", f"WITH {A.SITES_SQL}, s AS (SELECT *, CASE WHEN equipment_count > 0 THEN 1.0 ELSE 0.2 END AS act FROM site), {_priority_sql('s', 'equipment_count', 'confidence', 'act')}")
def priority_rank(spark, sf_dir):
    s = A.sites(spark, sf_dir)
    s = s.withColumn("activity", S.activity_from_count(F.col("equipment_count"), F.col("confidence")))
    return S.priority(s, "date", "site").select("site", "date", "priority_score", "priority_rank")


@query("fused_priority_rank", f"""WITH {_FUSED}, {_priority_sql('fused', 'a', 'confidence_fused', "CASE activity_fused WHEN 'ACTIVE' THEN 1.0 WHEN 'LIKELY_ACTIVE' THEN 0.7 WHEN 'INACTIVE_INFRASTRUCTURE' THEN 0.4 ELSE 0.5 END")}""")
def fused_priority_rank(spark, sf_dir):
    s = S.priority(_fused(spark, sf_dir), "date", "site", equipment="active_equipment_count", confidence="confidence_fused", activity="activity_fused", scores=S.ACTIVITY_FUSED)
    return s.select("site", "date", "priority_score", "priority_rank")


@query("date_summary", f"""WITH {A.SITES_SQL}, s AS (SELECT *, CASE WHEN equipment_count > 0 THEN 1.0 ELSE 0.2 END AS act FROM site), r AS ({'WITH ' + _priority_sql('s', 'equipment_count', 'confidence', 'act')})
SELECT date, count(*) AS sites, round(sum(round(area_m2 / 10000, 4)), 2) AS area_ha, count(*) FILTER (WHERE confidence >= 0.7) AS tier_high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.7) AS tier_medium,
  count(*) FILTER (WHERE confidence < 0.5) AS tier_low, count(*) FILTER (WHERE equipment_count > 0) AS active, 'SAT_' || date || '_' || lpad(arg_min(site, priority_rank)::VARCHAR, 4, '0') AS top_site FROM s JOIN r USING (site, date) GROUP BY date""")
def date_summary(spark, sf_dir):
    from ..operators.metrics import date_summary as summarise

    s = A.sites(spark, sf_dir).withColumn("activity", S.activity_from_count(F.col("equipment_count"), F.col("confidence")))
    s = S.priority(s, "date", "site").withColumns({"area_ha": S.hectares(F.col("area_m2")), "confidence_tier": S.tier(F.col("confidence"))})
    return summarise(s.withColumn("site_id", S.site_id("SAT", F.col("date"), F.col("site"))))


@query("centre_join", f"""WITH {A.SITES_SQL}, {A.MACHINES_SQL}, met AS (SELECT site, count(*) AS n FROM site JOIN machine ON (x - mx) ** 2 + (y - my) ** 2 <= 250000 GROUP BY 1)
SELECT site, coalesce(n, 0) AS equipment_total FROM site LEFT JOIN met USING (site)""")
def centre_join(spark, sf_dir):
    return spatial.equipment_near(A.sites(spark, sf_dir), A.machines(spark, sf_dir), "site", ("x", "y"), ("mx", "my"), 500.0).select("site", "equipment_total")


@query("detections_in_sites", f"""WITH {A.SITES_SQL}, {A.DETECTIONS_SQL}, {A.squares_sql(100)}
, met AS (SELECT DISTINCT site, event_id FROM bar JOIN det ON x1 >= bx1 AND y1 >= by1 AND x2 <= bx2 AND y2 <= by2)
SELECT site, count(event_id) AS n, CASE WHEN count(event_id) > 0 THEN 'ACTIVE' ELSE 'INACTIVE' END AS activity FROM site LEFT JOIN met USING (site) GROUP BY 1""")
def detections_in_sites(spark, sf_dir):
    n = spatial.boxes_within_cells(A.sites(spark, sf_dir), A.site_squares(spark, sf_dir, 100.0), A.detections(spark, sf_dir), "site", 100.0)
    return n.withColumn("activity", S.activity_from_count(F.col("n"), F.lit(0.0)))


@query("points_in_tiles", f"""WITH {A.MACHINES_SQL}, r AS (SELECT DISTINCT greatest(0, least(i * 1600 + 2000, 10010) - 2000) AS s FROM generate_series(0, 10) g(i) WHERE i * 1600 < 10010)
SELECT machine, a.s AS row_start, b.s AS col_start, round((mx - b.s) / 2000, 6) AS cx, round((my - a.s) / 2000, 6) AS cy FROM machine, r a, r b WHERE my >= a.s AND my < a.s + 2000 AND mx >= b.s AND mx < b.s + 2000""")
def points_in_tiles(spark, sf_dir):
    from ..operators.tiles import tile_grid_for

    m = A.machines(spark, sf_dir).select("machine", F.col("my").alias("row"), F.col("mx").alias("col"))
    out = spatial.points_in_tiles(m, tile_grid_for(spark, 10010, 10010, 2000, 0.2), 1600)
    return out.select("machine", F.col("row_start").cast("long").alias("row_start"), F.col("col_start").cast("long").alias("col_start"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query("point_in_boundary", f"""WITH {A.SITES_SQL}, ring AS (SELECT [1000.0, 9000.0, 8000.0, 3000.0, 1000.0] AS xs, [1000.0, 2000.0, 9500.0, 8000.0, 1000.0] AS ys),
e AS (SELECT site, x, y, xs[i] AS x1, ys[i] AS y1, xs[i + 1] AS x2, ys[i + 1] AS y2 FROM site, ring, generate_series(1, 4) g(i))
SELECT site FROM e GROUP BY site HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1""")
def point_in_boundary(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((1000, 1000), (9000, 2000), (8000, 9500), (3000, 8000), (1000, 1000))])
    s = A.sites(spark, sf_dir).where("x between 1000 and 9000 and y between 1000 and 9500")
    return s.where(G.point_in_ring(F.col("x"), F.col("y"), ring)).select("site")


@query("point_samples", f"""WITH {A.SITES_SQL}, {A.PIXELS_SQL}, s AS (SELECT site, x, y, site % (SELECT count(*) FROM embeddings) AS vec_id FROM site)
SELECT site, round(v, 6) AS v FROM s JOIN px ON px.vec_id = s.vec_id AND row = least(7, greatest(0, trunc(y / 1200 - 0.2)::INTEGER)) AND col = least(7, greatest(0, trunc(x / 1200)::INTEGER))""")
def point_samples(spark, sf_dir):
    from ..operators.pixels import sample_at

    px = A.patch_pixels(spark, sf_dir)
    n = A.read(spark, sf_dir, "embeddings").count()
    s = A.sites(spark, sf_dir).select("site", (F.col("site") % n).alias("vec_id"), (F.col("y") / 1200 - 0.2).alias("row"), (F.col("x") / 1200).alias("col"))
    return sample_at(s, px, 8, 8, keys=("vec_id",)).select("site", F.round("v", 6).alias("v"))


@query("offset_consensus", f"""WITH {A.SITES_SQL}, p AS (SELECT site AS pair_id, 12 + site % 13 AS sdx, -7 + site % 11 AS sdy FROM site), u AS (SELECT sdx, sdy, count(*) AS k, min(pair_id) AS pair_id FROM p GROUP BY ALL),
n AS (SELECT a.pair_id, sum(b.k)::BIGINT AS inliers, sum(b.k * b.sdx) / sum(b.k) AS dx, sum(b.k * b.sdy) / sum(b.k) AS dy FROM u a JOIN u b ON (a.sdx - b.sdx) ** 2 + (a.sdy - b.sdy) ** 2 <= 16 GROUP BY 1)
SELECT round(dx, 6) AS dx, round(dy, 6) AS dy, inliers FROM n ORDER BY inliers DESC, pair_id LIMIT 1""")
def offset_consensus(spark, sf_dir):
    p = A.sites(spark, sf_dir).select(F.col("site").alias("pair_id"), (12.0 + F.col("site") % 13).alias("sdx"), (-7.0 + F.col("site") % 11).alias("sdy"))
    return spatial.offset_consensus(p, 4.0).withColumns({"dx": F.round("dx", 6), "dy": F.round("dy", 6)})


_UTM = """u AS (SELECT site, -1.5 + x / 10000 AS lon, 5.0 + y / 8000 AS lat FROM site), z AS (SELECT *, 32600 + floor((lon + 180) / 6)::INTEGER + 1 AS epsg FROM u)"""


@query("utm_forward", f"""WITH {A.SITES_SQL}, {_UTM}, c AS (SELECT *, 0.00167922038638370::DOUBLE AS n, radians(lat) AS phi, radians(lon) - radians((epsg % 100) * 6 - 183) AS lam FROM z),
t AS (SELECT *, 2 * sqrt(n) / (1 + n) AS e, sin(phi) AS s FROM c), u2 AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM t), v AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM u2),
k AS (SELECT *, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 0.9996::DOUBLE * 6378137.0::DOUBLE / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS r FROM v)
SELECT site, epsg, round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS easting,
  round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS northing FROM k""")
def utm_forward(spark, sf_dir):
    u = A.sites(spark, sf_dir).select("site", (-1.5 + F.col("x") / 10000).alias("lon"), (5.0 + F.col("y") / 8000).alias("lat"))
    u = u.withColumn("epsg", G.utm_epsg(F.col("lat"), F.col("lon")))
    e, n = G.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    return u.select("site", "epsg", F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


@query("affine_georef", f"""WITH {A.DETECTIONS_SQL}, g AS (SELECT event_id, -1.21 + x1 * 5e-7 AS ax, 6.2 - y1 * 5e-7 AS ay, -1.21 + x2 * 5e-7 AS bx, 6.2 - y2 * 5e-7 AS b_y FROM det)
SELECT event_id, round(least(ax, bx), 8) AS min_x, round(greatest(ax, bx), 8) AS max_x, round(least(ay, b_y), 8) AS min_y, round(greatest(ay, b_y), 8) AS max_y FROM g""")
def affine_georef(spark, sf_dir):
    d = A.detections(spark, sf_dir)
    t = tuple(F.lit(v) for v in (5e-7, 0.0, -1.21, 0.0, -5e-7, 6.2))
    b = G.box_bounds([G.pixel_to_map(F.col("x1"), F.col("y1"), t), G.pixel_to_map(F.col("x2"), F.col("y2"), t)])
    return d.select("event_id", *[b[c].alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query("kalman_smooth", f"""WITH RECURSIVE {A.OBSERVATIONS_SQL}, o AS (SELECT track, date, area, row_number() OVER (PARTITION BY track ORDER BY date) AS i FROM obs),
k AS (SELECT track, i, date, area AS x, 0.0::DOUBLE AS v, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS d FROM o WHERE i = 1
  UNION ALL SELECT o.track, o.i, o.date, k.x + k.v + (k.a + 2 * k.b + k.d + 1e-3) / (k.a + 2 * k.b + k.d + 1e-3 + 1e-1) * (o.area - k.x - k.v), k.v + (k.b + k.d) / (k.a + 2 * k.b + k.d + 1e-3 + 1e-1) * (o.area - k.x - k.v),
    (1 - (k.a + 2 * k.b + k.d + 1e-3) / (k.a + 2 * k.b + k.d + 1e-3 + 1e-1)) * (k.a + 2 * k.b + k.d + 1e-3), (1 - (k.a + 2 * k.b + k.d + 1e-3) / (k.a + 2 * k.b + k.d + 1e-3 + 1e-1)) * (k.b + k.d),
    k.d + 1e-3 - (k.b + k.d) / (k.a + 2 * k.b + k.d + 1e-3 + 1e-1) * (k.b + k.d) FROM k JOIN o ON o.track = k.track AND o.i = k.i + 1)
SELECT track, strftime(date, '%Y-%m-%d') AS date, round(x, 5) AS smoothed FROM k""")
def kalman_smooth(spark, sf_dir):
    o = A.observations(spark, sf_dir).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("date", "area"))).alias("o"))
    o = o.withColumn("s", tracks.kalman_smooth(F.transform("o", lambda x: x["area"])))
    z = o.select("track", F.inline(F.arrays_zip(F.transform("o", lambda x: x["date"]).alias("date"), F.col("s").alias("smoothed"))).alias("date", "smoothed"))
    return z.select("track", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("smoothed", 5).alias("smoothed"))


@query("pairwise_robust_slope", f"""WITH {A.OBSERVATIONS_SQL}, o AS (SELECT track, date_diff('day', DATE '1992-01-01', date)::DOUBLE AS d, area AS y, row_number() OVER (PARTITION BY track ORDER BY date, area) AS i FROM obs),
l AS (SELECT a.track, a.i AS ia, b.i AS ib, a.d AS da, a.y AS ya, (b.y - a.y) / (b.d - a.d) AS m FROM o a JOIN o b ON a.track = b.track AND a.i < b.i AND a.d <> b.d),
f AS (SELECT l.track, ia, ib, m, count(*) AS n, count(*) * sum(c.d * c.d) - sum(c.d) ** 2 AS sp, count(*) * sum(c.d * c.y) - sum(c.d) * sum(c.y) AS t FROM l JOIN o c ON c.track = l.track AND abs(c.y - ya - m * (c.d - da)) < 0.05 GROUP BY ALL)
SELECT track, round(CASE WHEN sp > 0 THEN t / sp ELSE m END, 7) + 0.0 AS slope, n AS inliers FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, ia, ib) AS k FROM f) WHERE k = 1""")
def pairwise_robust_slope(spark, sf_dir):
    o = A.observations(spark, sf_dir).withColumn("day", F.datediff("date", F.lit("1992-01-01").cast("date")))
    return tracks.pairwise_slope(o, "track", "day", "area", 0.05).withColumn("slope", F.round("slope", 7) + 0.0)


@query("track_status", f"""WITH {A.OBSERVATIONS_SQL}, o AS (SELECT track, date_diff('day', DATE '1992-01-01', date)::DOUBLE AS d, area AS y, row_number() OVER (PARTITION BY track ORDER BY date, area) AS i FROM obs),
l AS (SELECT a.track, a.i AS ia, b.i AS ib, a.d AS da, a.y AS ya, (b.y - a.y) / (b.d - a.d) AS m FROM o a JOIN o b ON a.track = b.track AND a.i < b.i AND a.d <> b.d),
f AS (SELECT l.track, ia, ib, m, count(*) AS n, count(*) * sum(c.d * c.d) - sum(c.d) ** 2 AS sp, count(*) * sum(c.d * c.y) - sum(c.d) * sum(c.y) AS t FROM l JOIN o c ON c.track = l.track AND abs(c.y - ya - m * (c.d - da)) < 0.05 GROUP BY ALL),
g AS (SELECT track, round(CASE WHEN sp > 0 THEN t / sp ELSE m END, 7) * 30.44 AS rate FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, ia, ib) AS k FROM f) WHERE k = 1),
t AS (SELECT track, min(date) AS f, max(date) AS l, count(*) AS n, arg_min(area, date) AS a0, arg_max(area, date) AS a1, arg_max(activity, date) AS act, max(equipment) AS me, avg(confidence) AS mc FROM obs GROUP BY 1)
SELECT track, strftime(f, '%Y-%m-%d') AS first_seen, strftime(l, '%Y-%m-%d') AS last_seen, n AS n_observations, act AS latest_activity, me AS max_equipment_count, round(mc, 6) AS mean_confidence,
  CASE WHEN n < 2 THEN 'NEW' WHEN act IN ('ACTIVE', 'LIKELY_ACTIVE') AND coalesce(rate, 0) > 0.0001 THEN 'EXPANDING' WHEN a1 - a0 > 0.05 THEN 'GROWN' WHEN a1 - a0 < -0.05 THEN 'REDUCED' WHEN act IN ('INACTIVE', 'INACTIVE_INFRASTRUCTURE') THEN 'STABLE_INACTIVE' ELSE 'STABLE' END AS status
FROM t LEFT JOIN g USING (track)""")
def track_status(spark, sf_dir):
    """Status by the robust line's rate; areas here grow little, so a hundredth of the usual rate makes
    a track expanding."""
    obs = A.observations(spark, sf_dir)
    r = tracks.track_report(obs, "track", "date", "area", "confidence", "activity", "equipment")
    o = obs.withColumn("day", F.datediff("date", F.lit("1992-01-01").cast("date")))
    rate = tracks.pairwise_slope(o, "track", "day", "area", 0.05).select("track", (F.round("slope", 7) * tracks.DAYS_A_MONTH).alias("rate"))
    r = r.join(rate, "track", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    change = F.element_at("area_series", -1) - F.col("area_initial_ha")
    r = r.withColumn("status", tracks.track_status(F.col("n_observations"), F.col("latest_activity"), F.col("rate") * 100, change))
    return r.select(
        "track", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "n_observations", "latest_activity", "max_equipment_count",
        F.round("mean_confidence", 6).alias("mean_confidence"), "status",
    )


@query("growth_rates")
def growth_rates(spark, sf_dir):
    """The seeded robust fit; its draws have no counterpart in SQL."""
    o = A.observations(spark, sf_dir).withColumn("day", F.datediff("date", F.lit("1992-01-01").cast("date")))
    return tracks.growth_rates(o, "track", "day", "area")


@query("track_assignment")
def track_assignment(spark, sf_dir):
    """Four epochs of drifting boxes, assigned one after the other."""
    s = A.sites(spark, sf_dir)
    epochs = []
    for e in range(4):
        cx, cy, r = F.col("x") + (F.col("site") % 7) * 10 * e, F.col("y") + (F.col("site") % 5) * 8 * e, F.sqrt("area_m2") / 2
        epochs.append(s.where((F.col("site") + e) % 4 != 0).select((F.col("site") * 10 + e).alias("site_id"), cx.alias("cx"), cy.alias("cy"), (cx - r).alias("x1"), (cy - r).alias("y1"), (cx + r).alias("x2"), (cy + r).alias("y2")))
    return tracks.assign_tracks(epochs)


@query("object_match", f"""WITH RECURSIVE {A.DETECTIONS_SQL}, r AS (SELECT x1, y1, event_id, x2 - x1 AS side, row_number() OVER (PARTITION BY x1, y1 ORDER BY event_id) AS i FROM det),
k AS (SELECT x1, y1, i, [{{'id': event_id, 'side': side}}] AS seen, []::BIGINT[] AS used, event_id AS found, NULL::BIGINT AS truth FROM r WHERE i = 1
  UNION ALL SELECT k.x1, k.y1, r.i, list_append(k.seen, {{'id': r.event_id, 'side': r.side}}), CASE WHEN t.truth IS NULL THEN k.used ELSE list_append(k.used, t.truth) END, r.event_id, t.truth
  FROM k JOIN r ON r.i = k.i + 1 AND r.x1 = k.x1 AND r.y1 = k.y1,
    LATERAL (SELECT list_filter(k.seen, lambda s: NOT list_contains(k.used, s.id) AND least(s.side, r.side) ** 2 / greatest(s.side, r.side) ** 2 >= 0.3)[1].id AS truth) t)
SELECT found, truth FROM k WHERE truth IS NOT NULL""")
def object_match(spark, sf_dir):
    """Detections matched one to one with earlier ones that they overlap, in order, first fit. Boxes
    stand on a lattice whose step is longer than their sides, so only those of one corner overlap."""
    p = spatial.box_pairs(A.detections(spark, sf_dir), "event_id", 64.0).where("iou >= 0.3")
    return spatial.greedy_match(p.withColumnsRenamed({"a": "truth", "b": "found"}), [], "found", "truth", None)


@query("rasterised_points", f"""WITH {A.MACHINES_SQL}, p AS (SELECT my / 100 AS y, mx / 100 AS x FROM machine)
SELECT DISTINCT r AS row, c AS col FROM p, generate_series(-3, 110) a(r), generate_series(-3, 110) b(c) WHERE r BETWEEN floor(y - 2) AND floor(y + 2) AND c BETWEEN floor(x - 2) AND floor(x + 2)
  AND greatest(0, r - y, y - r - 1) ** 2 + greatest(0, c - x, x - c - 1) ** 2 <= 4""")
def rasterised_points(spark, sf_dir):
    p = A.machines(spark, sf_dir).select((F.col("my") / 100).alias("y"), (F.col("mx") / 100).alias("x"))
    return components.rasterise_points(p, 2.0).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query("utm_round_trip", f"WITH {A.SITES_SQL} SELECT site, round(-1.5 + x / 10000, 7) AS lon, round(5.0 + y / 8000, 7) AS lat FROM site")
def utm_round_trip(spark, sf_dir):
    u = A.sites(spark, sf_dir).select("site", (-1.5 + F.col("x") / 10000).alias("lon"), (5.0 + F.col("y") / 8000).alias("lat")).withColumn("epsg", G.utm_epsg(F.col("lat"), F.col("lon")))
    e, n = G.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    u = u.select("site", "epsg", e.alias("e"), n.alias("n"))
    lon, lat = G.from_utm(F.col("e"), F.col("n"), F.col("epsg"))
    return u.select("site", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query("change_summary", f"""WITH {A.OBSERVATIONS_SQL}, t AS (SELECT track, count(*) AS n, arg_min(area, date) AS a0, arg_max(area, date) AS a1, arg_max(activity, date) AS act FROM obs GROUP BY 1),
s AS (SELECT a1, CASE WHEN n < 2 THEN 'NEW' WHEN act IN ('ACTIVE', 'LIKELY_ACTIVE') AND a1 - a0 > 0.01 THEN 'EXPANDING' WHEN a1 - a0 > 0.05 THEN 'GROWN' WHEN a1 - a0 < -0.05 THEN 'REDUCED' WHEN act IN ('INACTIVE', 'INACTIVE_INFRASTRUCTURE') THEN 'STABLE_INACTIVE' ELSE 'STABLE' END AS status FROM t)
SELECT count(*) AS tracks, count(*) FILTER (WHERE status = 'NEW') AS new, count(*) FILTER (WHERE status = 'EXPANDING') AS expanding, count(*) FILTER (WHERE status = 'GROWN') AS grown, count(*) FILTER (WHERE status = 'REDUCED') AS reduced,
  count(*) FILTER (WHERE status LIKE 'STABLE%') AS stable, round(sum(a1), 2) AS area_ha FROM s""")
def change_summary(spark, sf_dir):
    from ..operators.metrics import change_summary as summarise

    r = tracks.track_report(A.observations(spark, sf_dir), "track", "date", "area", "confidence", "activity", "equipment")
    last = F.element_at("area_series", -1)
    r = r.withColumn("status", tracks.track_status(F.col("n_observations"), F.col("latest_activity"), last - F.col("area_initial_ha"), last - F.col("area_initial_ha")))
    return summarise(r.withColumn("area_latest_ha", last))


@query("top_sites", f"WITH {A.SITES_SQL}, s AS (SELECT *, CASE WHEN equipment_count > 0 THEN 1.0 ELSE 0.2 END AS act FROM site), r AS ({'WITH ' + _priority_sql('s', 'equipment_count', 'confidence', 'act')}) SELECT site, date, priority_score FROM r ORDER BY priority_score DESC, site LIMIT 10")
def top_sites(spark, sf_dir):
    s = A.sites(spark, sf_dir)
    s = S.priority(s.withColumn("activity", S.activity_from_count(F.col("equipment_count"), F.col("confidence"))), "date", "site")
    return s.orderBy(F.desc("priority_score"), "site").limit(10).select("site", "date", "priority_score")


@query("rasterised_rings", f"""WITH {A.MACHINES_SQL}, t AS (SELECT machine, mx / 100 AS x, my / 100 AS y FROM machine), c AS (SELECT machine, x, y, r AS row, q AS col FROM t, generate_series(-5, 110) a(r), generate_series(-5, 110) b(q) WHERE r BETWEEN floor(y) AND floor(y + 3) AND q BETWEEN floor(x) AND floor(x + 4)),
e AS (SELECT c.*, x + ax AS x1, y + ay AS y1, x + bx AS x2, y + b_y AS y2 FROM c, (VALUES (0, 0, 4, 1), (4, 1, 2, 3), (2, 3, 0, 0)) s(ax, ay, bx, b_y))
SELECT machine, row, col FROM e GROUP BY ALL HAVING count(*) FILTER (WHERE (y1 > row + 0.5) <> (y2 > row + 0.5) AND col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / (y2 - y1) + x1) % 2 = 1""".replace("GROUP BY ALL HAVING", "GROUP BY machine, row, col HAVING"))
def rasterised_rings(spark, sf_dir):
    m = A.machines(spark, sf_dir).select("machine", (F.col("mx") / 100).alias("x"), (F.col("my") / 100).alias("y"))
    ring = F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in ((0, 0), (4, 1), (2, 3), (0, 0))])
    out = components.rasterise_rings(m.select("machine", ring.alias("ring")), "machine")
    return out.select("machine", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
