"""Queries over pixels, patches and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions.scoring import hectares, tier
from ..operators import components, grids, pixels, tiles
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


def _ratio(n: str, d: str) -> str:
    return f"greatest(-1, least(1, ({n}) / (({d}) + 1e-8)))"


_nd = lambda a, b: _ratio(f"{a} - {b}", f"{a} + {b}")
R6 = "round({}, 6)"


@query("band_index", f"""WITH {A.BANDS_SQL}, b AS (SELECT *, green * 0.5 + 0.1 AS swir1, blue * 0.25 + 0.05 AS swir2 FROM bands)
SELECT l_orderkey, l_linenumber, CASE WHEN red IS NOT NULL THEN round({_nd('nir', 'red')}, 6) END AS ndvi, round({_nd('green', 'nir')}, 6) AS ndwi, round({_nd('green', 'swir1')}, 6) AS mndwi,
  round({_nd('swir1', 'nir')}, 6) AS ndbi, round({_nd('nir', 'swir2')}, 6) AS nbr, round((nir - red) / (nir + red + 0.5 + 1e-8) * 1.5, 6) AS savi, round((blue + green + red) / 3, 9) AS brightness FROM b""")
def band_index(spark, sf_dir):
    b = A.bands(spark, sf_dir)
    c = {n: F.col(n) for n in ("blue", "green", "red", "nir")}
    found = B.spectral_indices(**c, swir1=F.col("green") * 0.5 + 0.1, swir2=F.col("blue") * 0.25 + 0.05)
    return b.select("l_orderkey", "l_linenumber", *[F.round(v, 9 if n == "brightness" else 6).alias(n) for n, v in found.items()])


@query("radar_features", f"""WITH {A.BANDS_SQL}, s AS (SELECT l_orderkey, l_linenumber, blue + 0.01 AS vv, green + 0.02 AS vh FROM bands), p AS (SELECT *, vv / (vv + vh + 1e-8) AS p, vh / (vv + vh + 1e-8) AS q FROM s)
SELECT l_orderkey, l_linenumber, round(pow(10, vv / 10), 6) AS vv_linear, round(pow(10, vh / 10), 6) AS vh_linear,
  round(greatest(0, least(10, greatest(-1, least(1, vv / (vh + 1e-8 + 1e-8))))), 6) AS ratio, round(-(p * log2(p + 1e-8) + q * log2(q + 1e-8)), 6) AS entropy FROM p""")
def radar_features(spark, sf_dir):
    b = A.bands(spark, sf_dir)
    return b.select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(n) for n, v in B.radar_features(F.col("blue") + 0.01, F.col("green") + 0.02).items()])


@query("sigma0_calibration", """WITH t AS (SELECT l_returnflag AS scene, max(l_quantity * 3) AS top FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(CASE WHEN top > 100 THEN 10 * log10(greatest((l_quantity * 3) * (l_quantity * 3), 1e-8)) - 83 ELSE 10 * log10(greatest(l_quantity * 3, 1e-8)) END, 6) AS db
FROM lineitem JOIN t ON l_returnflag = scene""")
def sigma0_calibration(spark, sf_dir):
    l = A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") * 3).alias("dn"))
    top = l.groupBy("l_returnflag").agg(F.max("dn").alias("top"))
    return l.join(top, "l_returnflag").select("l_orderkey", "l_linenumber", F.round(B.sigma0_db(F.col("dn"), F.col("top")), 6).alias("db"))


@query("landsat_scaling", "SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, l_extendedprice * 2.75e-05 - 0.2)), 9) AS reflectance FROM lineitem")
def landsat_scaling(spark, sf_dir):
    l = A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("reflectance"))
    return pixels.landsat_or_stretch(l, ["reflectance"]).select("l_orderkey", "l_linenumber", F.round("reflectance", 9).alias("reflectance"))


@query("percentile_stretch", f"""WITH {A.BANDS_SQL}, q AS (SELECT quantile_cont(blue, [0.02, 0.98]) AS b, quantile_cont(green, [0.02, 0.98]) AS g, quantile_cont(red, [0.02, 0.98]) AS r, quantile_cont(nir, [0.02, 0.98]) AS n FROM bands)
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (blue - b[1]) / (b[2] - b[1]))), 6) AS blue, round(greatest(0, least(1, (green - g[1]) / (g[2] - g[1]))), 6) AS green,
  CASE WHEN red IS NOT NULL THEN round(greatest(0, least(1, (red - r[1]) / (r[2] - r[1]))), 6) END AS red, round(greatest(0, least(1, (nir - n[1]) / (n[2] - n[1]))), 6) AS nir FROM bands, q""")
def percentile_stretch(spark, sf_dir):
    names = ["blue", "green", "red", "nir"]
    return pixels.stretch(A.bands(spark, sf_dir), names).select("l_orderkey", "l_linenumber", *[F.round(n, 6).alias(n) for n in names])


@query("uav_stretch", f"""WITH {A.PIXELS_SQL}, q AS (SELECT vec_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px GROUP BY 1)
SELECT vec_id, row, col, round(greatest(0, least(1, (v - lo) / (hi - lo + 1e-8))), 6) AS v FROM px JOIN q USING (vec_id)""")
def uav_stretch(spark, sf_dir):
    return pixels.stretch(A.patch_pixels(spark, sf_dir), ["v"], by="vec_id", guard=1e-8).withColumn("v", F.round("v", 6))


@query("cloud_mask_gapfill", f"""WITH {A.BANDS_SQL}, t AS (SELECT *, max(blue) OVER (PARTITION BY scene) AS top FROM bands),
m AS (SELECT l_orderkey, l_linenumber, scene, coalesce(blue / (top + 1e-8) > 0.7, false) AS cloud, CASE WHEN NOT coalesce(blue / (top + 1e-8) > 0.7, false) THEN green END AS green, CASE WHEN NOT coalesce(blue / (top + 1e-8) > 0.7, false) THEN red END AS red FROM t)
SELECT l_orderkey, l_linenumber, cloud::INTEGER AS is_cloud, round(coalesce(green, median(green) OVER (PARTITION BY l_orderkey)), 9) AS green, round(coalesce(red, median(red) OVER (PARTITION BY l_orderkey)), 9) AS red FROM m""")
def cloud_mask_gapfill(spark, sf_dir):
    m = pixels.mask_clouds(A.bands(spark, sf_dir), "scene", "blue", ["green", "red"])
    m = pixels.fill_gaps(m, ["l_orderkey"], ["green", "red"])
    return m.select("l_orderkey", "l_linenumber", F.col("is_cloud").cast("int").alias("is_cloud"), F.round("green", 9).alias("green"), F.round("red", 9).alias("red"))


@query("temporal_composite", f"WITH {A.BANDS_SQL} SELECT l_orderkey, round(median(blue), 9) AS blue, round(median(red), 9) AS red FROM bands GROUP BY 1")
def temporal_composite(spark, sf_dir):
    return pixels.composite(A.bands(spark, sf_dir), ["l_orderkey"], ["blue", "red"]).select("l_orderkey", F.round("blue", 9).alias("blue"), F.round("red", 9).alias("red"))


@query("temporal_stats", """WITH s AS (SELECT user_id, CASE WHEN event_id % 11 <> 0 THEN value / 500 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events),
m AS (SELECT *, avg(x) OVER (PARTITION BY user_id) AS mx, (count(*) OVER (PARTITION BY user_id) - 1) / 2 AS mt FROM s)
SELECT user_id, count(*) AS n, round(arg_max(x, t) FILTER (WHERE t = 2 * mt) - arg_min(x, t) FILTER (WHERE t = 0), 6) AS x_diff, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(stddev_pop(x), 6) AS x_std,
  round(sum((t - mt) * (x - mx)) / (sum((t - mt) * (t - mt)) + 1e-8), 6) AS x_slope, round(count(*) FILTER (WHERE x < 0.3) / count(*), 6) AS x_loss FROM m GROUP BY user_id""")
def temporal_stats(spark, sf_dir):
    e = A.read(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 11 != 0, F.col("value") / 500).alias("x"))
    f = pixels.temporal_features(e, ["user_id"], ["ts", "event_id"], "x")
    return f.select("user_id", "n", *[F.round(c, 6).alias(c) for c in f.columns[2:]])


@query("bare_soil", f"""WITH {A.BANDS_SQL}, q AS (SELECT *, floor(red * 255) AS r, floor(green * 255) AS g, floor(blue * 255) AS b FROM bands),
h AS (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM q),
k AS (SELECT *, CASE WHEN t = l THEN 0 WHEN t = r THEN 60 * (g - b) / (t - l) WHEN t = g THEN 120 + 60 * (b - r) / (t - l) ELSE 240 + 60 * (r - g) / (t - l) END AS h0 FROM h),
m AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS hue, CASE WHEN t = 0 THEN 0 ELSE (t - l) / t END AS sat, t / 255 AS val FROM k)
SELECT l_orderkey, l_linenumber, CASE WHEN red IS NOT NULL THEN (((red > 100.0 / 255 AND green > 80.0 / 255 AND red / (green + 1e-8) BETWEEN 0.8 AND 1.5) OR (hue BETWEEN 20 AND 60 AND sat < 0.55 AND val > 0.25 AND val < 0.9) OR {_nd('nir', 'red')} < 0.2))::INTEGER END::DOUBLE AS bare FROM m""")
def bare_soil(spark, sf_dir):
    bare = F.when(F.col("red").isNotNull(), B.bare_soil(F.col("red"), F.col("green"), F.col("blue"), F.col("nir")).cast("int")).cast("double")
    return A.bands(spark, sf_dir).select("l_orderkey", "l_linenumber", bare.alias("bare"))


@query("mining_vote", f"""WITH {A.BANDS_SQL} SELECT l_orderkey, l_linenumber, (((blue > 0.5)::INTEGER + (green * 4 > 2)::INTEGER + (nir > 0.3)::INTEGER) >= 2)::INTEGER AS mining FROM bands""")
def mining_vote(spark, sf_dir):
    b = A.bands(spark, sf_dir)
    return b.select("l_orderkey", "l_linenumber", B.mining_vote(F.col("blue") > 0.5, F.col("green") * 4, F.col("nir")).cast("int").alias("mining"))


@query("tile_grid", """WITH s AS (SELECT r_regionkey::BIGINT AS scene, 900 + 137 * r_regionkey AS height, 700 + 251 * r_regionkey AS width FROM region),
r AS (SELECT DISTINCT scene, height, width, greatest(0, least(i * 409 + 512, height) - 512) AS row_start FROM s, generate_series(0, 20) g(i) WHERE i * 409 < height),
c AS (SELECT DISTINCT scene, greatest(0, least(i * 409 + 512, width) - 512) AS col_start FROM s, generate_series(0, 20) g(i) WHERE i * 409 < width)
SELECT scene, row_start, col_start, least(row_start + 512, height) AS row_end, least(col_start + 512, width) AS col_end, 512 - (least(row_start + 512, height) - row_start) AS pad_r, 512 - (least(col_start + 512, width) - col_start) AS pad_c,
  'tile_' || lpad((row_number() OVER (PARTITION BY scene ORDER BY row_start, col_start) - 1)::VARCHAR, 5, '0') AS tile_id FROM r JOIN c USING (scene)""")
def tile_grid(spark, sf_dir):
    s = A.read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("scene"), (900 + 137 * F.col("r_regionkey")).cast("long").alias("height"), (700 + 251 * F.col("r_regionkey")).cast("long").alias("width"))
    return tiles.tile_ids(tiles.tile_grid(s, 512, 0.2), "tile").drop("tile_no", "height", "width")


def _patch_tiles(spark, size, overlap):
    return tiles.tile_grid_for(spark, A.PATCH, A.PATCH, size, overlap)


@query("tile_quality", f"""WITH {A.PIXELS_SQL}, t AS (SELECT r.i AS row_start, c.i AS col_start FROM (VALUES (0), (2), (4)) r(i), (VALUES (0), (2), (4)) c(i)),
z AS (SELECT vec_id, row, col, CASE WHEN v < -0.25 THEN NULL WHEN v BETWEEN -0.05 AND 0.05 THEN 0 ELSE v END AS v FROM px)
SELECT vec_id, row_start, col_start, round(avg((v IS NULL)::INTEGER), 6) AS missing_share, round(1 - avg(coalesce(v = 0, false)::INTEGER), 6) AS valid_share
FROM z JOIN t ON row >= row_start AND row < row_start + 4 AND col >= col_start AND col < col_start + 4 GROUP BY ALL HAVING missing_share <= 0.2 AND valid_share >= 0.5""")
def tile_quality(spark, sf_dir):
    v = F.when(F.col("v") < -0.25, F.lit(None)).when(F.col("v").between(-0.05, 0.05), 0.0).otherwise(F.col("v"))
    px = A.patch_pixels(spark, sf_dir).withColumn("v", v)
    q = tiles.tile_quality(tiles.pixels_of_tiles(_patch_tiles(spark, 4, 0.5), px, 4), ["vec_id", "row_start", "col_start"], ["v"], 0.2, 0.5)
    return q.withColumns({c: F.round(c, 6) for c in ("missing_share", "valid_share")})


@query("hanning_mosaic", f"""WITH {A.PIXELS_SQL}, t AS (SELECT r.i AS row_start, c.i AS col_start FROM (VALUES (0), (2), (4)) r(i), (VALUES (0), (2), (4)) c(i)),
p AS (SELECT vec_id, row, col, v + row_start * 0.01 AS p, (0.5 - 0.5 * cos(2 * pi() * (row - row_start) / 3)) * (0.5 - 0.5 * cos(2 * pi() * (col - col_start) / 3)) / (0.5625 + 1e-8) AS w
  FROM px JOIN t ON row >= row_start AND row < row_start + 4 AND col >= col_start AND col < col_start + 4)
SELECT vec_id, row, col, CASE WHEN sum(w) > 1e-12 THEN round(sum(w * p) / sum(w), 6) ELSE 0 END AS p FROM p GROUP BY ALL""")
def hanning_mosaic(spark, sf_dir):
    j = tiles.pixels_of_tiles(_patch_tiles(spark, 4, 0.5), A.patch_pixels(spark, sf_dir), 4)
    w = tiles.hanning_weight(F.col("row") - F.col("row_start"), F.col("col") - F.col("col_start"), 4)
    j = j.select("vec_id", "row", "col", (F.col("v") + F.col("row_start") * 0.01).alias("p"), F.when(w > 1e-12, w).otherwise(0.0).alias("w"))
    return tiles.mosaic(j, ["vec_id", "row", "col"]).withColumn("p", F.round("p", 6))


_REFLECT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_SYMMETRIC = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"


def _window_sql(border: str, k: int = 2) -> str:
    return f"""off AS (SELECT a.i AS di, b.i AS dj FROM generate_series(-{k}, {k}) a(i), generate_series(-{k}, {k}) b(i)),
n AS (SELECT p.vec_id, p.row, p.col, p.v, q.v AS u FROM px p, off JOIN px q ON q.vec_id = p.vec_id AND q.row = {border.format('p.row + di')} AND q.col = {border.format('p.col + dj')})"""


def _unpacked(chunks, name):
    return chunks.select("vec_id", F.posexplode(name).alias("pos", name)).select("vec_id", F.floor(F.col("pos") / A.PATCH).cast("int").alias("row"), (F.col("pos") % A.PATCH).cast("int").alias("col"), name)


@query("focal_lee", f"""WITH {A.PIXELS_SQL}, {_window_sql(_REFLECT)}, s AS (SELECT vec_id, row, col, v, avg(u) AS m, greatest(0, avg(u * u) - avg(u) * avg(u)) AS w FROM n GROUP BY ALL), g AS (SELECT vec_id, var_pop(v) / 4 AS noise FROM px GROUP BY 1)
SELECT vec_id, row, col, round(m + w / (w + noise + 1e-10) * (v - m), 6) AS lee FROM s JOIN g USING (vec_id)""")
def focal_lee(spark, sf_dir):
    out = grids.map_chunks(A.patches(spark, sf_dir), {"lee": grids.refined_lee})
    return _unpacked(out, "lee").withColumn("lee", F.round("lee", 6))


@query("focal_texture", f"""WITH base AS ({"SELECT * FROM (WITH " + A.PIXELS_SQL + " SELECT vec_id, row, col, greatest(0, least(1, v * 2 + 0.5)) AS v FROM px)"}), px AS (SELECT * FROM base), {_window_sql(_SYMMETRIC)},
b AS (SELECT vec_id, row, col, least(15, floor(u * 16)) AS bin, count(*) / 25 AS p FROM n GROUP BY ALL), e AS (SELECT vec_id, row, col, -sum(p * log2(p + 1e-8)) AS entropy FROM b GROUP BY ALL),
s AS (SELECT vec_id, row, col, var_pop(u) AS contrast FROM n GROUP BY ALL)
SELECT vec_id, row, col, round(contrast, 6) AS contrast, round(entropy, 5) AS entropy, round(1 / (1 + contrast), 6) AS homogeneity FROM s JOIN e USING (vec_id, row, col)""")
def focal_texture(spark, sf_dir):
    p = A.patches(spark, sf_dir).withColumn("data", F.transform("data", lambda v: v * 2 + 0.5))
    k = {n: grids.TEXTURE[n] for n in ("contrast", "entropy", "homogeneity")}
    out = grids.map_chunks(p, k)
    z = out.select("vec_id", F.posexplode(F.arrays_zip(*k)).alias("pos", "z"))
    return z.select("vec_id", F.floor(F.col("pos") / A.PATCH).cast("int").alias("row"), (F.col("pos") % A.PATCH).cast("int").alias("col"), *[F.round(f"z.{n}", 5 if n == "entropy" else 6).alias(n) for n in k])


@query("morph_open_close", f"""WITH {A.PIXELS_SQL}, off AS (SELECT a.i AS di, b.i AS dj FROM generate_series(-1, 1) a(i), generate_series(-1, 1) b(i)),
m0 AS (SELECT vec_id, row, col, (v >= 0)::INTEGER AS o FROM px),
m1 AS (SELECT p.vec_id, p.row, p.col, (count(*) FILTER (WHERE q.o = 1) = 9)::INTEGER AS o FROM m0 p, off LEFT JOIN m0 q ON q.vec_id = p.vec_id AND q.row = p.row + di AND q.col = p.col + dj GROUP BY ALL),
m2 AS (SELECT p.vec_id, p.row, p.col, (count(*) FILTER (WHERE q.o = 1) > 0)::INTEGER AS o FROM m1 p, off LEFT JOIN m1 q ON q.vec_id = p.vec_id AND q.row = p.row + di AND q.col = p.col + dj GROUP BY ALL),
m3 AS (SELECT p.vec_id, p.row, p.col, (count(*) FILTER (WHERE q.o = 1) > 0)::INTEGER AS o FROM m2 p, off LEFT JOIN m2 q ON q.vec_id = p.vec_id AND q.row = p.row + di AND q.col = p.col + dj GROUP BY ALL),
m4 AS (SELECT p.vec_id, p.row, p.col, (count(*) FILTER (WHERE q.o = 1) = 9)::INTEGER AS o FROM m3 p, off LEFT JOIN m3 q ON q.vec_id = p.vec_id AND q.row = p.row + di AND q.col = p.col + dj GROUP BY ALL)
SELECT vec_id, row, col, o AS mask FROM m4""")
def morph_open_close(spark, sf_dir):
    out = grids.map_chunks(A.patches(spark, sf_dir), {"mask": lambda x: grids.closing(grids.opening(x >= 0, 3), 3)})
    return _unpacked(out, "mask").withColumn("mask", F.col("mask").cast("int"))


_CLAMP = "least(7, greatest(0, {0}))"
_T = "0.41421356237309503"


@query("edge_density", f"""WITH RECURSIVE {A.PIXELS_SQL}, off AS (SELECT a.i AS di, b.i AS dj FROM generate_series(-1, 1) a(i), generate_series(-1, 1) b(i)),
g AS (SELECT p.vec_id, p.row, p.col, sum(dj * (2 - abs(di)) * (q.v + 0.5) * 255) AS gx, sum(di * (2 - abs(dj)) * (q.v + 0.5) * 255) AS gy
  FROM px p, off JOIN px q ON q.vec_id = p.vec_id AND q.row = {_CLAMP.format('p.row + di')} AND q.col = {_CLAMP.format('p.col + dj')} GROUP BY ALL),
m AS (SELECT *, abs(gx) + abs(gy) AS m FROM g),
d AS (SELECT *, CASE WHEN abs(gy) <= {_T} * abs(gx) THEN 0 WHEN abs(gx) <= {_T} * abs(gy) THEN 1 ELSE 1 END AS dr,
  CASE WHEN abs(gy) <= {_T} * abs(gx) THEN 1 WHEN abs(gx) <= {_T} * abs(gy) THEN 0 WHEN gx * gy >= 0 THEN 1 ELSE -1 END AS dc FROM m),
t AS (SELECT d.vec_id, d.row, d.col, d.m, d.m > coalesce(a.m, 0) AND d.m >= coalesce(b.m, 0) AS thin FROM d
  LEFT JOIN m a ON a.vec_id = d.vec_id AND a.row = d.row - dr AND a.col = d.col - dc LEFT JOIN m b ON b.vec_id = d.vec_id AND b.row = d.row + dr AND b.col = d.col + dc),
w AS (SELECT vec_id, row, col, m > 150 AS strong FROM t WHERE thin AND m > 50),
e AS (SELECT vec_id, row, col FROM w WHERE strong
  UNION SELECT w.vec_id, w.row, w.col FROM e JOIN w ON w.vec_id = e.vec_id AND abs(w.row - e.row) <= 1 AND abs(w.col - e.col) <= 1),
x AS (SELECT px.vec_id, px.row, px.col, (e.row IS NOT NULL)::INTEGER::DOUBLE AS edge FROM px LEFT JOIN e USING (vec_id, row, col))
SELECT *, avg(edge) OVER (PARTITION BY vec_id, row // 4, col // 4) AS density FROM x""")
def edge_density(spark, sf_dir):
    """Canny edges, by chunks smaller than the images, and their share in 4x4 blocks."""
    from .flows import edges

    px = A.patch_pixels(spark, sf_dir).withColumn("v", (F.col("v") + 0.5) * 255)
    return pixels.block_mean(edges(px, ("vec_id",), "v", 4), 4, "edge", ("vec_id",))


@query("focal_lee_chunked", f"""WITH {A.PIXELS_SQL}, {_window_sql(_REFLECT)}, s AS (SELECT vec_id, row, col, v, avg(u) AS m, greatest(0, avg(u * u) - avg(u) * avg(u)) AS w FROM n GROUP BY ALL), g AS (SELECT vec_id, var_pop(v) / 4 AS noise FROM px GROUP BY 1)
SELECT vec_id, row, col, round(m + w / (w + noise + 1e-10) * (v - m), 6) AS lee FROM s JOIN g USING (vec_id)""")
def focal_lee_chunked(spark, sf_dir):
    """The same filter by chunks of a quarter of the image, against the whole image's variance."""
    from .flows import lee_filter

    return lee_filter(A.patch_pixels(spark, sf_dir), ("vec_id",), "v", 4).select("vec_id", "row", "col", F.round("v", 6).alias("lee"))


_FLOOD = """set_px AS (SELECT vec_id, row, col, v, row * 2147483648 + col AS k FROM px WHERE v >= 0.05),
reach AS (SELECT vec_id, k AS a, k AS b FROM set_px
  UNION SELECT r.vec_id, r.a, q.k FROM reach r JOIN set_px p ON p.vec_id = r.vec_id AND p.k = r.b JOIN set_px q ON q.vec_id = p.vec_id AND abs(q.row - p.row) + abs(q.col - p.col) = 1),
label AS (SELECT vec_id, b AS k, min(a) AS label FROM reach GROUP BY ALL)"""


@query("components_rank", f"""WITH RECURSIVE {A.PIXELS_SQL}, {_FLOOD},
reg AS (SELECT vec_id, label, count(*) AS pixel_count, count(*) * 100 AS area_m2, avg(v * 2) AS confidence FROM label JOIN set_px USING (vec_id, k) GROUP BY ALL HAVING count(*) * 100 >= 200),
sc AS (SELECT *, ln(1 + area_m2) AS la, min(ln(1 + area_m2)) OVER (PARTITION BY vec_id) AS lo, max(ln(1 + area_m2)) OVER (PARTITION BY vec_id) AS hi FROM reg),
p AS (SELECT *, round(0.3 * (CASE WHEN hi = lo THEN 1 ELSE (la - lo) / (hi - lo + 1e-8) END) + 0.25 / (1 + exp(1)) + 0.2 * 0.5 + 0.15 * confidence + 0.1 * (CASE WHEN confidence >= 0.6 THEN 0.7 ELSE 0.5 END), 6) AS priority_score FROM sc)
SELECT vec_id, label, pixel_count, round(area_m2 / 10000, 4) AS area_ha, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier,
  priority_score, row_number() OVER (PARTITION BY vec_id ORDER BY priority_score DESC, label)::INTEGER AS priority_rank FROM p""")
def components_rank(spark, sf_dir):
    """Threshold, regions, zonal confidence, tier, score and rank: the flagship."""
    from ..functions.scoring import activity_from_count, priority

    set_px = A.patch_pixels(spark, sf_dir).where("v >= 0.05").withColumn("v", F.col("v") * 2)
    cells = components.chunk_labels(set_px, "vec_id")
    r = components.regions(cells, "vec_id", 100.0, "v", 200.0)
    r = r.withColumns({"equipment_count": F.lit(0), "activity": activity_from_count(F.lit(None), F.col("confidence")), "water_proximity": F.lit(None).cast("double")})
    r = priority(r, "vec_id", "label")
    return r.select("vec_id", "label", "pixel_count", hectares(F.col("area_m2")).alias("area_ha"), F.round("confidence", 6).alias("confidence"), tier(F.col("confidence")).alias("confidence_tier"), "priority_score", "priority_rank")


@query("components_chunked", f"WITH RECURSIVE {A.PIXELS_SQL}, {_FLOOD} SELECT vec_id, label, count(*) AS n FROM label GROUP BY ALL")
def components_chunked(spark, sf_dir):
    cells = components.chunk_labels(A.patch_pixels(spark, sf_dir).where("v >= 0.05"), "vec_id", chunk=4)
    return cells.groupBy("vec_id", "label").agg(F.count("*").alias("n"))


_VERTEX = """win AS (SELECT vec_id, label, vr, vc, count(*) AS n, count(*) FILTER (WHERE (vr - row + vc - col) % 2 = 0) AS even
  FROM (SELECT vec_id, label, k // 2147483648 AS row, k % 2147483648 AS col, k // 2147483648 + i AS vr, k % 2147483648 + j AS vc FROM label, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)) GROUP BY ALL)"""


@query("site_outlines", f"""WITH RECURSIVE {A.PIXELS_SQL}, {_FLOOD}, {_VERTEX},
c AS (SELECT vec_id, label, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND even IN (0, 2) THEN 2 ELSE 0 END) AS corners,
  (sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND even IN (0, 2) THEN 2 ELSE 0 END) // 4) AS euler FROM win GROUP BY ALL),
s AS (SELECT a.vec_id, a.label, count(*) AS cells FROM label a GROUP BY ALL)
SELECT vec_id, label, (2 - euler)::BIGINT AS rings, corners::BIGINT AS corners, round(cells * 100.0, 6) AS area_m2 FROM c JOIN s USING (vec_id, label)""")
def site_outlines(spark, sf_dir):
    """Regions as polygons with holes: their rings, corners, and area by the shoelace rule."""
    from ..functions.geometry import ring_area

    cells = components.chunk_labels(A.patch_pixels(spark, sf_dir).where("v >= 0.05").drop("v"), "vec_id")
    p = components.rings(cells, ["vec_id", "label"], (10.0, 0.0, 5000.0, 0.0, -10.0, 9000.0))
    areas = F.transform("rings", ring_area)
    corners = F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r) - 1)
    holes = F.aggregate(F.slice(areas, 2, F.size("rings")), F.lit(0.0), lambda s, a: s + a)
    return p.select("vec_id", "label", F.size("rings").cast("long").alias("rings"), corners.cast("long").alias("corners"), F.round(areas[0] - holes, 6).alias("area_m2"))


@query("zonal_confidence", f"""WITH {A.PIXELS_SQL}, z AS (SELECT vec_id, ((row // 3) * 3 + col // 3)::BIGINT AS zone, row, col FROM px)
SELECT vec_id, zone, round(avg(v), 6) AS confidence FROM z JOIN px USING (vec_id, row, col) GROUP BY ALL""")
def zonal_confidence(spark, sf_dir):
    px = A.patch_pixels(spark, sf_dir)
    zones = px.select("vec_id", (F.floor(F.col("row") / 3) * 3 + F.floor(F.col("col") / 3)).alias("zone"), "row", "col")
    return components.zonal_mean(zones, ["vec_id", "zone"], px, ["vec_id", "row", "col"], "v").withColumn("confidence", F.round("confidence", 6))


@query("block_majority", f"WITH {A.PIXELS_SQL} SELECT vec_id, (row // 2)::INTEGER AS row, (col // 2)::INTEGER AS col, (avg((v >= 0)::INTEGER) >= 0.3)::INTEGER AS v FROM px GROUP BY ALL")
def block_majority(spark, sf_dir):
    px = A.patch_pixels(spark, sf_dir).withColumn("v", (F.col("v") >= 0).cast("int"))
    return pixels.resample(px, 2, "majority", keys=("vec_id",))


@query("resample_area_nearest", f"""WITH {A.PIXELS_SQL}, a AS (SELECT vec_id, (row // 4)::INTEGER AS row, (col // 4)::INTEGER AS col, round(avg(v), 6) AS area FROM px GROUP BY ALL)
SELECT a.*, round(px.v, 6) AS nearest FROM a JOIN px ON px.vec_id = a.vec_id AND px.row = a.row * 4 AND px.col = a.col * 4""")
def resample_area_nearest(spark, sf_dir):
    px = A.patch_pixels(spark, sf_dir)
    area = pixels.resample(px, 4, "area", keys=("vec_id",)).withColumnRenamed("v", "area")
    near = pixels.resample(px, 4, "nearest", keys=("vec_id",)).withColumnRenamed("v", "nearest")
    return area.join(near, ["vec_id", "row", "col"]).withColumns({c: F.round(c, 6) for c in ("area", "nearest")})


@query("bilinear_sample", f"""WITH {A.PIXELS_SQL}, pt AS (SELECT vec_id, k, 0.3 + k * 1.9 AS y, 7.6 - k * 1.7 AS x FROM embeddings, generate_series(0, 4) g(k)),
c AS (SELECT *, floor(y - 0.5) + i AS r, floor(x - 0.5) + j AS q FROM pt, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
w AS (SELECT *, (1 - abs(y - 0.5 - r)) * (1 - abs(x - 0.5 - q)) AS w, greatest(0, least(7, r)) AS row, greatest(0, least(7, q)) AS col FROM c)
SELECT w.vec_id, k, round(sum(w * v), 6) AS v FROM w JOIN px ON px.vec_id = w.vec_id AND px.row = w.row AND px.col = w.col GROUP BY ALL""")
def bilinear_sample(spark, sf_dir):
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    pts = A.patches(spark, sf_dir).select("vec_id", k.alias("k")).select("vec_id", F.col("k").cast("long").alias("k"), (0.3 + F.col("k") * 1.9).alias("y"), (7.6 - F.col("k") * 1.7).alias("x"))
    return pixels.bilinear(pts, A.patch_pixels(spark, sf_dir), 8, 8, ("vec_id",)).select("vec_id", "k", F.round("v", 6).alias("v"))


@query("distance_proximity", f"""WITH {A.PIXELS_SQL}, d AS (SELECT p.vec_id, p.row, p.col, min(sqrt((p.row - w.row) ** 2 + (p.col - w.col) ** 2)) AS d FROM px p LEFT JOIN px w ON w.vec_id = p.vec_id AND w.v > 0.2 GROUP BY ALL)
SELECT vec_id, row, col, round(coalesce(greatest(0, 1 - d * 50 / 200), 0), 6) AS water_proximity FROM d""")
def distance_proximity(spark, sf_dir):
    px = A.patch_pixels(spark, sf_dir)
    out = components.water_proximity(px.select("vec_id", "row", "col"), px.where("v > 0.2").select("vec_id", "row", "col"), ["vec_id"], 50.0)
    return out.withColumn("water_proximity", F.round("water_proximity", 6))


@query("cell_iou", f"""WITH {A.PIXELS_SQL}, a AS (SELECT label, row, col FROM (SELECT vec_id % 7 AS label, row, col, avg(v) AS v FROM px JOIN embeddings USING (vec_id) GROUP BY ALL) WHERE v > 0),
b AS (SELECT g, row, col FROM (SELECT vec_id % 5 AS g, row, col, avg(v) AS v FROM px GROUP BY ALL) WHERE v > 0),
n AS (SELECT label, g, count(*) AS i FROM a JOIN b USING (row, col) GROUP BY ALL), na AS (SELECT label, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT g, count(*) AS n FROM b GROUP BY 1)
SELECT label, g, round(i / (na.n + nb.n - i), 6) AS iou FROM n JOIN na USING (label) JOIN nb USING (g)""")
def cell_iou(spark, sf_dir):
    px = A.patch_pixels(spark, sf_dir)
    of = lambda k, n: px.groupBy((F.col("vec_id") % k).alias(n), "row", "col").agg(F.avg("v").alias("v")).where("v > 0").select(n, "row", "col")
    return components.cell_iou(of(7, "label"), of(5, "g"), ["row", "col"], "label", "g").withColumn("iou", F.round("iou", 6))


@query("feature_stack_fill", f"""WITH {A.BANDS_SQL} SELECT l_orderkey, l_linenumber, round(coalesce(red, 0), 6) AS red, round(CASE WHEN nir > 0.79 THEN 1 ELSE nir END, 6) AS nir FROM bands""")
def feature_stack_fill(spark, sf_dir):
    b = A.bands(spark, sf_dir)
    nir = F.when(F.col("nir") > 0.79, F.lit(float("inf"))).otherwise(F.col("nir"))
    return b.select("l_orderkey", "l_linenumber", F.round(B.finite_features(F.col("red")), 6).alias("red"), F.round(B.finite_features(nir), 6).alias("nir"))


@query("hue_saturation", f"""WITH {A.BANDS_SQL}, q AS (SELECT l_orderkey, l_linenumber, floor(red * 255) AS r, floor(green * 255) AS g, floor(blue * 255) AS b FROM bands), h AS (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM q),
k AS (SELECT *, CASE WHEN t = l THEN 0 WHEN t = r THEN 60 * (g - b) / (t - l) WHEN t = g THEN 120 + 60 * (b - r) / (t - l) ELSE 240 + 60 * (r - g) / (t - l) END AS h0 FROM h)
SELECT l_orderkey, l_linenumber, CASE WHEN r IS NOT NULL THEN round(CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END, 5) END AS hue, CASE WHEN r IS NOT NULL THEN round(CASE WHEN t = 0 THEN 0 ELSE (t - l) / t END, 6) END AS saturation, CASE WHEN r IS NOT NULL THEN round(t / 255, 6) END AS value FROM k""")
def hue_saturation(spark, sf_dir):
    h, s, v = (F.when(F.col("red").isNotNull(), c) for c in B.hsv(F.col("red"), F.col("green"), F.col("blue")))
    return A.bands(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(h, 5).alias("hue"), F.round(s, 6).alias("saturation"), F.round(v, 6).alias("value"))


@query("grey_levels", f"WITH {A.BANDS_SQL} SELECT l_orderkey, l_linenumber, round(red * 0.299 + green * 0.587 + blue * 0.114, 11) AS features, round(red * 0.2989 + green * 0.587 + blue * 0.114, 11) AS masks FROM bands")
def grey_levels(spark, sf_dir):
    rgb = [F.col(c) for c in ("red", "green", "blue")]
    return A.bands(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(B.grey(*rgb), 11).alias("features"), F.round(B.grey(*rgb, B.GREY_MASKS), 11).alias("masks"))


@query("probability_levels", f"""WITH {A.PIXELS_SQL}, l AS (SELECT * FROM (VALUES ('low', 0.3), ('medium', 0.5), ('high', 0.7)) t(level, least)) SELECT level, count(*) AS pixels, count(*) * 100 AS area_m2 FROM px JOIN l ON v * 2 + 0.3 >= least GROUP BY 1""")
def probability_levels(spark, sf_dir):
    from ..operators.scoring_models import thresholds

    px = A.patch_pixels(spark, sf_dir).select((F.col("v") * 2 + 0.3).alias("p"))
    hit = thresholds(px, "p", {"low": 0.3, "medium": 0.5, "high": 0.7})
    return hit.groupBy("level").agg(F.count("*").alias("pixels"), (F.count("*") * 100).alias("area_m2"))


@query("tile_masks", f"""WITH {A.PIXELS_SQL}, t AS (SELECT r.i AS row_start, c.i AS col_start FROM (VALUES (0), (2), (4)) r(i), (VALUES (0), (2), (4)) c(i))
SELECT vec_id, row_start, col_start, round(sum((v > 0.2)::INTEGER) / 16, 6) AS positive_fraction, (sum((v > 0.2)::INTEGER) / 16 >= 0.1)::INTEGER AS is_positive
FROM px JOIN t ON row >= row_start AND row < row_start + 4 AND col >= col_start AND col < col_start + 4 GROUP BY ALL""")
def tile_masks(spark, sf_dir):
    px = A.patch_pixels(spark, sf_dir).withColumn("v", (F.col("v") > 0.2).cast("int"))
    out = tiles.tile_masks(tiles.pixels_of_tiles(_patch_tiles(spark, 4, 0.5), px, 4), ["vec_id", "row_start", "col_start"], "v", 4, 0.1)
    return out.withColumns({"positive_fraction": F.round("positive_fraction", 6), "is_positive": F.col("is_positive").cast("int")})


@query("not_black_tiles", f"""WITH {A.PIXELS_SQL} SELECT vec_id, (row // 4)::BIGINT AS r, (col // 4)::BIGINT AS c FROM px GROUP BY ALL HAVING max(v - 0.2) > 0""")
def not_black_tiles(spark, sf_dir):
    px = A.patch_pixels(spark, sf_dir).select("vec_id", F.floor(F.col("row") / 4).alias("r"), F.floor(F.col("col") / 4).alias("c"), (F.col("v") - 0.2).alias("v"))
    return tiles.not_black(px, ["vec_id", "r", "c"], "v")


@query("mask_iou", f"""WITH {A.PIXELS_SQL}, m AS (SELECT a.vec_id, (a.v > 0)::INTEGER AS a, (b.v > 0)::INTEGER AS b FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.row = a.row AND b.col = a.col)
SELECT vec_id, round(coalesce(sum(a * b) / nullif(sum(a + b - a * b), 0), 0), 6) AS iou FROM m GROUP BY 1""")
def mask_iou(spark, sf_dir):
    px = A.patch_pixels(spark, sf_dir).withColumn("a", (F.col("v") > 0).cast("int")).drop("v")
    other = px.select((F.col("vec_id") - 1).alias("vec_id"), "row", "col", F.col("a").alias("b"))
    return components.mask_iou(px.join(other, ["vec_id", "row", "col"]), "a", "b", ["vec_id"]).withColumn("iou", F.round("iou", 6))


@query("coregister", f"""WITH {A.PIXELS_SQL}, l AS (SELECT vec_id, row, col, v FROM px WHERE row < 4 AND col < 4), r AS (SELECT vec_id - 1 AS vec_id, row, col, v AS fine FROM px)
SELECT l.vec_id, l.row, l.col, round(v, 6) AS v, round(fine, 6) AS fine FROM l LEFT JOIN r ON r.vec_id = l.vec_id AND r.row = l.row * 2 AND r.col = l.col * 2""")
def coregister(spark, sf_dir):
    """The upper left quarter of each patch as a coarse grid, over the next patch as one twice as fine."""
    px = A.patch_pixels(spark, sf_dir)
    left = px.where("row < 4 and col < 4").select("vec_id", "row", "col", "v")
    right = px.select((F.col("vec_id") - 1).alias("vec_id"), "row", "col", F.col("v").alias("fine"))
    return pixels.coregister(left, right, 2.0, ("vec_id",)).withColumns({c: F.round(c, 6) for c in ("v", "fine")})


def _morph_sql(source: str, out: str, k: int, least: int) -> str:
    """Pixels of which `least` of the (2k + 1)^2 around are set."""
    return f"""{out} AS (SELECT p.d, p.row, p.col, (count(q.o) FILTER (WHERE q.o = 1) >= {least})::INTEGER AS o FROM {source} p, generate_series(-{k}, {k}) a(di), generate_series(-{k}, {k}) b(dj)
  LEFT JOIN {source} q ON q.d = p.d AND q.row = p.row + di AND q.col = p.col + dj GROUP BY ALL)"""


@query("detect_sites", f"""WITH RECURSIVE {A.PIXELS_SQL},
img AS (SELECT vec_id // 64 AS d, (vec_id % 16 // 4 * 8 + row)::INTEGER AS row, (vec_id % 4 * 8 + col)::INTEGER AS col, least(1.0, max(v * 4)) AS p FROM px GROUP BY ALL),
m0 AS (SELECT d, row, col, (p >= 0.5)::INTEGER AS o FROM img), {_morph_sql('m0', 'm1', 1, 9)}, {_morph_sql('m1', 'm2', 1, 1)}, {_morph_sql('m2', 'm3', 2, 1)}, {_morph_sql('m3', 'm4', 2, 25)},
cell AS (SELECT d, row, col, row * 2147483648 + col AS k FROM m4 WHERE o = 1),
reach AS (SELECT d, k AS a, k AS b FROM cell UNION SELECT r.d, r.a, q.k FROM reach r JOIN cell p ON p.d = r.d AND p.k = r.b JOIN cell q ON q.d = p.d AND abs(q.row - p.row) + abs(q.col - p.col) = 1),
lab AS (SELECT d, b AS k, min(a) AS label FROM reach GROUP BY ALL),
reg AS (SELECT d, label, count(*) AS pixel_count, count(*) * 100.0 AS area_m2, avg(p) AS confidence FROM lab JOIN cell USING (d, k) JOIN img USING (d, row, col) GROUP BY ALL),
sc AS (SELECT *, ln(1 + area_m2) AS la, min(ln(1 + area_m2)) OVER (PARTITION BY d) AS lo, max(ln(1 + area_m2)) OVER (PARTITION BY d) AS hi, dense_rank() OVER (PARTITION BY d ORDER BY label) - 1 AS no FROM reg),
s AS (SELECT *, 'SAT_' || d || '_' || printf('%04d', no) AS site_id, round(0.3 * (CASE WHEN hi = lo THEN 1 ELSE (la - lo) / (hi - lo + 1e-8) END) + 0.25 / (1 + exp(1)) + 0.2 * 0.5 + 0.15 * confidence + 0.1 * (CASE WHEN confidence >= 0.6 THEN 0.7 ELSE 0.5 END), 6) AS priority_score FROM sc)
SELECT d::VARCHAR AS date, site_id, pixel_count, round(area_m2 / 10000, 4) AS area_ha, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_tier, priority_score,
  row_number() OVER (PARTITION BY d ORDER BY priority_score DESC, site_id)::INTEGER AS priority_rank FROM s""")
def detect_sites(spark, sf_dir):
    """The detection flow on images of 32 by 32 pixels, each of sixteen places for 64 patches."""
    from .flows import detect_sites as flow

    px = A.patch_pixels(spark, sf_dir)
    row, col = F.floor(F.col("vec_id") % 16 / 4) * 8 + F.col("row"), F.col("vec_id") % 4 * 8 + F.col("col")
    prob = px.groupBy(F.floor(F.col("vec_id") / 64).cast("string").alias("date"), row.cast("int").alias("row"), col.cast("int").alias("col")).agg(F.least(F.lit(1.0), F.max(F.col("v") * 4)).alias("p"))
    return flow(prob, 10.0).select("date", "site_id", "pixel_count", "area_ha", F.round("confidence", 6).alias("confidence"), "confidence_tier", "priority_score", "priority_rank")
