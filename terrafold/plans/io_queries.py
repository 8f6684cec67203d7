"""Queries that write derived files with the sinks and read them back with the sources."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import grids, labels, pixels, scoring_models, tiles
from ..sources import files, geotiff, sinks
from . import adapters as A
from .raster_queries import _SYMMETRIC, _morph_sql, _window_sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def scratch(spark, name: str) -> str:
    """A new place in the folder that all executors share; in a local session, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='terrafold-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _boxes(spark, sf_dir):
    return A.sites(spark, sf_dir).select("site", "date", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 50).alias("x2"), (F.col("y") + 20).alias("y2"))


def _box():
    return sinks.box_polygon("x1", "y1", "x2", "y2")


@query("geojson_source", f"WITH {A.SITES_SQL} SELECT site, date, x AS min_x, x + 50 AS max_x, y AS min_y, y + 20 AS max_y, 5::BIGINT AS points FROM site")
def geojson_source(spark, sf_dir):
    """Sites as one feature collection, read by the boundary source."""
    path = scratch(spark, "features")
    sinks.write_feature_collection(spark, f"{path}/all.geojson", _boxes(spark, sf_dir), _box(), ["site", "date"], "date")
    f = files.geojson(spark, path).select(F.col("properties")["site"].cast("long").alias("site"), F.col("properties")["date"].alias("date"), F.col("rings")[0].alias("r"))
    end = lambda k, of: of(F.transform("r", lambda p: p[k]))
    return f.select("site", "date", end("x", F.array_min).alias("min_x"), end("x", F.array_max).alias("max_x"), end("y", F.array_min).alias("min_y"), end("y", F.array_max).alias("max_y"), F.size("r").cast("long").alias("points"))


@query("geojson_lines", f"WITH {A.SITES_SQL} SELECT date, count(*) AS n, round(sum(x + 50), 3) AS x2 FROM site GROUP BY 1")
def geojson_lines(spark, sf_dir):
    """Features written by the executors, a folder a date."""
    path = scratch(spark, "lines")
    sinks.write_geojson_lines(_boxes(spark, sf_dir), _box(), ["site"], path, "date")
    t = spark.read.schema("type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, date string").json(path)
    return t.groupBy("date").agg(F.count("*").alias("n"), F.round(F.sum(F.col("geometry.coordinates")[0][1][0]), 3).alias("x2"))


@query("ground_truth_points", f"""WITH {A.SITES_SQL}, ring AS (SELECT [1000.0, 9000.0, 8000.0, 3000.0, 1000.0] AS xs, [1000.0, 2000.0, 9500.0, 8000.0, 1000.0] AS ys),
e AS (SELECT site, x, y, xs[i] AS x1, ys[i] AS y1, xs[i + 1] AS x2, ys[i + 1] AS y2 FROM site, ring, generate_series(1, 4) g(i))
SELECT site::VARCHAR AS notes, 'galamsey' AS site_type, 'unknown' AS active_status, 0.0::DOUBLE AS size_m2 FROM e GROUP BY site HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1""")
def ground_truth_points(spark, sf_dir):
    """A CSV of points with some columns missing, within a boundary."""
    path = scratch(spark, "truth")
    A.sites(spark, sf_dir).select(F.col("x").alias("longitude"), F.col("y").alias("latitude"), F.col("site").alias("notes")).write.option("header", True).csv(path)
    corners = ((1000, 1000), (9000, 2000), (8000, 9500), (3000, 8000), (1000, 1000))
    ring = F.array(F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in corners]))
    return files.ground_truth(spark, path, spark.range(1).select(ring.alias("rings"))).select("notes", "site_type", "active_status", "size_m2")


@query("tile_map", """WITH r AS (SELECT DISTINCT greatest(0, least(i * 576 + 640, 1500) - 640) AS s FROM generate_series(0, 5) g(i) WHERE i * 576 < 1500), c AS (SELECT DISTINCT greatest(0, least(i * 576 + 640, 2100) - 640) AS s FROM generate_series(0, 5) g(i) WHERE i * 576 < 2100)
SELECT 'uav_' || lpad((row_number() OVER (ORDER BY r.s, c.s) - 1)::VARCHAR, 5, '0') AS tile_id, r.s::INTEGER AS row_start, c.s::INTEGER AS col_start, least(r.s + 640, 1500)::INTEGER AS row_end, least(c.s + 640, 2100)::INTEGER AS col_end FROM r, c""")
def tile_map(spark, sf_dir):
    """A tile map written as JSON and read back."""
    grid = tiles.tile_ids(tiles.tile_grid_for(spark, 1500, 2100, 640, 0.1), "uav")
    path = scratch(spark, "tiles")
    grid.agg(F.collect_list(F.struct("tile_id", "row_start", "col_start", "row_end", "col_end")).alias("tiles")).coalesce(1).write.json(path)
    return files.tile_coordinates(spark, path).select("tile_id", "row_start", "col_start", "row_end", "col_end")


@query("label_files", f"""WITH {A.LABELS_SQL} SELECT 'tile_' || tile AS tile_id, count(*) AS n, count(*) FILTER (WHERE trim(line) <> '') AS filled FROM lines GROUP BY 1""")
def label_files(spark, sf_dir):
    """Label files, one a tile, read as a folder."""
    path = scratch(spark, "labels")
    by_tile = A.label_lines(spark, sf_dir).groupBy("tile").agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    for r in by_tile.toLocalIterator():  # fifty tiles
        sinks.write_text(spark, f"{path}/tile_{r['tile']}.txt", r["text"] + "\n")
    t = files.label_folder(spark, path)
    return t.groupBy("tile_id").agg(F.count("*").alias("n"), F.count_if(F.trim("line") != "").alias("filled"))


@query("probability_store", f"""WITH {A.PIXELS_SQL} SELECT (20240101 + vec_id % 3)::INTEGER AS date, vec_id, count(*) AS n, sum((v >= 0.1)::INTEGER) AS hits FROM px WHERE vec_id % 4 <> 3 GROUP BY ALL""")
def probability_store(spark, sf_dir):
    """Probability maps by date, thresholded; folders whose name is no date are no maps."""
    px = A.patch_pixels(spark, sf_dir).withColumnRenamed("v", "p")
    path = scratch(spark, "prob")
    date = F.when(F.col("vec_id") % 4 == 3, "draft").otherwise((20240101 + F.col("vec_id") % 3).cast("string"))
    sinks.write_chunks(px.withColumn("date", date), path)
    t = files.probability_maps(spark, path, 0.1)
    return t.groupBy(F.col("date").cast("int").alias("date"), "vec_id").agg(F.count("*").alias("n"), F.sum("p").alias("hits"))


@query("kml_placemarks", f"""WITH {A.SITES_SQL} SELECT 'site ' || site AS name, round(greatest(100.0, 0.0004 * 0.0002 * 111319.0 * 111319.0), 3) AS area_m2, round(x / 10000 + 0.0002, 7) AS lon, round(y / 10000 + 0.0001, 7) AS lat FROM site""")
def kml_placemarks(spark, sf_dir):
    """Rectangles as a KML file, which is one document."""
    corner = lambda a, b: F.struct((F.col("x") / 10000 + a).alias("x"), (F.col("y") / 10000 + b).alias("y"))
    ring = F.array(*[corner(a, b) for a, b in ((0.0, 0.0), (0.0004, 0.0), (0.0004, 0.0002), (0.0, 0.0002), (0.0, 0.0))])
    path = scratch(spark, "kml")
    sinks.write_kml(spark, f"{path}/doc.kml", A.sites(spark, sf_dir), F.concat(F.lit("site "), F.col("site").cast("string")), ring)
    return files.placemarks(spark, path).select("name", F.round("area_m2", 3).alias("area_m2"), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("report_csv", f"WITH {A.SITES_SQL} SELECT site, date, round(area_m2, 1) AS area_m2 FROM site")
def report_csv(spark, sf_dir):
    """The sorted report; a column that the table lacks is left out."""
    path = scratch(spark, "report")
    sinks.write_report(A.sites(spark, sf_dir), path, [F.desc("area_m2"), F.col("site")], ["site", "date", "area_m2", "absent"])
    return spark.read.option("header", True).schema("site long, date string, area_m2 double").csv(path).withColumn("area_m2", F.round("area_m2", 1))


@query("summary_json", f"WITH {A.SITES_SQL} SELECT count(*) AS total_sites, round(sum(area_m2) / 10000, 2) AS total_area_ha FROM site")
def summary_json(spark, sf_dir):
    path = scratch(spark, "summary")
    sinks.write_summary(A.sites(spark, sf_dir).agg(F.count("*").alias("total_sites"), F.round(F.sum("area_m2") / 10000, 2).alias("total_area_ha")), path)
    assert files.read_json(spark, path + "-absent").isEmpty()
    return files.read_json(spark, path).select("total_sites", "total_area_ha")


@query("split_store", f"WITH {A.SITES_SQL} SELECT CASE site % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(site)::BIGINT AS sites FROM site GROUP BY 1")
def split_store(spark, sf_dir):
    path = scratch(spark, "split")
    split = F.when(F.col("site") % 5 == 0, "test").when(F.col("site") % 5 == 1, "val").otherwise("train")
    sinks.write_split(A.sites(spark, sf_dir).select("site", split.alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("site").alias("sites"))


@query("resumed_table", f"WITH {A.SITES_SQL} SELECT 'first' AS run, count(*) AS n FROM site UNION ALL SELECT 'again', count(*) FROM site UNION ALL SELECT 'other', count(*) FILTER (WHERE site % 2 = 0) FROM site")
def resumed_table(spark, sf_dir):
    """A stage's table is built once for its settings, and anew for others."""
    path, rows = scratch(spark, "stage"), A.sites(spark, sf_dir).select("site")
    first = sinks.resume(spark, path, {"half": False}, lambda: rows)
    again = sinks.resume(spark, path, {"half": False}, lambda: rows.limit(0))
    other = sinks.resume(spark, path, {"half": True}, lambda: rows.where("site % 2 = 0"))
    runs = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("run"), "n") for k, t in (("first", first), ("again", again), ("other", other))]
    return runs[0].union(runs[1]).union(runs[2])


@query("geotiff_blocks", f"""WITH {A.PIXELS_SQL} SELECT vec_id, 1 + row // 4 AS band, row % 4 AS row, col, CASE WHEN v < -0.2 THEN NULL ELSE round(v, 5) + 0.0 END AS v, '20240' || (101 + vec_id % 9) AS date FROM px""")
def geotiff_blocks(spark, sf_dir):
    """Each patch as a file of two bands with a nodata value, decoded from its bytes."""
    import pandas as pd

    def write(frames):
        import os

        for f in frames:
            out = []
            for i, data in zip(f["vec_id"], f["data"]):
                x = np.array(data, np.float32).reshape(2, 4, 8)
                with tempfile.TemporaryDirectory() as folder:
                    place = os.path.join(folder, "x.tif")
                    geotiff.write_array(place, np.where(x < -0.2, np.float32(-9), x), (10.0, 0.0, 5.0, 0.0, -10.0, 7.0), 32630, -9.0, ("lzw", "deflate", "none")[i % 3], 16)
                    with open(place, "rb") as file:
                        out.append((f"/scenes/{i}_20240{101 + i % 9}.tif", file.read()))
            yield pd.DataFrame(out, columns=["path", "content"])

    found = A.patches(spark, sf_dir).select("vec_id", "data").mapInPandas(write, "path string, content binary")
    px = geotiff.pixels(geotiff.decode_blocks(found))
    vec = F.regexp_extract("path", r"/(\d+)_", 1).cast("long")
    return px.select(vec.alias("vec_id"), "band", "row", "col", (F.round("v", 5) + 0.0).alias("v"), "date")


_NAMES = "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS size, strftime(l_shipdate, '%Y%m%d') AS d FROM lineitem"


@query("dates_in_names", f"SELECT l_orderkey, l_linenumber, CASE WHEN d LIKE '20%' THEN d END AS date FROM (SELECT l_orderkey, l_linenumber, strftime(l_shipdate + INTERVAL 6 YEAR, '%Y%m%d') AS d FROM lineitem)")
def dates_in_names(spark, sf_dir):
    day = F.date_format(F.add_months("l_shipdate", 72), "yyyyMMdd")
    path = F.concat(F.lit("/data/scene_"), day, F.lit("_v1.tif"))
    return A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", files.date_column(path).alias("date"))


@query("largest_drone_file", "SELECT 'f' || arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS name FROM part")
def largest_drone_file(spark, sf_dir):
    p = A.read(spark, sf_dir, "part")
    return files.largest_file(p.select(F.concat(F.lit("f"), F.col("p_partkey")).alias("path"), (F.col("p_retailprice") * 1000000 + F.col("p_partkey")).alias("length"))).select(F.col("path").alias("name"))


@query("landsat_bands", """SELECT 'LC08_L2SP_193056_20200' || (101 + p_partkey % 800) || '_02_T1' AS scene, '20200' || (101 + p_partkey % 800) AS date, (1 + p_partkey % 9)::INTEGER AS band, count(*) AS n FROM part WHERE p_partkey % 9 BETWEEN 1 AND 6 GROUP BY ALL""")
def landsat_bands(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("LC08_L2SP_193056_20200"), 101 + k % 800, F.lit("_02_T1_SR_B"), 1 + k % 9, F.lit(".TIF"))
    f = A.read(spark, sf_dir, "part").select(name.alias("name"), F.concat(F.lit("/d/"), name).alias("path"))
    return files.landsat_scenes(f).groupBy("scene", "date", "band").agg(F.count("*").alias("n"))


@query("safe_band_files", """WITH f AS (SELECT p_partkey // 12 AS s, ['B02', 'B03', 'B04', 'B08', 'B11', 'B12'][1 + p_partkey % 6] AS band, CASE WHEN p_partkey % 12 < 6 THEN 20 ELSE 10 END AS m FROM part WHERE p_partkey % 5 <> 0),
w AS (SELECT *, abs(m - CASE WHEN band IN ('B11', 'B12') THEN 20 ELSE 10 END) AS gap FROM f), b AS (SELECT s, band, arg_min(m, gap * 100 + m) AS m FROM w GROUP BY ALL)
SELECT s::VARCHAR AS scene, band, m::INTEGER AS m FROM b WHERE s IN (SELECT s FROM b GROUP BY s HAVING count(*) >= 3)""")
def safe_band_files(spark, sf_dir):
    """Bands of scene folders at the resolution that is wanted, or the nearest to it."""
    k = F.col("p_partkey")
    band = F.element_at(F.array(*[F.lit(b) for b in ("B02", "B03", "B04", "B08", "B11", "B12")]), (1 + k % 6).cast("int"))
    name = F.concat(F.lit("T30_20240101T1_"), band, F.lit("_"), F.when(k % 12 < 6, "20").otherwise("10"), F.lit("m.jp2"))
    scene = F.concat(F.lit("S2A_MSI_20240101T1_x"), F.floor(k / 12))
    f = A.read(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(name.alias("name"), F.concat(F.lit("/s/"), scene, F.lit(".SAFE/G/"), name).alias("path"))
    out = files.safe_bands(f, {"B02": 10, "B03": 10, "B04": 10, "B08": 10, "B11": 20, "B12": 20})
    return out.select(F.regexp_extract("scene", r"_x(\d+)$", 1).alias("scene"), "band", F.regexp_extract("path", r"_(\d\d)m\.jp2$", 1).cast("int").alias("m"))


@query("footprint_zone", f"WITH {A.SITES_SQL} SELECT (32600 + floor((avg(-30 + x / 200) + 180) / 6) + 1)::INTEGER AS epsg FROM site")
def footprint_zone(spark, sf_dir):
    return files.footprint_epsg(A.sites(spark, sf_dir).select((5 + F.col("y") / 8000).alias("lat"), (-30 + F.col("x") / 200).alias("lon")))


@query("geolocation_points", """WITH g AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, greatest(1, count(*) OVER () // 25) AS n FROM part)
SELECT p_partkey::INTEGER AS line, round(p_partkey / 1000.0, 6) AS lat FROM g WHERE i % n = 0""")
def geolocation_points(spark, sf_dir):
    """About 25 control points of an annotation file with one a part."""
    path = scratch(spark, "grid")
    k = F.col("p_partkey").cast("int")
    p = A.read(spark, sf_dir, "part").select(k.alias("line"), (k % 7).alias("pixel"), (k / 1000).alias("latitude"), (k / 500).alias("longitude"))
    p.coalesce(1).write.format("xml").option("rootTag", "geolocationGridPointList").option("rowTag", "geolocationGridPoint").save(path)
    return files.geolocation_grid(spark, path).select("line", F.round("lat", 6).alias("lat"))


@query("image_labels", f"""WITH {A.LABELS_SQL} SELECT t AS tile, coalesce(string_agg(line, chr(10) ORDER BY line), '') AS label FROM generate_series(0, 59) g(t) LEFT JOIN lines ON tile = t GROUP BY 1""")
def image_labels(spark, sf_dir):
    images = spark.range(60).select(F.col("id").alias("tile"))
    return labels.images_with_labels(images, A.label_lines(spark, sf_dir), "tile")


@query("tile_dataset", f"""WITH {A.PIXELS_SQL}, t AS (SELECT r.i AS row_start, c.i AS col_start FROM (VALUES (0), (2), (4)) r(i), (VALUES (0), (2), (4)) c(i)),
z AS (SELECT vec_id, row, col, CASE WHEN v < -0.15 THEN NULL ELSE v END AS v FROM px),
k AS (SELECT vec_id, row_start, col_start FROM z JOIN t ON row >= row_start AND row < row_start + 4 AND col >= col_start AND col < col_start + 4 GROUP BY ALL HAVING avg((v IS NULL)::INTEGER) <= 0.1)
SELECT vec_id, row_start, col_start, 'tile_' || lpad((row_number() OVER (PARTITION BY vec_id ORDER BY row_start, col_start) - 1)::VARCHAR, 5, '0') AS tile_id FROM k""")
def tile_dataset(spark, sf_dir):
    """Tiles that pass the quality filter, numbered after it."""
    px = A.patch_pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") >= -0.15, F.col("v")))
    grid = tiles.tile_grid_for(spark, A.PATCH, A.PATCH, 4, 0.5)
    kept = tiles.tile_quality(tiles.pixels_of_tiles(grid, px, 4), ["vec_id", "row_start", "col_start"], ["v"], 0.1, 0.0)
    return tiles.tile_ids(tiles.number_kept(kept, ["vec_id"]), "tile").select("vec_id", "row_start", "col_start", "tile_id")


@query("focal_entropy", f"""WITH base AS (SELECT * FROM (WITH {A.PIXELS_SQL} SELECT vec_id, row, col, greatest(0, least(1, v * 2 + 0.5)) AS v FROM px)), px AS (SELECT * FROM base), {_window_sql(_SYMMETRIC)},
b AS (SELECT vec_id, row, col, least(15, floor(u * 16)) AS bin, count(*) / 25 AS p FROM n GROUP BY ALL) SELECT vec_id, row, col, round(-sum(p * log2(p + 1e-12)), 5) AS entropy FROM b GROUP BY ALL""")
def focal_entropy(spark, sf_dir):
    from .flows import filter_band

    px = A.patch_pixels(spark, sf_dir).withColumn("v", F.col("v") * 2 + 0.5)
    out = filter_band(px, ("vec_id",), "v", lambda x: grids.local_entropy(x, 5, eps=1e-12), 4)
    return out.select("vec_id", "row", "col", F.round("v", 5).alias("entropy"))


@query("joint_stretch", f"""WITH {A.BANDS_SQL}, q AS (SELECT quantile_cont(v, [0.02, 0.98]) AS p FROM (SELECT blue AS v FROM bands UNION ALL SELECT green FROM bands UNION ALL SELECT nir FROM bands))
SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, (blue - p[1]) / (p[2] - p[1]))), 9) AS blue, round(greatest(0, least(1, (green - p[1]) / (p[2] - p[1]))), 9) AS green, round(greatest(0, least(1, (nir - p[1]) / (p[2] - p[1]))), 9) AS nir FROM bands, q""")
def joint_stretch(spark, sf_dir):
    """One pair of percentiles over all bands, as for drone images."""
    names = ["blue", "green", "nir"]
    return pixels.stretch(A.bands(spark, sf_dir), names, joint=True).select("l_orderkey", "l_linenumber", *[F.round(n, 9).alias(n) for n in names])


@query("scene_gapfill", f"WITH {A.BANDS_SQL} SELECT l_orderkey, l_linenumber, round(coalesce(red, (SELECT median(red) FROM bands)), 9) AS red FROM bands")
def scene_gapfill(spark, sf_dir):
    """Gaps of a single date take the scene's median."""
    return pixels.fill_from_scene(A.bands(spark, sf_dir), ["red"]).select("l_orderkey", "l_linenumber", F.round("red", 9).alias("red"))


@query("scored_chunks", f"WITH {A.PIXELS_SQL} SELECT vec_id, (row * 8 + col)::INTEGER AS pos, round(1 / (1 + exp(-4 * v)), 6) AS p FROM px")
def scored_chunks(spark, sf_dir):
    """A model over chunks, loaded once a partition."""
    out = scoring_models.score_chunks(A.patches(spark, sf_dir), lambda: lambda x: 1 / (1 + np.exp(-4 * x)))
    return out.select("vec_id", F.posexplode("prob").alias("pos", "p")).withColumn("p", F.round("p", 6))


@query("scored_boxes", f"""WITH {A.PIXELS_SQL}, t AS (SELECT vec_id, arg_max(row, v) AS r, arg_max(col, v) AS c, max(v) AS p FROM px GROUP BY 1)
SELECT vec_id, 0 AS class_id, round(p, 6) AS confidence, c + 100.0 AS x1, r + 200.0 AS y1, c + 101.0 AS x2, r + 201.0 AS y2 FROM t""")
def scored_boxes(spark, sf_dir):
    """A detector over chunks, whose boxes move to the image."""

    def load():
        def find(image):
            r, c = np.unravel_index(np.argmax(image), image.shape)
            return [(0, image[r, c], float(c), float(r), c + 1.0, r + 1.0)]

        return find

    chunks = A.patches(spark, sf_dir).withColumns({"row0": F.lit(200.0), "col0": F.lit(100.0)})
    return scoring_models.score_boxes(chunks, load, ["vec_id"]).withColumn("confidence", F.round("confidence", 6))


@query("spectral_mask", f"""WITH {A.PIXELS_SQL}, i AS (SELECT 0 AS d, (vec_id // 25 * 8 + row)::INTEGER AS row, (vec_id % 25 * 8 + col)::INTEGER AS col, v FROM px),
m0 AS (SELECT d, row, col, ((CASE WHEN v > 0 THEN greatest(-1, least(1, (0.5 + v - 0.5) / (1.0 + v + 1e-8))) ELSE 0 END) < 0.25 AND v * 2 + 0.5 > 0.55)::INTEGER AS o FROM i),
{_morph_sql('m0', 'm1', 1, 1)}, {_morph_sql('m1', 'm2', 1, 9)}, {_morph_sql('m2', 'm3', 1, 9)}, {_morph_sql('m3', 'm4', 1, 1)} SELECT row, col, o AS mask FROM m4""")
def spectral_mask(spark, sf_dir):
    """Pseudo-labels on one image of all patches, 25 in a row, by chunks smaller than it."""
    from .flows import spectral_pseudo_label

    v, at = F.col("v"), F.col("vec_id")
    nir = F.when(v > 0, 0.5 + v).otherwise(0.5)
    px = A.patch_pixels(spark, sf_dir)
    px = px.select((F.floor(at / 25) * 8 + F.col("row")).cast("int").alias("row"), (at % 25 * 8 + F.col("col")).cast("int").alias("col"), nir.alias("nir"), F.lit(0.5).alias("red"), (v * 3 + 0.5).alias("blue"), (v * 3 + 0.5).alias("green"))
    return spectral_pseudo_label(px, 3, 16)


@query("clip_to_ring", f"""WITH {A.PIXELS_SQL}, c AS (SELECT *, 100 + (col + 0.5) * 10 AS x, 500 - (row + 0.5) * 10 AS y FROM px), n AS (SELECT * FROM c WHERE x BETWEEN 105 AND 165 AND y BETWEEN 432 AND 498),
s AS (SELECT n.*, x1, y1, x2, y2 FROM n, (VALUES (105, 432, 165, 450), (165, 450, 130, 498), (130, 498, 105, 432)) e(x1, y1, x2, y2))
SELECT vec_id, row, col, CASE WHEN count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 THEN round(v, 6) END AS v FROM s GROUP BY vec_id, row, col, v""")
def clip_to_ring(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((105, 432), (165, 450), (130, 498), (105, 432))])
    out = pixels.clip_to_ring(A.patch_pixels(spark, sf_dir), ring, (10, 0, 100, 0, -10, 500), ["v"])
    return out.select("vec_id", "row", "col", F.round("v", 6).alias("v"))


@query("pixel_centres", f"WITH {A.SITES_SQL} SELECT site, round(-1.5 + x / 10000, 7) AS lon, round(5.0 + y / 8000, 7) AS lat FROM site")
def pixel_centres(spark, sf_dir):
    """Centres of the pixels of a grid of centimetres on the site's zone, back in degrees."""
    from .flows import pixel_lonlat

    u = A.sites(spark, sf_dir).select("site", (-1.5 + F.col("x") / 10000).alias("lon"), (5.0 + F.col("y") / 8000).alias("lat"))
    e, n = G.to_utm(F.col("lon"), F.col("lat"), F.lit(32630))
    grid = u.select("site", (e / 10 - 0.5).alias("col"), ((2_000_000 - n) / 10 - 0.5).alias("row"))
    return pixel_lonlat(grid, (10, 0, 0, 0, -10, 2_000_000), 32630).select("site", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))
