"""Sources: boundaries, ground truth, tile maps, label folders, placemarks, scene folders, settings."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATE = r"(?<!\d)(20\d{6})(?!\d)"
_DATE_COMPAT = r"\b(20\d{6})\b"
RINGS = "array<array<array<double>>>"


def date_in_name(name: str, compat: bool = False) -> str | None:
    """The yyyymmdd in a file name; compat wants a word boundary, which an underscore is not."""
    m = re.search(_DATE_COMPAT if compat else _DATE, name)
    return m[1] if m else None


def date_column(path: Column, compat: bool = False) -> Column:
    found = F.regexp_extract(path, _DATE_COMPAT if compat else _DATE, 1)
    return F.when(found != "", found)


_FEATURE = "properties map<string,string>, geometry struct<type:string,coordinates:string>"
#: Longest first and last line of a collection with a feature a line; longer ones are whole documents.
_EDGE = 1 << 16


def _feature_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """(feature_id, f) of the files whose first and last line are a collection without features and
    whose other lines are a feature each, and the names of these files and of all others."""
    object_ = F.regexp_replace("value", r"^\s*,|,\s*$", "")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    short = F.when(F.length("value") <= _EDGE, F.col("value"))
    # a feature on a line of its own; a document on one line is a collection, not a feature
    whole = F.from_json(object_, "type string, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    feature = (whole["type"] == "Feature") & whole["__bad"].isNull()
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("m").alias("m0"), F.count_if(feature).alias("features"), F.min_by(short, "m").alias("first"), F.max_by(short, "m").alias("last"))
    by_file: dict = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["file"], r["block"])):  # one a split
        by_file.setdefault(r["file"], []).append(r)
    by_line, other, starts = [], [], []
    for file, found in by_file.items():
        try:
            edges = json.loads((found[0]["first"] or "") + (found[-1]["last"] or ""))
        except ValueError:
            edges = None
        if not isinstance(edges, dict) or edges.get("features") != [] or sum(r["n"] - r["features"] for r in found) != 2:
            other.append(file)
            continue
        by_line.append(file)
        before = -1  # the first line
        for r in found:
            starts.append((file, r["block"], before - r["m0"]))
            before += r["n"]
    at = spark.createDataFrame(starts, "file string, block long, shift long")
    rows = lines.join(F.broadcast(at), ["file", "block"]).where(feature)
    return rows.select((F.col("m") + F.col("shift")).cast("int").alias("feature_id"), F.from_json(object_, _FEATURE).alias("f")), by_line, other


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, properties map, type, rings) of a FeatureCollection; of a multi-polygon each
    polygon is a row. rings holds arrays of (x, y) structs. A missing file raises.

    Files with a feature a line, as the sink and common tools write them, are read by splits; in any
    other layout a file is parsed as a whole, in one task."""
    read, by_line, other = _feature_lines(spark, path)
    if other or not by_line:
        raw = spark.read.option("multiLine", True).schema(f"features array<struct<{_FEATURE.replace(' map', ':map').replace(' struct', ':struct')}>>").json(path)
        if by_line:
            raw = raw.where(F.col("_metadata.file_path").isin(other))
        raw = raw.select(F.posexplode("features").alias("feature_id", "f"))
        read = read.unionByName(raw) if by_line else raw
    f = read.select("feature_id", "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", RINGS)))
    many = F.when(F.col("type") == "MultiPolygon", F.from_json("c", f"array<{RINGS}>"))
    point = F.when(F.col("type") == "Point", F.array(F.array(F.array(F.from_json("c", "array<double>")))))
    polys = f.withColumn("p", F.explode(F.coalesce(one, many, point)))
    return polys.select("feature_id", "properties", "type", F.transform("p", lambda r: F.transform(r, lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))).alias("rings"))


def ground_truth(spark: SparkSession, path: str, boundary: DataFrame | None = None) -> DataFrame:
    """Points of a CSV with latitude and longitude; absent columns take their defaults. With a
    boundary of rings, points outside all outer rings go."""
    from ..functions.geometry import point_in_ring

    rows = spark.read.option("header", True).csv(path)
    for c in ("latitude", "longitude"):
        if c not in rows.columns:
            raise ValueError(f"{path} has no column {c}")
    # What absent columns of a ground-truth table hold.
    defaults = {"site_type": "galamsey", "active_status": "unknown", "size_m2": "0", "notes": "", "date": None}
    for c, d in defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d))
    rows = rows.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("latitude", "longitude", "size_m2")}).where("latitude is not null and longitude is not null")
    if boundary is None:
        return rows
    rings = boundary.select(F.col("rings")[0].alias("__ring"))
    xs, ys = F.transform("__ring", lambda p: p["x"]), F.transform("__ring", lambda p: p["y"])
    boxed = rings.withColumns({"__x0": F.array_min(xs), "__x1": F.array_max(xs), "__y0": F.array_min(ys), "__y1": F.array_max(ys)})
    near = (F.col("longitude").between(F.col("__x0"), F.col("__x1"))) & (F.col("latitude").between(F.col("__y0"), F.col("__y1")))
    return rows.join(boxed, near & point_in_ring(F.col("longitude"), F.col("latitude"), F.col("__ring")), "left_semi")


def tile_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """One row a tile id; of repeated ids the last stands."""
    schema = """tiles array<struct<tile_id:string,image_file:string,image_width:int,image_height:int,actual_width_px:int,actual_height_px:int,col_start:int,row_start:int,col_end:int,row_end:int,
    georeferencing:struct<crs:string,epsg:int,min_lon:double,max_lon:double,min_lat:double,max_lat:double,center_lon:double,center_lat:double,pixel_to_geo_transform:array<double>>>>"""
    t = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("tiles").alias("i", "t"))
    return t.groupBy(F.col("t.tile_id").alias("tile_id")).agg(F.max_by("t", "i").alias("t")).select("tile_id", *[f"t.{c}" for c in ("image_file", "image_width", "image_height", "actual_width_px", "actual_height_px", "col_start", "row_start", "col_end", "row_end", "georeferencing")])


def label_folder(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, line) of every text file of a folder. A missing folder raises."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1)
    return spark.read.option("pathGlobFilter", "*.txt").text(path).select(name.alias("tile_id"), F.col("value").alias("line"))


def placemarks(spark: SparkSession, path: str, least_area: float = 100.0) -> DataFrame:
    """(name, ring, area_m2, lon, lat) of a KML file's polygons, folders at any depth. The area is
    that of the ring in degrees, scaled, and at least least_area; the centre is the mean vertex."""
    from ..functions.geometry import ring_area

    metres = 111_319
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>, MultiGeometry struct<Polygon:array<struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>>>").load(path)
    text = F.explode(F.filter(F.concat(F.array("Polygon.outerBoundaryIs.LinearRing.coordinates"), F.coalesce(F.col("MultiGeometry.Polygon.outerBoundaryIs.LinearRing.coordinates"), F.array().cast("array<string>"))), lambda c: c.isNotNull()))
    point = lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y"))
    rows = rows.select("name", text.alias("c")).withColumn("ring", F.transform(F.split(F.trim(F.regexp_replace("c", r"\s+", " ")), " "), point)).where("size(ring) >= 4")
    inner = F.slice("ring", 1, F.size("ring") - 1)
    mean = lambda k: F.aggregate(inner, F.lit(0.0), lambda s, p: s + p[k]) / F.size(inner)
    return rows.select("name", "ring", F.greatest(F.lit(least_area), ring_area(F.col("ring")) * metres * metres).alias("area_m2"), mean("x").alias("lon"), mean("y").alias("lat"))


def scene_files(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """(path, name, length, date) of a folder's files, without their content."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("name"), "length", date_column(name).alias("date"))


def largest_file(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("length", "path")).alias("path"), F.max("length").alias("length"))


def safe_bands(files: DataFrame, bands: dict[str, int]) -> DataFrame:
    """One file a scene and band of SAFE folders, the finest resolution first; scenes with fewer
    than three bands go. bands: name to the resolution that is wanted, in metres."""
    band = F.regexp_extract("name", r"_(B\d[0-9A])(?:_(\d\d)m)?\.(?:jp2|tif)$", 1)
    metres = F.regexp_extract("name", r"_(\d\d)m\.(?:jp2|tif)$", 1)
    scene = F.regexp_extract("path", r"([^/]+)\.SAFE/", 1)
    wanted = F.create_map(*[F.lit(v) for kv in bands.items() for v in kv])
    rows = files.select(scene.alias("scene"), F.split(scene, "_")[2].substr(1, 8).alias("date"), band.alias("band"), "path", F.coalesce(metres.try_cast("int"), F.lit(99)).alias("m"))
    rows = rows.where(F.col("scene") != "").where(F.col("band").isin(*bands))
    best = rows.groupBy("scene", "date", "band").agg(F.min_by("path", F.struct(F.abs(F.col("m") - F.try_element_at(wanted, F.col("band"))), "path")).alias("path"))
    enough = best.groupBy("scene").agg(F.count("*").alias("n")).where("n >= 3").select("scene")
    return best.join(enough, "scene", "left_semi")


def landsat_scenes(files: DataFrame) -> DataFrame:
    """Bands 2-7 of LC0* scenes with the acquisition date from their name."""
    scene, band = F.regexp_extract("name", r"^(LC0.*?)_(?:SR_)?B([2-7])\.(?:TIF|tif)$", 1), F.regexp_extract("name", r"^(LC0.*?)_(?:SR_)?B([2-7])\.(?:TIF|tif)$", 2)
    return files.select(scene.alias("scene"), F.substring(scene, 18, 8).alias("date"), band.try_cast("int").alias("band"), "path").where("scene <> ''")


def geolocation_grid(spark: SparkSession, path: str) -> DataFrame:
    """(line, pixel, lat, lon) control points of a radar annotation file, every n-th of them so
    that about 25 remain."""
    p = spark.read.format("xml").option("rowTag", "geolocationGridPoint").schema("line int, pixel int, latitude double, longitude double").load(path)
    n = p.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 25)).alias("n"))
    from ..operators.components import rank_rows

    numbered = rank_rows(p, "i", "line", "pixel")
    return numbered.crossJoin(F.broadcast(n)).where("i % n = 0").select("line", "pixel", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def footprint_epsg(points: DataFrame) -> DataFrame:
    """UTM zone of the mean of lat, lon; 32630 without points."""
    from ..functions.geometry import utm_epsg

    m = points.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return m.select(F.coalesce(utm_epsg(F.col("lat"), F.col("lon")), F.lit(32630)).alias("epsg"))


def fit_warp(points, order: int = 2):
    """Least-squares polynomials from map (x, y) to (line, pixel) on the few control points; gives
    a function of numpy x and y."""
    import numpy as np

    p = points.toPandas() if hasattr(points, "toPandas") else points
    x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)
    mx, my, sx, sy = x.mean(), y.mean(), np.ptp(x) or 1, np.ptp(y) or 1
    terms = lambda a, b: np.stack([a**i * b**j for i in range(order + 1) for j in range(order + 1 - i)], -1)
    c = np.linalg.lstsq(terms((x - mx) / sx, (y - my) / sy), p[["line", "pixel"]].to_numpy(float), rcond=None)[0]
    return lambda a, b: terms((np.asarray(a) - mx) / sx, (np.asarray(b) - my) / sy) @ c


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document; an empty table if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], "value string")


def probability_maps(spark: SparkSession, path: str, threshold: float | None = None) -> DataFrame:
    """p(date, row, col, p) of a Parquet table partitioned by date, dates that are numbers only;
    with a threshold, binary."""
    t = spark.read.parquet(path).where(F.col("date").cast("string").rlike("^[0-9]"))
    return t if threshold is None else t.withColumn("p", (F.col("p") >= threshold).cast("int"))


@dataclass(frozen=True)
class Settings:
    """What a run reads from its YAML file, one attribute a value that an operator takes."""

    paths: dict = field(default_factory=dict)
    tile_size: int = 512
    overlap: float = 0.2
    thresholds: dict = field(default_factory=lambda: {"low": 0.3, "medium": 0.5, "high": 0.7})
    least_area_m2: float = 50.0
    weights: dict = field(default_factory=dict)
    satellite_weight: float = 0.6
    uav_weight: float = 0.4
    ransac_rounds: int = 1000
    distance_threshold_m: float = 150.0
    iou_threshold: float = 0.1
    folds: int = 5
    block_m: float = 2000.0
    map_center: tuple = (0.0, 0.0)
    zoom: int = 10


#: Where the values of Settings stand in a settings file: section and key, or the key at the top.
_SECTIONS = {
    "paths": ("paths",),
    "tile_size": ("tiling", "satellite_tile_size"),
    "overlap": ("tiling", "overlap"),
    "thresholds": ("inference", "thresholds"),
    "least_area_m2": ("inference", "min_polygon_area_m2"),
    "weights": ("prioritization", "weights"),
    "satellite_weight": ("fusion", "satellite_weight"),
    "uav_weight": ("fusion", "uav_weight"),
    "ransac_rounds": ("fusion", "ransac_max_iter"),
    "distance_threshold_m": ("change_detection", "distance_threshold_m"),
    "iou_threshold": ("change_detection", "iou_threshold"),
    "folds": ("validation", "spatial_cv_folds"),
    "block_m": ("validation", "block_m"),
    "map_center": ("dashboard", "map_center"),
    "zoom": ("dashboard", "default_zoom"),
}


def load_settings(path: str) -> Settings:
    """The settings of a YAML file, from its sections or from keys of the same name at the top;
    what the file does not say keeps its default. A validation buffer in km gives block_m."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f) or {}
    found = {k: v for k, v in raw.items() if k in Settings.__dataclass_fields__}
    for name, (section, *key) in _SECTIONS.items():
        value = raw.get(section)
        if key:
            value = value.get(key[0]) if isinstance(value, dict) else None
        if value is not None:
            found[name] = value
    buffer_km = (raw.get("validation") or {}).get("spatial_cv_buffer_km")
    if buffer_km is not None and "block_m" not in found:
        found["block_m"] = 1000.0 * buffer_km
    return Settings(**found)


def catalog(spark: SparkSession, tables: dict[str, tuple[str | None, str]]) -> dict[str, DataFrame]:
    """Named tables from (path or None, schema): an absent one is an empty table of its schema."""
    out = {}
    for name, (path, schema) in tables.items():
        out[name] = spark.read.schema(schema).parquet(path) if path else spark.createDataFrame([], schema)
        out[name].createOrReplaceTempView(name)
    return out
