"""The driver's tables as pixels, series, detections, sites and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATCH = 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patches(spark, sf_dir) -> DataFrame:
    """One 8x8 image a row: vec_id, h, w, data."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.lit(PATCH).alias("h"), F.lit(PATCH).alias("w"), F.transform("embedding", lambda v: v.cast("double")).alias("data"))


def patch_pixels(spark, sf_dir) -> DataFrame:
    p = patches(spark, sf_dir).select("vec_id", F.posexplode("data").alias("pos", "v"))
    return p.select("vec_id", F.floor(F.col("pos") / PATCH).cast("int").alias("row"), (F.col("pos") % PATCH).cast("int").alias("col"), "v")


def bands(spark, sf_dir) -> DataFrame:
    """Pixel (l_orderkey, l_linenumber), scene l_returnflag; every seventh discount is missing."""
    l = read(spark, sf_dir, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("scene"), (F.col("l_quantity") / 50).alias("blue"), (F.col("l_extendedprice") / 100000).alias("green"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount") * 10).alias("red"), (F.col("l_tax") * 10).alias("nir"),
    )


BANDS_SQL = """bands AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS scene, l_quantity / 50 AS blue, l_extendedprice / 100000 AS green,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_discount * 10 END AS red, l_tax * 10 AS nir FROM lineitem)"""
PIXELS_SQL = """px AS (
  SELECT vec_id, ((i - 1) // 8)::INTEGER AS row, ((i - 1) % 8)::INTEGER AS col, embedding[i]::DOUBLE AS v
  FROM embeddings, generate_series(1, 64) g(i))"""


def detections(spark, sf_dir) -> DataFrame:
    """Boxes: class, confidence, corner from the number in props and the user, side 5 to 11."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    side = 5 + F.col("event_id") % 7
    return e.select(
        "event_id", F.col("event_type").alias("class_name"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 500)).alias("confidence"),
        (k * 40).alias("x1"), (F.col("user_id") * 40.0).alias("y1"), (k * 40 + side).alias("x2"), (F.col("user_id") * 40.0 + side).alias("y2"),
    )


DETECTIONS_SQL = """det AS (
  SELECT event_id, event_type AS class_name, least(1.0, greatest(0.0, value / 500)) AS confidence, json_extract_string(props, '$.k')::DOUBLE * 40 AS x1,
    user_id * 40.0 AS y1, json_extract_string(props, '$.k')::DOUBLE * 40 + 5 + event_id % 7 AS x2, user_id * 40.0 + 5 + event_id % 7 AS y2 FROM events)"""


def sites(spark, sf_dir) -> DataFrame:
    """Sites on a 10 km square, dated by brand."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("site"), F.col("p_brand").alias("date"), (F.col("p_partkey") * 7919 % 10007).cast("double").alias("x"), (F.col("p_partkey") * 104729 % 10009).cast("double").alias("y"),
        (F.col("p_size") * 100.0).alias("area_m2"), (F.col("p_partkey") % 4).alias("equipment_count"), (F.col("p_partkey") % 97 / 97).alias("confidence"), (F.col("p_partkey") % 89 / 89).alias("water_proximity"),
    )


SITES_SQL = """site AS (
  SELECT p_partkey AS site, p_brand AS date, (p_partkey * 7919 % 10007)::DOUBLE AS x, (p_partkey * 104729 % 10009)::DOUBLE AS y, p_size * 100.0::DOUBLE AS area_m2,
    p_partkey % 4 AS equipment_count, (p_partkey % 97) / 97.0::DOUBLE AS confidence, (p_partkey % 89) / 89.0::DOUBLE AS water_proximity FROM part)"""


def site_squares(spark, sf_dir, pixel: float = 10.0) -> DataFrame:
    """Outlines of the sites: squares in the shape of an L, one row of 1 to 7 and one column of 1 to
    4, from the square that holds the site's point."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("site"), "p_size")
    at = sites(spark, sf_dir).select("site", F.floor(F.col("y") / pixel).alias("r"), F.floor(F.col("x") / pixel).alias("c")).join(p, "site")
    wide, tall = F.sequence(F.lit(0), (F.col("p_size") % 7).cast("int")), F.sequence(F.lit(0), (F.col("p_size") % 4).cast("int"))
    steps = F.concat(F.transform(wide, lambda i: F.struct(F.lit(0).alias("i"), i.alias("j"))), F.transform(tall, lambda i: F.struct(i.alias("i"), F.lit(0).alias("j"))))
    return at.select("site", "r", "c", F.inline(F.array_distinct(steps))).select("site", (F.col("r") + F.col("i")).alias("row"), (F.col("c") + F.col("j")).alias("col"))


def squares_sql(pixel: int = 10) -> str:
    """The two bars of each L as boxes."""
    x, y = f"floor(x / {pixel}) * {pixel}", f"floor(y / {pixel}) * {pixel}"
    return f"""bar AS (SELECT site, {x} AS bx1, {y} AS by1, {x} + {pixel} * (1 + p_size % 7) AS bx2, {y} + {pixel} AS by2 FROM site JOIN part ON p_partkey = site
  UNION ALL SELECT site, {x}, {y}, {x} + {pixel}, {y} + {pixel} * (1 + p_size % 4) FROM site JOIN part ON p_partkey = site)"""


def machines(spark, sf_dir) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    names = ("excavator", "truck", "water_pump", "settling_pond", "pit")
    of = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("machine"), (F.col("s_suppkey") * 6101 % 10007).cast("double").alias("mx"), (F.col("s_suppkey") * 7001 % 10009).cast("double").alias("my"), of.alias("class_name"))


MACHINES_SQL = """machine AS (
  SELECT s_suppkey AS machine, (s_suppkey * 6101 % 10007)::DOUBLE AS mx, (s_suppkey * 7001 % 10009)::DOUBLE AS my,
    ['excavator', 'truck', 'water_pump', 'settling_pond', 'pit'][s_suppkey % 5 + 1] AS class_name FROM supplier)"""


def truth(spark, sf_dir) -> DataFrame:
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(l, "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("p"))


TRUTH_SQL = "truth AS (SELECT doc_id, quality::INTEGER AS y, least(1.0, n_chars / 5000) AS p FROM documents JOIN labels USING (doc_id))"


def observations(spark, sf_dir) -> DataFrame:
    """Monthly areas of each supplier."""
    l = read(spark, sf_dir, "lineitem")
    m = l.groupBy(F.col("l_suppkey").alias("track"), F.trunc("l_shipdate", "month").alias("date")).agg(
        (F.sum("l_quantity") / 1000).alias("area"), F.avg("l_discount").alias("confidence"), F.count("*").alias("equipment"), F.max("l_returnflag").alias("flag")
    )
    activity = F.when(F.col("flag") == "R", "ACTIVE").when(F.col("flag") == "N", "INACTIVE").otherwise("UNKNOWN")
    return m.withColumn("activity", activity).drop("flag")


OBSERVATIONS_SQL = """obs AS (
  SELECT l_suppkey AS track, date_trunc('month', l_shipdate)::DATE AS date, sum(l_quantity) / 1000 AS area, avg(l_discount) AS confidence, count(*) AS equipment,
    CASE max(l_returnflag) WHEN 'R' THEN 'ACTIVE' WHEN 'N' THEN 'INACTIVE' ELSE 'UNKNOWN' END AS activity FROM lineitem GROUP BY ALL)"""


def label_lines(spark, sf_dir) -> DataFrame:
    """Label lines of which some are malformed, of a bad class or out of range."""
    e = read(spark, sf_dir, "events")
    c = lambda n: F.format_string("%.4f", (F.col("event_id") * n % 1000) / 1000.0)
    line = F.concat_ws(" ", (F.col("event_id") % 6).cast("string"), c(7), c(11), F.format_string("%.4f", (F.col("event_id") * 13 % 1010) / 1000.0), c(17))
    line = F.when(F.col("event_id") % 23 == 0, F.concat(line, F.lit(" 9"))).when(F.col("event_id") % 29 == 0, F.lit("1 0.5 x 0.1 0.1")).when(F.col("event_id") % 31 == 0, F.lit("  ")).otherwise(line)
    return e.select("event_id", (F.col("event_id") % 50).alias("tile"), line.alias("line"))


LABELS_SQL = """lines AS (
  SELECT event_id, event_id % 50 AS tile, CASE WHEN event_id % 23 = 0 THEN l || ' 9' WHEN event_id % 29 = 0 THEN '1 0.5 x 0.1 0.1' WHEN event_id % 31 = 0 THEN '  ' ELSE l END AS line
  FROM (SELECT event_id, printf('%d %.4f %.4f %.4f %.4f', event_id % 6, (event_id * 7 % 1000) / 1000.0::DOUBLE, (event_id * 11 % 1000) / 1000.0::DOUBLE,
    (event_id * 13 % 1010) / 1000.0::DOUBLE, (event_id * 17 % 1000) / 1000.0::DOUBLE) AS l FROM events))"""
