"""Sinks: GeoJSON, CSV and JSON reports, label files, split datasets, resumable tables, a map page."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of a given name, on any file system that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def write_document(spark: SparkSession, path: str, head: str, lines: DataFrame, tail: str, between: str = "") -> None:
    """One text file of a given name and any size: head, the rows of lines(value) with between before
    all but the first, tail. Executors write the rows; the driver's JVM copies their files into one
    as a stream, so neither heap grows with the rows. Their order is that of the partitions."""
    folder, name = path.rsplit("/", 1)
    parts, hadoop, conf = f"{folder}/_{name}.parts", spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    lines.select(F.concat(F.lit(between), "value").alias("value")).write.mode("overwrite").option("compression", "none").text(parts)
    place = hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    found = sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(hadoop.fs.Path(parts)) if s.getPath().getName().startswith("part-") and s.getLen() > 0)
    out = fs.create(place, True)
    out.write(bytearray(head.encode("utf-8")))
    for i, (_, part) in enumerate(found):
        rows = fs.open(part)
        if i == 0:
            rows.seek(len(between.encode("utf-8")))
        hadoop.io.IOUtils.copyBytes(rows, out, conf, False)
        rows.close()
    out.write(bytearray(tail.encode("utf-8")))
    out.close()
    fs.delete(hadoop.fs.Path(parts), True)


def box_polygon(x1, y1, x2, y2) -> Column:
    """GeoJSON geometry of a box, closed, as a struct."""
    p = lambda x, y: F.array(x, y)
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.array(p(x1, y1), p(x2, y1), p(x2, y2), p(x1, y2), p(x1, y1))).alias("coordinates"))


def features(rows: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row, as text."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_geojson_lines(rows: DataFrame, geometry: Column, properties: list[str], path: str, partition: str | None = None) -> None:
    """Newline-delimited features, written by the executors; partition puts a column's values
    into folders of their own."""
    cols = [partition] if partition else []
    out = rows.select(*cols, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))
    w = out.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).text(path)


def feature_collection(rows: DataFrame, geometry: Column, properties: list[str], class_col: str | None = None) -> str:
    """A small result as one FeatureCollection with its counts; for reports, not for tables that
    grow with the input."""
    found = [json.loads(r["value"]) for r in features(rows, geometry, properties).toLocalIterator()]
    meta = {"total_detections": len(found)}
    if class_col:
        meta["classes"] = sorted({f["properties"].get(class_col) for f in found} - {None})
    return json.dumps({"type": "FeatureCollection", "metadata": meta, "features": found})


def write_feature_collection(spark: SparkSession, path: str, rows: DataFrame, geometry: Column, properties: list[str], class_col: str | None = None) -> None:
    """As feature_collection, but as a file of any number of features, each on a line of its own."""
    meta = {"total_detections": rows.count()}
    if class_col:
        meta["classes"] = sorted(r[0] for r in rows.select(class_col).where(F.col(class_col).isNotNull()).distinct().collect())
    head = json.dumps({"type": "FeatureCollection", "metadata": meta, "features": []})
    write_document(spark, path, head.removesuffix("]}") + "\n", features(rows, geometry, properties), "]}\n", ",")


def placemark(name: Column, ring: Column) -> Column:
    """KML of a named polygon; ring is an array of (x, y) structs, closed."""
    text = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    points = F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), F.lit("0"))), " ")
    outline = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), points, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    return F.concat(F.lit("<Placemark><name>"), text, F.lit("</name>"), outline, F.lit("</Placemark>"))


def write_kml(spark: SparkSession, path: str, rows: DataFrame, name: Column, ring: Column) -> None:
    """One KML document, a placemark a row."""
    write_document(spark, path, "<kml><Document><Folder>\n", rows.select(placemark(name, ring).alias("value")), "</Folder></Document></kml>\n")


def write_report(rows: DataFrame, path: str, order: list[Column], columns: list[str]) -> None:
    """One sorted CSV with a header; columns that are not there are left out."""
    rows.select(*[c for c in columns if c in rows.columns]).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_summary(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str, by: str = "date") -> None:
    chunks.write.mode("overwrite").partitionBy(by).parquet(path)


def write_labels(lines: DataFrame, path: str) -> None:
    """(tile_id, line): a folder a tile with its canonical lines."""
    lines.select("tile_id", F.col("line").alias("value")).repartition("tile_id").write.mode("overwrite").partitionBy("tile_id").text(path)


def write_split(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").partitionBy("split").parquet(path)


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def resume(spark: SparkSession, path: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path for these settings, built and written if it is not there in full. The
    settings are part of the place, so that a change of them never meets an old result."""
    place = f"{path}/{settings_hash(settings)}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(place)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def popup(values: dict) -> str:
    """A table of labels and values, escaped."""
    rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape('' if v is None else str(v))}</td></tr>" for k, v in values.items())
    return f"<table>{rows}</table>"


def dashboard(layers: dict[str, str], top: list[dict], title: str = "Sites", centre: tuple[float, float] = (0.0, 0.0), zoom: int = 10) -> str:
    """A page with the given GeoJSON layers drawn as SVG outlines and the ten best sites in a
    panel. It needs no library and no network."""
    panel = "".join(f"<li>{popup(row)}</li>" for row in top[:10])
    data = json.dumps({k: json.loads(v) for k, v in layers.items()}).replace("</", "<\\/")
    return f"""<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title>
<style>body{{margin:0;display:flex;font:13px sans-serif}}svg{{flex:1;height:100vh;background:#eef}}ol{{width:320px;height:100vh;overflow:auto;margin:0}}polygon{{fill-opacity:.4;stroke:#222;stroke-width:.5}}</style></head>
<body data-lat="{centre[0]}" data-lon="{centre[1]}" data-zoom="{zoom}"><svg id="map"></svg><ol>{panel}</ol>
<script>
const layers = {data}, colours = ["#c33", "#36c", "#292", "#c80", "#808"], svg = document.getElementById("map");
let xs = [], ys = [], shapes = [];
Object.entries(layers).forEach(([name, c], i) => c.features.forEach(f => (f.geometry.type === "Polygon" ? [f.geometry.coordinates[0]] : []).forEach(r => {{ shapes.push([name, i, r, f.properties]); r.forEach(p => {{ xs.push(p[0]); ys.push(p[1]); }}); }})));
const x0 = Math.min(...xs), x1 = Math.max(...xs), y0 = Math.min(...ys), y1 = Math.max(...ys);
svg.setAttribute("viewBox", `${{x0}} ${{-y1}} ${{x1 - x0 || 1}} ${{y1 - y0 || 1}}`);
shapes.forEach(([name, i, r, p]) => {{ const e = document.createElementNS("http://www.w3.org/2000/svg", "polygon"); e.setAttribute("points", r.map(q => `${{q[0]}},${{-q[1]}}`).join(" ")); e.setAttribute("fill", colours[i % 5]); e.setAttribute("vector-effect", "non-scaling-stroke"); const t = document.createElementNS("http://www.w3.org/2000/svg", "title"); t.textContent = name + " " + JSON.stringify(p); e.appendChild(t); svg.appendChild(e); }});
</script></body></html>"""
