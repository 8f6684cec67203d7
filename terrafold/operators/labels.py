"""Box-label lines: parsing, validation, matching with tiles, georeferencing, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import pixel_to_map


def parse_line(line: Column) -> Column:
    """struct(class_id, cx, cy, w, h) of exactly five tokens, an integer and four numbers; else null."""
    t = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    whole = F.element_at(t, 1).rlike(r"^[+-]?\d+$")
    number = lambda i: F.try_element_at(t, F.lit(i)).try_cast("double")
    fields = F.struct(F.try_element_at(t, F.lit(1)).try_cast("int").alias("class_id"), *[number(i).alias(n) for i, n in ((2, "cx"), (3, "cy"), (4, "w"), (5, "h"))])
    ok = (F.size(t) == 5) & whole
    for i in range(2, 6):
        ok = ok & number(i).isNotNull()
    return F.when(ok, fields)


def issue(box: Column, classes: int) -> Column:
    """What is wrong with a parsed line; null if nothing is."""
    out = F.when(box.isNull(), "malformed").when((box["class_id"] < 0) | (box["class_id"] >= classes), "bad class")
    for n in ("cx", "cy", "w", "h"):
        out = out.when((box[n] < 0) | (box[n] > 1) | F.isnan(box[n]), f"{n} out of range")
    return out


def validate(lines: DataFrame, text: str, classes: int) -> DataFrame:
    """lines plus box and issue; blank lines, which are valid, are left out."""
    kept = lines.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "")
    return kept.withColumn("box", parse_line(F.col(text))).withColumn("issue", issue(F.col("box"), classes))


def correspond(labels: DataFrame, tiles: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Labels with and without a tile."""
    names = tiles.select(key).distinct()
    return labels.join(names, key, "left_semi"), labels.join(names, key, "left_anti")


def canonical_line(box: Column) -> Column:
    return F.format_string("%d %.6f %.6f %.6f %.6f", box["class_id"], box["cx"], box["cy"], box["w"], box["h"])


def georeference(labels: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """labels(key, box) with tiles(key, image_width, image_height, transform array<double>): map
    corners and centre of each box, to eight decimals."""
    rows = labels.join(tiles, key)
    t = tuple(F.col("transform")[i] for i in range(6))
    x = lambda f: f * F.col("image_width")
    y = lambda f: f * F.col("image_height")
    b = F.col("box")
    centre = pixel_to_map(x(b["cx"]), y(b["cy"]), t)
    low = pixel_to_map(x(b["cx"] - b["w"] / 2), y(b["cy"] - b["h"] / 2), t)
    high = pixel_to_map(x(b["cx"] + b["w"] / 2), y(b["cy"] + b["h"] / 2), t)
    r = lambda c: F.round(c, 8)
    return rows.withColumns(
        {
            "map_x": r(centre[0]), "map_y": r(centre[1]), "min_x": r(F.least(low[0], high[0])), "max_x": r(F.greatest(low[0], high[0])),
            "min_y": r(F.least(low[1], high[1])), "max_y": r(F.greatest(low[1], high[1])),
        }
    )


def annotation_rate(annotated: Column, total: Column) -> Column:
    return F.round(100 * annotated / F.greatest(total, F.lit(1)), 2)


def pseudo_labels(points_in_tiles: DataFrame, tile: str) -> DataFrame:
    """A class-0 box of a tenth of the tile around each point."""
    return points_in_tiles.select(tile, F.struct(F.lit(0).alias("class_id"), F.col("cx").cast("double"), F.col("cy").cast("double"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h")).alias("box"))


def images_with_labels(images: DataFrame, lines: DataFrame, key: str, text: str = "line") -> DataFrame:
    """images plus label: the image's lines in order, one below the other; empty for one without any."""
    found = lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("label"))
    return images.join(found, key, "left").withColumn("label", F.coalesce("label", F.lit("")))
