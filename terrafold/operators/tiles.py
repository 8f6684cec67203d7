"""Overlapping tiles and the weighted mosaic of their predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _starts(length: Column, size: int, overlap: float) -> Column:
    stride = max(1, int(size * (1 - overlap)))
    raw = F.transform(F.sequence(F.lit(0), length - 1, F.lit(stride)), lambda s: F.greatest(F.lit(0), F.least(s + size, length) - size))
    return raw


def tile_grid(scenes: DataFrame, size: int, overlap: float, distinct: bool = True) -> DataFrame:
    """scenes(.., height, width) to windows (row_start, col_start, row_end, col_end, pad_r, pad_c),
    numbered row by row from 0 within the scene. Windows at the far edges move back inside;
    distinct=False keeps the repeats that this makes."""
    rows, cols = _starts(F.col("height"), size, overlap), _starts(F.col("width"), size, overlap)
    if distinct:
        rows, cols = F.array_distinct(rows), F.array_distinct(cols)
    out = scenes.select("*", F.posexplode(rows).alias("__i", "row_start"), F.size(cols).alias("__n"), cols.alias("__cols"))
    out = out.select("*", F.posexplode("__cols").alias("__j", "col_start"))
    ends = {"row_end": F.least(F.col("row_start") + size, "height"), "col_end": F.least(F.col("col_start") + size, "width")}
    out = out.withColumn("tile_no", F.col("__i") * F.col("__n") + F.col("__j")).withColumns(ends)
    out = out.withColumns({"pad_r": size - (F.col("row_end") - F.col("row_start")), "pad_c": size - (F.col("col_end") - F.col("col_start"))})
    return out.drop("__i", "__j", "__n", "__cols")


def tile_grid_for(spark: SparkSession, height: int, width: int, size: int, overlap: float, distinct: bool = True) -> DataFrame:
    return tile_grid(spark.range(1).select(F.lit(height).alias("height"), F.lit(width).alias("width")), size, overlap, distinct).drop("height", "width")


def number_kept(tiles: DataFrame, scene: list[str]) -> DataFrame:
    """tiles renumbered from 0, row by row, within each scene: after tiles have been left out, ids
    have no gaps. A window holds one scene's tiles."""
    order = F.row_number().over(Window.partitionBy(*scene).orderBy("row_start", "col_start"))
    return tiles.withColumn("tile_no", order - 1)


def tile_ids(tiles: DataFrame, prefix: str, digits: int = 5) -> DataFrame:
    """Tile ids by their number."""
    return tiles.withColumn("tile_id", F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("tile_no").cast("string"), digits, "0")))


def pixels_of_tiles(tiles: DataFrame, pixels: DataFrame, stride: int) -> DataFrame:
    """Pixels of each window. A window names the stride-sized cells that it covers, which makes
    an equi-join with the pixels' own cell; the exact window is checked after it."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / stride), F.floor((F.col(b) - 1) / stride))
    cells = tiles.withColumn("__cr", F.explode(span("row_start", "row_end"))).withColumn("__cc", F.explode(span("col_start", "col_end")))
    own = pixels.withColumns({"__cr": F.floor(F.col("row") / stride), "__cc": F.floor(F.col("col") / stride)})
    inside = "row >= row_start and row < row_end and col >= col_start and col < col_end"
    return cells.join(own, ["__cr", "__cc"]).where(inside).drop("__cr", "__cc")


def tile_quality(tile_pixels: DataFrame, tile: list[str], bands: list[str], most_missing: float, least_valid: float) -> DataFrame:
    """Tiles with at most most_missing of pixels missing and at least least_valid not all zero."""
    missing = F.greatest(*[F.col(b).isNull().cast("double") for b in bands]) if len(bands) > 1 else F.col(bands[0]).isNull().cast("double")
    zero = F.lit(True)
    for b in bands:
        zero = zero & (F.coalesce(F.col(b), F.lit(1.0)) == 0)
    out = tile_pixels.groupBy(*tile).agg(F.avg(missing).alias("missing_share"), (1 - F.avg(zero.cast("double"))).alias("valid_share"))
    return out.where((F.col("missing_share") <= most_missing) & (F.col("valid_share") >= least_valid))


def not_black(tile_pixels: DataFrame, tile: list[str], value: str) -> DataFrame:
    return tile_pixels.groupBy(*tile).agg(F.max(value).alias("__top")).where("__top > 0").drop("__top")


def hanning_weight(row: Column, col: Column, size: int, floor: float = 0.0) -> Column:
    """Outer product of two Hanning windows at a tile's own (row, col). floor keeps the windows'
    zero ends from blanking the image border."""
    w = lambda i: 0.5 - 0.5 * F.cos(2 * math.pi * i / (size - 1))
    top = max((0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1))) for i in range(size)) ** 2
    value = w(row) * w(col) / (top + 1e-8)
    return F.greatest(value, F.lit(floor)) if floor else value


def mosaic(predictions: DataFrame, keys: list[str], p: str = "p", w: str = "w") -> DataFrame:
    """Weighted mean of overlapping predictions per pixel; 0 where no weight falls."""
    sums = predictions.groupBy(*keys).agg(F.sum(F.col(w) * F.col(p)).alias("__wp"), F.sum(w).alias("__w"))
    return sums.withColumn(p, F.when(F.col("__w") > 0, F.col("__wp") / F.when(F.col("__w") > 0, F.col("__w"))).otherwise(0.0)).drop("__wp", "__w")


def tile_masks(tile_pixels: DataFrame, tile: list[str], value: str, size: int, least: float = 0.001) -> DataFrame:
    """Share of set mask pixels of each tile (padding counts as unset) and whether it is positive."""
    out = tile_pixels.groupBy(*tile).agg((F.sum(value) / (size * size)).alias("positive_fraction"))
    return out.withColumn("is_positive", F.col("positive_fraction") >= least)
