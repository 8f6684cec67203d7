"""Operators on pixel tables: one row a pixel (and date), bands in columns, missing as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import EPS, clip


def cloud_flag(blue: Column, scene_max: Column, threshold: float = 0.3) -> Column:
    """Bright blue relative to its scene; nothing is cloud where the scene maximum is not positive."""
    return F.when(scene_max > 0, blue / (F.when(scene_max > 0, scene_max) + EPS) > 1 - threshold).otherwise(False)


def mask_clouds(pixels: DataFrame, scene: str, blue: str, bands: list[str], threshold: float = 0.3) -> DataFrame:
    """Every band of a cloudy pixel becomes null; is_cloud tells which. The scene maxima are
    aggregated first and joined back."""
    top = pixels.groupBy(F.col(scene).alias("__s")).agg(F.max(blue).alias("__top"))
    rows = pixels.join(top, F.col(scene).eqNullSafe(F.col("__s")))
    rows = rows.withColumn("is_cloud", F.coalesce(cloud_flag(F.col(blue), F.col("__top"), threshold), F.lit(False)))
    return rows.withColumns({b: F.when(~F.col("is_cloud"), F.col(b)) for b in bands}).drop("__s", "__top")


def fill_gaps(pixels: DataFrame, pixel: list[str], bands: list[str]) -> DataFrame:
    """Missing samples take the pixel's median over its dates."""
    own = pixels.groupBy(*[F.col(p).alias(f"__{p}") for p in pixel]).agg(*[F.median(b).alias(f"__m_{b}") for b in bands])
    match = F.lit(True)
    for p in pixel:
        match = match & F.col(p).eqNullSafe(F.col(f"__{p}"))
    rows = pixels.join(own, match, "left")
    rows = rows.withColumns({b: F.coalesce(b, f"__m_{b}") for b in bands})
    return rows.drop(*[f"__{p}" for p in pixel], *[f"__m_{b}" for b in bands])


def fill_from_scene(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """With a single date: missing samples take the band's exact median over the scene."""
    found = exact_percentiles(pixels, bands, (0.5,))
    return pixels.withColumns({b: F.coalesce(F.col(b), F.lit(found[b][0]).cast("double")) for b in bands})


def composite(pixels: DataFrame, pixel: list[str], bands: list[str]) -> DataFrame:
    """Median over dates."""
    return pixels.groupBy(*pixel).agg(*[F.median(b).alias(b) for b in bands])


#: Values of a percentile's bracket that one aggregate may hold.
BRACKET = 1000


def exact_percentiles(rows: DataFrame, columns: list[str], shares: tuple[float, ...], bracket: int = BRACKET) -> dict[str, list[float | None]]:
    """Exact percentiles with linear interpolation, whatever the number of rows.

    A bracket holds the wanted rank, at first from the least to the greatest value. In each round
    approximate percentiles give two values on either side of the rank; the rows below and equal to
    either are counted, and the bracket shrinks to the part that the rank falls in, which never
    holds these two. A rank among rows equal to one of them is found at once, so ties end the search
    and do not hold it up. Brackets of at most `bracket` values are gathered. A round is two scans
    for all columns together and leaves about a thousandth. Null and NaN do not count; a column
    without values has none."""
    clean = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    first = clean.agg(*[f for c in columns for f in (F.count(c), F.min(c), F.max(c))]).head()
    state = []
    for i, c in enumerate(columns):
        n, low, high = first[3 * i : 3 * i + 3]
        for q in shares:
            state.append({"c": c, "n": n, "rank": q * (n - 1) if n else None, "low": low, "high": high, "below": 0, "inside": n})
    inside = lambda s: F.when(F.col(s["c"]).between(s["low"], s["high"]), F.col(s["c"]))
    while wide := [s for s in state if s["inside"] > bracket and s["low"] < s["high"]]:
        ends = []
        for s in wide:
            at = (int(s["rank"]) - s["below"]) / s["inside"]
            ends.append(F.percentile_approx(inside(s), F.array(F.lit(max(0.0, at - 5e-4)), F.lit(min(1.0, at + 5e-4))), 10_000))
        sides = list(clean.agg(*ends).head())
        counts = []
        for s, (a, b) in zip(wide, sides):
            v = F.col(s["c"])
            counts += [F.count_if(v < a), F.count_if(v <= a), F.count_if(v < b), F.count_if(v <= b)]
            counts += [F.max(F.when(v < a, v)), F.min(F.when(v > a, v)), F.max(F.when(v < b, v)), F.min(F.when(v > b, v))]
        got = clean.agg(*counts).head()
        for k, (s, (a, b)) in enumerate(zip(wide, sides)):
            lt_a, le_a, lt_b, le_b, before_a, after_a, before_b, after_b = got[8 * k : 8 * k + 8]
            r, end = int(s["rank"]), s["below"] + s["inside"]
            if r < lt_a:
                s["high"], s["inside"] = before_a, lt_a - s["below"]
            elif r < le_a:
                s["low"], s["high"], s["below"], s["inside"] = a, a, lt_a, le_a - lt_a
            elif r < lt_b:
                s["low"], s["high"], s["below"], s["inside"] = after_a, before_b, le_a, lt_b - le_a
            elif r < le_b:
                s["low"], s["high"], s["below"], s["inside"] = b, b, lt_b, le_b - lt_b
            else:
                s["low"], s["below"], s["inside"] = after_b, le_b, end - le_b
    some = [s for s in state if s["n"]]
    if some:
        values = [F.sort_array(F.collect_list(inside(s))) if s["low"] < s["high"] else F.array(F.lit(s["low"])) for s in some]
        after = [F.min(F.when(F.col(s["c"]) > s["high"], F.col(s["c"]))) for s in some]
        got = clean.agg(F.count("*"), *values, *after).head()
        for k, s in enumerate(some):
            held, beyond, r = got[1 + k], got[1 + len(some) + k], int(s["rank"])
            pick = lambda i: (held[i] if s["low"] < s["high"] else s["low"]) if i < s["inside"] else beyond  # noqa: B023, E731
            a = pick(r - s["below"])
            b = pick(min(r + 1, s["n"] - 1) - s["below"])
            s["value"] = a + (b - a) * (s["rank"] - r)
    out: dict[str, list] = {c: [] for c in columns}
    for s in state:
        out[s["c"]].append(s.get("value"))
    return out


def stretch(pixels: DataFrame, bands: list[str], low: float = 0.02, high: float = 0.98, by: str | None = None, guard: float = 0.0, joint: bool = False) -> DataFrame:
    """Each band to [0, 1] between its exact percentiles; 0 where they coincide. guard is added
    to the divisor. by: percentiles of each image, whose values an aggregate then holds. joint: one
    pair of percentiles over the samples of all bands."""
    if joint and by is None:
        found = exact_percentiles(pixels.select(F.explode(F.array(*bands)).alias("v")), ["v"], (low, high))
        rows = pixels.withColumns({f"__p_{b}": F.array(*[F.lit(v).cast("double") for v in found["v"]]) for b in bands})
    elif joint:
        keyed = pixels.select(F.col(by).alias("__by"), F.explode(F.array(*bands)).alias("v")).groupBy("__by")
        keyed = keyed.agg(F.percentile("v", F.array(F.lit(low), F.lit(high))).alias("__p"))
        rows = pixels.join(keyed, F.col(by).eqNullSafe(F.col("__by"))).withColumns({f"__p_{b}": F.col("__p") for b in bands}).drop("__by", "__p")
    elif by is None:
        found = exact_percentiles(pixels, bands, (low, high))
        rows = pixels.withColumns({f"__p_{b}": F.array(*[F.lit(v).cast("double") for v in found[b]]) for b in bands})
    else:
        keyed = pixels.groupBy(F.col(by).alias("__by")).agg(*[F.percentile(b, F.array(F.lit(low), F.lit(high))).alias(f"__p_{b}") for b in bands])
        rows = pixels.join(keyed, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    out = {}
    for b in bands:
        p2, span = F.col(f"__p_{b}")[0], F.col(f"__p_{b}")[1] - F.col(f"__p_{b}")[0]
        scaled = clip((F.col(b) - p2) / (F.when(span >= 1e-10, span) + guard), 0.0, 1.0)
        out[b] = F.when(F.col(b).isNotNull(), F.when(span < 1e-10, 0.0).when(span.isNull(), 0.0).otherwise(scaled))
    return rows.withColumns(out).drop(*[f"__p_{b}" for b in bands])


def landsat_or_stretch(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Digital numbers (a maximum above 10000) are scaled to reflectance, others stretched."""
    from ..functions.bands import landsat_reflectance

    top = pixels.agg(F.greatest(*[F.max(b) for b in bands]) if len(bands) > 1 else F.max(bands[0])).head()[0]
    if top is not None and top > 10_000:
        return pixels.withColumns({b: landsat_reflectance(F.col(b)) for b in bands})
    return stretch(pixels, bands)


def temporal_features(series: DataFrame, pixel: list[str], order: list[str], x: str, loss_below: float = 0.3) -> DataFrame:
    """Per pixel over its dates in order: diff (last less first), minimum, maximum, standard
    deviation (population), slope against the position 0..T-1, and the share below loss_below;
    missing samples keep their position and count in the share's divisor."""
    t = F.row_number().over(Window.partitionBy(*pixel).orderBy(*order)) - 1
    rows = series.withColumn("__t", t).withColumn("__x", F.col(x).cast("double"))
    stats = rows.groupBy(*pixel).agg(
        F.count("*").alias("n"), F.min_by("__x", "__t").alias("__first"), F.max_by("__x", "__t").alias("__last"),
        F.min("__x").alias("x_min"), F.max("__x").alias("x_max"), F.stddev_pop("__x").alias("x_std"), F.avg("__x").alias("__mean"),
        F.sum(F.col("__t") * F.col("__x")).alias("__tx"), F.sum(F.when(F.col("__x").isNotNull(), F.col("__t"))).alias("__st"),
        F.sum("__x").alias("__sx"), F.count("__x").alias("__nx"), F.count_if(F.col("__x") < loss_below).alias("__loss"),
    )
    n = F.col("n").cast("double")
    mean_t = (n - 1) / 2
    # sum((t - mean_t) * (x - mean_x)) over the samples that are there
    top = F.col("__tx") - mean_t * F.col("__sx") - F.col("__mean") * (F.col("__st") - mean_t * F.col("__nx"))
    return stats.select(
        *pixel, "n", (F.col("__last") - F.col("__first")).alias("x_diff"), "x_min", "x_max", "x_std",
        (top / (n * (n * n - 1) / 12 + EPS)).alias("x_slope"), (F.col("__loss") / n).alias("x_loss"),
    )


def coregister(left: DataFrame, right: DataFrame, scale: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bands of two grids of one extent side by side on the left grid; right is read at the
    nearest pixel of a grid scale times as fine. keys name the scene on both sides."""
    cells = right.withColumnsRenamed({"row": "__r", "col": "__c", **{k: f"__{k}" for k in keys}})
    at_r, at_c = F.floor(F.col("row") * scale).cast("int"), F.floor(F.col("col") * scale).cast("int")
    match = (at_r == F.col("__r")) & (at_c == F.col("__c"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"__{k}"))
    return left.join(cells, match, "left").drop("__r", "__c", *[f"__{k}" for k in keys])


def resample(pixels: DataFrame, factor: int, how: str, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """Coarser by a whole factor: area (mean of the block), nearest (its first pixel) or majority
    (mean of at least 0.3, as 0 or 1)."""
    r, c = F.floor(F.col("row") / factor).cast("int"), F.floor(F.col("col") / factor).cast("int")
    if how == "nearest":
        return pixels.where((F.col("row") % factor == 0) & (F.col("col") % factor == 0)).select(*keys, r.alias("row"), c.alias("col"), value)
    mean = F.avg(value)
    mean = (mean >= 0.3).cast("int") if how == "majority" else mean
    return pixels.groupBy(*keys, r.alias("row"), c.alias("col")).agg(mean.alias(value))


def bilinear(points: DataFrame, pixels: DataFrame, height: int, width: int, keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """points(.., y, x) plus value: the four pixels around a point in pixel-centre coordinates,
    weighted; edges are extended. One equi-join of each point's four cells."""
    y, x = F.col("y") - 0.5, F.col("x") - 0.5
    r0, c0 = F.floor(y), F.floor(x)
    near = [(r0 + i, c0 + j, (1 - F.abs(y - (r0 + i))) * (1 - F.abs(x - (c0 + j)))) for i in (0, 1) for j in (0, 1)]
    inside = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    cells = F.array(*[F.struct(inside(r, height).alias("row"), inside(c, width).alias("col"), w.alias("w")) for r, c, w in near])
    ids = points.columns
    rows = points.select(*ids, F.inline(cells)).join(pixels.select(*keys, "row", "col", value), [*keys, "row", "col"])
    return rows.groupBy(*ids).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def sample_at(points: DataFrame, pixels: DataFrame, height: int, width: int, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """The pixel under each point(row, col), of the image that keys name, clamped to the edges."""
    r = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.col("row").cast("int")))
    c = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("col").cast("int")))
    cells = pixels.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("row").alias("__r"), F.col("col").alias("__c"), value)
    match = (r == F.col("__r")) & (c == F.col("__c"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"__{k}"))
    return points.join(cells, match, "left").drop("__r", "__c", *[f"__{k}" for k in keys])


def clip_to_ring(pixels: DataFrame, ring: Column, transform: tuple, bands: list[str]) -> DataFrame:
    """Pixels of the rectangle around a closed ring of (x, y) structs in map units; the bands of those
    whose centre is outside the ring become null."""
    from ..functions.geometry import pixel_to_map, point_in_ring

    x, y = pixel_to_map(F.col("col"), F.col("row"), tuple(F.lit(float(v)) for v in transform), centre=True)
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    near = x.between(F.array_min(xs), F.array_max(xs)) & y.between(F.array_min(ys), F.array_max(ys))
    inside = point_in_ring(x, y, ring)
    return pixels.where(near).withColumns({b: F.when(inside, F.col(b)) for b in bands})


def block_mean(pixels: DataFrame, size: int, value: str, keys: tuple[str, ...] = (), name: str = "density") -> DataFrame:
    """Mean of each block, given to all its pixels."""
    r, c = F.floor(F.col("row") / size), F.floor(F.col("col") / size)
    return pixels.withColumn(name, F.avg(value).over(Window.partitionBy(*keys, r, c)))
