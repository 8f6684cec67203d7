"""Spatial joins as equi-joins on grid cells with an exact check, and greedy one-pass selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_iou
from ..functions.scoring import ACTIVE_CLASSES, INFRASTRUCTURE_CLASSES


def near_pairs(left: DataFrame, right: DataFrame, lxy: tuple[str, str], rxy: tuple[str, str], radius: float, keys: tuple[tuple[str, str], ...] = (), how: str = "inner") -> DataFrame:
    """Pairs of points at most radius apart, with distance. The right side names the nine cells
    around each of its points; the left side stays in its own cell."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.sequence(F.lit(-1), F.lit(1))
    r = right.withColumn("__i", F.explode(around)).withColumn("__j", F.explode(around))
    r = r.withColumns({"__rx": cell(rxy[0]) + F.col("__i"), "__ry": cell(rxy[1]) + F.col("__j")}).drop("__i", "__j")
    left = left.withColumns({"__lx": cell(lxy[0]), "__ly": cell(lxy[1])})
    dx, dy = F.col(lxy[0]) - F.col(rxy[0]), F.col(lxy[1]) - F.col(rxy[1])
    on = (F.col("__lx") == F.col("__rx")) & (F.col("__ly") == F.col("__ry")) & (dx * dx + dy * dy <= radius * radius)
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    out = left.join(r, on, how).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    return out.drop("__lx", "__ly", "__rx", "__ry")


def nearest(left: DataFrame, right: DataFrame, lid: str, rid: str, lxy, rxy, radius: float) -> DataFrame:
    """The nearest right point within radius of each left one; ties to the smaller right id."""
    pairs = near_pairs(left, right, lxy, rxy, radius)
    first = F.row_number().over(Window.partitionBy(lid).orderBy("distance", rid))
    return pairs.withColumn("__n", first).where("__n = 1").drop("__n")


def equipment_near(sites: DataFrame, detections: DataFrame, sid: str, sxy, dxy, radius: float, class_name: str = "class_name") -> DataFrame:
    """sites plus counts of the detections within radius: all, active and infrastructure, and the
    sorted class names; 0 and an empty array without any."""
    pairs = near_pairs(sites.select(sid, *sxy), detections.select(*dxy, class_name), sxy, dxy, radius)
    return _equipment(sites, pairs, sid, class_name)


#: Groups into which the sites around one square of detections are split.
_FAN = 16


def equipment_near_cells(sites: DataFrame, cells: DataFrame, detections: DataFrame, sid: str, dxy, pixel: float, radius: float, class_name: str = "class_name") -> DataFrame:
    """As equipment_near, but by the distance to a site's outline: cells(sid, row, col) are the
    squares of `pixel` metres that make up the site, and a detection inside or within radius of any
    counts once. equipment_counts holds the classes in order, each with its number.

    Each detection is in one square of a grid, and a site is counted against every square within
    radius of its outline, so that the squares' counts add up and no pairs are emitted. A task holds
    the detections of a square and a share of the sites around it."""
    square, reach = max(2.0 * radius, float(pixel)), radius * (1 + 1e-9)
    at = lambda v: F.floor(v / square)
    around = lambda low, high: F.sequence(at(F.min(low) - reach), at(F.max(high) + reach))
    d = detections.select(F.col(dxy[0]).cast("double").alias("__x"), F.col(dxy[1]).cast("double").alias("__y"), F.col(class_name).alias("__class"))
    d = d.select(at(F.col("__x")).alias("__cx"), at(F.col("__y")).alias("__cy"), F.explode(F.sequence(F.lit(0), F.lit(_FAN - 1))).alias("__f"), "__x", "__y", "__class").where("__cx is not null and __cy is not null")
    # a row and a column in one number; then all of a site is in one partition, up to the counting
    c = cells.where("row is not null and col is not null").select(sid, (F.col("col") * float(pixel)).alias("__x0"), (F.col("row") * float(pixel)).alias("__y0"), (F.shiftleft(F.col("row").cast("long"), 32) + F.col("col").cast("long")).alias("__code")).repartition(sid)
    c = c.groupBy(sid, at(F.col("__x0")).alias("__sx"), at(F.col("__y0")).alias("__sy")).agg(F.collect_set("__code").alias("__codes"), around("__x0", F.col("__x0") + float(pixel)).alias("__cx"), around("__y0", F.col("__y0") + float(pixel)).alias("__cy"))
    c = c.select(sid, "__codes", F.explode("__cx").alias("__cx"), "__cy").select(sid, "__codes", "__cx", F.explode("__cy").alias("__cy"))
    c = c.groupBy(sid, "__cx", "__cy").agg(F.flatten(F.collect_list("__codes")).alias("__codes"))
    c = c.select(F.col(sid).alias("__sid"), "__codes", "__cx", "__cy", F.pmod(F.xxhash64(sid), F.lit(_FAN)).cast("int").alias("__f"))
    kind = lambda t, n: t.schema[n].dataType.simpleString()
    count = lambda a, b: _counts_near(a, b, float(pixel), float(radius))
    n = c.groupBy("__cx", "__cy", "__f").cogroup(d.groupBy("__cx", "__cy", "__f")).applyInArrow(count, f"__sid {kind(c, '__sid')}, __class {kind(d, '__class')}, __n bigint")
    n = n.repartition("__sid").groupBy("__sid", "__class").agg(F.sum("__n").alias("n"))
    total = lambda *of: F.coalesce(F.sum(F.when(F.col("__class").isin(*of), F.col("n"))), F.lit(0))
    found = n.groupBy(F.col("__sid").alias(sid)).agg(
        F.array_sort(F.collect_list(F.when(F.col("__class").isNotNull(), F.struct(F.col("__class").alias("class_name"), "n")))).alias("equipment_counts"), F.sum("n").alias("equipment_total"),
        total(*ACTIVE_CLASSES).alias("active_equipment_count"), total(*INFRASTRUCTURE_CLASSES).alias("infrastructure_count"),
    )
    found = _zeroes(sites.join(found, sid, "left")).withColumn("equipment_counts", F.coalesce("equipment_counts", F.array().cast(found.schema["equipment_counts"].dataType)))
    return found.withColumn("equipment_types", F.flatten(F.transform("equipment_counts", lambda k: F.array_repeat(k["class_name"], k["n"].cast("int")))))


def _rectangles(site: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, ...]:
    """(site, first row, last row, first column, last column) of rectangles that cover each site's
    cells and nothing else: runs in a row, and equal runs one below the other; sorted by site."""
    o = np.lexsort((col, row, site))
    site, row, col = site[o], row[o], col[o]
    new = np.r_[True, (np.diff(site) != 0) | (np.diff(row) != 0) | (np.diff(col) > 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    site, row, left, right = site[first], row[first], col[first], col[last]
    o = np.lexsort((row, right, left, site))
    site, row, left, right = site[o], row[o], left[o], right[o]
    new = np.r_[True, (np.diff(site) != 0) | (np.diff(left) != 0) | (np.diff(right) != 0) | (np.diff(row) > 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)] - 1
    return site[first], row[first], row[last], left[first], right[first]


def _counts_near(sites: pa.Table, detections: pa.Table, pixel: float, radius: float, rows: int = 64, cols: int = 4096) -> pa.Table:
    """(__sid, __class, __n) of sites(__sid, __codes) and detections(__x, __y, __class), in blocks of
    rows x cols, so that memory does not grow with the pairs."""
    ids, n_sites = sites.column("__sid").combine_chunks(), sites.num_rows
    kinds = detections.column("__class").combine_chunks().dictionary_encode("encode")
    names, cls, k = kinds.dictionary, kinds.indices.to_numpy(), len(kinds.dictionary)
    if not n_sites or not detections.num_rows:
        return pa.table({"__sid": ids.slice(0, 0), "__class": names.slice(0, 0), "__n": pa.array([], pa.int64())})
    codes = sites.column("__codes").combine_chunks()
    code, site = codes.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n_sites), np.diff(codes.offsets.to_numpy()))
    row = (code + (1 << 31)) >> 32
    site, top, bottom, left, right = _rectangles(site, row, code - (row << 32))
    x0, x1, y0, y1 = left * pixel, (right + 1) * pixel, top * pixel, (bottom + 1) * pixel
    begin = np.searchsorted(site, np.arange(n_sites + 1))
    low, high, many = np.minimum.reduceat(x0, begin[:-1]), np.maximum.reduceat(x1, begin[:-1]), np.diff(begin)
    o = np.argsort(detections.column("__x").to_numpy(), kind="stable")
    x, y, cls = detections.column("__x").to_numpy()[o], detections.column("__y").to_numpy()[o], cls[o]
    is_kind = np.zeros((len(x), k), np.float32)
    is_kind[np.arange(len(x)), cls] = 1
    order, found = np.argsort(low, kind="stable"), np.zeros((n_sites, k), np.int64)
    gap = lambda v, a, b: np.maximum(np.maximum(a[:, None] - v, v - b[:, None]), 0)
    for i in range(0, n_sites, rows):
        part = order[i : i + rows]
        a, b = np.searchsorted(x, low[part].min() - radius * (1 + 1e-9)), np.searchsorted(x, high[part].max() + radius * (1 + 1e-9), "right")
        for j in range(a, b, cols):
            s = slice(j, min(b, j + cols))
            near = np.zeros((len(part), s.stop - s.start), bool)
            for r in range(many[part].max()):
                have = np.flatnonzero(many[part] > r)
                at = begin[part[have]] + r
                dx, dy = gap(x[s], x0[at], x1[at]), gap(y[s], y0[at], y1[at])
                near[have] |= dx * dx + dy * dy <= radius * radius
            found[part] += (near.astype(np.float32) @ is_kind[s]).astype(np.int64)
    at, kind = np.nonzero(found)
    return pa.table({"__sid": ids.take(pa.array(at)), "__class": names.take(pa.array(kind)), "__n": pa.array(found[at, kind])})


def _zeroes(sites: DataFrame) -> DataFrame:
    return sites.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("equipment_total", "active_equipment_count", "infrastructure_count")})


def _equipment(sites: DataFrame, pairs: DataFrame, sid: str, class_name: str) -> DataFrame:
    found = pairs.groupBy(sid).agg(
        F.array_sort(F.collect_list(class_name)).alias("equipment_types"), F.count("*").alias("equipment_total"),
        F.count_if(F.col(class_name).isin(*ACTIVE_CLASSES)).alias("active_equipment_count"),
        F.count_if(F.col(class_name).isin(*INFRASTRUCTURE_CLASSES)).alias("infrastructure_count"),
    )
    return _zeroes(sites.join(found, sid, "left")).withColumn("equipment_types", F.coalesce("equipment_types", F.array().cast("array<string>")))


def boxes_within_cells(sites: DataFrame, cells: DataFrame, boxes: DataFrame, sid: str, pixel: float) -> DataFrame:
    """(sid, n) for the boxes (x1, y1, x2, y2) wholly within each site's outline: all the squares that
    a box covers are cells(sid, row, col) of the site."""
    first, last = lambda v: F.floor(F.col(v) / float(pixel)), lambda v: F.ceil(F.col(v) / float(pixel)) - 1
    span = lambda a, b: F.sequence(first(a), F.greatest(first(a), last(b)))
    b = boxes.select("x1", "y1", "x2", "y2").withColumn("__b", F.monotonically_increasing_id())
    b = b.select("__b", F.explode(span("y1", "y2")).alias("row"), span("x1", "x2").alias("__cols"), (F.size(span("y1", "y2")) * F.size(span("x1", "x2"))).alias("__need"))
    b = b.select("__b", "__need", "row", F.explode("__cols").alias("col"))
    met = b.join(cells.select(sid, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")), ["row", "col"])
    held = met.groupBy(sid, "__b", "__need").agg(F.count("*").alias("__have")).where("__have = __need")
    n = held.groupBy(sid).agg(F.count("*").alias("n"))
    return sites.select(sid).join(n, sid, "left").select(sid, F.coalesce("n", F.lit(0)).alias("n"))


def boxes_within(sites: DataFrame, boxes: DataFrame, sid: str, cell: float) -> DataFrame:
    """(sid, n) for the boxes (x1, y1, x2, y2) wholly within each site's box (sx1, sy1, sx2, sy2).
    A site names the cells that it covers; a box has that of its lower corner."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    s = sites.withColumn("__cx", F.explode(span("sx1", "sx2"))).withColumn("__cy", F.explode(span("sy1", "sy2")))
    b = boxes.withColumns({"__cx": F.floor(F.col("x1") / cell), "__cy": F.floor(F.col("y1") / cell)})
    met = s.join(b, ["__cx", "__cy"]).where("x1 >= sx1 and y1 >= sy1 and x2 <= sx2 and y2 <= sy2").groupBy(sid).agg(F.count("*").alias("n"))
    return sites.select(sid).join(met, sid, "left").select(sid, F.coalesce("n", F.lit(0)).alias("n"))


def points_in_tiles(points: DataFrame, tiles: DataFrame, stride: int) -> DataFrame:
    """points(row, col) with every half-open tile window that holds them, and their place in it."""
    from .tiles import pixels_of_tiles

    out = pixels_of_tiles(tiles, points, stride)
    return out.withColumns({"cx": (F.col("col") - F.col("col_start")) / (F.col("col_end") - F.col("col_start")), "cy": (F.col("row") - F.col("row_start")) / (F.col("row_end") - F.col("row_start"))})


def box_pairs(boxes: DataFrame, key: str, cell: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys.., a, b, iou) of overlapping boxes, a < b by key. Boxes name the cells that they
    cover; a pair counts in the cell of its common lower corner only."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    cells = boxes.select(*keys, key, "x1", "y1", "x2", "y2").withColumn("__cx", F.explode(span("x1", "x2"))).withColumn("__cy", F.explode(span("y1", "y2")))
    a = cells.withColumnsRenamed({key: "a", "x1": "ax1", "y1": "ay1", "x2": "ax2", "y2": "ay2"})
    b = cells.withColumnsRenamed({key: "b", "x1": "bx1", "y1": "by1", "x2": "bx2", "y2": "by2"})
    both = a.join(b, [*keys, "__cx", "__cy"]).where("a < b and ax1 < bx2 and bx1 < ax2 and ay1 < by2 and by1 < ay2")
    both = both.where((F.floor(F.greatest("ax1", "bx1") / cell) == F.col("__cx")) & (F.floor(F.greatest("ay1", "by1") / cell) == F.col("__cy")))
    iou = box_iou(tuple(F.col(c) for c in ("ax1", "ay1", "ax2", "ay2")), tuple(F.col(c) for c in ("bx1", "by1", "bx2", "by2")))
    return both.select(*keys, "a", "b", iou.alias("iou"))


def greedy_keep(items: DataFrame, pairs: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """items plus kept: scanned in order, an item is dropped if it conflicts with one kept before.

    Rounds of joins: an undecided item with no undecided earlier rival is kept, what conflicts
    with a kept item is dropped. The rounds grow with the longest chain of conflicts, not with
    the items, and no group is gathered."""
    from .components import reliable

    rank = items.select(key, F.struct(*order, F.col(key)).alias("__o"))
    p = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct()
    p = p.join(rank.withColumnsRenamed({key: "a", "__o": "__oa"}), "a").join(rank.withColumnsRenamed({key: "b", "__o": "__ob"}), "b")
    p = reliable(p.where("__oa < __ob").select("a", "b"))  # a comes first
    state = reliable(items.select(key).withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        open_ = state.where("kept is null").select(key)
        if open_.isEmpty():
            break
        undecided = p.join(open_.withColumnRenamed(key, "a"), "a", "left_semi")
        blocked = undecided.select(F.col("b").alias(key)).distinct()
        keep = open_.join(blocked, key, "left_anti").withColumn("__new", F.lit(True))
        drop = p.join(keep.select(F.col(key).alias("a")), "a", "left_semi").select(F.col("b").alias(key)).distinct().withColumn("__new", F.lit(False))
        state = reliable(state.join(keep.union(drop), key, "left").select(key, F.coalesce("kept", "__new").alias("kept")))
    return items.join(state, key)


def nms(boxes: DataFrame, key: str, confidence: str, threshold: float = 0.45, cell: float = 64.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Boxes that survive suppression by a more confident one of their class with an overlap
    above the threshold; ties to the smaller key."""
    rivals = box_pairs(boxes, key, cell, keys).where(F.col("iou") > threshold)
    return greedy_keep(boxes, rivals, key, [(-F.col(confidence)).alias("__c")]).where("kept").drop("kept")


def dedup_by_area(boxes: DataFrame, key: str, area: str, threshold: float = 0.5, cell: float = 64.0) -> DataFrame:
    """Larger first; an overlap of at least the threshold suppresses."""
    rivals = box_pairs(boxes, key, cell).where(F.col("iou") >= threshold)
    return greedy_keep(boxes, rivals, key, [(-F.col(area)).alias("__a")]).where("kept").drop("kept")


def greedy_match(candidates: DataFrame, group: list[str], new: str, old: str, score: str | None) -> DataFrame:
    """One-to-one matches (group.., new, old) from candidate pairs: new ones in order take the
    unused old one of the best score (score=None: the first), ties to the smaller old key.

    Rounds of joins: an open new one is settled when no earlier open one has its favourite among
    its candidates, as it then gets it whatever the others do; what is taken is struck from all.
    The first open one is always settled; rounds grow with the longest chain of rivals, not with
    the candidates, and no group is gathered."""
    from .components import reliable

    best = (-F.col(score)).alias("__s") if score else F.lit(0.0).alias("__s")
    open_ = reliable(candidates.select(*group, new, old, best).groupBy(*group, new, old).agg(F.min("__s").alias("__s")))
    done = None
    while not open_.isEmpty():
        favourite = open_.groupBy(*group, new).agg(F.min(F.struct("__s", F.col(old).alias("__o"))).alias("__f"))
        favourite = favourite.select(*group, new, F.col("__f.__o").alias(old))
        first = open_.groupBy(*group, old).agg(F.min(new).alias("__first"))
        settled = reliable(favourite.join(first, [*group, old]).where(F.col(new) == F.col("__first")).select(*group, new, old))
        done = settled if done is None else done.unionByName(settled)
        open_ = open_.join(settled.select(*group, new), [*group, new], "left_anti")
        open_ = reliable(open_.join(settled.select(*group, old), [*group, old], "left_anti"))
    return candidates.select(*group, new, old).limit(0) if done is None else done


def offset_consensus(pairs: DataFrame, tolerance: float) -> DataFrame:
    """One row (dx, dy, inliers): of the pairs' own offsets (sdx, sdy) that with the most pairs
    within tolerance, refined to their mean (two at least; ties to the smaller pair_id). Fewer
    than three pairs: zero. It is the exhaustive form of drawing one pair at a time.

    Equal offsets are counted first. Squares of half the tolerance hold only offsets within it, so
    a square votes for its own as a whole, by its sums, and only offsets of squares that the circle
    may cut are compared one by one."""
    side = tolerance / 2
    own = pairs.groupBy("sdx", "sdy").agg(F.count("*").alias("n"), F.min("pair_id").alias("pair_id"))
    own = own.withColumns({"__x": F.floor(F.col("sdx") / side), "__y": F.floor(F.col("sdy") / side)})
    steps = [(i, j) for i in range(-3, 4) for j in range(-3, 4)]
    near = F.array(*[F.struct(F.lit(i).alias("__i"), F.lit(j).alias("__j")) for i, j in steps])
    asked = own.select("pair_id", "sdx", "sdy", "__x", "__y", F.inline(near))
    asked = asked.withColumns({"__x": F.col("__x") + F.col("__i"), "__y": F.col("__y") + F.col("__j")})
    # of a square, the corner farthest from the offset decides whether all of it is within
    far = lambda v, c: F.greatest(F.abs(F.col(v) - F.col(c) * side), F.abs(F.col(v) - (F.col(c) + 1) * side))
    short = lambda v, c: F.greatest(F.lit(0.0), F.col(c) * side - F.col(v), F.col(v) - (F.col(c) + 1) * side)
    square = lambda f: f("sdx", "__x") * f("sdx", "__x") + f("sdy", "__y") * f("sdy", "__y")
    t2, slack = tolerance * tolerance, 1e-9 * tolerance * tolerance
    asked = asked.where(square(short) <= t2 + slack).withColumn("__whole", square(far) <= t2 - slack)
    whole = own.groupBy("__x", "__y").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("sdx")).alias("sx"), F.sum(F.col("n") * F.col("sdy")).alias("sy"))
    one = own.select("__x", "__y", "n", F.col("sdx").alias("odx"), F.col("sdy").alias("ody"))
    gx, gy = F.col("sdx") - F.col("odx"), F.col("sdy") - F.col("ody")
    cut = asked.where("not __whole").join(one, ["__x", "__y"]).where(gx * gx + gy * gy <= t2)
    votes = asked.where("__whole").join(whole, ["__x", "__y"]).select("pair_id", "sdx", "sdy", "n", "sx", "sy")
    votes = votes.union(cut.select("pair_id", "sdx", "sdy", "n", F.col("n") * F.col("odx"), F.col("n") * F.col("ody")))
    votes = votes.groupBy("pair_id", "sdx", "sdy").agg(F.sum("n").alias("inliers"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    votes = votes.select("pair_id", F.col("sdx").alias("x"), F.col("sdy").alias("y"), "inliers", (F.col("sx") / F.col("inliers")).alias("mx"), (F.col("sy") / F.col("inliers")).alias("my"))
    best = votes.agg(F.max_by(F.struct("mx", "my", "x", "y", "inliers"), F.struct("inliers", -F.col("pair_id"))).alias("b"))
    best = best.crossJoin(pairs.agg(F.count("*").alias("n")))  # two tables of one row
    some = F.col("n") >= 3
    pick = lambda m, x: F.when(some, F.when(F.col("b.inliers") >= 2, F.col(f"b.{m}")).otherwise(F.col(f"b.{x}"))).otherwise(0.0)
    return best.select(pick("mx", "x").alias("dx"), pick("my", "y").alias("dy"), F.when(some, F.col("b.inliers")).otherwise(0).alias("inliers"))


def offset_ransac(pairs: pd.DataFrame, rounds: int = 1000, tolerance: float = 20.0, seed: int = 42) -> tuple[float, float]:
    """The seeded form on the driver's few control points: one drawn pair a round."""
    d = pairs[["sdx", "sdy"]].to_numpy(float)
    if len(d) < 3:
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    best, inliers = np.zeros(2), np.zeros(len(d), bool)
    for _ in range(rounds):
        o = d[rng.integers(0, len(d))]
        near = np.hypot(*(d - o).T) <= tolerance
        if near.sum() > inliers.sum():
            best, inliers = o, near
    if inliers.sum() >= 2:
        best = d[inliers].mean(axis=0)
    return float(best[0]), float(best[1])
