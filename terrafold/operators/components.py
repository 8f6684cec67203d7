"""Connected regions of set cells, and what is measured over them."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliable(df: DataFrame) -> DataFrame:
    """df behind a checkpoint in the cluster's shared folder. Only a local session, as in tests, may
    do without one; it gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrafold-"))
    return df.checkpoint()


def rank_rows(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows plus a number from 0 in the order of columns that tell rows apart, without gathering
    them: sorted ranges are counted, and their offsets, one a partition, are added."""
    kept = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = reliable(kept.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33).cast("int")
    sizes = {r["p"]: r["count"] for r in kept.groupBy(part.alias("p")).count().collect()}  # one a partition
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(total)]
        total += sizes[p]
    if not offsets:
        return kept.withColumn(name, F.lit(0).cast("long")).drop("__m")
    start = F.element_at(F.create_map(*offsets), part).cast("long")
    return kept.withColumn(name, start + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")


def _flood(group: np.ndarray, row: np.ndarray, col: np.ndarray, connect: int) -> np.ndarray:
    """The place of the first cell, in the order given, of each cell's region within its group.
    Cells are sorted by group, row and column, each once."""
    n = len(row)
    low = int(col.min()) - 1
    width = np.int64(int(col.max()) - low + 2)
    top = int(row.min()) - 1
    height = np.int64(int(row.max()) - top + 2)
    key = (group.astype(np.int64) * height + (row - top)) * width + (col - low)
    steps = (1, width) if connect == 4 else (1, width - 1, width, width + 1)
    ends = []
    for step in steps:
        at = np.minimum(np.searchsorted(key, key + step), n - 1)
        hit = key[at] == key + step
        ends.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(x) for x in zip(*ends))
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


#: Cells that a worker labels at once; a chunk is never cut.
FLUSH = 1 << 18


def chunk_labels(cells: DataFrame, scene: str, chunk: int = 1024, connect: int = 4) -> DataFrame:
    """cells(scene, row, col, ..) plus label, the row-major number (row * 2^31 + col) of the first
    cell of the cell's region, by four neighbours or eight. Other columns pass through.

    Regions are found within square chunks first; labels that touch across a chunk border are then
    merged by repeated minima over the border pairs, which are few, with pointer jumping, so that
    rounds grow with the logarithm of the chunks that a region crosses. Nothing is collected."""
    if connect not in (4, 8):
        raise ValueError("connect is 4 or 8")
    rest = [c for c in cells.columns if c not in (scene, "row", "col")]
    at = {"row": F.col("row").cast("int").alias("row"), "col": F.col("col").cast("int").alias("col")}
    keyed = cells.select(scene, at["row"], at["col"], *rest)
    keyed = keyed.withColumns({"__br": F.floor(F.col("row") / chunk), "__bc": F.floor(F.col("col") / chunk)})
    keyed = keyed.repartition(scene, "__br", "__bc").sortWithinPartitions(scene, "__br", "__bc", "row", "col")
    passed = [scene, "row", "col", *rest]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def label(table: pa.Table) -> pa.Table:
            change = np.zeros(table.num_rows, bool)
            for c in (scene, "__br", "__bc"):
                v = table[c].combine_chunks()
                change[1:] |= ~pc.fill_null(pc.equal(v[1:], v[:-1]), False).to_numpy(zero_copy_only=False)
            r, c = table["row"].to_numpy().astype(np.int64), table["col"].to_numpy().astype(np.int64)
            first = _flood(np.cumsum(change), r, c, connect)
            return table.select(passed).append_column("label", pa.array(r[first] * (1 << 31) + c[first]))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(h.num_rows for h in held) < FLUSH:
                continue
            table = pa.Table.from_batches(held)
            # the last chunk may go on in the next batch
            last = np.ones(table.num_rows, bool)
            for c in (scene, "__br", "__bc"):
                last &= pc.fill_null(pc.equal(table[c], table[c][table.num_rows - 1]), False).to_numpy()
            cut = table.num_rows - int(last.sum())
            if cut:
                yield from label(table.slice(0, cut)).to_batches()
            held = table.slice(cut).to_batches()
        if held:
            yield from label(pa.Table.from_batches(held)).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.select(*passed).schema)
    found = reliable(keyed.mapInArrow(run, schema + ", label long"))
    edge = (F.col("row") % chunk == 0) | (F.col("col") % chunk == 0)
    if connect == 8:
        edge = edge | (F.col("col") % chunk == chunk - 1)
    back = ((-1, 0), (0, -1)) if connect == 4 else ((-1, 0), (0, -1), (-1, -1), (-1, 1))
    block = lambda r, c: (F.floor(r / chunk), F.floor(c / chunk))
    there = found.select(scene, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("label").alias("other"))
    near = F.array(*[F.struct((F.col("row") + i).alias("__r"), (F.col("col") + j).alias("__c")) for i, j in back])
    pairs = found.where(edge).select(scene, "row", "col", "label", F.inline(near))
    here, other = block(F.col("row"), F.col("col")), block(F.col("__r"), F.col("__c"))
    pairs = pairs.where((here[0] != other[0]) | (here[1] != other[1]))
    pairs = pairs.join(there, [scene, "__r", "__c"]).where("label <> other").select(scene, "label", "other").distinct()
    both = reliable(pairs.union(pairs.select(scene, F.col("other"), F.col("label"))).distinct())
    if both.isEmpty():
        return found
    names = reliable(both.select(scene, "label", F.col("label").alias("least")).distinct())
    while True:
        step = both.join(names.select(scene, F.col("label").alias("other"), F.col("least").alias("seen")), [scene, "other"])
        seen = step.groupBy(scene, "label").agg(F.min("seen").alias("seen"))
        near = names.join(seen, [scene, "label"]).select(scene, "label", F.col("least").alias("old"), F.least("least", "seen").alias("least"))
        jump = names.select(scene, F.col("label").alias("least"), F.col("least").alias("jump"))
        after = near.join(jump, [scene, "least"], "left")
        after = reliable(after.select(scene, "label", "old", F.least("least", F.coalesce("jump", "least")).alias("least")))
        names = after.drop("old")
        if after.where("old <> least").isEmpty():
            break
    return found.join(names, [scene, "label"], "left").select(*passed, F.coalesce("least", "label").alias("label"))


def rings(cells: DataFrame, keys: list[str], transform: tuple = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
    """(keys.., rings): the outline of each region of cells(keys.., row, col) as closed rings of
    (x, y) structs, the outer one first, then holes, with corners only.

    Sides that two cells of a region share cancel in an aggregate; what is left of a region, its
    outline, is chained in one row, as the polygon will be one. Where two cells touch by a corner the
    chain stays with its cell, so rings may touch themselves but do not cross."""
    r, c = F.col("row").cast("long"), F.col("col").cast("long")
    side = lambda r0, c0, r1, c1: F.struct(r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))
    sides = F.array(side(r, c, r, c + 1), side(r, c + 1, r + 1, c + 1), side(r + 1, c + 1, r + 1, c), side(r + 1, c, r, c))
    edges = cells.select(*keys, "row", "col").distinct().select(*keys, F.inline(sides))
    low = F.least(F.struct("r0", "c0"), F.struct(F.col("r1").alias("r0"), F.col("c1").alias("c0")))
    flat = (F.col("r0") == F.col("r1")).alias("flat")
    once = edges.groupBy(*keys, low.alias("low"), flat).agg(F.count("*").alias("n"), F.first("r0").alias("r0"), F.first("c0").alias("c0"), F.first("r1").alias("r1"), F.first("c1").alias("c1")).where("n = 1")
    lines = once.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r0", "c0", "r1", "c1"))).alias("__e"))
    a, b, x0, d, e, y0 = (float(v) for v in transform)
    passed = lines.columns

    def chain(edges: list[dict]) -> list[list[tuple[int, int]]]:
        out_of: dict[tuple, list] = {}
        for g in edges:
            out_of.setdefault((g["r0"], g["c0"]), []).append((g["r1"], g["c1"]))
        found = []
        for g in edges:
            start = (g["r0"], g["c0"])
            while out_of.get(start):
                ring, at, way = [start], start, None
                while True:
                    ahead = out_of[at]
                    if way is None or len(ahead) == 1:
                        to = ahead.pop(0)
                    else:  # turn right, towards the cell that the last side belongs to
                        to = next(q for q in ahead if (q[0] - at[0], q[1] - at[1]) == (way[1], -way[0]))
                        ahead.remove(to)
                    step = (to[0] - at[0], to[1] - at[1])
                    if way == step:
                        ring[-1] = to
                    else:
                        ring.append(to)
                    at, way = to, step
                    if at == start and (at[0] + way[1], at[1] - way[0]) not in out_of[at]:
                        break  # a right turn would go on with a side of this ring
                if len(ring) > 4 and (ring[1][0] - ring[0][0] == 0) == (ring[-1][0] - ring[-2][0] == 0):
                    ring = [*ring[1:-1], ring[1]]  # the start was no corner
                found.append(ring)
        area = lambda q: sum(p[1] * n[0] - n[1] * p[0] for p, n in zip(q, q[1:]))
        return sorted(found, key=lambda q: (-abs(area(q)), q))

    def run(batches):
        for batch in batches:
            out = []
            for edges in batch.column(len(passed) - 1).to_pylist():
                out.append([[{"x": x0 + a * q[1] + b * q[0], "y": y0 + d * q[1] + e * q[0]} for q in ring] for ring in chain(edges)])
            kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*passed[:-1], "rings"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name != "__e")
    return lines.mapInArrow(run, schema + ", rings array<array<struct<x:double,y:double>>>")


def regions(cells: DataFrame, scene: str, pixel_area: float, value: str = "p", least_area: float = 50.0) -> DataFrame:
    """One row a region of cells(scene, label, row, col, value): cell count, area, mean value and
    centroid; regions below least_area go."""
    out = cells.groupBy(scene, "label").agg(
        F.count("*").alias("pixel_count"), (F.count("*") * pixel_area).alias("area_m2"), F.avg(value).alias("confidence"),
        F.avg("row").alias("row_mean"), F.avg("col").alias("col_mean"),
        F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
    )
    return out.where(F.col("area_m2") >= least_area)


def zonal_mean(site_cells: DataFrame, sites: list[str], raster: DataFrame, keys: list[str], value: str, name: str = "confidence") -> DataFrame:
    """Mean of the raster under each site's cells; 0 for a site with none."""
    out = site_cells.join(raster, keys, "left").groupBy(*sites).agg(F.avg(value).alias(name))
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))


def cell_iou(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """(left, right, iou) of regions given as cells, for pairs that share one; exact for
    raster-born polygons."""
    both = a.join(b, keys).groupBy(left, right).agg(F.count("*").alias("inter"))
    na, nb = a.groupBy(left).agg(F.count("*").alias("na")), b.groupBy(right).agg(F.count("*").alias("nb"))
    return both.join(na, left).join(nb, right).select(left, right, (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("iou"))


def mask_iou(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    inter, union = F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) + F.col(b) - F.col(a) * F.col(b))
    return pairs.groupBy(*keys).agg(F.when(union > 0, inter / F.when(union > 0, union)).otherwise(0.0).alias("iou"))


def rasterise_points(points: DataFrame, radius: float, all_touched: bool = True) -> DataFrame:
    """(row, col) cells within radius pixels of points(y, x); all_touched takes every cell that
    the disc touches, otherwise those whose centre it holds."""
    span = lambda v: F.sequence(F.floor(F.col(v) - radius).cast("int"), F.floor(F.col(v) + radius).cast("int"))
    cells = points.withColumn("row", F.explode(span("y"))).withColumn("col", F.explode(span("x")))
    if all_touched:
        gap = lambda v, p: F.greatest(F.lit(0.0), F.col(p) - F.col(v), F.col(v) - F.col(p) - 1)
    else:
        gap = lambda v, p: F.abs(F.col(v) - F.col(p) - 0.5)
    dy, dx = gap("y", "row"), gap("x", "col")
    return cells.where(dy * dy + dx * dx <= radius * radius).select("row", "col").distinct()


def rasterise_rings(rings: DataFrame, key: str, ring: str = "ring", all_touched: bool = False) -> DataFrame:
    """(key, row, col) cells whose centre lies in a ring of (x, y) structs in pixel units; all_touched
    adds every cell that a side of the ring passes through."""
    from ..functions.geometry import point_in_ring

    ys, xs = F.transform(ring, lambda p: p["y"]), F.transform(ring, lambda p: p["x"])
    span = lambda v: F.sequence(F.floor(F.array_min(v)).cast("int"), F.floor(F.array_max(v)).cast("int"))
    cells = rings.where(F.size(ring) >= 4).select(key, ring, F.explode(span(ys)).alias("row"), span(xs).alias("__cols")).select(key, ring, "row", F.explode("__cols").alias("col"))
    hit = point_in_ring(F.col("col") + 0.5, F.col("row") + 0.5, F.col(ring))
    if all_touched:

        def crosses(i):
            p, q = F.col(ring)[i - 1], F.col(ring)[i]
            # the part of the side within the cell's rows, then within its columns: what of 0..1 is left
            def part(a, b, low):
                s = F.try_divide(low - a, b - a)
                t = F.try_divide(low + 1 - a, b - a)
                inside = (a >= low) & (a < low + 1)
                return F.when(a == b, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(s, t)), F.when(a == b, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(s, t))

            x, y = part(p["x"], q["x"], F.col("col")), part(p["y"], q["y"], F.col("row"))
            return F.greatest(F.lit(0.0), x[0], y[0]) < F.least(F.lit(1.0), x[1], y[1])

        hit = hit | F.exists(F.sequence(F.lit(1), F.size(ring) - 1), crosses)
    return cells.where(hit).select(key, "row", "col")


def water_proximity(cells: DataFrame, water: DataFrame, keys: list[str], metres_a_pixel: float, reach_m: float = 200.0) -> DataFrame:
    """cells plus water_proximity: 1 at water, falling to 0 at reach_m. Water cells name the
    reach-sized squares around them, so the range join has an equi-key."""
    reach = reach_m / metres_a_pixel
    square = max(1, int(reach) + 1)
    at = lambda c: F.floor(F.col(c) / square)
    own = cells.withColumns({"__sr": at("row"), "__sc": at("col")})
    around = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: i)
    wet = water.select(*keys, F.col("row").alias("__wr"), F.col("col").alias("__wc"), at("row").alias("__sr0"), at("col").alias("__sc0"))
    wet = wet.withColumn("__i", F.explode(around)).withColumn("__j", F.explode(around))
    wet = wet.withColumns({"__sr": F.col("__sr0") + F.col("__i"), "__sc": F.col("__sc0") + F.col("__j")})
    d2 = (F.col("row") - F.col("__wr")) * (F.col("row") - F.col("__wr")) + (F.col("col") - F.col("__wc")) * (F.col("col") - F.col("__wc"))
    near = own.join(wet, [*keys, "__sr", "__sc"]).groupBy(*keys, "row", "col").agg(F.min(d2).alias("__d2"))
    value = F.greatest(F.lit(0.0), 1 - F.sqrt("__d2") * metres_a_pixel / reach_m)
    return cells.join(near, [*keys, "row", "col"], "left").withColumn("water_proximity", F.coalesce(value, F.lit(0.0))).drop("__d2")
