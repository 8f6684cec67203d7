"""Focal operators on dense chunks: numpy kernels over Arrow batches, one chunk a row.

A chunk row has h, w and data (array<double>, row by row, missing as null) and may carry a halo.
Patches that are whole images need no halo. chunks_of() cuts larger pixel tables to chunks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks_of(pixels: DataFrame, size: int, halo: int, keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """(keys.., block_row, block_col, row0, col0, h, w, pos, data): blocks of size pixels with up
    to halo more on each side where the image has them; pos is the place in the chunk of each
    value of data, as an image may have holes. A pixel goes to its own block and to those
    whose halo it is in; a chunk is the largest thing a task holds."""
    near = lambda x: F.array_distinct(F.array(F.floor((F.col(x) - halo) / size), F.floor(F.col(x) / size), F.floor((F.col(x) + halo) / size)))
    rows = pixels.select(*keys, "row", "col", value).withColumn("block_row", F.explode(near("row"))).withColumn("block_col", F.explode(near("col")))
    ends = pixels.groupBy(*keys).agg(F.max("row").alias("__rows"), F.max("col").alias("__cols")) if keys else pixels.agg(F.max("row").alias("__rows"), F.max("col").alias("__cols"))
    rows = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    rows = rows.where((F.col("block_row") >= 0) & (F.col("block_col") >= 0) & (F.col("block_row") * size <= F.col("__rows")) & (F.col("block_col") * size <= F.col("__cols")))
    cells = rows.groupBy(*keys, "block_row", "block_col").agg(
        F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).cast("double").alias("v")))).alias("__cells"),
        F.min("row").alias("row0"), F.min("col").alias("col0"), F.max("row").alias("__r1"), F.max("col").alias("__c1"),
    )
    return cells.select(
        *keys, "block_row", "block_col", "row0", "col0", (F.col("__r1") - F.col("row0") + 1).cast("int").alias("h"), (F.col("__c1") - F.col("col0") + 1).cast("int").alias("w"),
        F.transform("__cells", lambda c: ((c["row"] - F.col("row0")) * (F.col("__c1") - F.col("col0") + 1) + c["col"] - F.col("col0")).cast("int")).alias("pos"),
        F.transform("__cells", lambda c: c["v"]).alias("data"),
    )


def map_chunks(chunks: DataFrame, kernels: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """chunks plus one array<double> column a kernel, each from data as an (h, w) array with NaN
    for null; a kernel keeps the shape. With a pos column, data need not fill the chunk, and what
    it leaves open is NaN. No rows move."""
    names = list(kernels)
    passed = chunks.columns

    def dense(h, w, data, pos):
        if pos is None:
            return np.array(data, dtype=float).reshape(h, w)
        out = np.full(h * w, np.nan)
        out[pos] = np.array(data, dtype=float)
        return out.reshape(h, w)

    def run(batches):
        for batch in batches:
            h, w, data = (batch.column(passed.index(c)).to_pylist() for c in ("h", "w", "data"))
            pos = batch.column(passed.index("pos")).to_pylist() if "pos" in passed else [None] * batch.num_rows
            images = [dense(*x) for x in zip(h, w, data, pos)]
            cols = []
            for name in names:
                out = [np.asarray(kernels[name](x)).astype(float).ravel() for x in images]
                cols.append(pa.array([[None if np.isnan(v) else v for v in o.tolist()] for o in out], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*passed, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, schema + "".join(f", {n} array<double>" for n in names))


def windows(x: np.ndarray, size: int, border: str) -> np.ndarray:
    """(h, w, size, size) neighbourhoods. border: reflect101 (edge not repeated), symmetric, zero or edge."""
    k = size // 2
    mode = {"reflect101": "reflect", "symmetric": "symmetric", "zero": "constant", "edge": "edge"}[border]
    if mode in ("reflect",) and min(x.shape) <= k:
        mode = "edge"
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, k, mode=mode), (size, size))


def local_mean(x: np.ndarray, size: int = 5, border: str = "reflect101") -> np.ndarray:
    return windows(x.astype(float), size, border).mean(axis=(2, 3))


def local_square(x: np.ndarray, size: int = 5, border: str = "reflect101") -> np.ndarray:
    """Mean of squares, for a variance whose mean is known."""
    return (windows(x.astype(float), size, border) ** 2).mean(axis=(2, 3))


def refined_lee(x: np.ndarray, size: int = 5, variance: float | None = None) -> np.ndarray:
    """Speckle filter: local mean plus the deviation weighted by local against global variance;
    variance is that of the whole image, where x is a part of it."""
    mean = local_mean(x, size)
    var = np.maximum(local_square(x, size) - mean**2, 0)
    noise = (x.var() if variance is None else variance) / 4
    return mean + var / (var + noise + 1e-10) * (x - mean)


def local_variance(x: np.ndarray, size: int = 5) -> np.ndarray:
    return windows(np.clip(x, 0, 1), size, "symmetric").var(axis=(2, 3))


def local_entropy(x: np.ndarray, size: int = 5, bins: int = 16, eps: float = 1e-8, border: str = "symmetric") -> np.ndarray:
    """Shannon entropy, in bits, of a histogram over [0, 1]; the last bin is closed."""
    n = windows(np.clip(x, 0, 1), size, border)
    at = np.minimum((n * bins).astype(int), bins - 1)
    p = np.stack([(at == b).mean(axis=(2, 3)) for b in range(bins)])
    return -(p * np.log2(p + eps)).sum(axis=0) if eps < 1e-10 else -np.where(p > 0, p * np.log2(p + eps), 0).sum(axis=0)


def local_homogeneity(x: np.ndarray, size: int = 5) -> np.ndarray:
    return 1 / (1 + local_variance(x, size))


def local_correlation(x: np.ndarray, size: int = 5) -> np.ndarray:
    var = local_variance(x, size)
    return np.where(np.sqrt(var) < 1e-8, 1.0, var / (var + 1e-8))


TEXTURE = {"contrast": local_variance, "entropy": local_entropy, "homogeneity": local_homogeneity, "correlation": local_correlation}


def erode(x: np.ndarray, size: int, border: str = "zero") -> np.ndarray:
    """border zero: outside counts as unset; edge: outside does not matter."""
    padded = np.pad(x > 0, size // 2, constant_values=border == "edge")
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size)).all(axis=(2, 3))


def dilate(x: np.ndarray, size: int) -> np.ndarray:
    padded = np.pad(x > 0, size // 2)
    return np.lib.stride_tricks.sliding_window_view(padded, (size, size)).any(axis=(2, 3))


def opening(x: np.ndarray, size: int, border: str = "zero", inside: np.ndarray | None = None) -> np.ndarray:
    """inside: where the image has pixels; what it leaves open is never set, between the two steps either."""
    inside = True if inside is None else inside
    return dilate(erode(x, size, border) & inside, size) & inside


def closing(x: np.ndarray, size: int, border: str = "zero", inside: np.ndarray | None = None) -> np.ndarray:
    inside = True if inside is None else inside
    return erode(dilate(x, size) & inside, size, border) & inside


def label4(x: np.ndarray) -> np.ndarray:
    """4-connected components of set pixels, numbered from 1 in row-major order of their first pixel."""
    h, w = x.shape
    on = np.flatnonzero(np.asarray(x > 0).ravel())
    root = {int(p): int(p) for p in on}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for p in on.tolist():
        for q in ((p - 1) if p % w else None, p - w):
            if q is not None and q in root:
                a, b = find(p), find(q)
                if a != b:
                    root[max(a, b)] = min(a, b)
    out = np.zeros(h * w, int)
    numbers: dict[int, int] = {}
    for p in on.tolist():
        out[p] = numbers.setdefault(find(p), len(numbers) + 1)
    return out.reshape(h, w)


def remove_small(x: np.ndarray, least: int) -> np.ndarray:
    labels = label4(x)
    sizes = np.bincount(labels.ravel())
    sizes[0] = 0
    return (sizes >= least)[labels]


def canny_levels(x: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thinned gradients of a grey image in 0-255: 2 strong, 1 weak, 0 none. 3x3 Sobel, L1
    magnitude, thinning along the gradient; a pixel depends on two around it."""
    p = np.pad(x.astype(float), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    at = lambda i, j: q[1 + i : q.shape[0] - 1 + i, 1 + j : q.shape[1] - 1 + j]
    t = np.tan(np.pi / 8)
    flat, steep = np.abs(gy) <= t * np.abs(gx), np.abs(gx) <= t * np.abs(gy)
    same = gx * gy >= 0
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    thin = (m > before) & (m >= after)
    return (thin & (m > low)).astype(int) + (thin & (m > high))


def canny(x: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges of a whole image: strong gradients, and weak ones that touch one through eight
    neighbours. Images in chunks take flows.edges, which follows weak ones across chunk borders."""
    level = canny_levels(x, low, high)
    weak, edge = level > 0, level == 2
    while True:
        grown = dilate(edge, 3) & weak
        if (grown == edge).all():
            return edge
        edge = grown


def distance_within(x: np.ndarray, reach: int) -> np.ndarray:
    """Exact Euclidean distance to the nearest set pixel, infinite beyond reach."""
    h, w = x.shape
    out = np.full((h, w), np.inf)
    padded = np.pad(x > 0, reach)
    for dr in range(-reach, reach + 1):
        for dc in range(-reach, reach + 1):
            d = (dr * dr + dc * dc) ** 0.5
            if d <= reach:
                hit = padded[reach + dr : reach + dr + h, reach + dc : reach + dc + w]
                out = np.where(hit & (d < out), d, out)
    return out
