"""Training splits and samples without spatial leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import near_pairs


def spatial_blocks(items: DataFrame, y: str, x: str, bins: int = 5) -> DataFrame:
    """items plus block = 10 * row bin + column bin over their extent."""
    e = items.agg(F.min(y).alias("__y0"), F.max(y).alias("__y1"), F.min(x).alias("__x0"), F.max(x).alias("__x1"))
    rows = items.crossJoin(F.broadcast(e))  # one row
    part = lambda v, a, b: F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(v) - F.col(a)) * bins, F.col(b) - F.col(a)), F.lit(0.0)))).cast("int")
    return rows.withColumn("block", part(y, "__y0", "__y1") * 10 + part(x, "__x0", "__x1")).drop("__y0", "__y1", "__x0", "__x1")


def split_blocks(items: DataFrame, seed: int = 42, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """items(block, ..) plus split: whole blocks go to test, val and train in seeded hash order,
    at least one to each of the first two. The order runs over the blocks, which are few."""
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("block").cast("string"))), "block")
    blocks = items.select("block").distinct().withColumn("__k", F.row_number().over(order))
    n = blocks.agg(F.count("*").alias("__n"))
    blocks = blocks.crossJoin(F.broadcast(n))
    n_test = F.greatest(F.lit(1), F.floor(F.col("__n") * test))
    n_val = F.greatest(F.lit(1), F.floor(F.col("__n") * val))
    split = F.when(F.col("__k") <= n_test, "test").when(F.col("__k") <= n_test + n_val, "val").otherwise("train")
    return items.join(blocks.select("block", split.alias("split")), "block")


def drop_near(items: DataFrame, key: str, y: str, x: str, radius: float) -> DataFrame:
    """Training items within radius of a test or val item go."""
    other = items.where("split <> 'train'").select(F.col(y).alias("__oy"), F.col(x).alias("__ox"))
    near = near_pairs(items.where("split = 'train'"), other, (x, y), ("__ox", "__oy"), radius).select(key).distinct()
    return items.join(near, key, "left_anti")


def shuffled_split(items: DataFrame, key: str, seed: int = 42, shares=(0.70, 0.15)) -> DataFrame:
    """items plus split train, val or test by the seeded hash of their key, which needs no order
    over all of them; the shares hold in expectation."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return items.withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "val").otherwise("test"))


def oversample(items: DataFrame, positive: str, times: int = 5) -> DataFrame:
    """Positive items appear times over, numbered by copy."""
    n = F.when(F.col(positive), times).otherwise(1)
    return items.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def augment(pixels: DataFrame, size: int, turn: int = 0, flip_rows: bool = False, flip_cols: bool = False) -> DataFrame:
    """Quarter turns (counter-clockwise) and flips of square tiles as a change of coordinates."""
    r, c = F.col("row"), F.col("col")
    for _ in range(turn % 4):
        r, c = size - 1 - c, r
    r = size - 1 - r if flip_rows else r
    c = size - 1 - c if flip_cols else c
    return pixels.withColumns({"row": r, "col": c})


def beta_share(key: Column, alpha: float, seed: int = 42, tries: int = 64) -> Column:
    """A draw from Beta(alpha, alpha) by the seeded hash of a key: of pairs u^(1/alpha), v^(1/alpha) the
    first whose sum is at most 1, as a share of it (Joehnk's method, for alpha up to 1)."""
    u = lambda i, k: (F.pmod(F.xxhash64(key, i, F.lit(seed + k)), F.lit(1_000_000)) + 0.5) / 1_000_000
    draws = F.transform(F.sequence(F.lit(1), F.lit(tries)), lambda i: F.struct(F.pow(u(i, 0), 1 / alpha).alias("x"), F.pow(u(i, 1), 1 / alpha).alias("y")))
    hit = F.get(F.filter(draws, lambda d: d["x"] + d["y"] <= 1), F.lit(0))
    return F.coalesce(hit["x"] / (hit["x"] + hit["y"]), F.lit(0.5))


def mixup(pairs: DataFrame, a: list[str], b: list[str], key: str, alpha: float = 0.4, seed: int = 42) -> DataFrame:
    """Convex mixtures of paired columns, named as a; the share of a pair is its seeded draw from
    Beta(alpha, alpha)."""
    out = pairs.withColumn("share", beta_share(F.col(key), alpha, seed))
    return out.withColumns({x: F.col("share") * F.col(x) + (1 - F.col("share")) * F.col(y) for x, y in zip(a, b)})


def first_available(key: str, value: str, *tables: DataFrame) -> DataFrame:
    """One value a key, from the first table in order that has it."""
    union = None
    for i, t in enumerate(tables):
        t = t.select(key, value, F.lit(i).alias("__i"))
        union = t if union is None else union.union(t)
    return union.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, "__i").alias(value))


def union_dates(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; a column that one lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
