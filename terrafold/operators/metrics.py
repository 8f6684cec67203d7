"""Accuracy by pixel, object and block; curves, losses and class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import EPS


def _over(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / F.when(d > 0, d)).otherwise(0.0)


def confusion(rows: DataFrame, truth: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    yes, no = F.coalesce(truth, F.lit(False)), F.coalesce(said, F.lit(False))
    return rows.groupBy(*(by or [])).agg(F.count_if(yes & no).alias("tp"), F.count_if(~yes & no).alias("fp"), F.count_if(yes & ~no).alias("fn"), F.count_if(~yes & ~no).alias("tn"))


def scores(counts: DataFrame, guarded: bool = False) -> DataFrame:
    """precision, recall, f1, iou and accuracy; guarded adds 1e-8 to the divisors instead of
    giving 0 for an empty one."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = (lambda n, d: n / (d + EPS)) if guarded else _over
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "iou": ratio(tp, tp + fp + fn), "accuracy": ratio(tp + tn, tp + tn + fp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_score(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Positives and negatives at each distinct score in [0, 1], which is all that the curves need."""
    return rows.where(F.col(p).between(0, 1)).groupBy(p).agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))


#: Equal parts of [0, 1] that cumulative counts are split by; their totals are a bounded table.
PARTS = 1024


def cumulative(rows: DataFrame, y: str, p: str) -> DataFrame:
    """(score, pos, neg, tp, fp, positives, negatives): counts at each score and summed over it and
    all higher ones. Sums run within parts of the score range and start from the totals of the
    parts above, so no task orders all scores."""
    part = F.least(F.lit(PARTS - 1), F.floor(F.col(p) * PARTS)).alias("__part")
    at = by_score(rows, y, p).withColumn("__part", part)
    above = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = at.groupBy("__part").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    parts = parts.select(
        "__part", F.coalesce(F.sum("__p").over(above), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__fp"),
        F.sum("__p").over(whole).alias("positives"), F.sum("__n").over(whole).alias("negatives"),
    )
    fall = Window.partitionBy("__part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(F.broadcast(parts), "__part")  # at most PARTS rows
    return out.select(p, "pos", "neg", (F.col("__tp") + F.sum("pos").over(fall)).alias("tp"), (F.col("__fp") + F.sum("neg").over(fall)).alias("fp"), "positives", "negatives")


def roc_auc(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Mann-Whitney statistic with half credit for ties; null with one class only."""
    wins = F.sum(F.col("pos") * (F.col("negatives") - F.col("fp") + F.col("neg") / 2))
    both = F.max("positives") * F.max("negatives")
    return cumulative(rows, y, p).agg(F.when(both > 0, wins / F.when(both > 0, both)).alias("roc_auc"))


def curve(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Cumulative tp and fp by falling score with recall (tpr), fpr and precision."""
    c = cumulative(rows, y, p)
    return c.select(p, "tp", "fp", _over(F.col("tp"), F.col("positives")).alias("recall"), _over(F.col("fp"), F.col("negatives")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def pr_auc(rows: DataFrame, y: str, p: str) -> DataFrame:
    """Trapezoids under the precision-recall curve, from recall 0 at precision 1."""
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / F.when(tp0 + fp0 > 0, tp0 + fp0)).otherwise(1.0)
    now = F.col("tp") / (F.col("tp") + F.col("fp"))
    return cumulative(rows, y, p).agg(F.sum(_over(F.col("pos"), F.col("positives")) * (now + before) / 2).alias("pr_auc"))


def threshold_sweep(rows: DataFrame, y: str, p: str, thresholds: list[float]) -> DataFrame:
    """Scores at each threshold from one pass: rows are counted by the highest threshold that
    they reach, then summed downwards."""
    cuts = sorted(thresholds)
    level = sum((F.when(F.col(p) >= t, 1).otherwise(0) for t in cuts), F.lit(0))
    counts = rows.where(F.col(p).isNotNull()).groupBy(level.alias("level")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(i + 1, float(t)) for i, t in enumerate(cuts)], "at int, threshold double")
    joined = grid.join(F.broadcast(counts), F.lit(True), "left")  # at most len(thresholds) + 1 rows
    over = F.col("level") >= F.col("at")
    out = joined.groupBy("threshold").agg(
        F.coalesce(F.sum(F.when(over, F.col("pos"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(over, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~over, F.col("pos"))), F.lit(0)).alias("fn"), F.coalesce(F.sum(F.when(~over, F.col("neg"))), F.lit(0)).alias("tn"),
    )
    return scores(out)


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def block_cv(rows: DataFrame, y: str, p: str, block: list[Column], threshold: float = 0.5, least_negatives: int = 100) -> DataFrame:
    """Scores within each block; blocks without positives and with few negatives are left out."""
    names = [f"block_{i}" for i in range(len(block))]
    keyed = rows.select(*[b.alias(n) for b, n in zip(block, names)], (F.col(y) == 1).alias("__y"), (F.col(p) >= threshold).alias("__p"))
    return scores(confusion(keyed, F.col("__y"), F.col("__p"), names).where(~((F.col("tp") + F.col("fn") == 0) & (F.col("fp") + F.col("tn") < least_negatives))))


def cv_summary(blocks: DataFrame, names: list[str]) -> DataFrame:
    return blocks.agg(F.count("*").alias("n_blocks"), *[f for n in names for f in (F.avg(n).alias(f"{n}_mean"), F.stddev_samp(n).alias(f"{n}_std"))])


def object_metrics(n_truth: int, n_said: int, n_matched: int) -> dict[str, float]:
    """Precision, recall, F1 and false alarm rate of one-to-one matched objects; without any
    truth the rate is the number of detections."""
    fp, fn = n_said - n_matched, n_truth - n_matched
    p = n_matched / n_said if n_said else 0.0
    r = n_matched / n_truth if n_truth else 0.0
    return {"tp": n_matched, "fp": fp, "fn": fn, "precision": p, "recall": r, "f1": 2 * p * r / (p + r) if p + r else 0.0, "false_alarm_rate": fp / n_truth if n_truth else float(n_said)}


def focal_dice(rows: DataFrame, y: str, p: str, alpha: float = 0.25, gamma: float = 2.0, smooth: float = 1.0, mix: float = 0.5) -> DataFrame:
    """Focal and Dice loss and their mixture, over all rows as one batch."""
    pt = F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))
    at = F.when(F.col(y) == 1, alpha).otherwise(1 - alpha)
    focal = F.avg(at * F.pow(1 - pt, gamma) * -F.log(F.greatest(pt, F.lit(1e-7))))
    dice = 1 - (2 * F.sum(F.col(p) * F.col(y)) + smooth) / (F.sum(p) + F.sum(y) + smooth)
    return rows.agg(focal.alias("focal"), dice.alias("dice")).withColumn("loss", mix * F.col("focal") + (1 - mix) * F.col("dice"))


def class_weights(rows: DataFrame, y: str) -> DataFrame:
    """total / (2 n + 1e-8) of each class; (1, 10) without positives."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col(y) == 1).alias("pos"))
    w = lambda c: F.col("n") / (2 * c + EPS)
    return out.select(F.when(F.col("pos") > 0, w(F.col("n") - F.col("pos"))).otherwise(1.0).alias("w0"), F.when(F.col("pos") > 0, w(F.col("pos"))).otherwise(10.0).alias("w1"))


def class_counts(rows: DataFrame, class_col: str, classes: list) -> DataFrame:
    """Count of every class, those without rows included."""
    spark = rows.sparkSession
    kind = rows.schema[class_col].dataType.simpleString()
    dim = spark.createDataFrame([(c,) for c in classes], f"{class_col} {kind}")
    return dim.join(rows.groupBy(class_col).agg(F.count("*").alias("n")), class_col, "left").select(class_col, F.coalesce("n", F.lit(0)).alias("n"))


def commonest(rows: DataFrame, cols: list[str], order: str) -> DataFrame:
    """The most frequent combination; of equal ones that which comes first by order."""
    return rows.groupBy(*cols).agg(F.count("*").alias("n"), F.min(order).alias("__first")).orderBy(F.desc("n"), "__first").limit(1).drop("__first")


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def date_summary(sites: DataFrame, date: str = "date") -> DataFrame:
    return sites.groupBy(date).agg(
        F.count("*").alias("sites"), F.round(F.sum("area_ha"), 2).alias("area_ha"),
        *[F.count_if(F.col("confidence_tier") == t).alias(f"tier_{t.lower()}") for t in ("HIGH", "MEDIUM", "LOW")],
        F.count_if(F.col("activity") == "ACTIVE").alias("active"), F.min_by("site_id", "priority_rank").alias("top_site"),
    )


def change_summary(tracks: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status").startswith(s)).alias(s.lower())
    return tracks.agg(F.count("*").alias("tracks"), *[of(s) for s in ("NEW", "EXPANDING", "GROWN", "REDUCED", "STABLE")], F.round(F.sum("area_latest_ha"), 2).alias("area_ha"))
