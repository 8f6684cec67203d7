"""Queries over labels, metrics, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, metrics, splits
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


_COUNTS = "count(*) FILTER (WHERE y = 1 AND s) AS tp, count(*) FILTER (WHERE y = 0 AND s) AS fp, count(*) FILTER (WHERE y = 1 AND NOT s) AS fn, count(*) FILTER (WHERE y = 0 AND NOT s) AS tn"
_SCORES = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp + fn, 0), 0) AS iou, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy"""
_ROUND = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(iou, 6) AS iou, round(accuracy, 6) AS accuracy, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1"
_NAMES = ("precision", "recall", "iou", "accuracy", "f1")


def _rounded(df, names=_NAMES):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("confusion", f"WITH {A.TRUTH_SQL}, c AS (SELECT {_COUNTS} FROM (SELECT *, p >= 0.5 AS s FROM truth)), m AS (SELECT *, {_SCORES} FROM c) SELECT tp, fp, fn, tn, {_ROUND} FROM m")
def confusion(spark, sf_dir):
    return _rounded(metrics.scores(metrics.confusion(A.truth(spark, sf_dir), F.col("y") == 1, F.col("p") >= 0.5)))


@query("binary_metrics", f"""WITH {A.TRUTH_SQL}, c AS (SELECT {_COUNTS} FROM (SELECT *, p >= 0.5 AS s FROM truth)), m AS (SELECT *, tp / (tp + fp + 1e-8) AS precision, tp / (tp + fn + 1e-8) AS recall FROM c)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 1e-8), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn + 1e-8), 6) AS accuracy, round(tp / (tp + fp + fn + 1e-8), 6) AS iou FROM m""")
def binary_metrics(spark, sf_dir):
    return _rounded(metrics.scores(metrics.confusion(A.truth(spark, sf_dir), F.col("y") == 1, F.col("p") >= 0.5), guarded=True)).select(*_NAMES)


_GRID = "t AS (SELECT round(0.1 + i * 0.05, 2)::DOUBLE AS threshold FROM generate_series(0, 16) g(i))"


@query("threshold_sweep", f"WITH {A.TRUTH_SQL}, {_GRID}, c AS (SELECT threshold, {_COUNTS} FROM (SELECT *, p >= threshold AS s FROM truth, t) GROUP BY 1), m AS (SELECT *, {_SCORES} FROM c) SELECT threshold, tp, fp, fn, tn, {_ROUND} FROM m")
def threshold_sweep(spark, sf_dir):
    return _rounded(metrics.threshold_sweep(A.truth(spark, sf_dir), "y", "p", [round(0.1 + i * 0.05, 2) for i in range(17)]))


@query("best_threshold", f"WITH {A.TRUTH_SQL}, {_GRID}, c AS (SELECT threshold, {_COUNTS} FROM (SELECT *, p >= threshold AS s FROM truth, t) GROUP BY 1), m AS (SELECT *, {_SCORES} FROM c), r AS (SELECT threshold, {_ROUND} FROM m) SELECT threshold, f1 FROM r ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    sweep = metrics.threshold_sweep(A.truth(spark, sf_dir), "y", "p", [round(0.1 + i * 0.05, 2) for i in range(17)])
    return metrics.best_threshold(_rounded(sweep, ("f1",)))


@query("roc_auc", f"""WITH {A.TRUTH_SQL}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM truth)
SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS roc_auc FROM r""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(A.truth(spark, sf_dir), "y", "p").select(F.round("roc_auc", 6).alias("roc_auc"))


_CURVE = """s AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM truth GROUP BY p), k AS (SELECT p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM s WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""


@query("pr_curve", f"WITH {A.TRUTH_SQL}, {_CURVE} SELECT round(p, 6) AS p, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / np, 6) AS recall, round(fp / nn, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM k")
def pr_curve(spark, sf_dir):
    return metrics.curve(A.truth(spark, sf_dir), "y", "p").withColumns({c: F.round(c, 6) for c in ("p", "recall", "fpr", "precision")})


@query("pr_auc", f"""WITH {A.TRUTH_SQL}, {_CURVE}, c AS (SELECT p, tp / np AS r, tp / (tp + fp) AS q FROM k), d AS (SELECT r, q, lag(r, 1, 0) OVER (ORDER BY p DESC) AS r0, lag(q, 1, 1) OVER (ORDER BY p DESC) AS q0 FROM c) SELECT round(sum((r - r0) * (q + q0) / 2), 6) AS pr_auc FROM d""")
def pr_auc(spark, sf_dir):
    return metrics.pr_auc(A.truth(spark, sf_dir), "y", "p").select(F.round("pr_auc", 6).alias("pr_auc"))


_BLOCKS = f"c AS (SELECT doc_id // 500 AS block_0, {_COUNTS} FROM (SELECT *, p >= 0.5 AS s FROM truth) GROUP BY 1 HAVING NOT (tp + fn = 0 AND fp + tn < 100)), m AS (SELECT *, {_SCORES} FROM c)"


@query("block_cv", f"WITH {A.TRUTH_SQL}, {_BLOCKS} SELECT block_0, tp, fp, fn, tn, {_ROUND} FROM m")
def block_cv(spark, sf_dir):
    return _rounded(metrics.block_cv(A.truth(spark, sf_dir), "y", "p", [F.floor(F.col("doc_id") / 500)]))


@query("cv_summary", f"WITH {A.TRUTH_SQL}, {_BLOCKS}, r AS (SELECT {_ROUND} FROM m) SELECT count(*) AS n_blocks, round(avg(f1), 5) AS f1_mean, round(stddev_samp(f1), 5) AS f1_std, round(avg(iou), 5) AS iou_mean, round(stddev_samp(iou), 5) AS iou_std FROM r")
def cv_summary(spark, sf_dir):
    b = _rounded(metrics.block_cv(A.truth(spark, sf_dir), "y", "p", [F.floor(F.col("doc_id") / 500)]))
    out = metrics.cv_summary(b, ["f1", "iou"])
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c != "n_blocks"})


@query("focal_dice_loss", f"""WITH {A.TRUTH_SQL}, x AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pt, CASE WHEN y = 1 THEN 0.25 ELSE 0.75 END AS a FROM truth),
l AS (SELECT avg(a * pow(1 - pt, 2) * -ln(greatest(pt, 1e-7))) AS focal, 1 - (2 * sum(p * y) + 1) / (sum(p) + sum(y) + 1) AS dice FROM x) SELECT round(focal, 6) AS focal, round(dice, 6) AS dice, round(0.5 * focal + 0.5 * dice, 6) AS loss FROM l""")
def focal_dice_loss(spark, sf_dir):
    return metrics.focal_dice(A.truth(spark, sf_dir), "y", "p").select(*[F.round(c, 6).alias(c) for c in ("focal", "dice", "loss")])


@query("class_weights", f"WITH {A.TRUTH_SQL} SELECT round(CASE WHEN sum(y) > 0 THEN count(*) / (2 * (count(*) - sum(y)) + 1e-8) ELSE 1 END, 6) AS w0, round(CASE WHEN sum(y) > 0 THEN count(*) / (2 * sum(y) + 1e-8) ELSE 10 END, 6) AS w1 FROM truth")
def class_weights(spark, sf_dir):
    return metrics.class_weights(A.truth(spark, sf_dir), "y").select(F.round("w0", 6).alias("w0"), F.round("w1", 6).alias("w1"))


@query("label_validate", f"""WITH {A.LABELS_SQL}, t AS (SELECT *, string_split_regex(trim(line), '\\s+') AS t FROM lines WHERE trim(line) <> ''),
b AS (SELECT event_id, CASE WHEN len(t) = 5 AND regexp_full_match(t[1], '[+-]?[0-9]+') AND try_cast(t[2] AS DOUBLE) IS NOT NULL AND try_cast(t[3] AS DOUBLE) IS NOT NULL AND try_cast(t[4] AS DOUBLE) IS NOT NULL AND try_cast(t[5] AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END AS ok, t FROM t)
SELECT event_id, CASE WHEN ok = 0 THEN 'malformed' WHEN t[1]::INTEGER >= 5 THEN 'bad class' WHEN t[2]::DOUBLE > 1 THEN 'cx out of range' WHEN t[3]::DOUBLE > 1 THEN 'cy out of range' WHEN t[4]::DOUBLE > 1 THEN 'w out of range' WHEN t[5]::DOUBLE > 1 THEN 'h out of range' ELSE '' END AS issue,
  CASE WHEN ok = 1 THEN printf('%d %.6f %.6f %.6f %.6f', t[1]::INTEGER, t[2]::DOUBLE, t[3]::DOUBLE, t[4]::DOUBLE, t[5]::DOUBLE) ELSE '' END AS canonical FROM b""")
def label_validate(spark, sf_dir):
    v = labels.validate(A.label_lines(spark, sf_dir), "line", 5)
    canonical = F.when(F.col("box").isNotNull(), labels.canonical_line(F.col("box"))).otherwise("")
    return v.select("event_id", F.coalesce("issue", F.lit("")).alias("issue"), canonical.alias("canonical"))


@query("label_match", f"WITH {A.LABELS_SQL} SELECT event_id, tile, (tile < 40)::INTEGER AS matched FROM lines")
def label_match(spark, sf_dir):
    yes, no = labels.correspond(A.label_lines(spark, sf_dir), spark.range(40).withColumnRenamed("id", "tile"), "tile")
    return yes.select("event_id", "tile", F.lit(1).alias("matched")).union(no.select("event_id", "tile", F.lit(0)))


@query("label_georeference", f"""WITH {A.LABELS_SQL}, b AS (SELECT event_id, tile, string_split(line, ' ') AS t FROM lines WHERE event_id % 23 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0)
SELECT event_id, round(-1.2 + tile * 0.001 + t[2]::DOUBLE * 640 * 1e-6, 8) AS map_x, round(6.2 - t[3]::DOUBLE * 480 * 1e-6, 8) AS map_y FROM b""")
def label_georeference(spark, sf_dir):
    rows = A.label_lines(spark, sf_dir).where("event_id % 23 <> 0 and event_id % 29 <> 0 and event_id % 31 <> 0").withColumn("box", labels.parse_line(F.col("line")))
    t = F.array(F.lit(1e-6), F.lit(0.0), -1.2 + F.col("id") * 0.001, F.lit(0.0), F.lit(-1e-6), F.lit(6.2))
    tiles = spark.range(50).select(F.col("id").alias("tile"), F.lit(640).alias("image_width"), F.lit(480).alias("image_height"), t.alias("transform"))
    return labels.georeference(rows, tiles, "tile").select("event_id", "map_x", "map_y")


@query("class_counts", "WITH d AS (SELECT unnest(['click', 'view', 'purchase', 'signup', 'logout', 'never']) AS event_type) SELECT event_type, count(event_id) AS n FROM d LEFT JOIN events USING (event_type) GROUP BY 1")
def class_counts(spark, sf_dir):
    return metrics.class_counts(A.read(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase", "signup", "logout", "never"])


@query("annotation_rate", f"WITH {A.LABELS_SQL} SELECT tile, round(100 * count(*) FILTER (WHERE trim(line) <> '') / greatest(count(*), 1), 2) AS rate FROM lines GROUP BY 1")
def annotation_rate(spark, sf_dir):
    l = A.label_lines(spark, sf_dir)
    return l.groupBy("tile").agg(labels.annotation_rate(F.count_if(F.trim("line") != ""), F.count("*")).alias("rate"))


@query("commonest_shape", "SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, min(p_partkey) LIMIT 1")
def commonest_shape(spark, sf_dir):
    return metrics.commonest(A.read(spark, sf_dir, "part"), ["p_size", "p_brand"], "p_partkey")


@query("value_summary", "SELECT l_returnflag, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n FROM lineitem GROUP BY 1")
def value_summary(spark, sf_dir):
    return metrics.summary(A.read(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).withColumn("mean", F.round("mean", 6))


@query("spatial_block_split", f"""WITH {A.SITES_SQL}, e AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM site), b AS (SELECT site, least(4, floor((y - y0) * 5 / (y1 - y0)))::INTEGER * 10 + least(4, floor((x - x0) * 5 / (x1 - x0)))::INTEGER AS block FROM site, e),
k AS (SELECT block, row_number() OVER (ORDER BY md5('42:' || block), block) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT block FROM b))
SELECT site, block, CASE WHEN k <= greatest(1, floor(n * 0.15)) THEN 'test' WHEN k <= 2 * greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS split FROM b JOIN k USING (block)""")
def spatial_block_split(spark, sf_dir):
    return splits.split_blocks(splits.spatial_blocks(A.sites(spark, sf_dir).select("site", "x", "y"), "y", "x")).select("site", "block", "split")


@query("split_without_leakage", f"""WITH {A.SITES_SQL}, s AS (SELECT site, x, y, CASE site % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM site)
SELECT site, split FROM s a WHERE split <> 'train' OR NOT EXISTS (SELECT 1 FROM s b WHERE b.split <> 'train' AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 10000)""")
def split_without_leakage(spark, sf_dir):
    s = A.sites(spark, sf_dir).select("site", "x", "y", F.when(F.col("site") % 10 == 0, "test").when(F.col("site") % 10 == 1, "val").otherwise("train").alias("split"))
    return splits.drop_near(s, "site", "y", "x", 100.0).select("site", "split")


@query("oversample", f"WITH {A.TRUTH_SQL} SELECT doc_id, c AS copy FROM truth, generate_series(1, 5) g(c) WHERE y = 1 OR c = 1")
def oversample(spark, sf_dir):
    return splits.oversample(A.truth(spark, sf_dir).withColumn("pos", F.col("y") == 1), "pos").select("doc_id", F.col("copy").cast("long").alias("copy"))


@query("augment_tiles", f"WITH {A.PIXELS_SQL} SELECT vec_id, 7 - col AS row, 7 - row AS col, round(v, 6) AS v FROM px")
def augment_tiles(spark, sf_dir):
    return splits.augment(A.patch_pixels(spark, sf_dir), 8, turn=1, flip_cols=True).select("vec_id", "row", "col", F.round("v", 6).alias("v"))


@query("mask_priority", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'auto' WHEN o_orderkey % 3 = 0 THEN 'polygon' ELSE 'spectral' END AS source FROM orders""")
def mask_priority(spark, sf_dir):
    o = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return splits.first_available("k", "source", o.where("k % 2 = 0").withColumn("source", F.lit("auto")), o.where("k % 3 = 0").withColumn("source", F.lit("polygon")), o.withColumn("source", F.lit("spectral")))


@query("union_by_name", """SELECT o_orderkey AS k, o_totalprice AS price, NULL::VARCHAR AS status FROM orders WHERE year(o_orderdate) = 1995 UNION ALL BY NAME SELECT o_orderkey AS k, NULL::DOUBLE AS price, o_orderstatus AS status FROM orders WHERE year(o_orderdate) = 1996""")
def union_by_name(spark, sf_dir):
    o = A.read(spark, sf_dir, "orders")
    return splits.union_dates(o.where("year(o_orderdate) = 1995").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), o.where("year(o_orderdate) = 1996").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")))
