"""Pluggable scorers over chunks, and a linear pixel baseline."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[np.ndarray], np.ndarray]


def score_chunks(chunks: DataFrame, scorer: Callable[[], Scorer], batch: int = 32) -> DataFrame:
    """chunks(.., h, w, data) plus prob (array<double>). scorer is called once a partition, on the
    worker, to load a model; the model maps [n, h, w] to probabilities of that shape. Chunks of
    one shape go to it up to batch at a time."""

    def run(frames):
        model = scorer()
        for f in frames:
            prob: list = [None] * len(f)
            for (h, w), rows in f.reset_index(drop=True).groupby(["h", "w"]).groups.items():
                for a in range(0, len(rows), batch):
                    part = rows[a : a + batch]
                    x = np.stack([np.nan_to_num(np.array(f["data"].iloc[i], float)).reshape(h, w) for i in part])
                    for i, p in zip(part, np.asarray(model(x), float)):
                        prob[i] = p.ravel()
            yield f.assign(prob=pd.Series(prob, index=f.index))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, schema + ", prob array<double>")


def score_boxes(chunks: DataFrame, scorer: Callable[[], Callable[[np.ndarray], list[tuple]]], keys: list[str]) -> DataFrame:
    """Boxes (keys.., class_id, confidence, x1, y1, x2, y2) that a detector finds in each chunk,
    moved to the image by row0 and col0."""

    def run(frames):
        model = scorer()
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                image = np.nan_to_num(np.array(r["data"], float)).reshape(r["h"], r["w"])
                out += [(*[r[k] for k in keys], int(c), float(p), x1 + r["col0"], y1 + r["row0"], x2 + r["col0"], y2 + r["row0"]) for c, p, x1, y1, x2, y2 in model(image)]
            yield pd.DataFrame(out, columns=[*keys, "class_id", "confidence", "x1", "y1", "x2", "y2"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name in keys)
    return chunks.mapInPandas(run, schema + ", class_id int, confidence double, x1 double, y1 double, x2 double, y2 double")


def thresholds(prob: DataFrame, p: str, levels: dict[str, float]) -> DataFrame:
    """One row a pixel and level that it reaches."""
    pairs = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(v)).alias("least")) for k, v in levels.items()])
    return prob.select("*", F.inline(pairs)).where(F.col(p) >= F.col("least")).drop("least")


def fit_pixel_baseline(rows: DataFrame, features: list[str], y: str):
    """Logistic regression over band columns, by Spark ML: the linear stand-in for a network."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    parts = [VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip"), LogisticRegression(featuresCol="__x", labelCol=y, maxIter=50)]
    return Pipeline(stages=parts).fit(rows)


def linear_score(weights: dict[str, float], intercept: float) -> Column:
    """Probability by a linear model as a column, without a UDF."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + F.coalesce(F.col(name), F.lit(0.0)) * w
    return 1 / (1 + F.exp(-z))
