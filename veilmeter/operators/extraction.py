"""Model extraction and inversion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.operators import models


def extract(queries: DataFrame, key: str) -> DataFrame:
    """key, substitute: the label that the target gave most often for the key; the lower of equal ones. Only its labels are asked for."""
    counts = queries.groupBy(key, "pred").count()
    return counts.groupBy(key).agg(F.max(F.struct("count", (-F.col("pred")).alias("low"))).alias("b")).select(key, (-F.col("b.low")).cast("int").alias("substitute"))


def agreement(rows: DataFrame, substitute: DataFrame | None, key: str) -> DataFrame:
    """n, agreement of target and substitute on the same rows; an unseen key counts as class 0. Without a substitute it raises."""
    if substitute is None:
        raise RuntimeError("no substitute has been extracted yet")
    both = rows.join(substitute, key, "left").withColumn("substitute", F.coalesce("substitute", F.lit(0)))
    return both.agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("substitute")).cast("double")).alias("agreement"))


def invert_argmax(model: DataFrame, classes: int = models.CLASSES) -> DataFrame:
    """label, k, confidence: the key for which the model is surest of each class; the smallest of equal ones."""
    each = model.select("k", "total", F.posexplode("counts").alias("label", "c"))
    each = each.withColumn("p", (F.col("c") + 1).cast("double") / (F.col("total") + classes).cast("double"))
    best = F.max(F.struct("p", (-F.col("k")).alias("low"))).alias("b")
    return each.groupBy("label").agg(best).select(F.col("label").cast("long").alias("label"), (-F.col("b.low")).alias("k"), F.col("b.p").alias("confidence"))


def hill_climb(centroids: DataFrame, target: int, restarts: int = 5, steps: int = 500, step: float = 0.01, seed: int = 42, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """restart, confidence, x: climbs for each restart in parallel; the model is softmax of -distance to class centroids (a row a class)."""
    rows = sorted((r["label"], r["centre"]) for r in centroids.collect())
    labels, means = [r[0] for r in rows], np.array([r[1] for r in rows])
    own = labels.index(target)

    def confidence(x: np.ndarray) -> float:
        z = -((means - x) ** 2).sum(axis=1)
        e = np.exp(z - z.max())
        return float(e[own] / e.sum())

    def run(batches):
        for pdf in batches:
            out = []
            for restart in pdf["id"]:
                rng = np.random.default_rng([seed, int(restart)])
                x = rng.uniform(low, high, means.shape[1])
                best = confidence(x)
                for _ in range(steps):
                    y = x.copy()
                    j = rng.integers(len(y))
                    y[j] = np.clip(y[j] + rng.uniform(-step, step), low, high)
                    if (c := confidence(y)) > best:
                        x, best = y, c
                out.append((int(restart), best, x.tolist()))
            yield pd.DataFrame(out, columns=["restart", "confidence", "x"])

    spark = centroids.sparkSession
    return spark.range(restarts).repartition(restarts).mapInPandas(run, "restart long, confidence double, x array<double>")


def best_restart(climbs: DataFrame) -> DataFrame:
    """restart, confidence, x: the surest of all restarts, the first of equal ones."""
    best = F.max(F.struct("confidence", (-F.col("restart")).alias("low"), "x")).alias("b")
    return climbs.agg(best).select((-F.col("b.low")).alias("restart"), F.col("b.confidence").alias("confidence"), F.col("b.x").alias("x"))


def inversion_report(best: DataFrame, target: int, restarts: int, steps: int) -> DataFrame:
    """attack, target_class, confidence (four digits), n_features, restarts, steps, reconstructed, of the surest restart."""
    return best.select(
        F.lit("model_inversion").alias("attack"), F.lit(target).cast("long").alias("target_class"), F.bround("confidence", 4).alias("confidence"), F.size("x").cast("long").alias("n_features"),
        F.lit(restarts).cast("long").alias("restarts"), F.lit(steps).cast("long").alias("steps"), F.transform("x", lambda v: F.bround(v, 4)).alias("reconstructed")
    )
