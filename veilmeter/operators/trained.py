"""Trained models as targets, shadows and substitutes: names and settings for MLlib estimators."""

from __future__ import annotations

from pyspark.ml.base import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier

#: Trees, depth, rate and leaf of the boosted targets.
BOOSTED = {"default": (100, 5, 0.1, 10), "generalised": (50, 3, 0.1, 50), "moderate": (200, 6, 0.1, 5), "overfitted": (500, 12, 0.2, 1)}
SHADOWS = ("random_forest", "decision_tree", "logistic_regression")
SUBSTITUTES = ("decision_tree", "random_forest", "logistic_regression", "mlp")


def _estimator(name: str, seed: int, features: int, classes: int, rows: int, **columns) -> Estimator:
    """rows: those that a logistic model will be fitted on; its penalty is 1 / rows, half the squared weights in all; 0: no penalty."""
    if name == "random_forest":
        return RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed, **columns)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=30, seed=seed, **columns)
    if name == "logistic_regression":
        return LogisticRegression(maxIter=1000, regParam=1 / rows if rows else 0.0, **columns)
    return MultilayerPerceptronClassifier(maxIter=500, layers=[features, 100, classes], seed=seed, **columns)


def shadow(name: str = "random_forest", seed: int = 42, rows: int = 0, **columns) -> Estimator:
    if name not in SHADOWS:
        raise ValueError(f"unknown shadow model: {name}")
    return _estimator(name, seed, 0, 0, rows, **columns)


def substitute(name: str = "decision_tree", features: int = 0, classes: int = 2, seed: int = 42, rows: int = 0, **columns) -> Estimator:
    """features and classes: the sizes that `mlp` needs."""
    if name not in SUBSTITUTES:
        raise ValueError(f"unknown substitute model: {name}")
    return _estimator(name, seed, features, classes, rows, **columns)


def boosted(name: str = "default", classes: int = 2, seed: int = 42, **columns) -> Estimator:
    """A boosted target by its setting; of more than two classes, one against the rest."""
    if name not in BOOSTED:
        raise ValueError(f"unknown boosted model: {name}")
    trees, depth, rate, leaf = BOOSTED[name]
    one = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, seed=seed, **columns)
    return one if classes == 2 else OneVsRest(classifier=one, **columns)
