"""Membership tests: confidence, loss, shadow models, likelihood ratio, and the least likely tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.operators import models, roc, selection


def confidence_scores(preds: DataFrame, run_id: str | Column = "run", use_true_label: bool = True) -> DataFrame:
    """scores: probability of the true label, or the highest one. A label out of range raises."""
    score = F.col("proba")[F.col("label")] if use_true_label else F.array_max("proba")
    return preds.select((F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"), "sample_id", "is_member", score.alias("score"))


def losses(preds: DataFrame) -> DataFrame:
    """run_id, sample_id, is_member, loss = -ln of the true label's probability, floored at 1e-12."""
    p = F.col("proba")[F.col("label")]
    return preds.select(F.lit("run").alias("run_id"), "sample_id", "is_member", (-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"))


def loss_evaluate(found: DataFrame, digits: int = 9) -> DataFrame:
    """run_id, threshold (mean member loss), advantage, auc of -loss. Losses are rounded, so both sides of a comparison went one way."""
    found = found.withColumn("loss", F.round("loss", digits))
    cut = found.groupBy("run_id").agg(F.round(F.avg(F.when(F.col("is_member"), F.col("loss"))), digits).alias("threshold"))
    said = (F.col("loss") <= F.col("threshold")).cast("double")
    by = found.join(cut, "run_id").groupBy("run_id").agg(
        F.first("threshold").alias("threshold"), (F.avg(F.when(F.col("is_member"), said)) - F.avg(F.when(~F.col("is_member"), said))).alias("advantage")
    )
    auc = roc.summary(roc.curve(found.withColumn("score", -F.col("loss")))).select("run_id", "auc")
    return by.join(auc, "run_id")


def in_shadow(sample_id: Column, shadow: Column) -> Column:
    """Half of the samples for each shadow, by integers alone."""
    return ((sample_id * 7919 + shadow * 104729) % 1000003) % 2 == 0


def with_shadows(samples: DataFrame, shadows: int) -> DataFrame:
    each = samples.withColumn("shadow", F.explode(F.sequence(F.lit(0), F.lit(shadows - 1))))
    return each.withColumn("is_in", in_shadow(F.col("sample_id"), F.col("shadow")))


def shadow_counts(each: DataFrame, classes: int = models.CLASSES) -> DataFrame:
    counts = F.array(*[F.sum((F.col("is_in") & (F.col("label") == j)).cast("long")) for j in range(classes)])
    return each.groupBy("shadow", "k").agg(counts.alias("counts"), F.sum(F.col("is_in").cast("long")).alias("total"))


def shadow_features(pool: DataFrame, shadows: int = 4, classes: int = models.CLASSES) -> DataFrame:
    """shadow, sample_id, is_in, label, proba, features (probabilities in falling order, so no class is told apart)."""
    each = with_shadows(pool, shadows)
    joined = each.join(shadow_counts(each, classes).hint("merge"), ["shadow", "k"])  # as many rows as shadows and keys, never broadcast
    out = joined.withColumn("proba", F.transform("counts", lambda c: (c + 1).cast("double") / (F.col("total") + classes).cast("double")))
    return out.select("shadow", "sample_id", "is_in", "label", "proba", F.sort_array("proba", asc=False).alias("features"))


def _key(features: Column, extra: Column | None) -> Column:
    whole = F.transform(features, lambda x: F.round(x * 1e6).cast("long"))
    return whole if extra is None else F.concat(whole, F.array(F.round(extra * 1e6).cast("long")))


def shadow_attack(features: DataFrame, preds: DataFrame, labelled: bool = False) -> DataFrame:
    """scores of the target's samples: smoothed share of `in` among shadow samples with the same features; 0.5 for unseen ones.
    labelled adds the true label's probability to the features."""
    true = F.col("proba")[F.col("label")] if labelled else None
    table = features.groupBy(_key(F.col("features"), true).alias("f")).agg(F.sum(F.col("is_in").cast("long")).alias("ins"), F.count("*").alias("n"))
    seen = preds.withColumn("f", _key(F.sort_array("proba", asc=False), true)).join(table, "f", "left")
    score = (F.coalesce("ins", F.lit(0)) + 1).cast("double") / (F.coalesce("n", F.lit(0)) + 2).cast("double")
    return seen.select(F.lit("run").alias("run_id"), "sample_id", "is_member", score.alias("score"))


def at_half(scores: DataFrame) -> DataFrame:
    """scores with is_member_pred: a score of at least one half."""
    return scores.withColumn("is_member_pred", F.col("score") >= 0.5)


def shadow_evaluate(scores: DataFrame, shadows: int) -> DataFrame:
    """run_id, auc, accuracy (at one half), n_shadow, n_members, n_nonmembers."""
    right = at_half(scores).groupBy("run_id").agg(F.avg((F.col("is_member_pred") == F.col("is_member")).cast("double")).alias("accuracy"))
    found = roc.summary(roc.curve(scores)).select("run_id", "auc", "n_members", "n_nonmembers")
    return found.join(right, "run_id").withColumn("n_shadow", F.lit(shadows).cast("long"))


def fitted_threshold(scores: DataFrame, fixed: float | None = None, reference: bool = True) -> DataFrame:
    """run_id, threshold: a fixed one, for which no score is looked at, or else the best against non-members, or without reference ones
    the members' median."""
    if fixed is not None:
        return scores.select("run_id").distinct().withColumn("threshold", F.lit(float(fixed)))
    found = roc.curve(scores)
    return roc.best_threshold(found).select("run_id", "threshold") if reference else roc.median_threshold(found, True)


def direct_evaluate(scores: DataFrame) -> DataFrame:
    """run_id, auc, threshold (the best), accuracy, n_members, n_nonmembers."""
    c = roc.curve(scores)
    at = roc.at_threshold(scores, roc.best_threshold(c)).select("run_id", "threshold", "accuracy")
    return roc.summary(c).select("run_id", "auc", "n_members", "n_nonmembers").join(at, "run_id")


def resistance(preds: DataFrame, attack=None) -> DataFrame:
    """run_id, attack_auc, attack_accuracy, advantage (how far the accuracy is from one half), threshold, of an attack on a model's
    predictions; attack: from predictions to run_id, auc, accuracy, threshold, by default the direct test."""
    found = (attack or (lambda p: direct_evaluate(confidence_scores(p))))(preds)
    return found.select("run_id", F.col("auc").alias("attack_auc"), F.col("accuracy").alias("attack_accuracy"), F.abs(F.col("accuracy") - 0.5).alias("advantage"), "threshold")


def drawn(samples: DataFrame, seed: int = 42) -> DataFrame:
    """Half of the samples, n // 2 exactly, without replacement: the first in a fixed mixed order, told by a cut and not by a sort."""
    half = samples.agg(F.lit(1).alias("_all"), F.floor(F.count("*") / 2).alias("k"))
    own = samples.withColumns({"_all": F.lit(1), "_key": selection.mixed(F.col("sample_id"), seed)})
    return selection.drawn(own, ["_all"], "_key", "sample_id", half, "_in").filter("_in").select(samples.columns)


def with_exact_shadows(samples: DataFrame, shadows: int) -> DataFrame:
    """samples for each shadow with is_in: n // 2 of them exactly, drawn anew for each."""
    each = samples.withColumn("shadow", F.explode(F.sequence(F.lit(0), F.lit(shadows - 1)))).withColumn("_key", selection.mixed(F.col("sample_id"), F.col("shadow")))
    half = samples.agg(F.floor(F.count("*") / 2).alias("k")).withColumn("shadow", F.explode(F.sequence(F.lit(0), F.lit(shadows - 1))))
    return selection.drawn(each, ["shadow"], "_key", "sample_id", half, "is_in").drop("_key")


def capped(samples: DataFrame, most: int) -> DataFrame:
    """The first `most` samples of each side: a bound on the targets of the likelihood-ratio test."""
    order = Window.partitionBy("is_member").orderBy("sample_id")
    return samples.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.log(q / (1 - q))


def _counts_by_key(pool: DataFrame, shadows: int, classes: int) -> DataFrame:
    """k, counts: for each shadow a row of a class's counts each and the total. A row a key, so samples meet it once and not once a shadow; it is never
    broadcast, as what the planner takes for its size is that of the pool's file, and keys may be as many as samples."""
    one = lambda s, j: F.sum((in_shadow(F.col("sample_id"), F.lit(s)) & (F.col("label") == j)).cast("long"))
    all_of = lambda s: F.sum(in_shadow(F.col("sample_id"), F.lit(s)).cast("long"))
    return pool.groupBy("k").agg(F.array(*[F.array(*[one(s, j) for j in range(classes)], all_of(s)) for s in range(shadows)]).alias("counts")).hint("merge")


def _logits(joined: DataFrame, shadows: int, classes: int) -> DataFrame:
    """sample_id, is_member, m, inn, out: for each shadow the logit with and without the sample itself. Null without a label."""
    row = lambda s: F.element_at("counts", s + 1)
    own = lambda s: in_shadow(F.col("sample_id"), F.lit(s)).cast("long")
    c, n = F.array(*[row(s)[F.col("label")] - own(s) for s in range(shadows)]), F.array(*[row(s)[classes] - own(s) for s in range(shadows)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = lambda p: np.log((q := np.clip(p, 1e-7, 1 - 1e-7)) / (1 - q))
        for b in batches:
            c, n = (b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for k in (3, 4))
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * shadows)
            lists = [pa.ListArray.from_arrays(ends, pa.array(log(x), from_pandas=True)) for x in ((c + 2) / (n + 1 + classes), (c + 1) / (n + classes))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], ["sample_id", "is_member", "m", "inn", "out"])

    kind = joined.schema["sample_id"].dataType.simpleString()
    return joined.select("sample_id", "is_member", "m", c.alias("c"), n.alias("n")).mapInArrow(run, f"sample_id {kind}, is_member boolean, m int, inn array<double>, out array<double>")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _deviation(values: Column, mean: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(values))


def _middle(values: Column) -> Column:
    """The median, by linear interpolation."""
    s, n = F.array_sort(values), F.size(values)
    low, high = F.element_at(s, F.floor((n - 1) / 2).cast("int") + 1), F.element_at(s, F.floor(n / 2).cast("int") + 1)
    return low + (high - low) * 0.5


def lira_scores(pool: DataFrame, targets: DataFrame, shadows: int = 16, classes: int = models.CLASSES, pooled: bool = False) -> DataFrame:
    """run_id, sample_id, is_member, mean and deviation with and without the target, score. A count model with the target differs from
    one without by one count, so nothing is fitted again; what is observed is the median without it. Deviations are rounded, so that
    equal values have none. pooled: one deviation for all, that of all values without the target."""
    counts = _counts_by_key(pool, shadows, classes)
    own = targets.groupBy("sample_id", "is_member").agg(F.collect_list(F.struct("k", "label")).alias("own")).select("sample_id", "is_member", F.size("own").alias("m"), F.explode("own").alias("o"))
    logits = lambda m: _logits(own.filter(m).select("sample_id", "is_member", "m", "o.*").join(counts, "k"), shadows, classes)
    more = logits("m > 1").groupBy("sample_id", "is_member").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("inn", "out")])  # rows of one id are one sample
    each = logits("m = 1").drop("m").unionByName(more)
    by = each.withColumns({"mean_in": _mean(F.col("inn")), "mean_out": _mean(F.col("out"))}).select(
        "sample_id", "is_member", "mean_in", (F.round(_deviation(F.col("inn"), F.col("mean_in")), 9) + 1e-9).alias("sd_in"), "mean_out", (F.round(_deviation(F.col("out"), F.col("mean_out")), 9) + 1e-9).alias("sd_out"), _middle(F.col("out")).alias("seen")
    )
    if pooled:
        one = each.select(F.explode("out").alias("out")).agg(F.stddev_pop("out") + 1e-9).scalar()
        by = by.withColumns({"sd_in": one, "sd_out": one})
    log_of = lambda m, s: -0.5 * ((F.col("seen") - F.col(m)) / F.col(s)) ** 2 - F.log(s)
    return by.select(F.lit("run").alias("run_id"), "*", (log_of("mean_in", "sd_in") - log_of("mean_out", "sd_out")).alias("score"))


def _by_document(log_probs: DataFrame, min_tokens: int) -> DataFrame:
    """doc_id, n_tokens, lp: each document's different log-probabilities in rising order and how often it has each, counted before they are shuffled.
    log_probs: doc_id and logp, or lp, such pairs of a part of the document."""
    if "lp" in log_probs.columns:
        whole = log_probs.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("lp"))).alias("lp"))
        return whole.withColumn("n_tokens", F.aggregate("lp", F.lit(0).cast("long"), lambda a, x: a + x["n"])).filter(F.col("n_tokens") >= min_tokens)
    counted = log_probs.groupBy("doc_id", "logp").agg(F.count("*").alias("n"))
    by = counted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("logp", "n"))).alias("lp"), F.sum("n").alias("n_tokens"))
    return by.filter(F.col("n_tokens") >= min_tokens)


def _least(k: float) -> tuple[Column, Column]:
    """How many tokens are the least ones, and the sum of their log-probabilities."""
    n = F.greatest(F.lit(1), F.ceil(F.lit(k) * F.col("n_tokens"))).cast("long")
    start = F.struct(n.alias("left"), F.lit(0.0).alias("total"))
    take = lambda a, x: F.least(a["left"], x["n"])
    return n, F.aggregate("lp", start, lambda a, x: F.struct((a["left"] - take(a, x)).alias("left"), (a["total"] + take(a, x) * x["logp"]).alias("total")), lambda a: a["total"])


def min_k(log_probs: DataFrame, k: float = 0.2, min_tokens: int = 10) -> DataFrame:
    """doc_id, n_tokens, n_min, score: the mean of the ceil(k * n) least log-probabilities; documents with fewer tokens are left out."""
    if not 0 < k <= 1:
        raise ValueError("k must be in (0, 1]")
    if min_tokens < 1:
        raise ValueError("min_tokens must be at least 1")
    n, total = _least(k)
    return _by_document(log_probs, min_tokens).select("doc_id", "n_tokens", n.alias("n_min"), (total / n).alias("score"))


def min_k_sweep(log_probs: DataFrame, ks: tuple[float, ...], min_tokens: int = 10) -> DataFrame:
    """k, n_docs, mean_score: the mean of min_k's scores for each k, from one pass over the tokens."""
    score = lambda k: _least(k)[1] / _least(k)[0]
    each = _by_document(log_probs, min_tokens).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), score(k).alias("score")) for k in ks])).alias("x")).select("x.*")
    return each.groupBy("k").agg(F.count("*").alias("n_docs"), F.avg("score").alias("mean_score"))


def min_k_array(values: list[float], k: float = 0.2, min_tokens: int = 10) -> float:
    if len(values) < min_tokens:
        raise ValueError(f"{len(values)} tokens, at least {min_tokens} are needed")
    n = max(1, math.ceil(k * len(values)))
    return sum(sorted(values)[:n]) / n


def min_k_predict(scores: DataFrame, threshold: float = -3.0) -> DataFrame:
    return scores.withColumns({"is_member_pred": F.col("score") >= threshold, "confidence": 1 / (1 + F.exp(-(F.col("score") - threshold)))})
