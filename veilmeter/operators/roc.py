"""Ranking statistics over scores(run_id, is_member, score), all runs in one plan.

Scores are grouped first, then dealt out by run and bucket, a range of scores that is told by a score alone (256 to an octave). Windows
run within buckets, and over a row a bucket, so no task holds a whole run. Sums are integers, which makes results exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.operators import ranks


def bucket(score: Column, parts: int = 256) -> Column:
    """A number that never falls as the score rises: `parts` of them to each power of two, and between one half and 1, where probabilities
    crowd, to each power of two of what is left to 1."""
    half, one = 1999 * parts, 2000 * parts  # where one half and 1 lie on the first scale

    def place(x: Column) -> Column:
        octave = F.floor(F.log2(x))
        return (octave + 2000) * parts + F.floor((x / F.pow(F.lit(2.0), octave) - 1) * parts)

    size = F.least(F.abs(score), F.lit(1e300))
    near = half + (half - place(1 - score))  # from one half on, rising as what is left falls
    far = F.when(size >= 1, place(size) + 2 * half - one + parts).otherwise(place(size))
    own = F.when((score > 0.5) & (score < 1), near).otherwise(F.signum(score) * far)
    return F.when(score == 0, F.lit(0)).otherwise(own).cast("long")


def curve(scores: DataFrame, weight: str | None = None) -> DataFrame:
    """run_id, score, p, n, tp, fp, pos, neg: the counts at and from each different score down to it. Null and NaN scores are left out. weight: for how
    many samples a row stands."""
    count = lambda c: F.sum(c.cast("long") * (F.col(weight) if weight else 1))
    by = scores.filter("score IS NOT NULL AND NOT isnan(score)").groupBy("run_id", "score").agg(count(F.col("is_member")).alias("p"), count(~F.col("is_member")).alias("n"))
    by = by.withColumn("bucket", bucket(F.col("score")))
    run, part = Window.partitionBy("run_id"), Window.partitionBy("run_id", "bucket")
    above = run.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy("run_id", "bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = sums.select("run_id", "bucket", zero(F.sum("bp").over(above)).alias("bp"), zero(F.sum("bn").over(above)).alias("bn"), F.sum("bp").over(run).alias("pos"), F.sum("bn").over(run).alias("neg"))
    down = part.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return by.join(sums, ["run_id", "bucket"]).select(
        "run_id", "score", "p", "n", (F.col("bp") + F.sum("p").over(down)).alias("tp"), (F.col("bn") + F.sum("n").over(down)).alias("fp"), "pos", "neg"
    )


def quantile(roc: DataFrame, q: float, side: str = "all") -> DataFrame:
    """run_id, threshold: the linear quantile of the scores of members (`p`), non-members (`n`) or all, from their counts."""
    own, down, total = {"p": ("p", "tp", "pos"), "n": ("n", "fp", "neg"), "all": ("p + n", "tp + fp", "pos + neg")}[side]
    place = F.expr(f"({total} - 1) * {q}D")
    low, high = F.floor(place), F.ceil(place)
    holds = lambda k: (F.expr(f"{total} - ({down})") <= k) & (F.expr(f"{total} - ({down}) + ({own})") > k)
    ends = roc.filter(holds(low) | holds(high)).groupBy("run_id").agg(F.min("score").alias("a"), F.max("score").alias("b"), F.first(place - low).alias("part"))
    return ends.select("run_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("threshold"))


def _rate(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def points(roc: DataFrame) -> DataFrame:
    """run_id, threshold, tpr, fpr at each different score, and the start at (0, 0) under an infinite threshold."""
    start = roc.select("run_id").distinct().select("run_id", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return start.unionByName(_points(roc))


def _points(roc: DataFrame) -> DataFrame:
    return roc.select("run_id", F.col("score").alias("threshold"), _rate("tp", "pos").alias("tpr"), _rate("fp", "neg").alias("fpr"))


def dropped_points(roc: DataFrame) -> DataFrame:
    """points without those on a line with both neighbours: a score stays if the next lower one has other counts, and so do the first and the
    last. Neighbours meet by their rank, so no window runs over a whole curve."""
    order = [F.col("run_id"), F.desc("score")]
    placed = ranks.ranked(roc, order, "place", within="run_id")
    later = placed.select("run_id", (F.col("place") - 1).alias("place"), F.col("p").alias("next_p"), F.col("n").alias("next_n"))
    both = placed.join(later, ["run_id", "place"], "left")
    kept = both.filter((F.col("place") == 0) | F.col("next_p").isNull() | (F.col("p") != F.col("next_p")) | (F.col("n") != F.col("next_n")))
    return points(kept)


def tpr_at(limit: float) -> Column:
    return F.coalesce(F.max(F.when(_rate("fp", "neg") <= limit, _rate("tp", "pos"))), F.lit(0.0))


def summary(roc: DataFrame) -> DataFrame:
    """run_id, auc (null if one class is missing), advantage (most TPR - FPR), tpr_at_1pct, tpr_at_01pct, n_members, n_nonmembers."""
    wins = F.sum((F.col("n") * (2 * (F.col("tp") - F.col("p")) + F.col("p"))).cast("decimal(38,0)")).cast("double")
    total = (2 * F.max("pos").cast("double") * F.max("neg").cast("double"))
    return roc.groupBy("run_id").agg(
        F.try_divide(wins, total).alias("auc"),
        F.greatest(F.lit(0.0), F.max(_rate("tp", "pos") - _rate("fp", "neg"))).alias("advantage"),
        tpr_at(0.01).alias("tpr_at_1pct"), tpr_at(0.001).alias("tpr_at_01pct"), F.max("pos").alias("n_members"), F.max("neg").alias("n_nonmembers"),
    )


def best_threshold(roc: DataFrame) -> DataFrame:
    """run_id, threshold, balanced_accuracy: the lowest score that maximises (TPR + TNR) / 2, compared as integers."""
    good = F.col("tp") * F.col("neg") + (F.col("neg") - F.col("fp")) * F.col("pos")
    first = F.max(F.struct(good.cast("decimal(38,0)").alias("good"), (-F.col("score")).alias("low"), "score", "pos", "neg")).alias("b")
    value = F.try_divide(F.col("b.good").cast("double"), 2 * F.col("b.pos").cast("double") * F.col("b.neg").cast("double"))
    return roc.groupBy("run_id").agg(first).select("run_id", F.col("b.score").alias("threshold"), value.alias("balanced_accuracy"))


def share(hit: Column, weight: str | None = None) -> Column:
    """The mean of a condition over the rows where it isn't null. weight: for how many samples a row stands."""
    if not weight:
        return F.avg(hit.cast("double"))
    return F.try_divide(F.sum(hit.cast("long") * F.col(weight)).cast("double"), F.sum(F.when(hit.isNotNull(), F.col(weight))).cast("double"))


def at_threshold(scores: DataFrame, thresholds: DataFrame, weight: str | None = None) -> DataFrame:
    """run_id, threshold, accuracy, tpr, fpr, advantage of `score >= threshold`."""
    said = scores.join(thresholds.select("run_id", "threshold"), "run_id").withColumn("said", F.col("score") >= F.col("threshold"))
    rate = lambda c: share(F.when(c, F.col("said")), weight)
    by = said.groupBy("run_id").agg(F.first("threshold").alias("threshold"), share(F.col("said") == F.col("is_member"), weight).alias("accuracy"), rate(F.col("is_member")).alias("tpr"), rate(~F.col("is_member")).alias("fpr"))
    return by.withColumn("advantage", F.col("tpr") - F.col("fpr"))


def tpr_by_quantile(roc: DataFrame, fpr: float) -> DataFrame:
    """run_id, threshold (linear quantile 1 - fpr of non-member scores), tpr: members at or above it; 0 if a side is empty."""
    cut = quantile(roc, 1 - fpr, "n")
    hit = F.coalesce(F.try_divide(F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("p")).otherwise(0)).cast("double"), F.max("pos").cast("double")), F.lit(0.0))
    return roc.join(cut, "run_id").groupBy("run_id").agg(F.first("threshold").alias("threshold"), hit.alias("tpr"))


def tpr_by_order(roc: DataFrame, fpr: float = 0.001) -> DataFrame:
    """run_id, threshold, tpr: the threshold is the non-member score at place max(0, int(n * fpr) - 1) from the top."""
    place = F.greatest(F.lit(0), F.floor(F.col("neg") * fpr) - 1)
    cut = roc.filter((F.col("fp") - F.col("n") <= place) & (F.col("fp") > place))
    return cut.select("run_id", F.col("score").alias("threshold"), F.coalesce(_rate("tp", "pos"), F.lit(0.0)).alias("tpr"))


def median_threshold(roc: DataFrame, members_only: bool) -> DataFrame:
    return quantile(roc, 0.5, "p" if members_only else "all")
