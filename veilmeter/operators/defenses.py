"""Training and output defenses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmeter.functions import privacy
from veilmeter.operators import ranks
from veilmeter.sources.shared import dropped, written


def clip(values: Column, low: float, high: float) -> Column:
    return F.transform(values, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x)))


def perturb(logits: Column, temperature: float = 1.0, noise: float = 0.1, bound: float = 10.0, seed: int | None = None) -> Column:
    """Clipped, divided by the temperature, with Gaussian noise (none where noise is 0)."""
    scaled = F.transform(clip(logits, -bound, bound), lambda x: x / temperature)
    return scaled if noise == 0 else F.transform(scaled, lambda x: x + F.randn(seed) * noise)


def _with(value: Column, f) -> Column:
    """f(value), value computed once."""
    return F.transform(F.array(value), f)[0]


def softmax(values: Column) -> Column:
    shifted = _with(F.array_max(values), lambda m: F.transform(values, lambda x: F.exp(x - m)))
    return _with(shifted, lambda e: _with(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda t: F.transform(e, lambda x: x / t)))


def perturb_proba(proba: Column, **how) -> Column:
    return softmax(perturb(F.transform(proba, privacy.log_floor), **how))


def smoothed_loss(logits: Column, label: Column, smoothing: float, classes: int) -> Column:
    """Cross-entropy with the true class at 1 - smoothing and the others sharing it."""
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x)))
    terms = F.transform(logits, lambda x, j: F.when(j == label, 1 - smoothing).otherwise(smoothing / (classes - 1)) * (total - x))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def early_stopping(rows: DataFrame, key: str, order: list[str], value: str, patience: int = 5, min_delta: float = 1e-4) -> DataFrame:
    """key, best, counter, stopped, n: each key's values folded in order; once stopped it stays so, while best and counter go on. The sorted
    rows are a stream, of which a task holds one key's state."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def out() -> pa.RecordBatch:
            kinds = [own, pa.float64(), pa.int64(), pa.bool_(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], ["k", "best", "counter", "stopped", "n"])
            done.clear()
            return batch

        own = None
        for b in batches:
            own = b.schema.field(0).type
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if state is None or k != now:
                    if state is not None:
                        done.append((now, *state))
                    now, state = k, [float("inf"), 0, False, 0]
                # As in SQL: NaN is not less, and a null that uses up the patience leaves open whether it stopped.
                if v is not None and v < state[0] - min_delta:
                    state[0], state[1] = v, 0
                else:
                    state[1] += 1
                    if state[1] >= patience and state[2] is not True:
                        state[2] = None if v is None else True
                state[3] += 1
            if len(done) >= 1000:
                yield out()
        if state is not None:
            done.append((now, *state))
            yield out()

    ordered = rows.repartition(key).sortWithinPartitions(key, *order, value).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    return ordered.mapInArrow(run, f"k {kind.simpleString()}, best double, counter long, stopped boolean, n long").withColumnRenamed("k", key)


def clipped(gradient: Column, most: float) -> Column:
    """The gradient at norm `most` if it is longer."""
    norm = F.sqrt(F.aggregate(gradient, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(gradient, lambda x: F.when(norm > most, x * most / norm).otherwise(x))


def first_step(samples: DataFrame, most: float = 0.4) -> DataFrame:
    """coordinate, gradient: the mean of clipped logistic gradients at weights 0, without noise; y is 1 for label 0."""
    y = F.when(F.col("label") == 0, 1.0).otherwise(0.0)
    g = samples.select(F.posexplode(clipped(F.transform("features", lambda x: (0.5 - y) * x), most)).alias("coordinate", "g"))
    return g.groupBy("coordinate").agg(F.avg("g").alias("gradient")).withColumn("coordinate", F.col("coordinate").cast("long"))


def batch_step(samples: DataFrame, most: float = 0.01, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """coordinate, gradient: the mean logistic gradient of one batch at weights 0, scaled as a whole where its norm is beyond `most`,
    with Gaussian noise of deviation noise * most."""
    y = F.when(F.col("label") == 0, 1.0).otherwise(0.0)
    g = samples.select(F.posexplode(F.transform("features", lambda x: (0.5 - y) * x)).alias("coordinate", "g")).groupBy("coordinate").agg(F.avg("g").alias("g"))
    scale = F.least(F.lit(1.0), most / (F.sqrt(g.agg(F.sum(F.col("g") * F.col("g"))).scalar()) + 1e-6))
    out = F.col("g") * scale + (F.randn(seed) * noise * most if noise else F.lit(0.0))
    return g.select(F.col("coordinate").cast("long").alias("coordinate"), out.alias("gradient"))


def dealt_batches(own: DataFrame, n: int, epochs: list[int], batch: int, seed: int, chunk: int) -> DataFrame:
    """own for each epoch with step (its batch of exactly `batch` rows, the last one less) and chunk (steps that one task runs through), in a folder each."""
    each = own.withColumn("epoch", F.explode(F.array(*map(F.lit, epochs)))).withColumn("h", F.xxhash64("sample_id", "epoch", F.lit(seed)))
    placed = ranks.ranked(each, [F.col("epoch"), F.col("h"), F.col("sample_id")], "place", within="epoch")
    placed = placed.withColumn("step", F.floor(F.col("place") / batch)).withColumn("chunk", F.floor(F.col("step") / chunk))
    return written(placed.drop("h").repartition("epoch", "chunk").sortWithinPartitions("epoch", "chunk", "place"), "batches", by=("epoch", "chunk"))


def dp_sgd(samples: DataFrame, configs: DataFrame, epochs: int = 10, batch: int = 64, rate: float = 0.1, most: float = 1.0, seed: int = 42, chunk: int = 64) -> DataFrame:
    """run_id, accuracy, steps, sigma, sample_rate, delta: a logistic fit for each setting from weights 0, all settings in each step. An epoch deals
    the rows into ceil(n / batch) batches of exactly `batch` rows, the last one less; each is read once. Steps depend on one another, so a job
    takes `chunk` of them, one after the other in one task that holds a batch; weights go from job to job through the driver. A step's
    noise depends on seed, epoch and step alone, so a lost task repeats it."""
    spark, rows = samples.sparkSession, [r.asDict() for r in configs.select("run_id", "sigma", "delta").collect()]
    own = samples.select("sample_id", "features", (F.col("label") == 0).cast("double").alias("y"))
    n, dim = own.agg(F.count("*"), F.max(F.size("features"))).first()
    steps = -(-(n or 0) // batch)
    weights, sigma = np.zeros((len(rows), dim or 0)), np.array([r["sigma"] for r in rows])
    at_once = max(1, min(epochs, 2_000_000 // max(1, n or 1)))  # epochs that are dealt out together
    for start in range(0, epochs if n else 0, at_once):
        turn = list(range(start, min(epochs, start + at_once)))
        dealt = dealt_batches(own, n, turn, batch, seed, chunk)
        for epoch in turn:
            for k in range(-(-steps // chunk)):

                def run(found: Iterator[pa.RecordBatch], now=weights, epoch=epoch) -> Iterator[pa.RecordBatch]:
                    w, x, y, step = now.copy(), [], [], None

                    def update() -> None:
                        rng, xs, ys = np.random.default_rng([seed, epoch, step]), np.stack(x), np.array(y)
                        g = 1 / (1 + np.exp(-np.clip(xs @ w.T, -500, 500))) - ys[:, None]
                        g *= np.minimum(1, most / np.maximum(np.abs(g) * np.linalg.norm(xs, axis=1)[:, None], 1e-12))
                        w[:] -= rate * (g.T @ xs + rng.normal(0, 1, w.shape) * (sigma * most)[:, None]) / len(ys)

                    for b in found:
                        values = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                        for s, v, own_y in zip(b.column(0).to_pylist(), values, b.column(2).to_pylist()):
                            if s != step:
                                if x:
                                    update()
                                x, y, step = [], [], s
                            x.append(v)
                            y.append(own_y)
                    if x:
                        update()
                    i, j = np.divmod(np.arange(w.size), max(1, w.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(w.ravel())], ["k", "j", "w"])

                some = dealt.filter((F.col("epoch") == epoch) & (F.col("chunk") == k)).select("step", "features", "y", "place").coalesce(1).sortWithinPartitions("place")
                found = some.mapInArrow(run, "k long, j long, w double").collect()  # settings x width numbers
                weights = np.zeros_like(weights)
                for r in found:
                    weights[r["k"], r["j"]] = r["w"]
        dropped(dealt)

    def hits(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rows), np.int64)
        for b in found:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                total += ((x @ weights.T > 0) == (b.column(1).to_numpy()[:, None] == 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(total)], ["k", "hits"])

    right = {r["k"]: r["n"] for r in own.select("features", "y").mapInArrow(hits, "k long, hits long").groupBy("k").agg(F.sum("hits").alias("n")).collect()} if n else {}
    out = [(r["run_id"], right[k] / n if n else None, epochs * steps, r["sigma"], min(1.0, batch / n) if n else None, r["delta"]) for k, r in enumerate(rows)]
    return spark.createDataFrame(out, "run_id string, accuracy double, steps long, sigma double, sample_rate double, delta double")
