"""Likelihood-ratio test with models that are fitted again: for each target, some with it and some without.

Targets are dealt to tasks. A task holds the pool as blocks of rows and fits the models of many targets side by side: a model's half
of the pool is a row of 0 and 1, and one matrix product of these rows with the rows' outer products gives the normal equations of all
models; those with the target add its own. Every model draws its n // 2 rows anew, from numbers that depend on seed, target, shadow and side.

A pool of more than POOL rows is never held by a task. Its rows are dealt to blocks by a mixed order and blocks to PARTS parts; of each block
PATTERNS exact halves are drawn, and their sums of outer products are added up by part and pattern. A model draws a pattern for each part, so
it has n // 2 rows of the whole pool, and no two models of a target have the same half of a part: they are as independent as halves drawn
anew. Other targets' models may have it again. What a task holds and what a target costs then don't grow with the pool.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.operators import ranks, selection

POOL = 4096  # rows of the largest pool that every task holds; of a larger one it holds sums by part and pattern
PARTS = 32
PATTERNS = 64
DEALT = 128  # rows of a block that is dealt to a part
TOGETHER = 32  # targets whose models are fitted side by side
BLOCK = 512  # rows of the pool whose outer products are in memory at once
RIDGE = 1.0


def halves(n: int, seed: int, target: int, shadows: int) -> np.ndarray:
    """side (1: with the target) x shadow x row: whether the row is drawn, n // 2 of them exactly."""
    keys = np.random.default_rng([seed, target & (2**63 - 1), int(target < 0)]).random((2, shadows, n))
    out = np.zeros(keys.shape, bool)
    np.put_along_axis(out, np.argpartition(keys, max(0, n // 2 - 1), axis=2)[:, :, : n // 2], True, axis=2)
    return out


def _sums(pool: np.ndarray, labels: np.ndarray, rows: np.ndarray, classes: int) -> np.ndarray:
    """draw x (upper half of the sum of outer products, sums of features by class) of the rows that each draw takes."""
    n, d = pool.shape
    one, half = np.eye(classes), d * (d + 1) // 2
    sums, parts = np.zeros((len(rows), half + d * classes)), np.empty((min(n, BLOCK), half + d * classes))
    for at in range(0, n, BLOCK):
        p, q = pool[at : at + BLOCK], one[labels[at : at + BLOCK]]
        own, to = parts[: len(p)], 0
        for i in range(d):  # outer products are symmetric, so half of them will do
            np.multiply(p[:, i : i + 1], p[:, i:], out=own[:, to : to + d - i])
            to += d - i
        own[:, half:] = (p[:, :, None] * q[:, None, :]).reshape(len(p), -1)
        sums += rows[:, at : at + BLOCK] @ own
    return sums


def _answers(sums: np.ndarray, x: np.ndarray, y: np.ndarray, shadows: int, classes: int, ridge: float) -> np.ndarray:
    """target x side x shadow: the logit of the true class's probability under each model, from the models' sums."""
    t, d = x.shape
    one, upper, half = np.eye(classes), np.triu_indices(d), d * (d + 1) // 2
    gram, right = np.empty((len(sums), d, d)), sums[:, half:].reshape(t, 2, shadows, d, classes)
    gram[:, upper[0], upper[1]] = gram[:, upper[1], upper[0]] = sums[:, :half]
    gram = gram.reshape(t, 2, shadows, d, d)
    gram[:, 1] += (x[:, :, None] * x[:, None, :])[:, None]
    right[:, 1] += (x[:, :, None] * one[y][:, None, :])[:, None]
    z = np.einsum("tsmdc,td->tsmc", np.linalg.solve(gram + ridge * np.eye(d), right), x)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    p = np.clip(np.take_along_axis(e / e.sum(axis=-1, keepdims=True), y[:, None, None, None], -1)[..., 0], 1e-7, 1 - 1e-7)
    return np.log(p / (1 - p))


def confidences(pool: np.ndarray, labels: np.ndarray, x: np.ndarray, y: np.ndarray, drawn: np.ndarray, classes: int, ridge: float = RIDGE) -> np.ndarray:
    """target x side x shadow: the logit of the true class's probability under each model. Models are ridge regressions on the classes; probabilities
    are the softmax of their answers. drawn: target x side x shadow x row."""
    rows = drawn.reshape(-1, drawn.shape[3]).astype(np.float64)
    return _answers(_sums(pool, labels, rows, classes), x, y, drawn.shape[2], classes, ridge)


def block_halves(n: int, seed: int, block: int, patterns: int) -> np.ndarray:
    """pattern x row: whether the row is drawn, n // 2 of a block's rows exactly. All blocks but the last have an even number of rows."""
    keys, out = np.random.default_rng([seed, block]).random((patterns, n)), np.zeros((patterns, n), bool)
    np.put_along_axis(out, np.argpartition(keys, max(0, n // 2 - 1), axis=1)[:, : n // 2], True, axis=1)
    return out


def picked(seed: int, target: int, shadows: int, parts: int, patterns: int) -> np.ndarray:
    """part x model (those without the target, then those with it): the pattern that it draws, another one for each model of a target."""
    keys = np.random.default_rng([seed, target & (2**63 - 1), int(target < 0)]).random((parts, patterns))
    return np.argsort(keys, axis=1)[:, : 2 * shadows]


def part_sums(pool: DataFrame, code: dict[int, int], seed: int, patterns: int) -> np.ndarray:
    """part x pattern x sums. A task takes the blocks of its parts one after another, so it holds a block and a part's sums."""
    placed = ranks.ranked(pool.select("sample_id", "features", "label"), [F.xxhash64("sample_id", F.lit(seed)), F.col("sample_id")], "_place")
    block = F.floor(F.col("_place") / DEALT)
    dealt = placed.select((block % PARTS).cast("int").alias("part"), block.alias("block"), "_place", F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"))
    classes = len(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums, held = None, None, []

        def add() -> np.ndarray:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            x, y = np.array(b.column(3).to_pylist(), np.float64), np.array([code[k] for k in b.column(4).to_pylist()])
            drawn = block_halves(len(x), seed, b.column(1)[0].as_py(), patterns)
            return _sums(x, y, drawn.astype(np.float64), classes)

        for big in batches:
            blocks = big.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                own = big.slice(at, to - at)
                if held and held[0].column(1)[0] != own.column(1)[0]:
                    sums, held = add() + (0 if sums is None else sums), []
                if part is not None and part != own.column(0)[0].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sums.tobytes()])], ["part", "sums"])
                    sums = None
                part = own.column(0)[0].as_py()
                held.append(own)
        if held:
            sums = add() + (0 if sums is None else sums)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sums.tobytes()])], ["part", "sums"])

    found = dealt.repartition(PARTS, "part").sortWithinPartitions("part", "block", "_place").mapInArrow(run, "part long, sums binary").collect()  # a row a part
    return np.stack([np.frombuffer(r["sums"]).reshape(patterns, -1) for r in sorted(found, key=lambda r: r["part"])])


def ratio(logits: np.ndarray) -> np.ndarray:
    """target x (mean and deviation with, and without, what is seen, score). What is seen is the median without the target."""
    mean, sd = logits.mean(axis=2), logits.std(axis=2) + 1e-9
    seen = np.median(logits[:, 0], axis=1)
    log = -0.5 * ((seen[:, None] - mean) / sd) ** 2 - np.log(sd)
    return np.stack([mean[:, 1], sd[:, 1], mean[:, 0], sd[:, 0], seen, log[:, 1] - log[:, 0]], axis=1)


def pool_rows(pool: DataFrame, most: int, seed: int = 42) -> pd.DataFrame:
    """The pool by sample_id: all of it, or `most` rows by a fixed mixed order."""
    n = pool.count()
    own = pool.select("sample_id", "features", "label")
    if n > most:
        keyed = own.withColumns({"_all": F.lit(1), "_key": selection.mixed(F.col("sample_id"), seed)})
        wanted = pool.sparkSession.createDataFrame([(1, most)], "_all int, k long")
        own = selection.drawn(keyed, ["_all"], "_key", "sample_id", wanted, "_in").filter("_in").select("sample_id", "features", "label")
    return own.toPandas().sort_values("sample_id", kind="stable")  # `most` rows


def lira_retrained(pool: DataFrame, targets: DataFrame, shadows: int = 4, seed: int = 42, most: int | None = None) -> DataFrame:
    """run_id, sample_id, is_member, mean_in, sd_in, mean_out, sd_out, seen, score of every target, 2 * shadows models fitted for each on the whole pool, or on
    `most` rows of it where that is given. pool, targets: sample_id, features, label (and is_member). Without a pool all is null."""
    schema = "sample_id long, is_member boolean, mean_in double, sd_in double, mean_out double, sd_out double, seen double, score double"
    labels = sorted(r[0] for r in pool.select(F.col("label").cast("int")).union(targets.select(F.col("label").cast("int"))).filter("label IS NOT NULL").distinct().collect())  # the classes
    code, patterns = {k: i for i, k in enumerate(labels)}, max(PATTERNS, 2 * shadows)
    parted = most is None and pool.count() > POOL
    if parted:
        held = part_sums(pool, code, seed, patterns)
    else:
        own = pool_rows(pool, POOL if most is None else most, seed)
        held = (np.stack(own["features"]).astype(np.float64), np.array([code[int(k)] for k in own["label"]])) if len(own) else None
    sent = targets.sparkSession.sparkContext.broadcast(held)
    names = [c.split()[0] for c in schema.split(", ")]

    def logits(x: np.ndarray, y: np.ndarray, idents: list[int]) -> np.ndarray:
        if not parted:
            rows, classes = sent.value
            return confidences(rows, classes, x, y, np.stack([halves(len(rows), seed, i, shadows) for i in idents]), len(code))
        picks = np.stack([picked(seed, i, shadows, PARTS, patterns) for i in idents], axis=1).reshape(PARTS, -1)
        sums = np.zeros((picks.shape[1], sent.value.shape[2]))
        for own, pick in zip(sent.value, picks):
            sums += own.take(pick, axis=0)
        return _answers(sums, x, y, shadows, len(code), RIDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, TOGETHER):
                b = big.slice(at, TOGETHER)
                if sent.value is None:
                    none = [pa.nulls(b.num_rows, pa.float64())] * 6
                else:
                    x, y = np.array(b.column(2).to_pylist(), np.float64), np.array([code[k] for k in b.column(3).to_pylist()])
                    none = [pa.array(c) for c in ratio(logits(x, y, b.column(0).to_pylist())).T]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *none], names)

    each = targets.select("sample_id", "is_member", "features", F.col("label").cast("int").alias("label")).repartition("sample_id")
    return each.mapInArrow(run, schema).select(F.lit("run").alias("run_id"), "*")
