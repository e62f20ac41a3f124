"""Approximate nearest neighbours over balanced posting lists.

Fitting takes a bounded sample and halves it by the median along the line between two means, again and again, so lists come out
of equal size; a list is known by its mean. A graph that links each mean to its nearest others is searched in memory, best
first. Every vector is posted to its nearest list and, near a border, to up to REPLICAS lists whose distance is within a ratio
of the nearest's. A query reads the lists whose distance is within a ratio of its nearest list's, up to a number of them, and distances to
what is posted there are exact. Ratio and number are measured on rows of the sample, so that FOUND of their neighbours are found, and are at least REACH, PROBES
and a SHARE-th of the lists. With probes=MOST_LISTS and an
infinite reach a query reads every list, which gives the exact neighbours.

The number of lists grows with the table up to MOST_LISTS, so the means and their graph stay small. A list that holds more than
CHUNK vectors, or is asked by more than CHUNK queries, is cut into chunks by a hash, each a group of its own, so copies of one
vector don't meet in one task. A chunk passes on K neighbours a query. Fitting takes about SAMPLE rows, by a hash of the id, and
no more than twice as many where ids repeat.

Defined cases: vectors that are null, empty, zero, of another length than the sample's, or with null or non-finite components
take no part; ties go to the smaller vec_id; rows that repeat a vec_id count once, at the smaller distance, and a query's own
id is no neighbour; null ids take no part; an empty table gives an empty table; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.llm.common import written

K = 10
SAMPLE = 20_000
PER_LIST = 128
MOST_LISTS = 4096
REPLICAS, BORDER = 4, 1.1
PROBES, SHARE, REACH = 96, 16, 1.15
FOUND = 0.95
DEGREE = 24
CHUNK = 4096


class Index:
    """Means of the lists and the graph between them."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        size = -(-len(sample) // max(1, lists))
        self.means = np.stack([sample[own].mean(axis=0) for own in self._halved(sample, np.arange(len(sample)), max(1, size), rng)])
        square = self.square = (self.means**2).sum(axis=1)
        n = len(self.means)
        near = np.zeros((n, max(1, min(DEGREE, n - 1))), int)
        for at in range(0, n if n > 1 else 0, 256):
            own = np.arange(at, min(at + 256, n))
            far = square[own, None] - 2 * self.means[own] @ self.means.T + square[None, :]
            far[own - at, own] = np.inf
            near[own] = np.argsort(far, axis=1, kind="stable")[:, : near.shape[1]]
        # A ring besides the nearest links keeps the graph in one part.
        self.after = np.concatenate([near, (np.arange(n)[:, None] + [1, n - 1]) % n], axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def _halved(self, x: np.ndarray, own: np.ndarray, size: int, rng) -> list[np.ndarray]:
        if len(own) <= size:
            return [own]
        points = x[own]
        two = points[rng.choice(len(points), 2, replace=False)]
        for _ in range(6):
            first = ((points - two[0]) ** 2).sum(axis=1) < ((points - two[1]) ** 2).sum(axis=1)
            if first.all() or not first.any():
                break
            two = np.stack([points[first].mean(axis=0), points[~first].mean(axis=0)])
        order = np.argsort(points @ (two[1] - two[0]), kind="stable")
        half = len(order) // 2
        return self._halved(x, own[order[:half]], size, rng) + self._halved(x, own[order[half:]], size, rng)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest lists of each row of x that a best-first walk with `width` places finds, nearest first, and their distances; -1 and infinite past the last."""
        n, lists = len(x), len(self.means)
        width = min(width, lists)
        rows, own_square = np.arange(n)[:, None], (x**2).sum(axis=1)[:, None]
        met, done = np.zeros((n, lists), bool), np.zeros((n, lists), bool)

        def distance(at: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(self.square[at] - 2 * np.matmul(self.means[at], x[:, :, None])[:, :, 0] + own_square, 0))

        held = np.tile(self.entry, (n, 1))
        far = distance(held)
        met[rows, held] = True
        while True:
            best = np.argsort(far, axis=1, kind="stable")[:, :width]
            held, far = np.take_along_axis(held, best, 1), np.take_along_axis(far, best, 1)
            waiting = np.isfinite(far) & ~done[rows, held]
            if not waiting.any():
                return np.where(np.isfinite(far), held, -1), far
            turn = np.argsort(~waiting, axis=1, kind="stable")[:, :4]
            now, go = np.take_along_axis(held, turn, 1), np.take_along_axis(waiting, turn, 1)
            done[np.broadcast_to(rows, now.shape)[go], now[go]] = True
            fresh = self.after[now].reshape(n, -1)
            fresh_far = np.where(np.repeat(go, self.after.shape[1], axis=1) & ~met[rows, fresh], distance(fresh), np.inf)
            # A node may be reached from two others: it takes one place, with the least of the distances.
            order = np.argsort(2 * fresh + np.isinf(fresh_far), axis=1, kind="stable")
            ordered = np.take_along_axis(fresh, order, 1)
            again = np.zeros(fresh.shape, bool)
            np.put_along_axis(again, order, np.concatenate([np.zeros((n, 1), bool), ordered[:, 1:] == ordered[:, :-1]], axis=1), 1)
            fresh_far = np.where(again, np.inf, fresh_far)
            met[np.broadcast_to(rows, fresh.shape)[np.isfinite(fresh_far)], fresh[np.isfinite(fresh_far)]] = True
            held, far = np.concatenate([held, fresh], axis=1), np.concatenate([far, fresh_far], axis=1)

    def pick(self, x: np.ndarray, width: int, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: the lists within `ratio` of each row's nearest, at most `most`."""
        lists, far = self.search(x, width)
        near = np.isfinite(far[:, :most])
        if np.isfinite(ratio):
            near &= far[:, :most] <= ratio * far[:, :1] + 1e-12
        row, place = np.nonzero(near)
        return row, lists[row, place]


def calibrated(index: Index, sample: np.ndarray, k: int = K, share: float = FOUND, rows: int = 256, seed: int = 42) -> tuple[int, float]:
    """probes, reach: how many lists, and up to which ratio, must be read so that `share` of the k nearest neighbours that some rows of the
    sample have in it are found. In the whole table neighbours are nearer, so less would do there. Never less than PROBES, or a SHARE-th of the
    lists, and REACH."""
    lists = len(index.means)
    least = max(PROBES, lists // SHARE)
    k = min(k, len(sample) - 1)
    if lists == 1 or k < 1:
        return least, REACH
    asked = np.random.default_rng(seed).choice(len(sample), min(rows, len(sample)), replace=False)
    q, square = sample[asked], (sample**2).sum(axis=1)
    far = square[None, :] - 2 * q @ sample.T
    far[np.arange(len(q)), asked] = np.inf
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    found, distance = index.search(q, max(least, lists // 2))
    at = {(i, c): r for i, own in enumerate(found.tolist()) for r, c in enumerate(own) if c >= 0}
    row, place = index.pick(sample[near.ravel()], 2 * REPLICAS + 8, REPLICAS, BORDER)
    rank = np.full(near.size, lists)
    np.minimum.at(rank, row, [at.get((r // k, c), lists) for r, c in zip(row.tolist(), place.tolist())])
    ratio = np.where(rank < found.shape[1], distance[np.arange(near.size) // k, np.minimum(rank, found.shape[1] - 1)] / np.maximum(distance[np.arange(near.size) // k, 0], 1e-300), np.inf)
    # Each may lose half of what may be lost; a walk that hasn't come by a list counts as any number of lists.
    most = 1 - (1 - share) / 2
    probes, reach = int(np.quantile(rank, most, method="higher")) + 1, float(np.quantile(ratio, most, method="higher"))
    return min(lists, max(least, probes)), max(REACH, reach)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def _posted(vectors: DataFrame, index, dim: int, width: int, most: int, ratio: float) -> DataFrame:
    """list, id, vec (double components, little-endian) for each list that a vector is posted to, or asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                ids = b.column(0).to_numpy()
                x = b.column(1).flatten().to_numpy().reshape(len(ids), dim)
                row, place = index.value.pick(x, width, most, ratio)
                raw = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(ids[row], pa.int64()), pa.array([raw[k] for k in row], pa.binary())], ["list", "id", "vec"])

    return vectors.filter(F.size("v") == dim).mapInArrow(run, "list long, id long, vec binary")


def nearest_in(points: pd.DataFrame, queries: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """The k nearest different ids of each query within one chunk, exactly; an id that repeats counts at its smallest distance."""
    points = points.drop_duplicates(["id", "vec"])
    ids = points["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, p = ids[order], np.frombuffer(b"".join(points["vec"]), "<f8").reshape(-1, dim)[order]
    square, out = (p**2).sum(axis=1), []
    start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    asked, all_q = queries["id"].to_numpy(), np.frombuffer(b"".join(queries["vec"]), "<f8").reshape(-1, dim)
    for at in range(0, len(asked), 256):
        q, own = all_q[at : at + 256], asked[at : at + 256]
        rough = square[None, :] - 2 * q @ p.T + (q**2).sum(axis=1)[:, None]
        rough[own[:, None] == ids[None, :]] = np.inf
        slack = 1e-9 * (square.max() + (q**2).sum(axis=1))
        least = rough if len(start) == len(ids) else np.minimum.reduceat(rough, start, axis=1)
        limit = (np.partition(least, k - 1, axis=1)[:, k - 1] if len(start) > k else np.full(len(q), np.inf)) + slack
        for j, name in enumerate(own):
            near = np.flatnonzero((rough[j] <= limit[j]) & np.isfinite(rough[j]))
            score = np.sqrt(((p[near] - q[j]) ** 2).sum(axis=1))
            best = np.argsort(score, kind="stable")
            if len(start) < len(ids):
                best = best[np.sort(np.unique(ids[near[best]], return_index=True)[1])]
            best = best[:k]
            out.append((np.full(len(best), name), ids[near[best]], score[best]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
    return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], columns)))


def search(vectors: DataFrame, query_ids=None, k: int = K, probes: int | None = None, reach: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query; query_ids: a condition on vec_id, by default divisible by 100; probes: how many lists
    one reads at most; reach: the ratio of distances within which lists are read."""
    spark = vectors.sparkSession
    ready = usable(vectors)
    schema = "query_id long, rank int, vec_id long, score double"
    total = ready.count()
    share = min(1.0, SAMPLE / max(1, total))
    picked = ready.filter(F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1_000_000)) / 1e6 < share).limit(2 * SAMPLE).toPandas()
    if not len(picked):
        return spark.createDataFrame([], schema)
    picked = picked.sort_values("vec_id", kind="stable")
    dim = int(picked["v"].map(len).mode()[0])
    sample = np.stack([v for v in picked["v"] if len(v) == dim])
    index = spark.sparkContext.broadcast(Index(sample, max(1, min(MOST_LISTS, total // PER_LIST, len(sample) // 4))))
    if probes is None or reach is None:
        own = calibrated(index.value, sample, k)
        probes, reach = own[0] if probes is None else probes, own[1] if reach is None else reach
    points = written(_posted(ready, index, dim, 2 * REPLICAS + 8, REPLICAS, BORDER), "postings")
    asked = F.pmod("vec_id", F.lit(100)) == 0 if query_ids is None else query_ids
    queries = written(_posted(ready.filter(asked), index, dim, probes, probes, reach), "probes")
    # A list's chunks of points and of queries; as many rows as there are lists.
    chunks = {}
    for name, df in (("p", points), ("q", queries)):
        chunks[name] = {r["list"]: -(-r["count"] // CHUNK) for r in df.groupBy("list").count().collect()}
    table = lambda d: F.create_map(*[F.lit(x) for pair in sorted(d.items()) for x in pair]) if any(n > 1 for n in d.values()) else None

    def spread(df: DataFrame, own: dict, other: dict, mine: str, theirs: str) -> DataFrame:
        cut, copies = table(own), table(other)
        one = F.lit(0).cast("long")
        df = df.withColumn(mine, F.pmod(F.xxhash64("id"), cut[F.col("list")]) if cut is not None else one)
        many = F.explode(F.sequence(one, F.coalesce(copies[F.col("list")], F.lit(1)).cast("long") - 1)) if copies is not None else one
        return df.withColumn(theirs, many)

    left = spread(points, chunks["p"], chunks["q"], "pc", "qc")
    right = spread(queries, chunks["q"], chunks["p"], "qc", "pc")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return nearest_in(a, b, dim, k)

    key = ["list", "pc", "qc"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
