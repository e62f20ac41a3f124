"""Importance resampling towards a target distribution: hashed n-gram features, array-scored weights, exact draw by a histogram of scores.

1. Every run of 1 to 3 words falls into one of BUCKETS by its CRC-32. numpy advances the registers of all words of a batch side
   by side, byte by byte; a run's register goes on from that of the run before its last word. Each task adds up one array of
   counts, so only BUCKETS numbers a task are shuffled, and BUCKETS numbers reach the driver, at any size of the tables.
2. The gains of the buckets are an array sent with the tasks; a document's weight is the sum of its features' gains, in one pass.
3. Scores are whole numbers. Their histogram, with the counts of all higher scores (sums over ranges of scores, so no task holds all
   of them), gives each score its rank offset and the score at which the draw ends. Only rows that reach it are numbered within
   their score, by doc_id.

Defined cases: null text has no features and weight 0; an empty target or an empty table counts as no features (S or T is 0); a document
without an id draws its noise as if its id were an empty text, and comes after others of its score; rows that share an id share the
noise and are numbered in any order, rows equal in all as well; documents with fewer than `least` words are never drawn, and don't
count among the N; very long texts and words are taken whole; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.llm.common import slices, written
from veilmeter.llm.words import Words, kinds
from veilmeter.operators import ranks

BUCKETS = 10_000
LONGEST = 3  # words of a run
LEAST = 20  # words of a document that may be drawn
SHARE = 5  # of 100 documents
SEED = 42
WIDE = 48  # bytes of a word beyond which zlib takes it alone
ALL = np.uint32(0xFFFFFFFF)
#: Fixed values by rule: the byte table of CRC-32 with the reflected polynomial.
STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    STEP = np.where(STEP & 1, (STEP >> 1) ^ np.uint32(0xEDB88320), STEP >> 1).astype(np.uint32)
#: Words are runs of digits, a-z and bytes beyond ASCII.
KINDS = kinds(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))


class Registers:
    """Advances CRC-32 registers, one a word, over the words' bytes."""

    def __init__(self, words: Words):
        self.words, size = words, words.ends - words.starts
        self.wide = np.flatnonzero(size > WIDE)
        narrow = np.minimum(size, WIDE + 1).astype(np.uint8)
        self.order = np.argsort(narrow, kind="stable")[::-1][len(self.wide) :]  # the longest first
        counts = np.bincount(narrow, minlength=WIDE + 2)[: WIDE + 1]
        left = counts[::-1].cumsum()[::-1]  # left[j]: words of at least j bytes
        at = words.starts[self.order]
        self.bytes = [words.lower[at[: left[j + 1]] + j] for j in range(WIDE) if left[j + 1]]

    def advanced(self, start: np.ndarray) -> np.ndarray:
        now = start[self.order]
        for b in self.bytes:
            m = len(b)
            now[:m] = STEP[(now[:m] ^ b) & 255] ^ (now[:m] >> 8)
        out = np.empty_like(start)
        out[self.order] = now
        for k in self.wide:
            out[k] = zlib.crc32(self.words.word(k), int(start[k] ^ ALL)) ^ int(ALL)
        return out


def feature_buckets(words: Words, buckets: int = BUCKETS, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of runs: the last word of each run, and its bucket."""
    n = len(words.starts)
    place = np.arange(n) - words.first[words.texts()]
    registers, state, own = Registers(words), np.full(n, ALL, np.uint32), np.arange(n)
    for size in range(1, longest + 1):
        if size > 1:
            before = np.roll(state, 1)
            state = STEP[(before ^ 32) & 255] ^ (before >> 8)
            own = np.flatnonzero(place >= size - 1)
        state = registers.advanced(state)
        yield own, ((state[own] ^ ALL) % buckets).astype(np.int64)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for big in batches:
            for b in slices(big, 0):
                for _, found in feature_buckets(Words(b.column(0), KINDS), buckets):
                    total += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of a bucket's smoothed share in the target over that in the corpus)."""
    s, t, n = own.astype(np.float64), target.astype(np.float64), float(len(own))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 1):
                words = Words(b.column(1), KINDS)
                text, total, features = words.texts(), np.zeros(words.rows, np.int64), np.zeros(words.rows, np.int64)
                for own, found in feature_buckets(words, len(gain)):
                    sums = np.r_[0, gain[found].cumsum()]
                    cut = np.searchsorted(text[own], np.arange(words.rows + 1))
                    total += sums[cut[1:]] - sums[cut[:-1]]
                    features += np.diff(cut)
                columns = [pa.array(words.counts, pa.int64()), pa.array(features), pa.array(total)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """A Gumbel number of each doc_id, in thousandths, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document: the best share of 100 by weight and noise."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = written(weighted(docs, gain).withColumn("score", F.col("weight") + noise(seed)), "scored")
    may = scored.filter(F.col("n_words") >= least)
    counted = may.groupBy("score").agg(F.count("*").alias("n"))
    above = written(ranks.running(written(counted, "histogram"), [F.desc("score")], {"above": F.col("n")}), "offsets")
    drawn = share * (above.agg(F.sum("n")).first()[0] or 0) // 100
    last = above.filter(F.col("above") < drawn).agg(F.min("score")).first()[0]
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*columns, none)
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    rank = F.col("above") + place
    reach = may.filter(F.col("score") >= last).join(above.filter(F.col("score") >= last).select("score", "above"), "score")
    rest = scored.filter((F.col("score") < last) | (F.col("n_words") < least))
    return reach.select(*columns, F.when(rank <= drawn, rank).cast("long").alias("rank")).unionByName(rest.select(*columns, none))
