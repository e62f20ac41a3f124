"""Quality classifier: ordinal regression with a cumulative logit link on graded ratings.

Grades come from labels: 0 toxic, 1 poor, 2 good. A document's features are hashed: each different word in lower case without
marks, the marks at its end, and its shape. One weight a feature serves all grades; ordered thresholds t1 < t2 split the
score s: P(grade <= k) = 1 / (1 + exp(s - t_k)). A document gets its expected grade and the tail probability of the best grade,
by which it is selected.

Fitting uses a bounded sample: about MOST labelled rows a grade, by a hash of doc_id, and never more than twice as many; texts of over
LONGEST characters are among them only where a grade has less than FEW others. Their features are made on the executors. Scoring covers all documents and whole texts.

Defined cases: a null or blank text has no features, and is not kept; contradicting labels of one document count as the lowest grade;
null labels are left out; without labels of at least two grades all documents get probability 1; equal texts give equal
results, so ties and repeated rows need no rule; rows that repeat a labelled doc_id are each in the sample, up to its bound; very long texts are
scored whole; an empty table gives an empty table; only doc_id and text of documents, and doc_id, quality, toxic of labels are
read, other columns of any name are kept as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.llm.common import Known, slices

MOST = 2500
LONGEST = 40_000
FEW = 32
BITS = 18
GRADES = 3
ROUNDS = 200
SPARSE = 0.01
RARE = 25  # rows in which a feature must be to get a weight
KEEP = 0.4
WORDS = 80_000
WORD = re.compile(r"(\W*)(.*?)([\W_]*)", re.S)


def features_of(word: str) -> tuple[int, ...]:
    """The hashed features of one word between white space."""
    before, body, after = WORD.fullmatch(word).groups()
    shape = "upper" if len(body) > 1 and body.isupper() else "digit" if any(c.isdigit() for c in body) else "long" if len(body) > 30 else ""
    names = [f"w:{body.lower()}" if body else "", f"e:{after}" if after else "", f"b:{before}" if before else "", f"s:{shape}" if shape else ""]
    return tuple(zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for n in names if n)


def features(texts: list[str], known: Known | None = None) -> list[np.ndarray]:
    """Each text's different features in order. known: what a task keeps of words between calls; it goes with the task."""
    words, known = [set(t.split()) for t in texts], Known(WORDS) if known is None else known
    known.turn()
    known.now.update((w, features_of(w)) for w in known.missing(set().union(*words)))
    now = known.now
    return [np.unique(np.fromiter((f for w in own for f in now[w]), np.int32)) for own in words]


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).filter("grade IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Grades and features of the bounded sample, and how many rows each grade has in all."""
    rows = graded(labels)
    counts = {r["grade"]: r["count"] for r in rows.groupBy("grade").count().collect()}
    if not counts:
        return np.empty(0, int), [], np.ones(GRADES)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, MOST / n))])
    picked = rows.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1_000_000)) / 1e6 < share[F.col("grade")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(WORDS)
        for big in batches:
            for b in slices(big, 2):
                found = pa.array(features(b.column(2).to_pylist(), known), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), found], ["doc_id", "grade", "long", "h", "f"])

    # picked holds about MOST rows a grade at any size of the tables.
    texts = docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(picked), "doc_id")
    texts = texts.select("doc_id", "grade", "text", (F.length("text") > LONGEST).alias("long"), F.xxhash64("doc_id", "text").alias("h"))
    found = texts.mapInArrow(run, "doc_id long, grade int, long boolean, h long, f array<int>")
    place = F.row_number().over(Window.partitionBy("grade").orderBy("long", "h"))
    found = found.withColumn("place", place).filter(F.col("place") <= 2 * MOST).filter(~F.col("long") | (F.col("place") <= FEW))
    got = found.select("doc_id", "grade", "h", "f").toPandas().sort_values(["doc_id", "grade", "h"], kind="stable")
    return got["grade"].to_numpy(), list(got["f"]), np.array([counts.get(k, 0) for k in range(GRADES)], dtype=float)


def fit(grades: np.ndarray, rows: list[np.ndarray], counts: np.ndarray, rounds: int = ROUNDS, sparse: float = SPARSE, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """Weights by feature and the ordered thresholds, by gradient ascent (Adam) on the log-likelihood; a row weighs as many as it stands for."""
    weights, cuts = np.zeros(1 << BITS, dtype=np.float64), np.array([-2.0, -1.0])
    if len(set(grades.tolist())) < 2:
        return weights, np.array([-1e3, -999.0])
    flat = np.concatenate(rows)
    used, flat = np.unique(flat, return_inverse=True)
    often = np.bincount(flat) >= min(rare, 2 + len(rows) // 100)  # a feature of few rows tells nothing of others
    owner = np.repeat(np.arange(len(rows)), list(map(len, rows)))[often[flat]]
    flat = flat[often[flat]]
    row_weight = (counts / np.maximum(np.bincount(grades, minlength=GRADES), 1))[grades]
    row_weight /= row_weight.sum()
    w, raw = np.zeros(len(used)), np.array([cuts[0], np.log(cuts[1] - cuts[0])])
    first, second = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    for k in range(1, rounds + 1):
        s = np.bincount(owner, weights=w[flat], minlength=len(rows))
        t = np.array([-np.inf, raw[0], raw[0] + np.exp(raw[1]), np.inf])
        with np.errstate(over="ignore"):
            low, high = (1 / (1 + np.exp(s - x)) for x in (t[grades], t[grades + 1]))
        chance = np.maximum(high - low, 1e-12)
        by_row = row_weight * (low + high - 1)
        by_high, by_low = (row_weight * x * (1 - x) / chance for x in (high, low))
        t1 = by_high[grades == 0].sum() - by_low[grades == 1].sum()
        t2 = by_high[grades == 1].sum() - by_low[grades == 2].sum()
        up = np.concatenate([np.bincount(flat, weights=by_row[owner], minlength=len(used)) - 1e-4 * w, [t1 + t2, t2 * np.exp(raw[1])]])
        first, second = 0.9 * first + 0.1 * up, 0.99 * second + 0.01 * up**2
        step = 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-6)
        w, raw = w + step[:-2], raw + step[-2:]
        w = np.sign(w) * np.maximum(np.abs(w) - sparse, 0)  # words that tell nothing get no weight
    weights[used] = w
    return weights, np.array([raw[0], raw[0] + np.exp(raw[1])])


def grade_texts(texts: list[str], weights: np.ndarray, cuts: np.ndarray, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and probability of the best grade; both 0 for a blank text."""
    rows = features(texts, known)
    s = np.array([weights[f].sum() for f in rows])
    with np.errstate(over="ignore"):
        above = 1 / (1 + np.exp(cuts[None, :] - s[:, None]))
    blank = np.array([not len(f) for f in rows])
    return np.where(blank, 0.0, above.sum(axis=1)), np.where(blank, 0.0, above[:, -1])


def _map(docs: DataFrame, labels: DataFrame, columns: list, schema, out) -> DataFrame:
    weights, cuts = fit(*sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), cuts))  # 1 MB at any size
    where = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(WORDS)
        for big in batches:
            for b in slices(big, where):
                yield out(b, *grade_texts(b.column(where).to_pylist(), *shared.value, known))

    return docs.select(*columns, F.coalesce("text", F.lit("")).alias("_whole_text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_good (probability of the best grade), keep."""

    def out(b: pa.RecordBatch, grade: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(grade), pa.array(good), pa.array(good >= KEEP)], ["doc_id", "expected_grade", "p_good", "keep"])

    return _map(docs, labels, ["doc_id"], "doc_id long, expected_grade double, p_good double, keep boolean", out)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, whole rows, that are kept."""
    columns = list(range(len(docs.columns)))

    def out(b: pa.RecordBatch, _: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
        return b.select(columns).filter(pa.array(good >= KEEP))

    return _map(docs, labels, docs.columns, docs.schema, out)
