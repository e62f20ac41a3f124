"""Where a model's answers come from: a table, an MLlib model, or a function of the user's own. All give sample_id, is_member, label, proba, pred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["sample_id", "is_member", "label", "proba", "pred"]


def _with_pred(rows: DataFrame) -> DataFrame:
    """The first class of the highest probability."""
    return rows.withColumn("pred", (F.array_position("proba", F.array_max("proba")) - 1).cast("int")).select(COLUMNS)


def from_table(rows: DataFrame, proba: str = "proba") -> DataFrame:
    """Answers that are there already."""
    return _with_pred(rows.withColumn("proba", F.col(proba).cast("array<double>")))


def from_mllib(rows: DataFrame, model) -> DataFrame:
    """Answers of a fitted MLlib model; rows: sample_id, is_member, label and the model's columns."""
    from pyspark.ml.functions import vector_to_array

    return _with_pred(model.transform(rows).withColumn("proba", vector_to_array("probability")))


def from_function(rows: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 4096) -> DataFrame:
    """Answers of any model: load gives, once a task, a function from a matrix of features to one of probabilities, which is asked for `batch` rows at a
    time. rows: sample_id, is_member, label, features. Another number of answers than rows raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = None
        for big in batches:
            for at in range(0, big.num_rows, batch):
                b = big.slice(at, batch)
                answer = load() if answer is None else answer
                p = np.asarray(answer(np.array(b.column(3).to_pylist(), np.float64)), np.float64)
                if p.ndim != 2 or len(p) != b.num_rows:
                    raise ValueError(f"{b.num_rows} rows were asked for, answers of shape {p.shape} came")
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(p.tolist(), pa.list_(pa.float64()))], ["sample_id", "is_member", "label", "proba"])

    own = rows.select("sample_id", "is_member", F.col("label").cast("int").alias("label"), "features")
    return _with_pred(own.mapInArrow(run, "sample_id long, is_member boolean, label int, proba array<double>"))
