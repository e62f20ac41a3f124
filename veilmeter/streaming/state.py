"""Stateful operators over streams: a running accountant, and early stopping with one state a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.functions import privacy


def running_accountant(events: DataFrame, sigma: float, batch: int, delta: float, accountant: str = "gdp", size: int = 50_000) -> DataFrame:
    """user_id, event_id, step, epsilon: what is spent after each of a user's steps, at a sample rate of batch / size."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return events.select("user_id", "event_id", step.alias("step")).withColumn("epsilon", privacy.steps_epsilon(F.col("step"), batch / size, sigma, delta, accountant))


def early_stopping_stream(stream: DataFrame, patience: int = 5, min_delta: float = 1e-4) -> DataFrame:
    """(user_id, ts, event_id, value) of a stream -> user_id, best, counter, stopped whenever new values come."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, counter, stopped = state.get if state.exists else (float("inf"), 0, False)
        for v in pd.concat(list(batches)).sort_values(["ts", "event_id"])["value"]:
            better = v < best - min_delta
            best, counter = (v, 0) if better else (best, counter + 1)
            stopped = stopped or counter >= patience
        state.update((float(best), int(counter), bool(stopped)))
        yield pd.DataFrame([(key[0], float(best), int(counter), bool(stopped))], columns=["user_id", "best", "counter", "stopped"])

    schema = "best double, counter long, stopped boolean"
    return stream.groupBy("user_id").applyInPandasWithState(step, f"user_id long, {schema}", schema, "update", "NoTimeout")
