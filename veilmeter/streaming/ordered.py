"""Folds over streams whose events come late and out of order: each key's events are folded in order of (ts, event_id).

Users are dealt to BUCKETS groups by a hash, so that many share a call and a state: what the fold holds of each user, and a buffer of events that
the watermark hasn't passed. An event-time timer wakes a group when the watermark passes its earliest buffered event, so events are folded without
new ones coming. An event later than `delay` behind the newest is dropped, as the watermark says; all others end as a batch over the same events does.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.functions import privacy

BUCKETS = 1024
EVENT = ["user_id", "us", "event_id", "value"]


def ordered_fold(stream: DataFrame, start: tuple, fold: Callable[[tuple, float], tuple], fields: str, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(user_id, ts, event_id, value) of a stream -> user_id, event_id and the fold's fields after each event, once the watermark has passed it. Users
    that are null are one user, in a group of its own."""
    names = [f.split()[0] for f in fields.split(", ")]

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, parts = ({}, []) if not state.exists else pickle.loads(state.get[0])
        if not state.hasTimedOut:
            parts = [*parts, *([b[c].to_numpy() for c in EVENT] for b in batches)]
        mark = state.getCurrentWatermarkMs()
        user, us, ident, value = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0),) * 4
        ready = np.flatnonzero(us <= mark * 1000)
        ready = ready[np.lexsort((value[ready], ident[ready], us[ready], user[ready]))]
        out, own = [], user[ready]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        values = value[ready].tolist()
        for name, a, b in zip(own[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(own)]):
            now = held.get(name, start)
            for v in values[a:b]:
                now = fold(now, v)
                out.append(now)
            held[name] = now
        rest = np.flatnonzero(us > mark * 1000)
        state.update((pickle.dumps((held, [[c[rest] for c in (user, us, ident, value)]] if len(rest) else [])),))
        if len(rest):
            state.setTimeoutTimestamp(max(mark + 1, -(-int(us[rest].min()) // 1000)))
        columns = dict(zip(names, zip(*out))) if out else dict.fromkeys(names, ())
        yield pd.DataFrame({"user_id": pd.Series([None] * len(own) if key[0] < 0 else own, dtype="Int64"), "event_id": ident[ready], **columns})

    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    own = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    own = own.select(bucket.alias("bucket"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("us"), "event_id", F.col("value").cast("double").alias("value"))
    return own.groupBy("bucket").applyInPandasWithState(step, f"user_id long, event_id long, {fields}", "held binary", "append", "EventTimeTimeout")


def early_stopping(stream: DataFrame, patience: int = 5, min_delta: float = 1e-4, delay: str = "1 hour") -> DataFrame:
    """user_id, event_id, best, counter, stopped, n after each event."""

    def fold(held: tuple, value: float) -> tuple:
        best, counter, stopped, n = held
        best, counter = (value, 0) if value < best - min_delta else (best, counter + 1)
        return best, counter, stopped or counter >= patience, n + 1

    return ordered_fold(stream, (float("inf"), 0, False, 0), fold, "best double, counter long, stopped boolean, n long", delay)


def running_accountant(stream: DataFrame, sigma: float, batch: int, delta: float, accountant: str = "gdp", size: int = 50_000, delay: str = "1 hour") -> DataFrame:
    """user_id, event_id, step, epsilon: what is spent after each of a user's steps, at a sample rate of batch / size."""
    steps = ordered_fold(stream, (0,), lambda held, _: (held[0] + 1,), "step long", delay)
    return steps.withColumn("epsilon", privacy.steps_epsilon(F.col("step"), batch / size, sigma, delta, accountant))
