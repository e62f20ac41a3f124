"""Ranks and running sums over a whole table without one task for all of it, or for a group of it.

Rows are dealt out by ranges of their order and written with the number of their range. A range's sums, one row each, give what
lies before it; inside a range a window adds up. So no task holds more than a range, and only a row a range meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.sources.shared import written


def _parts(df: DataFrame, parts: int | None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], within: str | None = None, parts: int | None = None) -> DataFrame:
    """df with, for each name of sums, its sum over all rows before a row; within: over those with the same value there, by which order then
    begins. Rows that are equal in order share a range, so order should tell most rows apart. An empty table stays empty."""
    own = df.withColumns({f"_rk_{k}": v.cast("long") for k, v in sums.items()})
    placed = written(own.repartitionByRange(_parts(df, parts), *order).withColumn("_rk_part", F.spark_partition_id()), "ranges")
    group = [within] if within else []
    total = placed.groupBy("_rk_part", *group).agg(*[F.sum(f"_rk_{k}").alias(f"_rk_sum_{k}") for k in sums])
    # A row a range and group. A group that spans ranges has a row in each; so what meets here is bounded by ranges and groups.
    before = Window.partitionBy(*group).orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select("_rk_part", *group, *[F.coalesce(F.sum(f"_rk_sum_{k}").over(before), F.lit(0)).alias(f"_rk_off_{k}") for k in sums])
    inside = Window.partitionBy("_rk_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"_rk_in_{k}": F.coalesce(F.sum(f"_rk_{k}").over(inside), F.lit(0)) for k in sums})
    same = local["_rk_part"] == offsets["_rk_part"]
    if within:
        same = same & local[within].eqNullSafe(offsets[within])
    joined = local.join(offsets, same)
    return joined.select(*[local[c] for c in df.columns], *[(F.col(f"_rk_in_{k}") + F.col(f"_rk_off_{k}")).alias(k) for k in sums])


def ranked(df: DataFrame, order: list[Column], out: str, within: str | None = None, parts: int | None = None) -> DataFrame:
    """df with the place of each row in the order, from 0."""
    return running(df, order, {out: F.lit(1)}, within, parts)
