"""Exact selection without a sort: cuts and order statistics narrowed by counts, all groups together.

A round counts the rows that are still in question by a digit, or a bucket, of their value. Only counts are shuffled, and what
is in question shrinks by the radix each round, so no task sorts or holds a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmeter.operators import roc

RADIX = 10  # bits of a digit
FEW = 4096  # values in question that are put in order in the end


def least_cut(rows: DataFrame, group: list[str], key: str, wanted: DataFrame, bits: int = 20) -> DataFrame:
    """group, cut, need: the least `k` rows of each group are those with key < cut and `need` of those with key = cut. rows: group and a
    whole key from 0 to below 2**bits. wanted: group and k, from 1 to the group's rows."""
    state = wanted.select(*group, F.lit(0).cast("long").alias("_prefix"), F.col("k").cast("long").alias("_need"))
    order = Window.partitionBy(*group).orderBy("_digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for shift in range(RADIX * (-(-bits // RADIX) - 1), -1, -RADIX):
        inside = rows.select(*group, F.col(key).cast("long").alias("_key")).join(state, group).filter(F.shiftright("_key", shift + RADIX) == F.col("_prefix"))
        digit = F.shiftright("_key", shift).bitwiseAND(F.lit((1 << RADIX) - 1)).alias("_digit")
        counts = inside.groupBy(*group, "_prefix", "_need", digit).count().withColumn("_up", F.sum("count").over(order))
        found = counts.filter((F.col("_up") >= F.col("_need")) & (F.col("_up") - F.col("count") < F.col("_need")))
        state = found.select(*group, (F.col("_prefix") * (1 << RADIX) + F.col("_digit")).alias("_prefix"), (F.col("_need") - F.col("_up") + F.col("count")).alias("_need"))
    return state.select(*group, F.col("_prefix").alias("cut"), F.col("_need").alias("need"))


def drawn(rows: DataFrame, group: list[str], key: str, ident: str, wanted: DataFrame, out: str, bits: int = 20) -> DataFrame:
    """rows with whether each is of its group's `k` least by (key, ident); groups without a wanted row of at least 1 have none. Rows of the key
    at the cut are numbered by ident, the others aren't put in order."""
    cut = least_cut(rows, group, key, wanted.filter("k > 0"), bits)
    both = rows.join(cut, group, "left")
    sure = both.filter("cut IS NULL OR %s <> cut" % key).withColumn(out, F.coalesce(F.col(key) < F.col("cut"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(ident))
    edge = both.filter("%s = cut" % key).withColumn(out, place <= F.col("need"))
    return sure.unionByName(edge).select(*rows.columns, out)


def at_places(values: DataFrame, wanted: list[tuple]) -> dict[tuple, float]:
    """(g, place) -> the value at that place, from 0, of the values of g in order. values: g, x (null and NaN are left out); wanted: some (g, place)
    for each of a bounded number of columns g. First buckets are those of a logarithmic scale, later ones parts of what is left."""
    spark = values.sparkSession
    own = values.filter("x IS NOT NULL AND NOT isnan(x)").select("g", F.col("x").cast("double").alias("x"))
    state = {key: (-math.inf, math.inf, 0, math.inf) for key in wanted}  # low, high, values before, values inside
    order = Window.partitionBy("g", "place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = own.schema["g"].dataType.simpleString()

    def inside(open_keys: list[tuple]) -> DataFrame:
        rows = [(g, p, *state[g, p][:3]) for g, p in open_keys]
        cuts = F.broadcast(spark.createDataFrame(rows, f"g {kind}, place long, low double, high double, before long"))  # a row a column and place
        return own.join(cuts, "g").filter("x >= low AND x <= high")

    first = True
    while todo := [k for k, (low, high, _, n) in state.items() if n > FEW and low < high]:
        part = F.least(F.lit(4095), F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * 4096)).cast("long")
        bucket = roc.bucket(F.col("x")) if first else part
        counts = inside(todo).groupBy("g", "place", "before", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        counts = counts.withColumn("up", F.col("before") + F.sum("n").over(order))
        found = counts.filter((F.col("up") > F.col("place")) & (F.col("up") - F.col("n") <= F.col("place"))).collect()  # a row a column and place
        met = {(r["g"], r["place"]): (r["low"], r["high"], r["up"] - r["n"], r["n"]) for r in found}
        state = {k: met.get(k, v if k not in todo else (math.nan, math.nan, 0, 0)) for k, v in state.items()}
        first = False
    out = {k: low for k, (low, high, _, _) in state.items() if low == high}
    if rest := [k for k, (low, high, _, _) in state.items() if low < high]:
        place = F.row_number().over(Window.partitionBy("g", "place").orderBy("x")) - 1 + F.col("before")
        for r in inside(rest).withColumn("at", place).filter("at = place").collect():
            out[r["g"], r["place"]] = r["x"]
    return out


def medians(values: DataFrame) -> dict:
    """g -> the median of its values, by linear interpolation; columns without a value are left out."""
    counts = values.filter("x IS NOT NULL AND NOT isnan(x)").groupBy("g").count().collect()  # a row a column
    sides = {r["g"]: ((r["count"] - 1) // 2, r["count"] // 2) for r in counts}
    found = at_places(values, sorted({(g, p) for g, own in sides.items() for p in own}))
    return {g: found[g, a] + (found[g, b] - found[g, a]) * 0.5 for g, (a, b) in sides.items()}


def mixed(ident: Column, salt: int | Column = 0) -> Column:
    """A whole number below 2**20 from an id, by integers alone, so that SQL gives the same."""
    return F.pmod(ident * 7919 + F.lit(104729) * salt, F.lit(1000003))
