"""Preprocessing with fitted parameters as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.operators import ranks, selection


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Sorted different values to 0, 1, ...; null becomes "nan" first. Codes are ranks over ranges of values, so no task holds all of them."""
    df = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("nan")))
    codes = ranks.ranked(df.select(column).distinct(), [F.col(column)], out)
    return df.join(codes, column)


def median_impute(df: DataFrame, column: str) -> DataFrame:
    """Null and NaN become the exact median, by linear interpolation; a column without a value stays so."""
    return median_impute_columns(df, [column])


def median_impute_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's nulls and NaN become its exact median; the medians of all are selected together, in a few passes of counts."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("g"), F.col(c).cast("double").alias("x")) for k, c in enumerate(columns)])).alias("v")
    middle = selection.medians(df.select(each).select("v.*"))
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    return df.withColumns({c: F.coalesce(clean[c], F.lit(middle.get(k)).cast("double")) for k, c in enumerate(columns)})


def standard_scale(df: DataFrame, column: str, fit_on, out: str) -> DataFrame:
    """(x - mean) / deviation of the rows where fit_on holds; population deviation, 1 where it is 0."""
    own = df.filter(fit_on)
    sd = own.agg(F.when(F.stddev_pop(column) == 0, 1.0).otherwise(F.stddev_pop(column))).scalar()
    return df.withColumn(out, (F.col(column) - own.agg(F.avg(column)).scalar()) / sd)


def stratified_split(df: DataFrame, label: str, id_name: str, test_size: float, out: str = "is_test") -> DataFrame:
    """The first ceil(test_size * count) rows of each label in a fixed hash order are the test side."""
    own = df.withColumn("_mixed", (F.col(id_name) * 7919 + 104729) % 1000003)
    placed = ranks.ranked(own, [F.col(label), F.col("_mixed"), F.col(id_name)], "_place", within=label)
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_count"))
    both = placed.join(F.broadcast(counts), F.col(label).eqNullSafe(F.col("_label")))  # a row a label
    return both.withColumn(out, F.col("_place") < F.ceil(F.lit(test_size) * F.col("_count"))).select(*df.columns, out)


def median_impute_array(df: DataFrame, column: str, key: str) -> DataFrame:
    """Null and NaN components of an array become their component's exact median over all rows. No row leaves its place: only counts are shuffled."""
    clean = F.transform(column, lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double")))
    middle = selection.medians(df.select(F.posexplode(clean).alias("g", "x")))
    by_place = F.array(*[F.lit(middle.get(g)).cast("double") for g in range(max(middle, default=-1) + 1)])
    return df.select(key, F.transform(clean, lambda x, i: F.coalesce(x, F.get(by_place, i))).alias(column))


def target_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Strings to the codes of label_encode; numbers cut to whole ones."""
    return label_encode(df, column, out) if df.schema[column].dataType.simpleString() == "string" else df.withColumn(out, F.col(column).cast("long"))


def binary_target(raw, positive: list[str]):
    """1 where the text, without blanks and dots at its end, is one of `positive`, else 0."""
    return F.regexp_replace(F.trim(raw), "[.]+$", "").isin(positive).cast("int")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """balance: the share of rows whose label is 1."""
    return df.agg(F.avg((F.col(label) == 1).cast("double")).alias("balance"))
