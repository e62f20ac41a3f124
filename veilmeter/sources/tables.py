"""Tables as the relations that the operators take: samples(sample_id, k, label, is_member), tokens, configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmeter.sources.shared import spread

STATUS = ["F", "O", "P"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name == "documents" else found


def order_samples(spark: SparkSession, sf_dir: str, key: str = "o_custkey", *more) -> DataFrame:
    """Orders as samples: label 0, 1, 2 from the status, members have even ids, and a key of any granularity; more: further columns."""
    orders = read(spark, sf_dir, "orders")
    label = F.array_position(F.array(*map(F.lit, STATUS)), F.col("o_orderstatus")).cast("int") - 1
    return orders.select(F.col("o_orderkey").alias("sample_id"), F.expr(key).alias("k"), label.alias("label"), (F.col("o_orderkey") % 2 == 0).alias("is_member"), *more)


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("features"), "label", (F.col("vec_id") % 2 == 0).alias("is_member"))


def configs(spark: SparkSession) -> DataFrame:
    """The four published accountant settings."""
    rows = [("a", 4.0, 0.01, 1000, 1e-5), ("b", 2.0, 0.01, 1000, 1e-5), ("c", 1.0, 0.01, 1000, 1e-5), ("d", 4.0, 0.005, 2000, 1e-5)]
    return spark.createDataFrame(rows, "run_id string, sigma double, sample_rate double, steps long, delta double")


def write_json(df: DataFrame, path: str) -> None:
    """A report sink: one JSON document a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def log_probs(spark: SparkSession, docs: int, tokens: int, mean: float, deviation: float, seed: int = 42) -> DataFrame:
    """doc_id, pos, logp: made-up token log-probabilities, normal and at most -1e-6."""
    each = spark.range(docs).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(tokens - 1))).alias("pos"))
    return each.withColumn("logp", F.least(F.randn(seed) * deviation + mean, F.lit(-1e-6)))
