"""Tables in the folder that driver and executors share: they cut the lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, one machine), a temporary one."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.veilmeter.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='veilmeter_')}"
        spark.conf.set("spark.veilmeter.shared.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilmeter/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: tuple[str, ...] = (), **options) -> DataFrame:
    """df as a Parquet table in the shared folder, in a folder for each value of `by`. Its shuffle files go once it is written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, splits: int = 4) -> DataFrame:
    """A table of fewer files than cores, and of few splits, dealt out over the cores: a small file is one task else. Larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < splits * cores
    return df.repartition(cores) if few and cores > 1 else df


def small(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """df, to be broadcast where it has at most so many rows (of a few short columns each), by count; shuffled else."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most else df


def _root(path: str) -> str:
    """A table's folder, from one of its files; folders of partitions are called name=value."""
    folder = path.rpartition("/")[0]
    while "=" in folder.rpartition("/")[2]:
        folder = folder.rpartition("/")[0]
    return folder


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by `written` that nothing will read again."""
    from pyarrow import fs

    for t in tables:
        for folder in {_root(f) for f in t.inputFiles()}:
            system, path = fs.FileSystem.from_uri(folder)
            system.delete_dir(path)
