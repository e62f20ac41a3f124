"""The corpus pipeline: language identification, quality, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilmeter.llm import langid, linededup, packing, quality, simhash
from veilmeter.llm.common import table, written

STAGES = [
    ("language_id", lambda spark, docs, sf_dir: langid.keep_identified(docs)),
    ("quality", lambda spark, docs, sf_dir: quality.keep_good(docs, table(spark, sf_dir, "labels"))),
    ("line_dedup", lambda spark, docs, sf_dir: linededup.dedup_lines(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: simhash.keep_first(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]

#: The stages' learned decisions have no SQL; a test holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
