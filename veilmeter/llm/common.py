"""What the operators share: the folder that driver and executors share, written tables, tokenizer paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmeter.operators.words import slices
from veilmeter.sources.shared import dropped, shared_dir, shared_path, spread, written

__all__ = ["Known", "dropped", "shared_dir", "shared_path", "slices", "table", "text_or_empty", "tokenizer_path", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit("")).alias(name)


class Known:
    """What a worker keeps of words that it has met: a generation that fills, and the one before it, so memory is bounded."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def turn(self) -> None:
        """To be called before each batch of texts."""
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now

    def missing(self, words: set[str]) -> list[str]:
        """Those not known; after this the others are in `now`."""
        rest = words.difference(self.now)
        again = rest.intersection(self.old)
        self.now.update((w, self.old[w]) for w in again)
        return list(rest.difference(again))
