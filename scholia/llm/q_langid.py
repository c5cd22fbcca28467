"""Query op1: the language of every document, learned from the rows outside the held-out quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import LanguageModel, identify, train


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), identify(fitted(docs), with_spans=False).alias("r"))
    return found.select("doc_id", "held_out", "r.lang_pred", "r.score", "r.n_spans")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
