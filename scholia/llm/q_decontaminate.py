"""Query op10: every document with whether it holds a benchmark item, and which."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, stored, table
from .decontaminate import contamination


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = stored(contamination(docs, table(spark, sf_dir, "benchmark")), "contaminated")
    best = found.groupBy("k").agg(F.max("cover").alias("cover"), F.min("exact").alias("exact"), F.array_sort(F.collect_set("item")).alias("items"))
    return docs.select("doc_id", row_key().alias("k")).join(best, "k", "left").select("doc_id", F.col("cover").isNotNull().alias("contaminated"), F.coalesce(F.round("cover", 6), F.lit(0.0)).alias("cover"), F.coalesce(~F.col("exact"), F.lit(False)).alias("re_parameterised"), F.coalesce("items", F.array().cast("array<bigint>")).alias("item_ids"))


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
