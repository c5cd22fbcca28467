"""Query op5: all documents in 16 shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sharding import sharded


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
