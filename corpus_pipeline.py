"""A cleaning pipeline over documents: language, near duplicates, contamination, mixture, shards. Each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import common, decontaminate, langid, mixing, ngram_join, q_langid, sharding

#: A document is rejected when less than this share of its letters lies in spans of its main language.
LEAST_LANGUAGE_SHARE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with an identified language. Null texts, texts without a letter, and texts of no learned script go."""
    common.small_batches(spark)
    model = q_langid.fitted(docs)
    found = docs.withColumn("__lang", langid.identify(model, "text", with_spans=False))
    return found.where((F.col("__lang.lang_pred") != "und") & (F.col("__lang.score") >= LEAST_LANGUAGE_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one of the smallest id, once. Null, empty and blank texts are linked with nothing and all stay."""
    common.small_batches(spark)
    return ngram_join.first_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null, empty and blank texts hold none and stay; repeated rows go or stay together."""
    return decontaminate.clean_documents(docs, decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents by the raked probability of their source, language and topic. Texts without words have no weight and stay; rows of one id are drawn alike."""
    out = mixing.mixed(docs, F.col("source"), F.col("lang"), mixing.topic_of(F.col("text")), F.col("text"), F.col("doc_id"))
    return out.where("__kept").select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to 16 shards of near equal bytes. A null text has size 1, as an empty one; repeated rows have slots of their own."""
    return sharding.sharded(docs).select("doc_id", "lang", "source", "n_chars", F.col("__size").alias("size"), F.col("__shard").alias("shard"), F.col("__slot").cast("long").alias("slot"))


STAGES = [("language_id", identify_language), ("ngram_jaccard", drop_near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

ORACLE_SQL = None  # language identification is a trained model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
