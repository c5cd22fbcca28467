"""Query op2: every document as stored 8-bit media, read back, with features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .audio import digest, features, to_media
from .common import discard, stored, table, text_bytes


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    media = stored(docs.select("doc_id", text_bytes().alias("n_bytes"), to_media("text").alias("media")), "media", "zstd")
    tensors = stored(media.select("doc_id", "n_bytes", features("media").alias("r")).select("doc_id", "n_bytes", "r.*"), "tensors", "zstd")
    discard(media)
    return tensors.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", digest("tensors").alias("feature"), "n_frames", "n_segments")


QUERIES = {"op2_audio_features": op2_audio_features}
ORACLES: dict[str, str] = {}
