"""Query op6: every document's place, length and checksum in a token store, read back from it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .token_store import write_store


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return store.read(docs.select("doc_id"))


QUERIES = {"op6_token_store": op6_token_store}
ORACLES: dict[str, str] = {}
