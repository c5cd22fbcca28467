"""Query op4: every document without the sentence spans that an earlier document or place holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .spans import without_repeats


def op4_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "__clean.n_sentences", "__clean.n_removed", "__clean.spans", "__clean.text")


QUERIES = {"op4_span_dedup": op4_span_dedup}
ORACLES: dict[str, str] = {}
