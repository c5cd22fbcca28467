"""Query op12: the five best inner products of every vector whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .top_inner import top_inner


def op12_top_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner(table(spark, sf_dir, "embeddings"), query_every=50, k=5)


OP12 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON c.r <> q.r WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM pairs
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5
"""

QUERIES = {"op12_top_inner": op12_top_inner}
ORACLES = {"op12_top_inner": OP12}
