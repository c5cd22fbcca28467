"""Query op9: components of documents linked by 5-word shingles at Jaccard 0.8 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .ngram_join import similarity_components


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(similarity_components(table(spark, sf_dir, "documents")), "found")
    least = stored(found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return found.join(least, "component", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), rows AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(v) FROM reach WHERE reach.u = sets.doc_id) AS component_id FROM sets
"""

QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLES = {"op9_ngram_join": OP9}
