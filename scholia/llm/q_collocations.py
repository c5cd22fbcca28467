"""Query op13: each language's first collocations of two and three words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import table


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), runs AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), f AS MATERIALIZED (
  SELECT lang, len(p) AS k, array_to_string(p, ' ') AS phrase, any_value(p) AS words, count(*) AS f
  FROM (SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS p FROM runs) GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, phrase, words, k AS size, f AS a FROM f WHERE k > 1 AND f >= 10
), longer AS (
  SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase FROM candidates WHERE size = 3) GROUP BY lang, phrase
), kept AS (
  SELECT c.* FROM candidates AS c LEFT JOIN longer AS o ON o.lang = c.lang AND o.phrase = c.phrase AND c.size = 2 WHERE o.most IS NULL OR 100 * o.most < 50 * c.a
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS lw, array_to_string(words[k + 1:size], ' ') AS rw FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((CAST(c.a AS HUGEINT) * c.a * 1000000) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts AS c JOIN f AS x ON x.lang = c.lang AND x.phrase = c.lw AND x.k = c.k JOIN f AS y ON y.lang = c.lang AND y.phrase = c.rw
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) JOIN totals USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": OP13}
