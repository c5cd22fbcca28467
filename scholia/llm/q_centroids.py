"""Query op11: every vector with its cluster after five rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .centroids import clustered
from .common import table


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds one after the other, all distances of each."""
    steps = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INTEGER) AS cluster, x FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {k})
)"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT v.r, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), 'c': c.cluster}}) AS b FROM v CROSS JOIN c{i} AS c GROUP BY v.r
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT cluster, list(CAST(m AS BIGINT) ORDER BY d) AS x FROM (
    SELECT b.c AS cluster, d, (sum(v.x[d]) - ((sum(v.x[d]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{i} JOIN v USING (r) CROSS JOIN range(1, 65) AS g(d) GROUP BY b.c, d
  ) GROUP BY cluster
), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster)
)""")
    return ",\n".join(steps) + f""" SELECT vec_id, b.c AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} AS c ON c.cluster = b.c"""


QUERIES = {"op11_centroids": op11_centroids}
ORACLES = {"op11_centroids": _sql()}
