"""Clustering and exact search over vectors against plain versions: ties, odd rows, hot vectors, pruning."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import q_centroids, q_top_inner
from scholia.llm.centroids import SortedLists, clustered
from scholia.llm.top_inner import Block, _as_block, best_of, top_inner

SCHEMA = "vec_id bigint, embedding array<float>"


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for name in "row id strip group score rank x cluster k n size least".split():
        df = df.withColumn(name, F.lit(name))
    return df


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def usable(v, dims=None):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (dims is None or len(v) == dims)


def made(n, dims, seed, values=None):
    rng = np.random.default_rng(seed)
    x = rng.choice(values, (n, dims)) if values is not None else rng.normal(size=(n, dims)) * 0.2
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(9000, None), (9001, [0.5]), (9002, [float("nan")] * 6), (9003, [float("inf")] + [0.0] * 5), (9004, [None] + [0.0] * 5), (9005, [])]


@pytest.mark.parametrize("seed", range(4))
def test_the_walk_finds_the_nearest(seed):
    """Ties go to the smaller number, equal centroids too; values outside all lists, too."""
    rng = np.random.default_rng(seed)
    for _ in range(40):
        k, dims, far = int(rng.integers(1, 12)), int(rng.integers(1, 7)), int(rng.choice([2, 5, 1000]))
        c, x = rng.integers(-far, far, (k, dims)), rng.integers(-2 * far, 2 * far, (50, dims))
        c[rng.integers(0, k)] = c[0]
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        number, distance = SortedLists(c).nearest(x)
        assert (number == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_the_walk_stops_early():
    """Far from all but one centroid, few are met."""
    c = np.arange(40)[:, None] * 1000 + np.zeros((1, 2), np.int64)
    lists, met = SortedLists(c), []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            met.append(np.size(at[0] if isinstance(at, tuple) else at))
            return super().__getitem__(at)

    lists.centroids = c.view(Counted)
    assert lists.nearest(np.array([[5003, 5001]]))[0].tolist() == [5] and sum(met) < 10


def plain_clusters(rows, dims, k, rounds):
    kept = [(i, whole(v)) for i, v in rows if usable(v, dims)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    c = [list(v) for _, v in sorted(kept, key=rank)[:k]]
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda v: min((dist(v, x), n) for n, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            c[n] = [sum(col) // len(mine) for col in zip(*mine)] if len(mine) else c[n]
    out = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in out)
    by = {n: sum(d for _, d, m in out if m == n) for n in range(len(c))}
    return sorted(repr((i, n, d, by[n], total, hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())) for i, d, n in out)


@pytest.mark.parametrize("seed, values", [(1, None), (2, [0.0, 0.01, -0.01]), (3, [0.5])])
def test_clusters_as_by_all_distances(spark, seed, values):
    rows = made(150, 6, seed, values) + ODD + [(3, made(4, 6, seed, values)[3][1]), (None, [0.1] * 6), (77, [0.25] * 6)] + [(i, [0.3] * 6) for i in range(500, 560)]
    out = clustered(frame(spark, rows), dims=6, k=8, rounds=3)
    assert sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in out.collect()) == plain_clusters(rows, 6, 8, 3)


def test_few_vectors_and_none(spark):
    assert sorted((r.vec_id, r.distance) for r in clustered(frame(spark, made(3, 6, 1)), dims=6, k=8).collect()) == [(0, 0), (1, 0), (2, 0)]
    none = clustered(frame(spark, ODD), dims=6, k=8)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        clustered(frame(spark, [(1, [1e9] * 6)]), dims=6).collect()


def plain_top(rows, every, k):
    kept = [(n, i, whole(v)) for n, (i, v) in enumerate(rows) if usable(v)]
    out = []
    for n, i, v in kept:
        if i is not None and i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for m, j, w in kept if m != n)[:k]
            out += [repr((i, r, j, -s)) for r, (s, _, _, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, values, strip, block, group", [(1, None, 40, 16, 8), (2, [0.0, 0.5, -0.5], 30, 7, 3), (3, [0.5], 50, 64, 64), (4, None, 1000, 500, 100)])
def test_best_products_as_by_all_pairs(spark, seed, values, strip, block, group):
    """In many strips and in one; with ties throughout, equal vectors, rows that repeat, other lengths, and rows without an id."""
    rows = made(160, 19, seed, values) + [r for r in ODD if r[1] is None or len(r[1]) != 6 or not usable(r[1])] + [(10, made(20, 19, seed, values)[10][1]), (10, [0.7] * 19), (None, [0.9] * 19), (None, [0.9] * 3), (30, [0.2] * 25)]
    out = top_inner(frame(spark, rows), query_every=10, k=4, strip=strip, block=block, group=group)
    assert sorted(repr((r.query_id, r["rank"], r.vec_id, r.score)) for r in out.collect()) == plain_top(rows, 10, 4)


def test_fewer_candidates_than_asked_for_and_none(spark):
    rows = made(3, 8, 5)
    out = top_inner(frame(spark, rows), query_every=1, k=5)
    assert sorted(repr((r.query_id, r["rank"], r.vec_id, r.score)) for r in out.collect()) == plain_top(rows, 1, 5)
    assert top_inner(frame(spark, [])).count() == 0 and top_inner(frame(spark, made(1, 8, 6))).count() == 0


def test_a_block_loses_nothing_at_any_bound():
    """Whatever bound a query brings, all that reach it are there, and what is dropped is dropped after few groups of dimensions."""
    rng = np.random.default_rng(7)
    x = rng.integers(-100, 100, (300, 40)) * np.linspace(3, 0.1, 40).astype(np.int64).clip(1)
    block = Block(*_as_block(0, list(range(300)), list(range(300)), x)[1:])
    parts = block.as_numbers(np.float64)
    for q in x[:20]:
        one = Block(*_as_block(0, [999], [999], q[None])[1:])
        scores = x @ q
        for least in (-np.inf, *np.sort(scores)[[0, 150, 290, 295, 299]], scores.max() + 1):
            at, got = best_of(block, parts, [w[:, 0] for w in one.as_numbers(np.float64)], one.rest[:, 0], 999, 5, float(least))
            want = [i for i in np.lexsort((np.arange(300), -scores)) if scores[i] >= least][:5]
            assert at.tolist() == want and got.tolist() == scores[want].tolist()


def test_queries_by_sql_on_odd_tables(spark, tmp_path):
    """The queries' SQL over a table that has what the given ones lack."""
    import duckdb

    rows = [(i, v) for i, v in made(120, 64, 9, [0.0, 0.25, -0.5, 0.125])] + [(500, None), (501, [0.5] * 63), (502, [float("nan")] * 64), (550, [None] * 64)] + [(600 + i, [0.25] * 64) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    other = duckdb.connect()
    other.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for query, sql in ((q_centroids.op11_centroids, q_centroids.ORACLES["op11_centroids"]), (q_top_inner.op12_top_inner, q_top_inner.ORACLES["op12_top_inner"])):
        df = query(spark, str(tmp_path))
        columns = sorted(df.columns)
        assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, other.sql(sql).select(*columns).fetchall()))
