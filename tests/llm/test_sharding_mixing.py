import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm.mixing import mixed, rake
from scholia.llm.sharding import differenced, sharded


def spread(sizes, labels, m):
    sums = np.bincount(labels, sizes, m)
    return sums.max() - sums.min()


def test_differencing_beats_greedy_and_keeps_labels():
    rng = np.random.default_rng(2)
    for m in (2, 5, 16):
        sizes = rng.lognormal(7, 1, 400).astype(int) + 1
        got = differenced([[int(s)] + [0] * (m - 1) for s in sizes], m)
        assert all(sorted(g) == list(range(m)) for g in got)
        greedy = np.zeros(m)
        for s in sorted(sizes, reverse=True):
            greedy[greedy.argmin()] += s
        assert spread(sizes, [g[0] for g in got], m) <= greedy.max() - greedy.min() + 1


@pytest.mark.parametrize("bundle", [16, 2000])
def test_shards(spark, docs, bundle):
    out = sharded(docs, bundle=bundle, rows_per_slot_bucket=3).toPandas()
    assert len(out) == docs.count() and "text" not in out.columns and "source" in out.columns
    sums = out.groupby("__shard")["__size"].sum()
    assert sums.max() - sums.min() <= 0.05 * sums.mean() + out["__size"].max() * (bundle == 16)
    for _, g in out.groupby("__shard"):
        assert sorted(g["__slot"]) == list(range(len(g)))
    texts = docs.select("doc_id", "text").toPandas().merge(out[["doc_id", "__shard"]], on="doc_id")
    assert texts.groupby("text")["__shard"].nunique().max() == 1


def test_shards_of_odd_rows(spark, odd, none):
    out = sharded(odd).collect()
    assert len(out) == 10 and {"k", "n", "cid", "key", "score"} <= set(out[0].asDict())
    assert {r["__size"] for r in out if r.doc_id in (2, 3)} == {1}
    assert sharded(none).count() == 0


def test_raking_meets_marginals(spark):
    cells = [(s, k, t, int(n)) for (s, k, t), n in zip([(s, k, t) for s in "ab" for k in "xyz" for t in "pq"], [5, 50, 7, 9, 100, 3, 20, 20, 8, 60, 4, 30])]
    df = spark.createDataFrame(cells, "__source string, __language string, __topic string, tokens bigint")
    targets = {"source": {"a": 0.7, "b": 0.3}, "language": {"x": 0.2, "y": 0.3, "z": 0.5}, "topic": {"p": 0.5, "q": 0.5}}
    out = rake(df, targets, iterations=25).toPandas()
    for name, shares in targets.items():
        got = out.groupby(f"__{name}")["weight"].sum()
        for k, v in shares.items():
            assert abs(got[k] - v) < 1e-4
    # raking keeps the cross ratios of the table
    w = out.set_index(["__source", "__language", "__topic"])
    ratio = lambda c: (w[c]["a", "x", "p"] * w[c]["b", "y", "p"]) / (w[c]["a", "y", "p"] * w[c]["b", "x", "p"])
    assert abs(ratio("tokens") / ratio("weight") - 1) < 1e-6


def test_sample_follows_the_fit(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("source"), F.lit("en").alias("lang"), F.repeat(F.lit("abcd"), 10).alias("text"))
    out = mixed(df, F.col("source"), F.col("lang"), F.lit("t"), F.col("text"), F.col("doc_id"), targets={"source": {"rare": 0.5, "often": 0.5}, "language": {"en": 1.0}, "topic": {"t": 1.0}})
    kept = {r.source: r.n for r in out.where("__kept").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert kept["rare"] == 2000 and 1850 < kept["often"] < 2150


def test_mixing_odd_rows(spark, odd, none):
    args = (F.col("source"), F.col("lang"), F.col("key"), F.col("text"), F.col("doc_id"))
    out = mixed(odd, *args).collect()
    assert len(out) == 10 and all(0 <= r["__probability"] <= 1 for r in out)
    assert all(r["__kept"] for r in out if not r.text)
    assert mixed(none, *args).count() == 0
