"""The inverted file of vectors: recall against the exact search, the exact way, ties, odd rows."""

import numpy as np
import pytest

from scholia.operators import retrieval as S
from scholia.operators import vector_store as V


@pytest.fixture(scope="module")
def vectors(spark):
    """Fifty clouds of unequal size; some vectors stand twice, some can't be in an index."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(50, 24))
    of = rng.choice(50, 6000, p=rng.dirichlet(np.full(50, 0.6)))
    x = centres[of] + 0.45 * rng.normal(size=(6000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7000 + i, x[i].tolist()) for i in range(40)] + [(8000, [0.0] * 24), (8001, None), (8002, [1.0]), (8003, [float("nan")] * 24), (8004, [None] * 24)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return V.built(vectors, "id", "embedding", str(tmp_path_factory.mktemp("vectors")), "v1")


def hits(df):
    return sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())


def asked(vectors, every):
    return vectors.where(f"id % {every} = 0 and id < 8000").selectExpr("id AS query_id", "embedding")


def test_the_exact_way(spark, vectors, index):
    q = asked(vectors, 211)
    want = hits(S.vector_topk(vectors.where("id <= 8000"), q, 10))
    assert hits(index.search(q, 10, share=1.0)) == want


def test_recall_and_what_is_read(spark, vectors, index):
    q = asked(vectors, 40)
    want, got = ({(a, c) for a, _, c, _ in hits(x)} for x in (S.vector_topk(vectors.where("id <= 8000"), q, 10), index.search(q, 10, share=0.1)))
    assert len(want & got) / len(want) >= 0.95
    assert index.share_read(q, share=0.1) < 0.2


def test_every_row_is_in_one_cell(vectors, index):
    ids = [i for r in index._blocks().select("ids").collect() for i in r.ids]
    assert sorted(ids) == [*range(6000), *range(7000, 7040), 8000]
    assert max(r.n for r in index._blocks().collect()) <= 2 * V.BLOCK


def test_versions_and_empty_tables(spark, vectors, index, tmp_path):
    assert V.opened(spark, index.path, "other") is None and V.opened(spark, index.path, "v1").manifest == index.manifest
    none = V.built(vectors.where("false"), "id", "embedding", str(tmp_path))
    assert none.search(asked(vectors, 500), 5).count() == 0
    few = V.built(vectors.where("id < 3"), "id", "embedding", str(tmp_path / "few"))
    assert [r.id for r in few.search(vectors.where("id = 1").selectExpr("id AS query_id", "embedding"), 5).orderBy("rank").collect()][0] == 1


def test_the_query_finds_most_of_what_the_exact_one_does(spark):
    from scholia.plans import store_queries as Q

    sf = "/root/testdata/sf0.01"
    want, got = ({(r.query_id, r.id) for r in q(spark, sf).collect()} for q in (Q.vector_search_saved, Q.vector_search_probed))
    assert len(want & got) / len(want) >= 0.9


def test_a_task_holds_few_scores_and_small_batches(spark, vectors, monkeypatch):
    """However many queries meet however many rows, and however long rows are."""
    import numpy as np
    import pyarrow as pa

    seen, plain = [], S._best
    monkeypatch.setattr(S, "_best", lambda s, most: seen.append(s.size) or plain(s, most))
    monkeypatch.setattr(S, "MOST_SCORES", 1000)
    rng = np.random.default_rng(3)
    rows, asks = rng.normal(size=(300, 8)), rng.normal(size=(50, 8))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    q = pa.record_batch([pa.array(range(50)), pa.array(asks.tolist(), pa.list_(pa.float64()))], ["query_id", "v"])
    got = pa.Table.from_batches(S.best_rows(iter([q]), pa.array(range(300)), unit, 4)).column("id").to_pylist()
    want = np.argsort(-np.round(S._unit_rows(q.column("v")) @ unit.T, 12), axis=1, kind="stable")[:, :4]
    assert got == want.reshape(-1).tolist() and max(seen) <= 1000
    from scholia.sources.tables import table

    table(spark, "/root/testdata/sf0.001", "embeddings")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 400
