"""The saved keyword index against scores computed plainly: after building, adding, replacing, deleting and compacting, with and without a filter, also where much is pruned."""

import math
import random
import re

import numpy as np
import pytest

from scholia.operators import keyword_store as K


def plain_scores(docs, query, allowed=None):
    sets = {i: {w.lower() for w in re.findall("[A-Za-z0-9]+", t or "")} for i, t in docs.items()}
    n, mean = len(sets), sum(map(len, sets.values())) / len(sets)
    out = {}
    for i, s in sets.items():
        if (allowed is None or i in allowed) and s & query:
            norm = 1.5 * (0.25 + 0.75 * len(s) / mean)
            out[i] = sum(math.log(1 + (n - d + 0.5) / (d + 0.5)) * 2.5 / (1 + norm) for w in s & query for d in [sum(w in x for x in sets.values())])
    return out


def plain_best(docs, queries, most, allowed=None):
    rows = []
    for q, words in queries.items():
        scores = plain_scores(docs, words, allowed)
        rows += [(q, i, r) for r, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:most])]
    return sorted(rows)


def made(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    return {i: " ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=rng.randint(1, 60))) for i in range(n)}


@pytest.fixture(scope="module")
def queries():
    rng = random.Random(5)
    return {q: {f"w{min(399, int(rng.expovariate(0.02)))}" for _ in range(rng.randint(1, 9))} | {"w0", "W9"} - {"W9"} for q in range(25)}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id bigint, text string")


def best(spark, index, queries, most, allowed=None):
    q = spark.createDataFrame([(q, w) for q, ws in queries.items() for w in ws], "query_id bigint, term string")
    seen = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "id bigint")
    return sorted((r.query_id, r.id, r.rank) for r in index.search(q, most, seen).collect())


def test_every_kind_of_change_equals_a_rebuild(spark, tmp_path, queries):
    docs = made(900, 1) | {900: None, 901: "", 902: "w0 w0 w1"}
    index = K.built(frame(spark, docs), "id", "text", str(tmp_path), "one")
    assert best(spark, index, queries, 7) == plain_best(docs, queries, 7)
    seen = {i for i in docs if i % 3 == 0}
    assert best(spark, index, queries, 7, seen) == plain_best(docs, queries, 7, seen)
    more = {i: t for i, t in made(1000, 2).items() if i >= 850}
    gone = [5, 17, 899, 12345]
    index = K.changed(index, frame(spark, more), deleted=spark.createDataFrame([(i,) for i in gone], "id bigint"), version="two")
    now = {i: t for i, t in (docs | more).items() if i not in gone} | {899: more[899]}
    assert best(spark, index, queries, 7) == plain_best(now, queries, 7)
    assert index.documents_count == len(now) and index.documents().count() == len(now)
    index = K.changed(index, deleted=spark.createDataFrame([(850,), (0,)], "id bigint"), version="three")
    now = {i: t for i, t in now.items() if i not in (850, 0)}
    assert best(spark, index, queries, 7) == plain_best(now, queries, 7)
    assert K.opened(spark, str(tmp_path), "two") is None and K.opened(spark, str(tmp_path), "three").manifest == index.manifest
    small = K.compacted(index)
    assert len(small.manifest["segments"]) == 1 and best(spark, small, queries, 7, seen) == plain_best(now, queries, 7, seen)
    K.cleaned(small)
    assert best(spark, K.opened(spark, str(tmp_path)), queries, 7) == plain_best(now, queries, 7)


def test_nothing_to_search(spark, tmp_path, queries):
    index = K.built(frame(spark, {}), "id", "text", str(tmp_path))
    assert best(spark, index, queries, 5) == [] and K.opened(spark, str(tmp_path / "other")) is None
    assert best(spark, K.changed(index, frame(spark, {1: "w0"})), {1: {"w0"}, 2: {"none"}}, 5) == [(1, 1, 0)]


def test_a_change_that_lost_the_race_is_refused(spark, tmp_path):
    index = K.built(frame(spark, {1: "a"}), "id", "text", str(tmp_path))
    folder = K.Folder(spark, str(tmp_path))
    assert folder.put("manifest-1.json", folder.read("manifest-0.json")) and not folder.put("manifest-1.json", "{}")
    assert K.opened(spark, str(tmp_path)).manifest == index.manifest


def test_only_the_wanted_terms_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BUCKET_LISTS", 1000)
    docs = {i: "common often " + ("rare " if i % 40 == 0 else "") + " ".join(f"x{i}y{j}" for j in range(i % 7)) for i in range(2000)}
    index = K.built(frame(spark, docs), "id", "text", str(tmp_path))
    found = index.lists(spark.createDataFrame([("rare",), ("common",)], "term string"))
    assert {r.term for r in found.select("term").distinct().collect()} == {"rare", "common"}
    assert index.manifest["segments"][0]["buckets"] > 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "In(term" in plan
    queries = {1: {"rare", "common", "often"}}
    assert best(spark, index, queries, 5) == plain_best(docs, queries, 5)


def test_lists_that_cannot_lift_a_document_find_none():
    """Against adding everything, for lists of every kind; and the work that is spared."""
    rng = np.random.default_rng(4)
    for trial in range(200):
        docs, most = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        lists = []
        for _ in range(int(rng.integers(1, 7))):
            at = np.flatnonzero(rng.random(docs) < rng.choice([0.05, 0.5, 1.0]))
            part = rng.choice([1e-3, 0.1, 1, 5]) * (0.5 + rng.integers(0, 3, len(at)) / 4)
            if len(at):
                lists.append((at, part, float(part.max())))
        may = None if trial % 2 else rng.random(docs) < 0.5
        whole = np.zeros(docs)
        for at, part, _ in lists:
            whole[at] += part
        seen = [i for i in range(docs) if whole[i] > 0 and (may is None or may[i])]
        want = sorted(seen, key=lambda i: (-round(whole[i], 9), i))[:most]
        at, score = K.best_of(lists, docs, most, may)
        assert sorted(at.tolist(), key=lambda i: (-round(whole[i], 9), i))[:most] == want
        assert np.allclose(score[np.isin(at, want)], whole[at[np.isin(at, want)]])


def test_lists_are_written_once(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrameWriter

    written, plain = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path.rsplit("/", 1)[1]), plain(self, path, *a, **k))[1])
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "two 三四五 two")], "id bigint, text string")
    index = K.built(docs, "id", "text", str(tmp_path / "index"))
    assert written == ["documents", "postings"]
    rows = {r.term: sorted(r.ids) for r in index.lists(spark.createDataFrame([("one",), ("two",), ("三四",)], "term string")).collect()}
    assert rows == {"one": [1], "two": [1, 4], "三四": [4]}
