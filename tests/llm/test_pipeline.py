"""The pipeline's stages one after another, and each stage against a plain version of its rule."""

import pytest

import corpus_pipeline as P
from scholia.llm import q_langid
from scholia.llm.ngram_join import words_of

SF = "/root/testdata/sf0.001"


def sets(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def similar(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 80 * (len(a) + len(b) - both)


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, now = [docs.collect()], docs
    for name, f in P.STAGES:
        now = f(spark, now, SF)
        rows = now.collect()
        out.append(rows)
        now = spark.createDataFrame(rows, now.schema)
    return out


def test_language_stage_keeps_clean_documents(stages):
    before, after = {r.doc_id for r in stages[0]}, {r.doc_id for r in stages[1]}
    assert after <= before and len(after) >= 0.99 * len(before) and stages[1][0].asDict().keys() == stages[0][0].asDict().keys()


def test_near_duplicates_go_but_one_of_each_group_stays(stages):
    texts = {r.doc_id: sets(r.text) for r in stages[1]}
    kept = {r.doc_id for r in stages[2]}
    ids = sorted(kept)
    assert not any(similar(texts[a], texts[b]) for i, a in enumerate(ids) for b in ids[:i])
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[:i]:
            if similar(texts[a], texts[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert kept == {root(i) for i in texts}


def test_no_item_is_left(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 10]
    assert any(x in r.text for r in stages[2] for x in items)
    assert not any(x in r.text for r in stages[3] for x in items)
    holds = {r.doc_id for r in stages[2] if any(x in r.text for x in items)}
    assert {r.doc_id for r in stages[2]} - {r.doc_id for r in stages[3]} - holds == set()


def test_mixture_and_shards(stages):
    assert {r.doc_id for r in stages[4]} <= {r.doc_id for r in stages[3]} and stages[4]
    assert sorted(r.doc_id for r in stages[5]) == sorted(r.doc_id for r in stages[4])
    for shard in {r.shard for r in stages[5]}:
        slots = sorted(r.slot for r in stages[5] if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_run_equals_the_stages(spark, stages):
    assert sorted(map(tuple, P.run(spark, SF).select("doc_id", "size").collect())) == sorted((r.doc_id, r.size) for r in stages[5])


def test_odd_and_empty_tables_pass_each_stage(spark, odd, none):
    for _, f in P.STAGES:
        f(spark, odd, SF).count()
        assert f(spark, none, SF).count() == 0
    left = P.identify_language(spark, odd, SF).collect()
    assert all(r.text and any(c.isalpha() for c in r.text) for r in left)


def test_held_out_remainder(spark):
    import zlib

    rows = [(i, zlib.crc32(str(i).encode()) % 4 == 2) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, want boolean")
    assert df.where(q_langid.held_out() != df.want).count() == 0


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, repeated rows and columns with the names that stages might use."""
    stages = dict(P.STAGES)
    docs = odd.withColumnsRenamed({"k": "shard", "n": "slot", "cid": "template", "key": "component"})
    for name, f in P.STAGES[:-1]:
        assert f(spark, docs, SF).columns == docs.columns and f(spark, none, SF).count() == 0, name
    assert ids(stages["ngram_jaccard"](spark, docs, SF)) == [(False, i) for i in range(1, 8)] + [(True, 0)]
    assert ids(stages["decontamination"](spark, docs, SF)) == ids(docs)
    kept = ids(stages["mixing"](spark, docs, SF))
    assert {(False, 2), (False, 3), (False, 4)} <= set(kept) <= set(ids(docs)) and kept.count((False, 1)) in (0, 2)
    out = stages["sharding"](spark, docs, SF).collect()
    assert len(out) == 10 and {r["size"] for r in out if r.doc_id in (2, 3)} == {1}
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out))) for s in {r["shard"] for r in out})
