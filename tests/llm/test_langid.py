import numpy as np

from scholia.llm import langid, q_langid
from scholia.llm.langid import best_path, identify, script_of, train


def plain_viterbi(scores, penalty):
    v, back = scores[0].astype(float), []
    for s in scores[1:]:
        step = [[v[a] - (penalty if a != b else 0) for a in range(len(v))] for b in range(len(v))]
        back.append([int(np.argmax(r)) for r in step])
        v = np.array([max(r) for r in step]) + s
    return v.max(), back


def path_value(scores, labels, penalty):
    return sum(scores[i, k] for i, k in enumerate(labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:]))


def test_best_path_is_the_best():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 3, 0, 12, 7])
    scores = rng.normal(0, 3, (lengths.sum(), 3)).astype(np.float32)
    labels = best_path(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        if n:
            assert np.isclose(path_value(scores[at : at + n], labels[at : at + n], 2.0), plain_viterbi(scores[at : at + n], 2.0)[0], atol=1e-4)
        at += n


def test_scripts():
    assert [script_of(c) for c in "aéДא中かα"] == ["Latin", "Latin", "Cyrillic", "Hebrew", "Han", "Kana", "Greek"]


def test_held_out_accuracy(spark, docs):
    model = train(docs.where(~q_langid.held_out()))
    out = docs.where(q_langid.held_out()).select("lang", identify(model)["lang_pred"].alias("p")).collect()
    assert len(out) > 20 and sum(r.lang == r.p for r in out) / len(out) >= 0.97


def test_mixed_text_gets_spans(spark, docs):
    model = train(docs)
    pick = {r.lang: r.text for r in docs.orderBy("doc_id").collect()}
    a, b = (" ".join(pick[k].split()[:40]).replace("!", "") for k in ("en", "de"))
    r = spark.createDataFrame([(f"{a} {b}",)], "text string").select(identify(model).alias("r")).first().r
    assert {"en", "de"} <= {s.lang for s in r.spans}
    main = max(r.spans, key=lambda s: s.end - s.start)
    assert main.lang in ("en", "de") and r.n_spans == len(r.spans)


def test_other_script_is_und_inside_and_fallback_outside(spark):
    rows = [(i, t, k) for i in range(20) for t, k in (("the cat sat on the mat", "en"), ("кошка сидела на окне", "ru"))]
    model = train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    out = [r.r for r in spark.createDataFrame([("the cat кошка сидела",), ("日本語",), ("1 2 ² ½",), (None,)], "text string").select(identify(model).alias("r")).collect()]
    assert [s.lang for s in out[0].spans] == ["en", "ru"]
    assert out[1].lang_pred in ("en", "ru") and out[1].score == 0.0
    assert out[2].lang_pred == out[3].lang_pred == "und"


def test_odd_rows(spark, odd, none):
    model = train(odd)
    out = odd.select("doc_id", "text", identify(model).alias("r")).collect()
    for r in out:
        assert (r.r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.r.score <= 1
    assert none.select(identify(model)).count() == 0
    empty = train(none)
    assert odd.select(identify(empty).alias("r")).where("r.lang_pred <> 'und'").count() == 0
    assert isinstance(empty, langid.LanguageModel)
