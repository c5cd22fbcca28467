"""Segmentation by a dictionary against all paths, and tokens with and without it."""

import math
import random

import pytest

from scholia.functions import segmentation as G
from scholia.functions import text as T


def every_path(run, weights):
    """The best score over all ways to cut a run into words and single unknown characters."""
    total, low = math.log(sum(weights.values())), min(weights.values())
    if not run:
        return 0.0
    cuts = [math.log(G.UNKNOWN * low) - total + every_path(run[1:], weights)]
    cuts += [math.log(weights[run[:n]]) - total + every_path(run[n:], weights) for n in range(1, len(run) + 1) if run[:n] in weights]
    return max(cuts)


def test_the_best_path_of_all():
    rng = random.Random(1)
    letters = "天地人山水火"
    for _ in range(150):
        weights = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.choice([1.0, 3.0, 50.0]) for _ in range(rng.randint(1, 12))}
        d, run = G.Dictionary(weights.items()), "".join(rng.choices(letters, k=rng.randint(0, 9)))
        path = d.path(run)
        total, low = math.log(sum(weights.values())), min(weights.values())
        assert "".join(w for w, _ in path) == run and all((w in weights) for w, known in path if known)
        score = sum((math.log(weights[w]) if known else math.log(G.UNKNOWN * low)) - total for w, known in path)
        assert math.isclose(score, every_path(run, weights), abs_tol=1e-9)


def test_words_stay_whole():
    d = G.Dictionary([("向量数据库", 5), ("数据", 9), ("知识图谱", None), ("图谱", -1), ("库", 2)])
    assert d.tokens("向量数据库和知识图谱 API v2") == ["向量数据库", "知识图谱", "api", "v2"]  # 和 is a stop word
    assert d.tokens("数据库很快") == ["数据", "库", "很", "快", "很快"]
    assert d.tokens(None) == d.tokens("") == d.tokens("。！") == []
    assert G.Dictionary([]).tokens("天地人") == ["天", "地", "人", "天地", "地人"]


def test_without_words_as_the_other_tokens(spark):
    texts = [("知识库管理与引用溯源 Qwen2.5 的 API，the api",), ("一二三 abc 一二三",), (None,), ("",), ("x" * 50 + "天" * 200,)]
    df = spark.createDataFrame(texts, "t string")
    for r in df.select(T.tokens(df.t).alias("a"), G.tokens("t", G.Dictionary([])).alias("b")).collect():
        assert sorted(r.a) == sorted(r.b)


def test_a_dictionary_from_a_table_is_bounded(spark):
    words = spark.createDataFrame([("天地", 3), ("人", None), (None, 1), (" ", 1)], "word string, weight int")
    assert G.dictionary(words).tokens("天地人") == ["天地", "人"]
    with pytest.raises(ValueError, match="more than 2"):
        G.dictionary(words, 2)
