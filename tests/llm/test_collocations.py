"""Collocations against plain counting, and automata against the phrases they were made from."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import automata as A
from scholia.llm import collocations as C

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=2000, share=50):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longest = {}
        for p, a in candidates.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longest[part] = max(a, longest.get(part, 0))
        scored = []
        for p, a in candidates.items():
            if 100 * longest.get(p, 0) >= share * a and len(p) == 2 and p in longest:
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string").repartition(3)
    for name in "a l r n k phrase score rank words range counts part f salt most".split():
        df = df.withColumn(name, F.lit(name))
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def made(seed, docs=120, langs=("en", "de", None)):
    rng = random.Random(seed)
    words = ["the", "of", "Old", "town", "New", "york", "CITY", "river", "ünd", "Über", "a b", "x y", "É", "\x1c", "日本", "b"]
    rows = []
    for _ in range(docs):
        parts = [rng.choice([" new york city ", " of the ", "\tOLD  town ", rng.choice(words), rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n", "?!", ""]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(langs), "".join(parts)))
    return rows


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"words_a_range": 200, "words_held": 300, "most_common": 5}), (3, {"words_a_range": 50, "words_held": 50, "most_common": 10**9}), (4, {"least": 3, "share": 90, "top": 7})])
def test_as_by_plain_counting(spark, seed, options):
    rows = made(seed) + [("en", None), ("en", ""), (None, " .,; "), ("fr", "la la la la la la la la la la la la la")] + [("es", "muy buen dia. " * 30)] * 2
    assert found(spark, rows, **options) == plain(rows, **{k: v for k, v in options.items() if k in ("least", "share", "top")})


def test_very_long_texts_are_taken_in_slices(spark, monkeypatch):
    text = " ".join(random.Random(5).choices(["one", "two", "three.", "four,"], k=4000))
    for slice_bytes in (1, 50, 1 << 22):
        monkeypatch.setattr(C, "SLICE", slice_bytes)
        assert [w for run in C.word_runs(text) for w in run if w != C.END] == [w.encode() for w in re.split("[., ]+", text) if w]
    long = [("en", "river bank side " * 60_000)]
    assert found(spark, long) == plain(long)


def test_nothing(spark):
    assert found(spark, []) == [] and found(spark, [("en", None), (None, "")]) == []


def random_phrases(rng, words):
    ids = np.array([rng.randrange(-1, len(words)) for _ in range(rng.randint(0, 300))], np.int64)
    return C.phrases_of(ids, words)


def spelled(p):
    two = {(p.words[i], p.words[j]): n for i, j, n in zip(p.first, p.second, p.pair_count)}
    three = {(p.words[p.first[b]], p.words[p.second[b]], p.words[k]): n for b, k, n in zip(p.pair, p.third, p.count)}
    return two, three


def test_automata_spell_what_they_were_made_from():
    rng = random.Random(6)
    words = sorted(f"w{i}".encode() for i in range(12))
    for step in (1, 3, 1 << 20):
        for _ in range(60):
            p = random_phrases(rng, words)
            q = A.phrases(A.build(p, step))
            assert spelled(p) == spelled(q) and all((x == y).all() for x, y in zip((p.first, p.second, p.pair), (q.first, q.second, q.pair)))


def test_equal_states_are_one():
    """Fifty words that are followed alike share their states: the automaton hardly grows with them."""
    words = sorted(f"w{i:03d}".encode() for i in range(60))
    text = [x for i in range(50) for x in (i, 55, 56, -1)]
    sizes = [len(A.build(C.phrases_of(np.array(text[: 4 * n]), words))) for n in (5, 50)]
    p = C.phrases_of(np.array(text), words)
    seconds = A.Register(3)
    starts = A._starts(p.first)
    assert len(set(seconds.freeze(starts[:50], p.second[:50], p.pair_count[:50], np.ones(50, np.int64)).tolist())) == 1 and sizes[1] < 3 * sizes[0]


def test_union_sums_and_composition_looks_up():
    rng = random.Random(7)
    words = sorted(f"w{i}".encode() for i in range(9))
    for at_once in (2, 64):
        parts = [random_phrases(rng, words).slim() for _ in range(7)]
        two, three = Counter(), Counter()
        for p in parts:
            a, b = spelled(p)
            two.update(a)
            three.update(b)
        whole = A.union([A.build(p) for p in parts], at_once)
        assert spelled(whole) == (dict(two), dict(three))
        assert spelled(whole.kept(5))[1] == {k: n for k, n in three.items() if n >= 5}
        asked = random_phrases(rng, [b"other", *words, b"x"]).slim()
        assert spelled(A.composed(asked, whole))[0] == {k: two[k] for k in spelled(asked)[0] if k in two}
