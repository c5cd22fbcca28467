"""Repeated spans against a plain version that looks at every span of every document."""

import random

from pyspark.sql import functions as F

from scholia.llm import spans

MARKS = ".!?。！？"


def plain_sentences(text):
    """Sentences, character by character; the texts here have none long enough to be cut again."""
    out, now, i = [], "", 0
    while i < len(text):
        c = text[i]
        now += c
        i += 1
        if c == "\n":
            while i < len(text) and text[i] == "\n":
                now, i = now + text[i], i + 1
        elif c in MARKS:
            while i < len(text) and text[i] in MARKS:
                now, i = now + text[i], i + 1
            j = i
            while j < len(text) and text[j] in "\"'”’»)]":
                j += 1
            k = j
            while k < len(text) and text[k].isspace():
                k += 1
            if k > j or k == len(text):
                now, i = now + text[i:k], k
        else:
            continue
        out.append(now)
        now = ""
    return out + [now] * bool(now)


def plain_words(s):
    return "".join(c.lower() if c.isalnum() or c == "_" else " " for c in s).split()


def every_span(rows, least_sentences=2, least_words=20, within=False):
    """The texts that remain: all pairs of first and last sentence of all documents, in plain dictionaries."""
    cut = [(i, plain_sentences(t or ""), []) for i, t in rows]
    places = {}
    for n, (i, sentences, gone) in enumerate(cut):
        words = [plain_words(s) for s in sentences]
        full = [j for j, w in enumerate(words) if w]
        for a in range(len(full)):
            for b in range(a + least_sentences, len(full) + 1):
                key = tuple(tuple(words[j]) for j in full[a:b])
                if sum(map(len, key)) >= least_words:
                    places.setdefault(key, []).append((i is None, i, n, full[a], full[b - 1]))
    for found in places.values():
        first = min(found)
        several = len({p[2] for p in found}) > 1
        for p in found:
            if p[2] != first[2] or (within and p != first):
                if several or within:
                    cut[p[2]][2].extend(range(p[3], p[4] + 1))
    return {i: "".join(s for j, s in enumerate(sentences) if j not in gone).strip() if gone else t for (i, sentences, gone), (_, t) in zip(cut, rows)}


def made(seed, docs=60):
    """Documents of few different sentences, some of them one word long, so that spans repeat in all ways."""
    rng = random.Random(seed)
    words = [a + b for a in "bdfgk" for b in ("an", "el", "or", "ust")]
    pool = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 9, 15]))).capitalize() + rng.choice([". ", "! ", ".\n", "\n", '?" ', "."]) for _ in range(40)]
    chains = [[rng.choice(pool) for _ in range(rng.randint(3, 9))] for _ in range(8)]
    return [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice(chains)) for _ in range(rng.randint(1, 12)))) for i in range(docs)]


def cleaned(spark, rows, **options):
    return {r.doc_id: r["__clean"].text for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), **options).collect()}


def test_sentences_join_to_the_text(spark, docs):
    texts = [r.text for r in docs.collect()] + [t for _, t in made(1)]
    for t in [*texts, "a " * 500 + "b, c " * 90, "", "\n\n", "3.5 and ...", "“Quoted.” Then"]:
        assert "".join(spans.sentences_of(t)) == t
    for _, t in made(2):
        assert spans.sentences_of(t) == plain_sentences(t)


def test_as_with_every_span(spark):
    for seed, within in ((3, False), (4, True), (5, False)):
        rows = made(seed)
        assert cleaned(spark, rows, within=within) == every_span(rows, within=within)


def test_the_query_is_the_plain_version_over_the_whole_table(spark, tmp_path):
    from scholia.llm import q_spans

    rows = made(11, 80)
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in q_spans.op4_span_dedup(spark, str(tmp_path)).collect()}
    assert got == every_span(rows, within=True)


def test_three_sentences_at_least(spark):
    rows = made(6)
    assert cleaned(spark, rows, least_sentences=3, least_words=12) == every_span(rows, 3, 12, True)


def test_planted_passages_go_and_clean_texts_stay(spark, docs):
    rng = random.Random(7)
    base = [(r.doc_id, r.text) for r in docs.dropDuplicates(["text"]).orderBy("doc_id").collect()]
    before = cleaned(spark, base)
    words = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "rt", "l")]
    passages = [". ".join(" ".join(rng.choice(words) for _ in range(rng.choice([4, 9, 18, 30]))) for _ in range(9)) + "." for _ in range(10)]
    planted = [(10_000 + i, f"Own words {i} start here {rng.random()} and {passages[i % 10]} And end {i} there, {rng.random()}.") for i in range(100)]
    out = cleaned(spark, base + planted)
    assert all(out[i] == before[i] for i, _ in base)
    assert all(out[10_000 + i] == planted[i][1] for i in range(10))
    for i in range(10, 100):  # the passage's first sentence runs on from the document's own words
        assert f"Own words {i} start" in out[10_000 + i] and not any(x in out[10_000 + i] for x in passages[i % 10].split(". ")[1:] if " " in x)


def test_a_refrain_goes_unless_only_other_documents_count(spark):
    refrain = "We sing this line of many words again and again. It ends with another line of as many words as that. "
    rows = [(1, refrain + "A verse. " + refrain), (2, "Other words only.")]
    assert cleaned(spark, rows, within=False) == dict(rows)
    assert cleaned(spark, rows)[1] == refrain + "A verse."
    both = [(1, refrain + "A verse. " + refrain), (2, "Other words only. " + refrain + "The end.")]  # the first holder across documents, too
    assert cleaned(spark, both) == {1: refrain + "A verse.", 2: "Other words only. The end."} == every_span(both, within=True)


def test_spans_of_odd_rows(spark, odd, none):
    out = spans.without_repeats(odd).collect()
    assert len(out) == 10 and set(odd.columns) < set(out[0].asDict())
    assert [r["__clean"].text for r in out if r.doc_id == 2] == [None]
    assert spans.without_repeats(none).count() == 0


def test_columns_with_any_names_nulls_and_repeated_rows(spark):
    text = "One sentence that holds ten words all in a row. And then another one that holds ten words as well. "
    rows = [(5, text + "Five."), (None, text + "None."), (3, text + "Three."), (3, text + "Three."), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("k", "id", "first", "many", "hash", "covered", "n", "last"):
        df = df.withColumn(name, F.lit(name))
    out = spans.without_repeats(df)
    assert out.columns == [*df.columns, "__clean"]
    assert sorted((r.doc_id or 0, r["__clean"].text) for r in out.where("text is not null").collect()) == [(0, "None."), (3, text + "Three."), (3, text + "Three."), (5, "Five.")]
