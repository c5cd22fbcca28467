"""Queries over whole texts against brute force."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.plans import text_queries as Q


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_numbers_of_a_group_over_ranges(spark, tmp_path):
    rows = [(i, "x", "hot" if i % 3 else None if i % 2 else "s") for i in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = Q.numbered(Q.documents(spark, saved(spark, tmp_path, rows)), "source", "doc_id").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for i, _, s in rows:
        want.setdefault(s, []).append(i)
    assert sorted((str(r.source), r.number, r.doc_id) for r in got) == sorted((str(s), n, i) for s, ids in want.items() for n, i in enumerate(ids, 1))


def test_entries_are_counted_per_line(spark, tmp_path):
    rows = [(i, "x", "hot") for i in range(1200)] + [(2000 + i, "x", "few") for i in range(4)] + [(3000 + i, "x", "six") for i in range(6)]
    out = Q.text_entry_count(spark, saved(spark, tmp_path, rows))
    assert {r.source: r.entries for r in out.collect()} == {"hot": 999, "few": -1, "six": 6}
    assert "collect_list" not in out._jdf.queryExecution().toString()
    lines = [("a", f"[{i}] x") for i in (3, 4, 5, 6, 7, 7)] + [("b", f"[{i}] x") for i in (1, 2, 3, 4, 6)] + [("c", x) for x in ("[1]", "[2]", " [3]", "[4444]", "x [5]")]
    counts = spark.createDataFrame(lines, "k string, line string").groupBy("k").agg(T.entries_of_lines(T.entry_number("line")).alias("n"))
    assert {r.k: r.n for r in counts.collect()} == {"a": 5, "b": None, "c": None}


def test_bigram_cosine_of_whole_texts(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, " ", "a", "ab", "\U0001f600\U0001f600 \u00e9", *["x" * 300 + "".join(rng.choice("abcd \u4e00\n") for _ in range(rng.randrange(2, 900))) for _ in range(20)]]
    rows = [(i, t, "st"[i % 7 == 0]) for i, t in enumerate(texts)]
    want = {}
    for s in "st":
        own = [r for r in rows if r[2] == s]
        for (i, a, _), (_, b, _) in zip(own, own[1:]):
            x, y = (Counter(map("".join, zip(t, t[1:]))) for t in ((a or "").strip(), (b or "").strip()))
            norm = sum(v * v for v in x.values()) ** 0.5 * sum(v * v for v in y.values()) ** 0.5
            want[i] = round(sum(v * y[g] for g, v in x.items()) / norm, 5) if norm else None
    got = {r.doc_id: r.similarity and round(r.similarity, 5) for r in Q.text_bigram_cosine_whole(spark, saved(spark, tmp_path, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == w if w is None else abs(got[i] - w) < 2e-5 for i, w in want.items())


def bare(t):
    for _ in range(3):
        for p in (r"^\s*[（(][^）)]{0,24}[）)]\s*", r"^\s*(?:[-•·*]\s*)+", r"^\s*\d{1,2}[.、．)]\s*"):
            t = re.sub(p, "", t)
    return t.strip()


def plain(t):
    for p, to in ((r"(?s)```[^\n]*\n(.*?)```", r"\n\1\n"), (r"`([^`]+)`", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"<[^>]+>", "")):
        t = re.sub(p, to, t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t.strip()))


def test_markers_and_markup_of_whole_texts(spark, tmp_path):
    rng = random.Random(6)
    heads = ["（一） ", "(a) ", "- ", "• * ", "1. ", "12、", "123. ", "  3) - 2. ", "[x](http://y/z) ", "<b>q</b> ", "```py\na < b\n\n\n\nc\n```", "`k` ", "# h\n", "[1] ", "plain "]
    texts = [None, "", " \n", *[rng.choice(heads) + rng.choice(heads) + "word <i>y</i> `z`\n- (b) 4. last " * rng.randrange(1, 90) for _ in range(60)], *heads]
    folder = saved(spark, tmp_path, [(i, t, "s") for i, t in enumerate(texts)])
    assert {r.doc_id: r.bare for r in Q.text_strip_markers_whole(spark, folder).collect()} == {i: None if t is None else bare(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.plain_md5 for r in Q.text_markdown_whole(spark, folder).collect()} == {i: hashlib.md5(plain(t or "").encode()).hexdigest() for i, t in enumerate(texts)}


def test_shingles_are_taken_in_one_pass(spark):
    rows = ["", " ", "abc", "abcdefgh", "ab cd\nefghi", "😀a😀b😀c😀d😀e", "ab" * 30, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, t string").select("id", T.shingles(F.col("t")).alias("s"))
    plain = lambda t: {t[i : i + 8] for i in range(max(1, len(t) - 7))} if t else set()
    for r in df.collect():
        assert len(r.s) == len(set(r.s)) and set(r.s) == plain("".join((rows[r.id] or "").split()))
    assert "slice(" not in df._jdf.queryExecution().optimizedPlan().toString()  # a slice for each place took twice as long


def test_neighbours_are_found_without_a_window_over_a_source(spark):
    plan = Q.text_bigram_cosine(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan


def test_a_context_is_folded_once_for_a_text_not_for_each_sentence(spark, tmp_path):
    from scholia.plans import app_queries as A

    rows = [(0, "Abc def ghi. strasse. nowhere to be found" + " x" * 600, "s"), (1, "x" * 1200 + ". Abc. xxxxxxxxxxxxy", "s"), (2, None, "s"), (3, " . ", "s"), (4, "", "s")]
    df = A.answer_faithfulness(spark, saved(spark, tmp_path, rows))
    assert {r.doc_id: r.faithfulness for r in df.collect()} == {0: 1.0, 1: round(2 / 3, 6)}
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(lambda") == 1 and "contains(upper(" not in plan
