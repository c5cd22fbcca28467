"""Chunks kept by a pass in order, JSON lines, parents and groups against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import ingest as I
from scholia.operators import quality as Y
from scholia.operators.ranks import cumulated, numbered
from scholia.operators.retrieval import vector_topk
from scholia.sources import jsonl as J


def shingles(text, k):
    t = "".join(text.split())
    return {t[i : i + k] for i in range(len(t) - k + 1)} if len(t) > k else ({t} if t else set())


def plain_pass(rows, threshold, k):
    """The pass itself: texts one after another against all that were kept."""
    seen, kept, out = set(), [], set()
    for i, t in sorted(rows):
        bare, s = "".join(t.split()), shingles(t, k)
        if bare in seen:
            continue
        seen.add(bare)
        if s and any(len(s & x) / len(s | x) >= threshold - 1e-12 for x in kept):
            continue
        kept.append(s)
        out.add(i)
    return out


def made(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(30, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base)) + list(" and a line that all of them share at the end of the text")
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, "".join(t)))
    return rows + [(n, ""), (n + 1, "  "), (n + 2, "short")]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_chunks_as_by_a_pass(spark, seed):
    rows = made(seed)
    got = Y.kept_chunks(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", 0.7, 5).collect()
    firsts = {}
    for i, t in rows:
        firsts.setdefault("".join(t.split()), i)
    assert {r.id: r["class"] for r in got} == {i: firsts["".join(t.split())] for i, t in rows}
    assert {r.id for r in got if r.kept} == plain_pass(rows, 0.7, 5)


def test_rounds_go_on_to_the_end(spark):
    """A chain in which each id is near the next: every second one stays, after as many rounds."""
    n = 30
    ids = spark.range(n)
    pairs = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert sorted(r.id for r in Y.kept_of_pairs(ids, pairs).collect()) == list(range(0, n, 2))


def test_numbers_and_sums_of_groups_over_many_parts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o bigint, n bigint")
    want, sums, place = {}, {}, {}
    for g, o, n in sorted(rows, key=lambda r: r[1]):
        want[o] = (place.get(g, 0), sums.get(g, 0))
        place[g], sums[g] = place.get(g, 0) + 1, sums.get(g, 0) + n
    assert {r.o: r.number for r in numbered(df, ["g"], ["o"]).collect()} == {o: w[0] for o, w in want.items()}
    assert {r.o: r.before for r in cumulated(df, ["g"], ["o"], "n").collect()} == {o: w[1] for o, w in want.items()}


def test_nearest_vectors_with_ties_and_many_blocks(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(5)
    q = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    got = {}
    for r in vector_topk(df, q, 7, block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))

    def cosine(a, b):
        n = (sum(x * x for x in a) or 1) ** 0.5 * (sum(x * x for x in b) or 1) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / n, 9)

    for i, v in rows[::10]:
        want = sorted(range(300), key=lambda j: (-cosine(v, rows[j][1]), j))[:7]
        assert [x for _, x in sorted(got[i])] == want
    assert vector_topk(df, q.limit(0), 7).count() == 0


def test_lines_out_and_in(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = [("a?", "ref\n\"quoted\"", ["x.md"], None), ("b 你好", None, [], ["k"])]
    J.write_lines(spark.createDataFrame(rows, "question string, reference_answer string, expected_sources array<string>, expected_keywords array<string>"), path)
    got = sorted(J.read_lines(spark, path).collect())
    assert [(r.question, r.reference_answer, r.expected_sources, r.expected_keywords, r.difficulty) for r in got] == [(*r, None) for r in rows]
    (tmp_path / "hand.jsonl").write_text('{"question": "one"}\n\n{"question": "two", "other": 1}\n')
    assert sorted(r.question for r in J.read_lines(spark, str(tmp_path / "hand.jsonl")).collect()) == ["one", "two"]
    (tmp_path / "bad.jsonl").write_text('{"question": "one"}\nno object\n')
    with pytest.raises(Exception, match="FAILFAST"):
        J.read_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_breadcrumbs_and_prefixes(spark):
    rows = [("手册", ["手册", "考勤"], "text", "考勤", "手册 > 考勤"), ("T", ["A"], "text", "", "T > A"), ("T", [], "【x】 y", None, ""), ("T", None, None, "p", "b")]
    out = spark.createDataFrame(rows, "title string, path array<string>, text string, p string, b string").select(I.breadcrumb(F.col("title"), F.col("path")).alias("crumb"), I.prefixed(F.col("text"), F.col("p"), F.col("b")).alias("shown"), I.without_breadcrumb(F.col("text")).alias("bare")).collect()
    assert [r.crumb for r in out] == ["手册 > 考勤", "T > A", "T", "T"]
    assert [r.shown for r in out[:3]] == ["【考勤】\ntext", "【T > A】\ntext", "【x】 y"] and [r.bare for r in out] == ["text", "text", "y", ""]


def test_groups_of_a_context(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate([5, 5, 20, 1, 1, 9, 3])] + [(2, 0, "short"), (3, 0, "x" * 50), (3, 1, "y")]
    c = spark.createDataFrame(rows, "query_id int, position bigint, content string")
    got = sorted((r.query_id, r.group, r.position) for r in I.packed(c, 10, 3).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 3, 4), (3, 1, 0), (3, 2, 1)]
    out = {(r.query_id, r.group): r.text for r in I.group_summaries(c, I.packed(c, 10, 3), F.when(F.col("group") == 2, "made"), 6).collect()}
    assert out[1, 1] == "（第1/3部分·原文摘录）xxxxxx…" and out[1, 2] == "（第2/3部分）made" and (2, 1) not in out


def test_repeated_lines_of_pages(spark):
    """Against counting: a line that stands on three pages or more goes, on fewer it stays, and so do short ones."""
    rng = random.Random(5)
    lines = [f"line number {i} here" for i in range(30)] + ["ab", "xyz"]
    texts = ["\n\n".join("\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(T.deep_clean(F.col("text")).alias("t")).collect()]
    for text, out in zip(texts, got):
        pages = [p.split("\n") for p in text.split("\n\n")]
        often = {x for x in lines if len(x) >= 4 and sum(x in p for p in pages) >= 3} if len(pages) >= 3 else set()
        want = [x for p in pages for x in p if x not in often]
        assert out.split() == " ".join(want).split()


def test_seeds_meet_only_entities_that_hold_the_query(spark, monkeypatch):
    """Names of many digits share runs of three characters with very many others; only holders of the whole query, or of its rarest six characters, are listed."""
    from scholia.operators import ingest as M

    sizes, plain = {}, M.written

    def counted(df, name):
        out = plain(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(M, "written", counted)
    names = [f"s{i}" for i in range(10000, 12000)]
    entities = spark.createDataFrame([(n, "") for n in names] + [("Long Named Place", "with S11111 inside")], "name string, description string")
    asked = spark.createDataFrame([(1, "s1111"), (2, "S11999"), (3, "named place"), (4, "zzzz"), (5, "s1")], "query_id int, text string")
    got = sorted((r.query_id, r.place, r.name) for r in M.seeds(asked, entities, 3).collect())
    assert got == [(1, 1, "s11110"), (1, 2, "s11111"), (1, 3, "s11112"), (2, 1, "s11999"), (3, 1, "Long Named Place")] and sizes["listed"] <= 20
