"""Functions over single values, on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from scholia.functions import decisions as D
from scholia.functions import queries as Q
from scholia.functions import splitting as X
from scholia.functions import text as T


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cleaning(spark):
    assert values(spark, ["  a \t b\n\n\n\nc ", None, ""], T.clean) == ["a b\n\nc", "", ""]
    pages = "\n\n".join(f"公司手册页眉\n正文{i}\n第 {i} 页\n------" for i in range(3))
    assert values(spark, [pages, "公司手册页眉\na\n公司手册页眉", "x　y\n12\nz"], T.deep_clean) == ["正文0\n\n正文1\n\n正文2", "公司手册页眉\na\n公司手册页眉", "x y\nz"]


def test_hashes_ignore_white_space(spark):
    a, b, c = values(spark, ["内容 A", "内容\nA　", "内容B"], T.content_hash)
    assert a == b != c


def test_shingles(spark):
    assert values(spark, ["abc d", "", "abcdefghij"], T.shingles) == [["abcd"], [], ["abcdefgh", "bcdefghi", "cdefghij"]]


def test_tokens(spark):
    assert values(spark, ["BM25 bm25 知识库的", None], T.tokens) == [["bm25", "知", "识", "库", "知识", "识库", "库的"], []]
    assert values(spark, ["什么是 a 5 Qwen2.5-1.5B"], T.query_terms) == [["么是", "5", "qwen2.5-1.5b"]]


def test_sentences(spark):
    assert values(spark, ["圆周率是3.14。对吗？\n好"], T.split_sentences) == [["圆周率是3.14。", "对吗？", "好"]]
    assert values(spark, ["每天工作8小时[1]。短。\n第二句没有标点"], T.check_sentences) == [["每天工作8小时[1]。", "第二句没有标点"]]
    assert values(spark, ["（C1） - 1. 每天工作八个小时[2]。太短。"], T.answer_sentences) == [["每天工作八个小时。"]]


def test_entries_and_metadata(spark):
    refs = "\n".join(f"[{i}] A" for i in range(1, 7))
    assert values(spark, [refs, refs.replace("[3]", "[9]"), "[1] a"], T.entry_count) == [6, None, None]
    assert values(spark, ["hr， admin,hr", None, "all", " * "], T.acl) == ["hr,admin", "*", "*", "*"]
    assert values(spark, ["草稿", "Archived", None, "x"], T.status) == ["draft", "expired", "active", "active"]
    day = datetime.date(2026, 3, 5)
    assert values(spark, ["2026-03-05", "2026/3/5", "2026.03.05", "2026-03-05 10:00:00", "soon", None], T.any_date) == [day] * 4 + [None, None]
    m = values(spark, ["---\ntitle: '员工手册'\nx y\nacl: hr\n---\n正文", "正文"], T.frontmatter)
    assert (m[0].meta, m[0].body, m[1].meta, m[1].body) == ({"title": "员工手册", "acl": "hr"}, "正文", {}, "正文")


def test_markdown_and_snippets(spark):
    assert values(spark, ["# T\n[a](http://x) <b>c</b> `d`\n```py\ncode\n```"], T.markdown_to_text) == ["# T\na c d\n\ncode"]
    assert values(spark, ["【x】 短。", "一" * 150 + "。" + "二" * 100], T.snippet) == ["短。", "一" * 150 + "。"]


def test_question_normalising(spark):
    now = F.lit("2026-03-31").cast("date")
    got = values(spark, ["請問，上个月的报消规定", "昨天和上周五", "ＡＢ　ｃ", None], lambda c: Q.normalized(c, now))
    assert got == ["2026年2月的报销规定", "2026年3月30日和2026年3月27日", "AB c", ""]


@pytest.mark.parametrize("text,want", [("你好！", ("chitchat", "greeting")), ("拜拜", ("chitchat", "farewell")), ("你好，请问年假几天", ("fact", None)), ("你是谁", ("chitchat", "identity")), ("论文引用了多少文献", ("aggregate", None)), ("今天几号", ("chitchat", "datetime")), ("今天天气怎么样", ("chitchat", "live_info")), ("帮我写一首诗", ("chitchat", "general_generation")), ("知识库里没有的内容你会怎么回答", ("chitchat", "capability")), ("", ("fact", None))])
def test_routing(spark, text, want):
    r = values(spark, [text], Q.intent)[0]
    assert (r.intent, r.kind) == want


def test_history_and_memory(spark):
    df = spark.createDataFrame([("它怎么报销？", "差旅费标准是什么"), ("年假总共有多少天可以休", "差旅费标准是什么"), ("那补贴呢还有没有别的规定", None)], "q string, u string")
    assert [r.v for r in df.select(Q.rewritten(F.col("q"), F.col("u")).alias("v")).collect()] == ["差旅费标准是什么；它怎么报销？", "年假总共有多少天可以休", "那补贴呢还有没有别的规定"]
    got = values(spark, ["记住：周五交报告。", "我的部门是研发部", "hello"], Q.remembered)
    assert [[(x.key, x.value) for x in g] for g in got] == [[("用户叮嘱", "周五交报告")], [("部门", "研发部")], []]
    assert values(spark, ["请问 什么模型", "x"], Q.variants) == [["请问 什么模型", "什么模型", "请问 什么模型" + Q.MODEL_EXPANSION], ["x"]]


def test_sentence_chunks():
    s = "这是一个用来测试的句子。"
    chunks = X.sentence_chunks(s * 30, 80, 10)
    assert all(len(c) <= 91 for c in chunks) and "".join(chunks).replace("\n", "").count("句子") >= 30
    assert X.sentence_chunks("  ") == [] and X.sentence_chunks(None) == []
    long = X.sentence_chunks("字" * 1000, 100, 10)
    assert len(long) >= 10 and max(map(len, long)) <= 111
    assert all(len(c) <= 43 for c in X.sentence_chunks("第一句话很短。第二句话也短。第三句话还短。" * 4, 30, 8, 0))
    assert any("3.14" in c for c in X.sentence_chunks("圆周率约为3.14。它很有用。", 50, 5))
    assert [c.split("\n")[-1] for c in X.recursive_chunks("A" * 200, 50, 5)] == ["A" * 50] * 4


def test_sections():
    text = "intro\n# 员工手册\n总则\n## 考勤制度\n8 小时\n### 迟到\n扣款\n## 报销\n7 天"
    got = X.sections(text, "f")
    assert [p for p, _, _ in got] == [[], ["员工手册"], ["员工手册", "考勤制度"], ["员工手册", "考勤制度", "迟到"], ["员工手册", "报销"]]
    assert [t for _, t, _ in X.sections("一、请假\na\n二、报销\nb")] == ["一、请假", "二、报销"]
    assert X.sections("plain", "f") == [([], "f", "plain")]


def test_decisions(spark):
    r = spark.range(1).select(D.choice(["a", "b"], F.lit("b"), F.lit(None).cast("double")).alias("c"), D.yes_no(F.lit(1.7)).alias("y"), D.grade(5, F.lit(4)).alias("g"), D.distribution(F.create_map(F.lit("x"), F.lit(-1.0), F.lit("y"), F.lit(0.0))).alias("d")).first()
    assert r.c.label == "b" and abs(r.c.confidence - 0.9) < 1e-9 and (r.y.probability, r.y.label) == (1.0, "yes")
    assert r.g.score > 3.5 and r.d == {"x": 0.5, "y": 0.5}
    assert values(spark, ["3/5", "第2档", "0.5", "9", "?"], lambda c: D.grade_index(5, c)) == [2, 1, 2, 4, 4]
