"""Operators on small tables with known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import answers as A
from scholia.operators import changes, evaluation, graph, quality, retrieval, sessions, store
from scholia.operators import predicates as P
from scholia.sources import files, web

CONTEXT = [(1, "员工每天工作8小时，考勤由人事部门统计。"), (2, "报销需在7天内提交，单笔上限5000元。"), (3, "年假为5天，需提前申请。")]


def test_predicates(spark):
    row = spark.createDataFrame([("active", "*", None)], "doc_status string, acl string, department string")
    holds = lambda w: row.where(P.compiled(w)).count() == 1
    assert holds(None) and holds({"doc_status": "active"}) and holds({"acl": {"$in": ["*", "hr"]}}) and holds({"department": {"$nin": ["hr"]}}) and holds({"department": {"$ne": "hr"}})
    assert holds({"$or": [{"acl": "hr"}, {"doc_status": {"$eq": "active"}}]}) and not holds({"$and": [{"acl": "hr"}, {"doc_status": "active"}]})
    assert not holds({"acl": {"$regex": ".*"}}) and not holds({"department": {"$in": ["hr"]}})
    with pytest.raises(ValueError):
        P.compiled({"acl": {"$regex": ".*"}}, strict=True)


def test_fusion_is_dense_and_keeps_kinds(spark):
    v = spark.createDataFrame([("q", "in-1", 0, 0.8), ("q", "in-2", 1, 0.7)], "query_id string, id string, rank int, score double")
    k = spark.createDataFrame([("q", "out", 0, 9.0), ("q", "in-1", 1, 3.0)], "query_id string, id string, rank int, score double")
    out = {r.id: r for r in retrieval.fused(v, k, 10).collect()}
    assert [out[i].fusion_rank for i in ("in-1", "in-2", "out")] == [0, 1, 2] and out["out"].kind == "keyword" and abs(out["out"].score - 0.9) < 1e-9


def test_gate_uses_the_semantic_score(spark):
    hits = spark.createDataFrame([("a", 0.1, "vector"), ("a", 0.95, "keyword"), ("b", 0.2, "vector"), ("c", 0.5, "keyword"), ("d", 0.7, "keyword")], "query_id string, score double, kind string")
    assert {r.query_id for r in retrieval.gated(hits).collect()} == {"b", "d"}


def test_bm25_of_one_term(spark):
    docs = spark.createDataFrame([(1, "spark sql"), (2, "spark"), (3, "flink")], "id int, text string")
    q = spark.createDataFrame([("q", "spark")], "query_id string, term string")
    got = {r.id: r.score for r in retrieval.bm25(retrieval.postings(docs, "id", "text"), retrieval.corpus_stats(docs, "text"), q).collect()}
    import math

    idf, avg = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5)), 4 / 3
    assert got == pytest.approx({1: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg)), 2: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 / avg))})


def test_vector_topk_blocks_agree(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(50)] + [(99, [0.0] * 4)]
    index = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(3)
    q = index.where("id < 5").select(F.col("id").alias("query_id"), "embedding")
    one = sorted(map(tuple, retrieval.vector_topk(index, q, 3).select("query_id", "rank", "id").collect()))
    assert one == sorted(map(tuple, retrieval.vector_topk(index, q, 3, block=2).select("query_id", "rank", "id").collect())) and len(one) == 15


def test_budget_and_order(spark):
    h = spark.createDataFrame([("q", i, s) for i, s in enumerate([10, 500, 300])], "query_id string, position int, size int")
    assert [r.allowed for r in retrieval.budgets(h, F.col("size"), 300).orderBy("position").collect()] == [10, 190, 100]
    assert [r.allowed for r in retrieval.budgets(h, F.col("size"), 0).orderBy("position").collect()] == [10, 500, 300]
    h = spark.createDataFrame([("q", 0, "b", 5), ("q", 1, "a", 2), ("q", 2, "b", 3), ("q", 3, "c", None)], "query_id string, rank int, source string, chunk_index int")
    assert [r["rank"] for r in retrieval.in_document_order(h).orderBy("position").collect()] == [2, 0, 1, 3]


def test_whole_documents_stop_per_source(spark):
    chunks = spark.createDataFrame([("a0", "a", 0, "x" * 6), ("a1", "a", 1, "x" * 6), ("b0", "b", 0, "x" * 3), ("b1", "b", 1, "x")], "id string, source string, chunk_index int, text string")
    hits = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b")], "query_id string, rank int, source string")
    assert [r.id for r in retrieval.whole_documents(hits, chunks, characters=10).orderBy("position").collect()] == ["a0", "b0", "b1"]


@pytest.mark.parametrize("answer,status", [("抱歉，没有。", "refused"), ("", "refused"), ("资料无法确定。", "refused"), ("员工每天工作8小时[1]。报销需在7天内提交[2]。", "verified"), ("员工每天工作8小时[9]。", "unverified"), ("单笔报销上限9999元[2]。", "partial"), ("员工每天工作8小时。报销需在7天内提交。", "partial"), ("火星基地需要量子芯片[1]。", "partial"), ("火星基地需要量子芯片[1]。外星飞船停泊港湾[2]。", "unverified"), ("每月3333人[1]，4444台，5555次，66%。", "unverified")])
def test_verification(spark, answer, status):
    df = spark.createDataFrame([(answer, CONTEXT)], "answer string, context array<struct<index:int,content:string>>")
    assert A.verified(df, fallback="抱歉，没有。").first().status == status


def test_synthesis_is_spared(spark):
    df = spark.createDataFrame([("因此本质在于流程错位，并非设计缺陷[1]。员工每天工作8小时[1]。", CONTEXT)], "answer string, context array<struct<index:int,content:string>>")
    assert A.verified(df).first().status == "partial" and A.verified(df, synthesis_aware=True).first().status == "verified"


def test_extractive_answer(spark):
    c = spark.createDataFrame([("q", i, f"【手册】\n# 标题\n{t}") for i, t in CONTEXT], "query_id string, index int, content string")
    q = spark.createDataFrame([("q", "报销多少天内提交"), ("r", "量子")], "query_id string, question string")
    out = {r.query_id: r.answer for r in A.extractive_answers(c.unionByName(c.withColumn("query_id", F.lit("r"))), q).collect()}
    assert out == {"q": "- 报销需在7天内提交，单笔上限5000元 [2]。"}


def test_blending(spark):
    rows = [("verified", False, 0.9, 0.9, False), ("partial", True, 0.9, 0.9, False), ("partial", True, 0.9, 0.9, True), ("refused", False, 1.0, 0.0, True), ("partial", None, 0.0, 0.1, False)]
    df = spark.createDataFrame(rows, "s string, g boolean, p double, q double, d boolean")
    assert [r.v for r in df.select(A.blended(*[F.col(c) for c in "sgpqd"]).alias("v")).collect()] == ["partial", "verified", "partial", "refused", "unverified"]


def test_measures(spark):
    def one(rel):
        df = spark.createDataFrame([("q", i, bool(r)) for i, r in enumerate(rel)], "query_id string, rank int, relevant boolean")
        r = evaluation.per_query(df).first()
        return round(r.ndcg, 4), round(r.mrr, 4)

    assert one([1, 1, 1, 1, 1]) == (1.0, 1.0) and one([0] * 5) == (0.0, 0.0) and one([1, 0, 1, 0, 1])[0] == 0.8855 and one([0, 0, 1])[1] == 0.3333


def test_duplicates_and_gate(spark):
    d = spark.createDataFrame([(1, "内容A"), (2, "内容B"), (3, "内 容A")], "id int, text string")
    assert sorted(r.id for r in quality.first_of_each(d, "id").collect()) == [1, 2]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    assert sorted(r.id for r in quality.kept_of_pairs(ids, pairs).collect()) == [1, 3, 5]
    now = F.lit(datetime.datetime(2026, 1, 1))
    rows = [("active", "hr", None, None), ("draft", "hr", None, None), ("active", "*", None, None), ("active", "hr,it", None, None), ("active", "hr", "2020-01-01", None), ("active", "hr", "??", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "s string, a string, v string, u string")
    got = [r.v for r in df.select(quality.rejection(F.col("s"), F.col("a"), F.col("v"), F.col("u"), now, explicit_acl=True, expiry_days=365).alias("v")).collect()]
    assert got == [None, "status=draft", "acl=*", "groups=hr,it", "valid_until=2020-01-01", "age"]


def test_store(spark):
    old = spark.createDataFrame([("1", "a", 0), ("2", "a", 0), ("3", "b", 0)], "id string, source string, seq int")
    new = spark.createDataFrame([("1", "a", 1), ("1", "a", 2)], "id string, source string, seq int")
    assert sorted((r.id, r.seq) for r in store.upserted(old, new, "id", "seq").collect()) == [("1", 2), ("2", 0), ("3", 0)]
    assert sorted(r.id for r in store.replaced(old, new).collect()) == ["1", "1", "3"] and [r.id for r in store.stale(old, new, "id").collect()] == ["2"]
    with pytest.raises(ValueError):
        store.deleted(old, {})
    snaps = spark.createDataFrame([("d", 1, "h1"), ("d", 2, "h1"), ("d", 3, "h2"), ("d", 4, "h1")], "doc string, seq int, doc_hash string")
    assert [(r.seq, r.version) for r in store.versions(snaps).orderBy("seq").collect()] == [(1, 1), (3, 2), (4, 3)]


def test_changes(spark):
    old = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "bb", "c"])], "doc string, chunk_pos int, text string")
    new = spark.createDataFrame([("d", i, t) for i, t in enumerate(["a", "bx", "c", "d"])], "doc string, chunk_pos int, text string")
    r = changes.chunk_changes(old, new).first()
    assert (r.added, r.removed, r.modified, r.unchanged, r.similarity) == (1, 0, 1, 2, 0.5)


def test_graph(spark):
    rel = spark.createDataFrame([("Alice", "MIT", "WORKS_FOR"), ("Alice", "China", "LIVES_IN"), ("MIT", "USA", "IN"), ("USA", "Earth", "ON")], "source string, target string, type string")
    seeds = spark.createDataFrame([("Alice",)], "name string")
    assert {(r.name, r.hop) for r in graph.subgraph(seeds, rel, 2).collect()} == {("Alice", 0), ("MIT", 1), ("China", 1), ("USA", 2)}
    assert graph.relations_of(seeds.union(spark.createDataFrame([("MIT",)], "name string")), rel, "in").count() == 1
    ents = spark.createDataFrame([("Alice", "Person", "", ["A"], 1), ("Alice", "", "x", ["B", "A"], 2)], "name string, type string, description string, aliases array<string>, seq int")
    r = graph.merged_entities(ents).first()
    assert (r.type, r.description, r.aliases) == ("Person", "x", ["A", "B"])


def test_budgeted_history(spark):
    m = spark.createDataFrame([("c", i, s) for i, s in enumerate([5, 50, 7, 90])], "conv_id string, turn int, n int")
    assert sessions.within_budget(m, 100, F.col("n")).first().kept == [2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文内容".encode("gb18030"))
    (tmp_path / "b.md").write_text("# 标题\n[链接](http://x)\n")
    (tmp_path / "c.csv").write_text("a;b\n1;2\n")
    (tmp_path / "d.html").write_text("<title>t</title><nav>n</nav><h2>H</h2><p>x <b>y</b></p><script>z</script>")
    (tmp_path / "e.bin").write_bytes(b"\x00")
    (tmp_path / "f.txt").write_text(" ")
    got = {r.source: r.content for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "中文内容", "b.md": "# 标题\n链接", "c.csv": "| a | b |\n| --- | --- |\n| 1 | 2 |", "d.html": "## H\nx y"}


def test_word_documents(spark, tmp_path):
    import zipfile

    from scholia.sources import docx

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b  c')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    body = f"{p('Title', 'H1')}{p(' ')}<w:p><w:r><w:t>one</w:t><w:tab/><w:t>two &amp; three</w:t></w:r><w:r><w:br/><w:t>four</w:t></w:r></w:p>{table}{p('Part', 'X2')}{p('end')}"
    styles = f'<w:styles {ns}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="X2"><w:name w:val="标题 2"/></w:style></w:styles>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", styles)
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    data = (tmp_path / "a.docx").read_bytes()
    assert docx.blocks(data) == [(1, "Title"), (None, "one\ttwo & three\nfour"), (None, "| a | b c |\n| --- | --- |\n| 1 | 2 |"), (2, "Part"), (None, "end")]
    assert docx.marked_text(data).startswith("# Title\none") and "## Part" in docx.marked_text(data) and docx.blocks(b"PK") == []
    got = files.read_documents(spark, str(tmp_path)).collect()
    assert [(r.source, r.title, r.content.split("\n")[0]) for r in got] == [("a.docx", "a", "Title")]


def test_urls(spark):
    rows = [("http://a.example/x", True), ("ftp://a.example", False), ("http://127.0.0.1/", False), ("http://user@10.0.0.1:80/", False), ("https://172.32.0.1", True), ("http://localhost", False)]
    df = spark.createDataFrame([(u, "<title>A &amp; B</title>", w) for u, w in rows], "url string, html string, want boolean")
    assert web.pages(df).where("allowed <> want or title <> 'A & B'").count() == 0


def test_heads_are_cut_before_they_are_folded(spark):
    """ß in full capitals is two characters, which would move the end of a head and meet a plain ss."""
    rows = [("Größe über Maß und Ziel.", "GRÖẞE ÜBER MASS", 1.0), ("Größe über M.", "Größe über X", 0.0), ("die Maße.", "die masse", 0.0), ("ᾳ b", "ᾼ B", 1.0)]
    df = spark.createDataFrame(rows, "a string, c string, want double")
    assert df.where(evaluation.faithfulness(F.col("a"), F.col("c"), text.upper) != F.col("want")).count() == 0


def test_titles_of_pages_as_their_sql_has_them(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from scholia.plans import data_queries

    rows = [(1, "https://a.example/x", "<title> A &amp; &quot;B&quot; &amp;lt; </title>"), (2, "https://b.example/", "<title></title>"), (3, "https://c.example", "no title")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in data_queries.web_pages(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(c.sql(data_queries.R.oracles["web_pages"]).fetchall())
    assert web.pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).where("page_id = 1").first().title == 'A & "B" &lt;'


def test_changes_are_counted_without_texts(spark):
    """Many documents at once, as one after the other; texts aren't carried along where no similarity is asked for."""
    import difflib
    import random

    rng, old, new, want = random.Random(5), [], [], []
    for d in range(40):
        a = [rng.choice("abcd") * 3 for _ in range(rng.randint(0, 6))]
        b = a if d % 3 == 0 else [rng.choice("abcd") * 3 for _ in range(rng.randint(0, 6))]
        old += [(f"d{d}", i, x) for i, x in enumerate(a)]
        new += [(f"d{d}", i, x) for i, x in enumerate(b)]
        n = dict.fromkeys(("insert", "delete", "replace", "equal"), 0)
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            n[tag] += m - k if tag == "insert" else j - i
        want += [(f"d{d}", n["insert"], n["delete"], n["replace"], n["equal"])] if a or b else []
    o, w = (spark.createDataFrame(x, "doc string, chunk_pos int, text string") for x in (old, new))
    got = changes.chunk_changes(o, w).select("doc", "added", "removed", "modified", "unchanged")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and not [line for line in plan.split("\n") if "collect_list" in line and "text#" in line]
