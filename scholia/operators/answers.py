"""Answers quoted from retrieved passages, their citations, and checks of answers against their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions import text as T

#: Hard facts in a text (shares, dates, amounts, long numbers), in order.
FACTS = (
    r"\d+(?:\.\d+)?\s*%",
    r"\d{4}\s*年(?:\d{1,2}\s*月)?(?:\d{1,2}\s*日)?",
    r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}",
    r"\d+(?:\.\d+)?\s*(?:万元|亿元|元|天|日|小时|分钟|人|次|个|条|台|月|年|km|kg|m²|㎡)",
    r"\d{3,}",
)
#: How an answer that refuses begins.
REFUSAL = (
    r"^(?:抱歉[，,]?\s*)?(?:(?:当前|现有|手头|检索到的)?(?:资料|材料|知识库)(?:中)?(?:没有|未|无法)(?:找到|检索到|确定|回答|提供)|无法回答(?:该|这个)?问题)"
    r"(?:[^。！？!?\n]{0,20})(?:[。！？!?\n]|——|$)"
)
#: Words that mark a judgement or a summary.
SYNTHESIS = (
    "所以 因此 因而 导致 使得 意味着 说明 表明 反映 印证 本质 实质 真正 核心 关键 根源 动机 意图 想表达 想论证 目的 无异于 并非 并不 不是 而是 恰恰 反而 "
    "对比 相较 相比 转折 矛盾 悖论 错位 代价 受益 受损 总体 整体 归纳 总结 概括 层次 递进 始终 更大 越来越 最终"
).split()


def passages(context: DataFrame, questions: DataFrame, most_chunks: int = 3, most_sentences: int = 2, characters: int = 260, min_term_hits: int = 1) -> DataFrame:
    """(query_id, o, index, passage): sentences of the context (query_id, index, content) that share most terms with the question, in the order of the answer.
    Queries whose chunks all share fewer than ``min_term_hits`` terms have none."""
    q = questions.select("query_id", T.query_terms(F.col("question")).alias("terms"))
    c = context.join(q, "query_id").withColumn("hits", T.term_hits(F.col("terms"), F.col("content")))
    w = W.partitionBy("query_id")
    c = c.withColumn("best", F.max("hits").over(w)).where(F.col("best") >= min_term_hits).where((F.col("best") == 0) | (F.col("hits") > 0))
    c = c.withColumn("o", F.row_number().over(w.orderBy(F.desc("hits"), "index"))).where(F.col("o") <= most_chunks)
    body = T.strip(F.regexp_replace(F.regexp_replace(T.strip(F.col("content")), r"^\s*【[^】\n]{0,120}】\s*", ""), r"(?m)^\s*#{1,6}\s+.*$", ""))
    c = c.withColumn("body", body).withColumn("s", T.answer_sentences(F.col("body")))
    c = c.withColumn("s", F.when(F.size("s") > 0, F.col("s")).when(F.length("body") > 0, F.array(T.strip(F.substring("body", 1, characters)))).otherwise(F.array().cast("array<string>")))
    s = c.select("query_id", "index", "o", "terms", F.posexplode("s").alias("position", "sentence")).withColumn("h", T.term_hits(F.col("terms"), F.col("sentence")))
    one = W.partitionBy("query_id", "index")
    s = s.withColumn("any", F.max("h").over(one)).where((F.col("any") == 0) | (F.col("h") > 0))
    score = F.col("h") / F.greatest(F.lit(1), F.size("terms")) + F.when(F.col("position") == 0, 0.015).otherwise(0.0)
    s = s.withColumn("n", F.row_number().over(one.orderBy(F.desc(score), "position"))).where(F.col("n") <= most_sentences)
    s = s.withColumn("passage", T.strip(F.substring("sentence", 1, characters))).where("passage <> ''")
    listed = s.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", "position", "index", "passage"))).alias("p"))  # at most most_chunks * most_sentences
    plain = lambda x: F.lower(T.without_space(x))
    start = F.array().cast("array<struct<o:int,position:int,index:int,passage:string>>")
    kept = F.aggregate("p", start, lambda a, x: F.when(F.exists(a, lambda y: F.contains(plain(y["passage"]), plain(x["passage"]))), a).otherwise(F.concat(a, F.array(x.cast("struct<o:int,position:int,index:int,passage:string>")))))
    return listed.select("query_id", F.posexplode(kept).alias("o", "x")).select("query_id", "o", "x.index", "x.passage")


def cited(passage: Column, index: Column) -> Column:
    """A passage as a line of an answer: its mark before its last stop."""
    last = F.substring(passage, -1, 1)
    stops = last.rlike("[。！？!?；;.:：]")
    bare = F.when(stops, F.regexp_replace(F.expr("substring({0}, 1, length({0}) - 1)".format("passage")), r"\s+$", "")).otherwise(F.regexp_replace(passage, r"\s+$", ""))
    return F.concat(F.lit("- "), bare, F.lit(" ["), index.cast("string"), F.lit("]"), F.when(stops, last).otherwise("。"))


def extractive_answers(context: DataFrame, questions: DataFrame, **options) -> DataFrame:
    """(query_id, answer): one line a passage; queries without a passage have no row."""
    lines = passages(context, questions, **options).withColumn("line", cited(F.col("passage"), F.col("index")))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("answer"))


def facts(c: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*[F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), T.strip) for p in FACTS])))


def is_synthesis(sentence: Column) -> Column:
    """A sentence that judges or sums up and states no hard fact."""
    return (F.size(facts(sentence)) == 0) & sentence.rlike("|".join(SYNTHESIS))


def _cites(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[([0-9]{1,2})\]"), F.lit(1)), lambda x: x.cast("int"))


def _ground_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+|[一-鿿]"), F.lit(0))


def verified(answers: DataFrame, fallback: str | None = None, min_cited: float = 0.5, min_grounding: float = 0.6, synthesis_aware: bool = False) -> DataFrame:
    """``answers`` (answer, context: array of structs of index and content) with a report: refused, invalid_citations, cited_sentence_ratio,
    unsupported_facts, unsupported_sentences and status."""
    answer = T.strip(F.coalesce(F.col("answer"), F.lit("")))
    df = answers.withColumn("__a", answer).withColumn("__body", T.strip(F.regexp_replace("__a", r"(?s)参考资料[:：]?[ \t]*(?:\n.*|$)", "")))
    refused = (F.col("__a") == "") | F.col("__a").rlike(REFUSAL)
    if fallback:
        refused = refused | (F.col("__a") == fallback.strip())
    df = df.withColumn("refused", refused).withColumn("__valid", F.transform("context", lambda x: x["index"])).withColumn("__s", T.check_sentences(F.col("__body")))
    df = df.withColumn("invalid_citations", F.array_sort(F.array_except(F.array_distinct(_cites(F.col("__body"))), F.col("__valid"))))
    has = lambda s: s.rlike(r"\[[0-9]{1,2}\]")
    share = lambda some: F.when(F.size(some) > 0, F.size(F.filter(some, has)) / F.size(some)).otherwise(0.0)
    df = df.withColumn("cited_sentence_ratio", share(F.col("__s")))
    df = df.withColumn("__all", T.without_space(F.array_join(F.transform("context", lambda x: F.coalesce(x["content"], F.lit(""))), ""))).withColumn("__facts", facts(F.col("__body")))
    df = df.withColumn("unsupported_facts", F.filter("__facts", lambda f: ~F.contains(F.col("__all"), T.without_space(f))))
    df = df.withColumn("__tokens", F.transform("context", lambda x: F.struct(x["index"].alias("index"), F.array_distinct(_ground_tokens(T.without_space(x["content"]))).alias("t"))))

    def ungrounded(s: Column) -> Column:
        own = _ground_tokens(F.regexp_replace(s, r"\[[0-9]{1,2}(?:\s*[,，]\s*[0-9]{1,2})*\]", ""))
        said = F.array_distinct(_cites(s))
        ref = F.array_distinct(F.flatten(F.transform(F.filter("__tokens", lambda x: F.array_contains(said, x["index"])), lambda x: x["t"])))
        low = T.let(ref, lambda r: (F.size(r) > 0) & (F.size(F.filter(own, lambda t: F.array_contains(r, t))) / F.size(own) < min_grounding))
        checked = (F.size(said) > 0) & (F.size(F.array_except(said, F.col("__valid"))) == 0) & (F.size(own) > 0)
        return checked & ~is_synthesis(s) & low if synthesis_aware else checked & low

    df = df.withColumn("unsupported_sentences", F.transform(F.filter("__s", ungrounded), lambda s: F.substring(s, 1, 80)))
    coverage = F.col("cited_sentence_ratio")
    if synthesis_aware:
        stated = F.filter("__s", lambda s: F.size(facts(s)) > 0)
        coverage = F.when(F.size(stated) > 0, share(stated)).otherwise(1.0)
    bad = (F.size("invalid_citations") > 0) | (F.size("unsupported_facts") >= 3) | (F.size("unsupported_sentences") >= 2)
    part = (F.size("unsupported_facts") > 0) | (F.size("unsupported_sentences") > 0) | (coverage < min_cited)
    df = df.withColumn("status", F.when(F.col("refused"), "refused").when(bad, "unverified").when(part, "partial").otherwise("verified"))
    blank = lambda name, kind: F.when(F.col("refused"), F.array().cast(kind)).otherwise(F.col(name))
    df = df.withColumns({"invalid_citations": blank("invalid_citations", "array<int>"), "unsupported_facts": blank("unsupported_facts", "array<string>"), "unsupported_sentences": blank("unsupported_sentences", "array<string>"), "cited_sentence_ratio": F.when(F.col("refused"), 0.0).otherwise(F.col("cited_sentence_ratio"))})
    return df.drop("__a", "__body", "__valid", "__s", "__all", "__facts", "__tokens")


def blended(status: Column, grounded: Column, probability: Column, quality: Column, hard_defect: Column) -> Column:
    """A status by rules made one step worse or better by a model's judgement: worse easily, better only from partial with all signs good."""
    worse = (F.coalesce(~grounded, F.lit(False)) & (probability >= 0.6)) | (quality < 0.3)
    down = F.when(status == "verified", "partial").otherwise("unverified")
    up = (status == "partial") & ~hard_defect & F.coalesce(grounded, F.lit(False)) & (probability >= 0.7) & (quality >= 0.7)
    return F.when(status == "refused", status).when(worse, down).when(up, "verified").otherwise(status)


def visible_context(answer: Column, context: Column, refused: Column) -> Column:
    """The chunks that an answer cites; none where it refuses."""
    cited_here = F.array_distinct(_cites(answer))
    return F.filter(context, lambda x: ~refused & F.array_contains(cited_here, x["index"]))


def built_context(hits: DataFrame, characters: int) -> DataFrame:
    """The context of each query from hits (query_id, position, source, title, text, allowed): title with its place where one source gives three chunks or more,
    the leading 【…】 off where there is one source, text cut to its budget with …, and index from 1 without gaps."""
    w = W.partitionBy("query_id")
    h = hits.withColumn("__n", F.count("*").over(w)).withColumn("__one", F.min("source").over(w) == F.max("source").over(w))
    short = F.when(F.length("title") <= 12, F.col("title")).otherwise(T.let(T.strip(F.substring_index(F.substring_index("title", "-", -1), "_", -1)), lambda t: F.when(F.length(t).between(1, 20), t).otherwise(F.substring("title", 1, 12))))
    title = F.when(F.col("__one") & (F.col("__n") >= 3), F.concat(short, F.lit("｜第"), (F.col("position") + 1).cast("string"), F.lit("/"), F.col("__n").cast("string"), F.lit("段"))).otherwise(F.col("title"))
    text = F.when(F.col("__one"), F.regexp_replace("text", r"^【[^】]{0,119}】\s*", "")).otherwise(F.col("text"))
    content = F.when(F.length(text) > F.col("allowed"), F.concat(F.expr("substring(__t, 1, cast(greatest(0, allowed - 1) as int))"), F.lit("…"))).otherwise(F.col("__t"))
    h = h.where("allowed > 0").withColumn("__t", text).withColumn("title", title).withColumn("content", content)
    return h.withColumn("index", F.row_number().over(w.orderBy("position"))).drop("__n", "__one", "__t")
