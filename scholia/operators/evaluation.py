"""Measures of retrieval and answers, per query and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import text as T


def per_query(hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hit, ndcg, mrr) of hits (query_id, rank from 0, relevant). The ideal order is that of the retrieved hits; without a relevant hit all are 0."""
    rel = F.col("relevant").cast("int")
    g = hits.groupBy("query_id").agg(F.max(rel).alias("hit"), F.sum(F.when(F.col("relevant") & (F.col("rank") < k), 1 / F.log2(F.col("rank") + 2)).otherwise(0.0)).alias("dcg"), F.least(F.lit(k), F.sum(rel)).cast("int").alias("n"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return g.select("query_id", "hit", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"))


def relevant(source: Column, expected: Column) -> Column:
    """Whether any expected name stands in the source's name."""
    return F.exists(expected, lambda e: F.contains(F.coalesce(source, F.lit("")), e))


def coverage(answer: Column, keywords: Column) -> Column:
    """Share of keywords that stand in the answer; 1 without keywords."""
    return F.when(F.size(keywords) <= 0, 1.0).otherwise(F.size(F.filter(keywords, lambda k: (k != "") & F.contains(answer, k))) / F.size(keywords))


def faithfulness(answer: Column, context: Column, folded=lambda c: c) -> Column:
    """Share of the answer's sentences whose first 12 characters stand in the context; null without sentences or context. ``folded`` makes both comparable after the cut, as folding may change lengths."""
    s = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"[。！？!?；;\n]+"), T.strip), lambda x: x != "")
    share = lambda c, v: F.when(F.size(v) > 0, F.size(F.filter(v, lambda x: F.contains(c, folded(F.substring(x, 1, 12))))) / F.size(v))
    # the context is made and folded once for a text, not for each sentence
    return T.let(context, lambda raw: F.when(F.length(T.strip(raw)) > 0, T.let(folded(raw), lambda c: T.let(s, lambda v: share(c, v)))))


def similarity(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, similarity): cosine of the counts of neighbouring characters of two texts a row. Counts are grouped by pair and text, so that long texts are many rows."""
    grams = lambda c, side: pairs.select(key, F.explode(T.bigram_counts(F.col(c))).alias("g"), F.lit(1).alias(side))
    both = grams(left, "a").unionByName(grams(right, "b"), allowMissingColumns=True).groupBy(key, "g").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    sums = both.groupBy(key).agg(F.sum(F.col("a") * F.col("b")).alias("dot"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    return sums.select(key, F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)).alias("similarity"))


def report(questions: DataFrame, per: DataFrame, answers: DataFrame, keywords: Column) -> DataFrame:
    """One row of measures over all ``questions`` (query_id): retrieval from ``per`` (``per_query``), and of ``answers`` (query_id, answer, context, reference, and what ``keywords`` needs) the coverage of
    keywords, similarity to the reference, faithfulness to the context and the outcome of verification. Means leave out what has no value, as an answer without a reference; a question without hits is a miss."""
    from . import answers as A

    whole = F.array_join(F.transform("context", lambda x: x["content"]), "\n")
    rows = answers.withColumns({"coverage": coverage(F.lower("answer"), keywords), "faithfulness": faithfulness(F.col("answer"), whole)})
    checked = A.verified(rows).select("query_id", "coverage", "faithfulness", "refused", "status", "cited_sentence_ratio", F.size("unsupported_facts").alias("facts"), F.size("invalid_citations").alias("invalid"))
    like = similarity(answers.where("reference is not null"), "query_id", "answer", "reference")
    all_ = questions.select("query_id").join(per, "query_id", "left").join(checked, "query_id", "left").join(like, "query_id", "left")
    mean = lambda c: F.round(F.avg(c), 6)
    answered = F.col("status").isNotNull() & ~F.col("refused")
    return all_.agg(
        F.count("*").alias("samples"), F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("retrieval_hit_rate"), mean("coverage").alias("avg_keyword_coverage"), mean("similarity").alias("avg_answer_similarity"),
        mean("faithfulness").alias("avg_faithfulness"), mean("ndcg").alias("ndcg_at_5"), mean("mrr").alias("mrr"), F.count("status").alias("checked"), mean(F.when(answered, (F.col("status") == "verified").cast("int"))).alias("verified_rate"),
    )
