"""Listings, searches and rollups of the application tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions import text as T
from scholia.operators import answers as A
from scholia.operators import evaluation as V
from scholia.operators import store as S
from scholia.sources.tables import table

from . import retrieval_queries as Q
from .registry import Registry

R = Registry()


@R.add("""WITH q AS (SELECT text, min(conv_id * 1000 + turn) AS first FROM conversations WHERE role = 'user' GROUP BY text)
SELECT first, md5(text) AS question FROM q WHERE text NOT IN (SELECT text FROM benchmark)""")
def question_dedup(spark, sf_dir):
    """The first of each question, but for those of the evaluation set."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("first"), F.md5("text").alias("question"))
    known = table(spark, sf_dir, "benchmark").select(F.md5("text").alias("question"))
    return q.groupBy("question").agg(F.min("first").alias("first")).join(known, "question", "left_anti").select("first", "question")


@R.add("SELECT count(*) AS documents, sum((n_chars + 399) // 400)::BIGINT AS chunks, count(DISTINCT source) AS sources FROM documents")
def listing_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.sum(F.floor((F.col("n_chars") + 399) / 400)).cast("long").alias("chunks"), F.count_distinct("source").alias("sources"))


@R.add("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def question_search(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("the"))).select("conv_id", "turn")


@R.add("""WITH f AS (SELECT doc_id, quality, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 97 END AS seen FROM labels)
SELECT doc_id, row_number() OVER (ORDER BY seen DESC NULLS LAST, doc_id) AS place FROM f WHERE quality = 0 ORDER BY place LIMIT 50""")
def feedback_listing(spark, sf_dir):
    """The last fifty bad ratings, those without a time at the end."""
    f = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 97).alias("at"))
    top = f.orderBy(F.desc_nulls_last("at"), "doc_id").limit(50)
    return top.select("doc_id", F.row_number().over(W.orderBy(F.desc_nulls_last("at"), "doc_id")).cast("long").alias("place"))


@R.add("SELECT c_custkey, coalesce('kb' || CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END, 'default') AS kb FROM customer")
def default_knowledge_base(spark, sf_dir):
    """Records without a base go to the default one."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.coalesce(F.concat(F.lit("kb"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).cast("string")), F.lit("default")).alias("kb"))


@R.add("SELECT CAST(c_custkey AS VARCHAR) AS source FROM customer WHERE c_custkey % 5 <> 0 UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders")
def ledger_register(spark, sf_dir):
    """Sources that have rows but no record get one."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("source"))
    return S.registered(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source")).distinct(), "source")


@R.add("SELECT user_id, count(*) AS calls, round(count(*) FILTER (WHERE value >= 50) / count(*), 6) AS failure_rate, round(sum(value), 4) AS spent FROM events GROUP BY user_id")
def usage_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.try_divide(F.count_if(F.col("value") >= 50), F.count("*")), 6).alias("failure_rate"), F.round(F.sum("value"), 4).alias("spent"))


@R.add(r"""WITH t AS (SELECT doc_id, replace(text, '.', '。') AS c FROM documents), s AS (SELECT doc_id, c, list_filter(list_transform(regexp_split_to_array(c, '[。！？!?；;\n]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM t)
SELECT doc_id, round(len(list_filter(s, lambda x: contains(upper(c[1:1000]), upper(x[1:12])))) / len(s), 6) AS faithfulness FROM s WHERE len(s) > 0 AND trim(c[1:1000], ' ' || chr(10)) <> ''""")
def answer_faithfulness(spark, sf_dir):
    """Each text as an answer, its first thousand characters as the context."""
    t = F.replace("text", F.lit("."), F.lit("。"))
    share = F.round(V.faithfulness(t, F.substring(t, 1, 1000), T.upper), 6)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_compact(F.array(share))).alias("faithfulness"))  # a filter would work it out twice


@R.add("""SELECT doc_id, CASE WHEN st = 'refused' THEN 'refused' WHEN quality = 0 THEN CASE st WHEN 'verified' THEN 'partial' ELSE 'unverified' END WHEN st = 'partial' AND toxic = 0 THEN 'verified' ELSE st END AS status
FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'refused' WHEN 1 THEN 'partial' WHEN 2 THEN 'verified' ELSE 'unverified' END AS st FROM labels)""")
def status_blend(spark, sf_dir):
    """Statuses made better or worse by labels as a model's judgement."""
    d = F.col("doc_id") % 4
    st = F.when(d == 0, "refused").when(d == 1, "partial").when(d == 2, "verified").otherwise("unverified")
    good = F.col("quality") == 1
    return table(spark, sf_dir, "labels").select("doc_id", A.blended(st, good, F.lit(0.9), F.col("quality").cast("double"), F.col("toxic") == 1).alias("status"))


@R.add(f"WITH {Q.BM25}, h AS (SELECT query_id, id, rank, length(text) AS s FROM kw JOIN documents ON doc_id = id WHERE rank < 8) SELECT query_id, count(*) AS blocks, sum(s)::BIGINT AS chars, count(*) FILTER (WHERE s > 500) AS long_blocks FROM h GROUP BY query_id")
def context_probe(spark, sf_dir):
    hits = Q.keyword_hits(spark, sf_dir, 8).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("s")), "id")
    return hits.groupBy("query_id").agg(F.count("*").alias("blocks"), F.sum("s").cast("long").alias("chars"), F.count_if(F.col("s") > 500).alias("long_blocks"))


@R.add("SELECT conv_id, turn, text[1:500] AS excerpt, length(text) > 500 AS cut FROM conversations")
def result_excerpts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.preview(F.col("text"), 500).alias("excerpt"), (F.length("text") > 500).alias("cut"))
