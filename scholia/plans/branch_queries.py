"""Queries whose rows reach every branch of a rule: refusals, citations that are wrong or missing, invented facts, all kinds of question, dates against the day of each event."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import queries as Q
from scholia.operators import answers as A
from scholia.sources.tables import table

from .registry import Registry
from .retrieval_queries import ANSWERS, _answers

R = Registry()

INVENTED = "\n".join(f"- 共计{n}元 [1]。" for n in (98765, 98764, 98763))


@R.add(f"""WITH {ANSWERS}, tk AS (SELECT kp.query_id, k, kp.idx, regexp_extract_all(p, '[A-Za-z0-9]+|[一-鿿]') AS own, list_distinct(regexp_extract_all(regexp_replace(content, '\\s+', '', 'g'), '[A-Za-z0-9]+|[一-鿿]')) AS ref FROM kp JOIN cx ON cx.query_id = kp.query_id AND cx.idx = kp.idx),
lo AS (SELECT query_id, idx, len(own) > 0 AND len(ref) > 0 AND len(list_filter(own, lambda x: list_contains(ref, x))) / len(own) < 0.6 AS low FROM tk),
gr AS (SELECT query_id, query_id % 6 AS v, count(*) FILTER (WHERE low) AS bad, count(*) FILTER (WHERE low AND idx <> 1) AS bad_else, max((idx = 1)::INT) AS cites_first FROM lo GROUP BY query_id),
rp AS (SELECT query_id, v IN (1, 5) AS refused, CASE WHEN v IN (1, 3, 5) THEN 0.0 ELSE 1.0 END AS ratio, CASE WHEN v = 2 THEN cites_first ELSE 0 END AS invalid, CASE WHEN v = 4 THEN 6 ELSE 0 END AS facts, CASE WHEN v = 2 THEN bad_else WHEN v = 4 THEN bad + 3 WHEN v = 0 THEN bad ELSE 0 END AS low FROM gr)
SELECT query_id, refused, ratio::DOUBLE AS cited_sentence_ratio, invalid AS n_invalid, facts AS n_facts, low AS n_ungrounded,
 CASE WHEN refused THEN 'refused' WHEN invalid > 0 OR facts >= 3 OR low >= 2 THEN 'unverified' WHEN facts > 0 OR low > 0 OR ratio < 0.5 THEN 'partial' ELSE 'verified' END AS status FROM rp""")
def answer_checks(spark, sf_dir):
    """Answers as they are, with a refusal in front, with a citation of nothing, without citations, with three invented amounts, and none at all."""
    v, a = F.col("query_id") % 6, F.col("answer")
    changed = (
        F.when(v == 0, a).when(v == 1, F.concat(F.lit("资料无法确定。\n"), a)).when(v == 2, F.replace(a, F.lit("[1]"), F.lit("[9]"))).when(v == 3, F.regexp_replace(a, r" \[\d\]", ""))
        .when(v == 4, F.concat(a, F.lit("\n" + INVENTED))).otherwise("")
    )
    out = A.verified(_answers(spark, sf_dir).withColumn("answer", changed))
    size = lambda c: F.size(c).cast("long")
    return out.select("query_id", "refused", F.round("cited_sentence_ratio", 6).alias("cited_sentence_ratio"), F.size("invalid_citations").alias("n_invalid"), F.size("unsupported_facts").alias("n_facts"), size("unsupported_sentences").alias("n_ungrounded"), "status")


PHRASES = ("再见！", "谢谢", "你好。", "你是谁？", "如果知识库没有相关内容，你会怎么回答", "今天是星期几？", "明天的天气怎么样", "帮我写一首诗", "这篇论文有多少篇参考文献", "这篇论文中写了什么故事", "", "晚安~ ")
_Q = lambda s: s.replace("'", "''")


@R.add(f"""WITH q AS (SELECT conv_id, turn, list_extract([{", ".join(f"'{p}'" for p in PHRASES)}], CAST((conv_id + turn) % {len(PHRASES)} + 1 AS INTEGER)) AS p, role, text FROM conversations),
t AS (SELECT *, regexp_replace(CASE WHEN conv_id % 3 = 0 THEN p || ' ' || text ELSE p END, '^\\s+|\\s+$', '', 'g') AS q FROM q), k AS (SELECT conv_id, turn, q, NOT regexp_matches(q, '{_Q(Q.DOCUMENT)}') AS free FROM t),
n AS (SELECT *, CASE WHEN q = '' THEN NULL WHEN regexp_matches(q, '{_Q(Q.FAREWELL)}') THEN 'farewell' WHEN regexp_matches(q, '{_Q(Q.THANKS)}') THEN 'thanks' WHEN regexp_matches(q, '{_Q(Q.GREETING)}') THEN 'greeting' WHEN regexp_matches(q, '{_Q(Q.IDENTITY)}') THEN 'identity'
 WHEN free AND regexp_matches(q, '{_Q(Q.BOUNDARY)}') THEN 'capability' WHEN free AND regexp_matches(q, '{_Q(Q.DATETIME)}') THEN 'datetime' WHEN free AND regexp_matches(q, '{_Q(Q.LIVE)}') THEN 'live_info' WHEN free AND regexp_matches(q, '{_Q(Q.GENERATION)}') THEN 'general_generation' END AS kind FROM k)
SELECT conv_id, turn, CASE WHEN kind IS NOT NULL THEN 'chitchat' WHEN regexp_matches(q, '{_Q(Q.COUNTING)}') THEN 'aggregate' ELSE 'fact' END AS intent, kind FROM n""")
def question_kinds(spark, sf_dir):
    """Turns as questions of each kind, alone and with the turn's own text behind; the SQL decides by the patterns itself."""
    n = (F.col("conv_id") + F.col("turn")) % len(PHRASES)
    p = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), (n + 1).cast("int"))
    q = F.when(F.col("conv_id") % 3 == 0, F.concat(p, F.lit(" "), F.col("text"))).otherwise(p)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.intent(q).alias("i")).select("conv_id", "turn", "i.intent", "i.kind")


WORDS = ("前年", "明年", "上个月", "下月", "昨天", "后天", "上周三", "下周日", "周一")


@R.add(f"""WITH d AS (SELECT event_id, CAST(ts AS DATE) AS d, event_id % {len(WORDS)} AS v, CAST(date_trunc('week', ts) AS DATE) AS m FROM events),
x AS (SELECT event_id, v, CAST(CASE v WHEN 0 THEN d - INTERVAL 2 YEAR WHEN 1 THEN d + INTERVAL 1 YEAR WHEN 2 THEN d - INTERVAL 1 MONTH WHEN 3 THEN d + INTERVAL 1 MONTH WHEN 4 THEN d - INTERVAL 1 DAY WHEN 5 THEN d + INTERVAL 2 DAY WHEN 6 THEN m - INTERVAL 5 DAY WHEN 7 THEN m + INTERVAL 13 DAY ELSE m END AS DATE) AS x FROM d)
SELECT event_id, year(x) || '年' || CASE WHEN v > 1 THEN month(x) || '月' ELSE '' END || CASE WHEN v > 3 THEN day(x) || '日' ELSE '' END || '的情况' AS text FROM x""")
def relative_dates(spark, sf_dir):
    """A relative date a row, against the day of the event."""
    word = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("event_id") % len(WORDS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", Q.concrete_dates(F.concat(word, F.lit("的情况")), F.to_date("ts")).alias("text"))
