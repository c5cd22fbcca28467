"""Citations, prompts, model output, addresses, secrets, positions and outlines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions import records as X
from scholia.operators import retrieval as S
from scholia.sources.tables import table

from .registry import Registry

R = Registry()


@R.add("SELECT doc_id, '[' || (doc_id % 9 + 1) || '] Doc ' || doc_id || '（来源：' || source || '，第 ' || (doc_id % 5) || CASE WHEN lang = 'en' THEN ' 页' ELSE ' 节' END || '）' AS cite FROM documents")
def citation_lines(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", X.citation(d % 9 + 1, F.concat(F.lit("Doc "), d.cast("string")), F.col("source"), d % 5, F.when(F.col("lang") == "en", ".PDF").otherwise(".md")).alias("cite"))


@R.add("""WITH m AS (SELECT conv_id, string_agg('- turn ' || turn || '：' || role, chr(10) ORDER BY turn) AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 10 GROUP BY conv_id)
SELECT conv_id, '你好 u' || conv_id || '，{unknown}' || chr(10) || '【用户长期记忆】' || chr(10) || b AS prompt FROM m""")
def prompt_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    memories = F.transform("m", lambda x: F.struct(F.concat(F.lit("turn "), x["turn"].cast("string")).alias("key"), x["role"].alias("value")))
    return c.select("conv_id", X.rendered(F.lit("你好 {user_name}，{unknown}\n{memory}"), {"user_name": F.concat(F.lit("u"), F.col("conv_id").cast("string")), "memory": X.memory_block(memories)}).alias("prompt"))


@R.add("SELECT source, CASE WHEN count(*) % 2 = 0 THEN '根据知识库检索结果，「' || source || '」部分为编号条目列表，共 ' || count(*) || ' 条。 [1]' END AS answer FROM documents GROUP BY source")
def structured_count(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return g.select("source", X.count_answer(F.col("n") % 2 == 0, F.col("n"), F.concat(F.lit("手册 > "), F.col("source"), F.lit("｜编号"))).alias("answer"))


@R.add("SELECT event_id, event_type AS name, user_id AS n FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, NULL, -1 FROM events WHERE event_id % 3 = 2")
def json_salvage(spark, sf_dir):
    """Clean objects, fenced ones with prose and a comma too many, and garbage."""
    body = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "n": '), F.col("user_id").cast("string"))
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(body, F.lit("}"))).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit(",}\n```\nDone."))).otherwise("no object here")
    return table(spark, sf_dir, "events").select("event_id", X.salvaged(raw, "name string, n bigint").alias("j")).select("event_id", "j.name", F.coalesce("j.n", F.lit(-1)).alias("n"))


@R.add("""SELECT event_id, 'need ' || event_type AS thought, CASE WHEN event_id % 2 = 0 THEN event_type END AS action, CASE WHEN event_id % 2 = 0 THEN '{"user": ' || user_id || '}' END AS action_input, CASE WHEN event_id % 2 = 1 THEN 'done ' || event_type END AS final_answer FROM events""")
def agent_steps(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    act = F.concat(F.lit("Action: "), F.col("event_type"), F.lit(".\nAction Input: {\"user\": "), F.col("user_id").cast("string"), F.lit(",}\n"))
    raw = F.concat(F.lit("Thought: need "), F.col("event_type"), F.lit("\n"), F.when(even, act).otherwise(F.concat(F.lit("Action: None\nFinal Answer: done "), F.col("event_type"))))
    return table(spark, sf_dir, "events").select("event_id", X.react_step(raw).alias("s")).select("event_id", "s.*")


@R.add("SELECT event_id, '[REDACTED]' AS token, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN repeat('x', 50) || '...[TRUNCATED]' ELSE 'short' END AS body FROM events")
def masked_logs(spark, sf_dir):
    body = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("x"), 150)).otherwise("short")
    m = X.masked(F.create_map(F.lit("Token"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("body"), body))
    get = lambda k: F.element_at("m", F.lit(k)).alias(k.lower())
    return table(spark, sf_dir, "events").select("event_id", m.alias("m")).select("event_id", get("Token"), get("kind"), get("body"))


@R.add("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '203.0.113.' || (user_id % 200) WHEN 1 THEN '198.51.100.7' WHEN 2 THEN '8.8.8.' || (user_id % 200) ELSE 'unknown' END AS ip FROM events")
def client_addresses(spark, sf_dir):
    k, last = F.col("event_id") % 4, (F.col("user_id") % 200).cast("string")
    direct = F.when(k == 0, F.concat(F.lit("10.1.2."), last)).when(k == 1, "192.168.0.9").when(k == 2, F.concat(F.lit("8.8.8."), last))
    forwarded = F.when(k == 0, F.concat(F.lit("203.0.113."), last, F.lit(", 10.0.0.1"))).when(k == 2, "1.2.3.4")
    return table(spark, sf_dir, "events").select("event_id", X.client_ip(direct, forwarded, F.when(k == 1, " 198.51.100.7 "), ["10.0.0.0/8", "192.168.0.0/16"]).alias("ip"))


@R.add(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS s, regexp_replace(substring(text, 101, 300), '\s+', '', 'g') AS b FROM documents)
SELECT doc_id, CAST(CASE WHEN length(b) >= 8 AND instr(s, b[1:48]) > 0 THEN instr(s, b[1:48]) - 1 ELSE -1 END AS INTEGER) AS position FROM t""")
def chunk_positions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(X.located(F.substring("text", 101, 300), F.col("text")), F.lit(-1)).alias("position"))


@R.add("""WITH t AS (SELECT o_custkey AS doc, o_orderkey AS page, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
m AS (SELECT *, CAST(left(o_orderpriority, 1) AS INTEGER) AS level FROM t WHERE n % 2 = 1),
h AS (SELECT p.doc, p.page, max(m.n) AS n FROM t p JOIN m ON m.doc = p.doc AND m.n <= p.n GROUP BY ALL),
a AS (SELECT h.doc, h.page, m.n, m.level, m.page AS title FROM h JOIN m ON m.doc = h.doc AND m.n <= h.n)
SELECT doc, page, string_agg(CAST(title AS VARCHAR), ' > ' ORDER BY n) AS path FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.doc = x.doc AND y.page = x.page AND y.n > x.n AND y.level <= x.level) GROUP BY doc, page""")
def outline_paths(spark, sf_dir):
    """Orders as pages of their customer; every other one is a heading, its priority the level."""
    n = F.row_number().over(W.partitionBy("doc").orderBy("page"))
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), "o_orderpriority").withColumn("seq", n)
    marks = t.where("seq % 2 = 1").select("doc", "page", "seq", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.col("page").cast("string").alias("title"))
    return X.outline_paths(t.select("doc", "page"), marks).select("doc", "page", F.array_join("path", " > ").alias("path"))


@R.add("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, max(score) AS best FROM s WHERE query_id <> id GROUP BY query_id) SELECT query_id, CASE WHEN best < 0.45 THEN 'weak' ELSE 'strong' END AS hint FROM r""")
def relevance_hint(spark, sf_dir):
    """Whether a query's best hit but itself is weak."""
    e = table(spark, sf_dir, "embeddings")
    hits = S.vector_topk(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 2, "vec_id").where("query_id <> id")
    return hits.groupBy("query_id").agg(F.when(F.max("score") < 0.45, "weak").otherwise("strong").alias("hint"))
