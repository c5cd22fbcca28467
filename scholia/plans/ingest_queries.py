"""Ingestion, exports, summaries, memory and the whole evaluation report over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import evaluation as V
from scholia.operators import graph as G
from scholia.operators import ingest as I
from scholia.operators import quality as Y
from scholia.sources import jsonl as J
from scholia.sources.tables import table, written, written_path

from . import data_queries, retrieval_queries
from .registry import Registry

R = Registry()


def _lines(df, name, schema):
    """Written as JSON lines to the shared folder and read back."""
    path = written_path(df.limit(0), name) + "-lines"
    J.write_lines(df, path)
    return J.read_lines(df.sparkSession, path, schema)


# ---- JSON lines


@R.add("SELECT text AS question, 'item' || item_id AS source, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)))) AS expected_keywords FROM benchmark".replace("list_sort(", "array_to_string(list_sort(").replace(") AS expected_keywords", "), ',') AS expected_keywords"))
def evaluation_set(spark, sf_dir):
    """The benchmark as an evaluation set, out and in."""
    b = table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("source"), F.array_sort(T.tokens(F.col("text"))).alias("expected_keywords"))
    return _lines(b, "evaluation", J.EVALUATION).select("question", "source", F.array_join("expected_keywords", ",").alias("expected_keywords"))


FEEDBACK = "f AS (SELECT doc_id AS id, 'q' || doc_id AS query, CASE WHEN quality = 1 THEN 'helpful' ELSE 'not_helpful' END AS rating, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'c' || doc_id END AS correction, doc_id % 2 = 0 AS resolved FROM labels)"


def _feedback(spark, sf_dir):
    d = F.col("doc_id")
    text = lambda p: F.concat(F.lit(p), d.cast("string"))
    correction = F.when(d % 3 == 0, F.lit(None)).when(d % 3 == 1, "").otherwise(text("c"))
    return table(spark, sf_dir, "labels").select(d.alias("id"), text("q").alias("query"), F.when(F.col("quality") == 1, "helpful").otherwise("not_helpful").alias("rating"), correction.alias("correction"), (d % 2 == 0).alias("resolved"))


@R.add(f"WITH {FEEDBACK} SELECT query AS question, correction AS reference_answer, 'feedback:' || id AS source, 1 AS round FROM f WHERE rating = 'not_helpful' AND NOT resolved AND coalesce(correction, '') <> ''")
def feedback_export(spark, sf_dir):
    """Exported twice: the second set is empty, as the first resolved its items."""
    first = written_path(_feedback(spark, sf_dir).limit(0), "feedback")
    left = J.export_feedback(_feedback(spark, sf_dir), first + "-1")
    J.export_feedback(left, first + "-2")
    schema = "question string, reference_answer string, source string"
    return J.read_lines(spark, first + "-1", schema).withColumn("round", F.lit(1)).unionByName(J.read_lines(spark, first + "-2", schema).withColumn("round", F.lit(2)))


@R.add(f"WITH {FEEDBACK} SELECT id, '原问题：' || query || CASE WHEN id % 5 = 0 THEN '' ELSE chr(10) || '当时的回答：' || rating END || CASE WHEN coalesce(correction, '') = '' THEN '' ELSE chr(10) || '用户认为应该是：' || correction END AS text FROM f")
def feedback_texts(spark, sf_dir):
    f = _feedback(spark, sf_dir)
    return f.select("id", J.feedback_text(F.col("query"), F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("rating")), F.col("correction")).alias("text"))


@R.add(f"WITH {data_queries.CHUNKS} SELECT md5(source || '|1|' || chunk_index) AS id, source, md5(text) AS text_md5 FROM ch")
def collection_export(spark, sf_dir):
    """A collection of chunks as lines, read back."""
    c = data_queries.chunks(spark, sf_dir).select("id", "source", "text")
    return _lines(c, "collection", "id string, source string, text string").select("id", "source", F.md5("text").alias("text_md5"))


# ---- sections, parents, prefixes

SECTIONS = """se AS (SELECT doc_id, 'doc' || doc_id AS source, i + 1 AS page, substring(text, CAST(i * 3000 + 1 AS BIGINT), 3000) AS content, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN ['Doc ' || doc_id, 'part ' || i] WHEN doc_id % 3 = 1 THEN ['part ' || i] ELSE CAST([] AS VARCHAR[]) END AS path,
 CASE WHEN doc_id % 4 = 0 THEN 'n=' || length(text) ELSE '' END AS note FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 2999) // 3000)) AS i FROM documents)),
cr AS (SELECT *, array_to_string(CASE WHEN len(path) > 0 AND path[1] = title THEN path ELSE list_concat([title], path) END, ' > ') || CASE WHEN note = '' THEN '' ELSE '｜' || note END AS breadcrumb,
 CASE WHEN len(path) > 0 THEN path[-1] ELSE '' END || CASE WHEN note = '' THEN '' ELSE '｜' || note END AS chunk_prefix FROM se),
ck AS (SELECT *, substring(content, CAST(j * 1000 + 1 AS BIGINT), 1000) AS text FROM (SELECT *, unnest(range(0, (length(content) + 999) // 1000)) AS j FROM cr))"""


def _sections(spark, sf_dir):
    d = F.col("doc_id")
    s = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.posexplode(T.fixed_chunks(F.col("text"), 3000)).alias("i", "content"))
    title, part = F.concat(F.lit("Doc "), d.cast("string")), F.concat(F.lit("part "), F.col("i").cast("string"))
    path = F.when(d % 3 == 0, F.array(title, part)).when(d % 3 == 1, F.array(part)).otherwise(F.array().cast("array<string>"))
    return s.select(F.concat(F.lit("doc"), d.cast("string")).alias("source"), (F.col("i") + 1).alias("page"), "content", title.alias("title"), path.alias("path"), F.when(d % 4 == 0, F.concat(F.lit("n="), F.col("n").cast("string"))).otherwise("").alias("note"))


@R.add(f"WITH {SECTIONS} SELECT md5(source || '|' || page || '|' || j) AS id, md5(source || '|' || page)[1:16] AS parent_id, md5(content[1:2000]) AS parent_md5, breadcrumb, chunk_prefix, md5('【' || CASE WHEN chunk_prefix <> '' THEN chunk_prefix ELSE breadcrumb END || '】' || chr(10) || text) AS prefixed_md5, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS bare_md5 FROM ck")
def parent_chunks(spark, sf_dir):
    """Small chunks with their section, and the prefix put on and taken off again."""
    c = I.with_parents(_sections(spark, sf_dir), T.fixed_chunks(F.col("content"), 1000))
    shown = I.prefixed(F.col("text"), F.col("chunk_prefix"), F.col("breadcrumb"))
    return c.select("id", "parent_id", F.md5("parent_text").alias("parent_md5"), "breadcrumb", "chunk_prefix", F.md5(shown).alias("prefixed_md5"), F.md5(I.without_breadcrumb(shown)).alias("bare_md5"))


ENRICHED = """d AS (SELECT doc_id, source AS part, lang, regexp_replace(text, '(^|\\n)#', '\\1 ', 'g') AS t FROM documents WHERE trim(text, ' ' || chr(10)) <> ''),
s AS (SELECT *, 1 AS page, ['Part ' || part] AS path, '# Part ' || part || chr(10) || 'intro' AS content, '' AS note FROM d UNION ALL SELECT *, 2, ['Part ' || part, lang], '## ' || lang || chr(10) || rtrim(t, chr(10)), '' FROM d
 UNION ALL SELECT *, 3, ['Part ' || part, 'List'], '## List' || chr(10) || '[1] a' || chr(10) || '[2] b' || chr(10) || '[3] c' || chr(10) || '[4] d' || chr(10) || '[5] e', '本节为编号条目列表，共5条（[1]-[5]）' FROM d WHERE doc_id % 2 = 0),
e AS (SELECT 'doc' || doc_id || '.md' AS source, doc_id, page, path, content, note, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id ELSE 'Part ' || part END AS title FROM s)"""


def _enriched(spark, sf_dir):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("trim(BOTH ' \\n' FROM text) <> ''")
    lines = F.concat(F.when(d % 3 == 0, F.concat(F.lit("title: Title "), d.cast("string"), F.lit("\n"))).otherwise(""), F.when(d % 4 == 0, "access: hr, it\n").otherwise(""), F.when(d % 5 == 0, "status: 草稿\n").otherwise(""), F.when(d % 7 == 0, "expires_at: 2027/3/5\n").otherwise(""), F.lit("department: d\n"))
    entries = F.when(d % 2 == 0, "\n## List\n[1] a\n[2] b\n[3] c\n[4] d\n[5] e").otherwise("")
    body = F.concat(F.lit("# Part "), "source", F.lit("\nintro\n## "), "lang", F.lit("\n"), F.regexp_replace("text", r"(^|\n)#", "$1 "), entries)
    return I.enriched(docs.select(F.concat(F.lit("doc"), d.cast("string"), F.lit(".md")).alias("source"), F.concat(F.lit("---\n"), lines, F.lit("---\n"), body).alias("raw"), F.lit("2026-01-01 00:00:00").alias("updated_at")))


@R.add(f"""WITH {ENRICHED} SELECT source, page, title, CASE WHEN doc_id % 4 = 0 THEN 'hr,it' ELSE '*' END AS acl, CASE WHEN doc_id % 5 = 0 THEN 'draft' ELSE 'active' END AS doc_status, CASE WHEN doc_id % 7 = 0 THEN '2027-03-05' END AS valid_until, 'd' AS department,
 array_to_string(CASE WHEN path[1] = title THEN path ELSE list_concat([title], path) END, ' > ') || CASE WHEN note = '' THEN '' ELSE '｜' || note END AS breadcrumb, path[-1] || CASE WHEN note = '' THEN '' ELSE '｜' || note END AS chunk_prefix, md5(rtrim(content, chr(10) || ' ')) AS content_md5 FROM e""")
def enriched_sections(spark, sf_dir):
    """Documents as Markdown files with a block of metadata, two headings, and a list of entries in every second one."""
    out = _enriched(spark, sf_dir)
    return out.select("source", "page", "title", "acl", "doc_status", F.col("valid_until").cast("string").alias("valid_until"), "department", "breadcrumb", "chunk_prefix", F.md5(F.rtrim(F.col("content"), F.lit("\n "))).alias("content_md5"))


@R.add(f"""WITH {ENRICHED} SELECT source, page, CASE WHEN page > 1 THEN '请用一句话介绍「' || path[-1] || '」的内容。' ELSE '请用一句话介绍本文的主题。' END AS question, md5(rtrim(split_part(content, chr(10) || chr(10), 1)[1:200], chr(10) || ' ')) AS answer_md5, path[-1] AS keywords FROM e""")
def demo_evaluation_set(spark, sf_dir):
    sections = _enriched(spark, sf_dir).withColumn("title", F.element_at("path", -1))
    q = I.demo_questions(sections)
    return q.select("source", "page", "question", F.md5(F.rtrim(F.col("reference_answer"), F.lit("\n "))).alias("answer_md5"), F.array_join("expected_keywords", ",").alias("keywords"))


@R.add("SELECT user_id AS archive, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events) WHERE place <= 50")
def evaluation_archive(spark, sf_dir):
    """Events as reports of an archive."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("archive"), "event_id", F.col("props").alias("answer"))
    return I.archive_index(e, "archive", "event_id").select("archive", "event_id", F.col("place").cast("long").alias("place"))


@R.add(f"""WITH {data_queries.CHUNKS}, v AS (SELECT DISTINCT 'kb' || (doc_id % 100) AS doc, doc_id // 100 + 1 AS version FROM ch) SELECT doc, string_agg(version, ',' ORDER BY version) AS versions, max(version) AS latest FROM v GROUP BY doc""")
def version_listing(spark, sf_dir):
    c = data_queries.chunks(spark, sf_dir).select(F.concat(F.lit("kb"), (F.col("doc_id") % 100).cast("string")).alias("doc"), (F.floor(F.col("doc_id") / 100) + 1).alias("version"), "text")
    v = I.version_list(I.version_summary(c))
    return v.select("doc", F.array_join(F.transform("versions", lambda x: x.cast("string")), ",").alias("versions"), "latest")


@R.add(f"WITH {retrieval_queries.BM25}, {SECTIONS} SELECT query_id, id, md5('doc' || id || '|1')[1:16] AS parent_id, md5(content[1:2000]) AS parent_md5 FROM kw LEFT JOIN se ON se.doc_id = kw.id AND page = 1 WHERE rank < 5 AND content IS NOT NULL")
def parent_attach(spark, sf_dir):
    """Hits with the first section of their document."""
    hits = retrieval_queries.keyword_hits(spark, sf_dir, 5).select("query_id", "id", F.concat(F.lit("doc"), F.col("id").cast("string")).alias("source"), F.lit(1).alias("page"))
    out = I.attach_parents(hits, _sections(spark, sf_dir)).where("parent_id is not null")
    return out.select("query_id", "id", "parent_id", F.md5("parent_text").alias("parent_md5"))


# ---- groups of a long context

PACKED = f"""{retrieval_queries.BM25}, x AS (SELECT query_id, rank AS position, text AS content, length(text) AS size FROM kw JOIN documents ON doc_id = id),
walked AS (SELECT query_id, position, content, size, CAST(size AS BIGINT) AS used, 1 AS g FROM x WHERE position = 0
 UNION ALL SELECT x.query_id, x.position, x.content, x.size, CASE WHEN r.used > 0 AND r.used + x.size > 6000 THEN x.size ELSE r.used + x.size END, CASE WHEN r.used > 0 AND r.used + x.size > 6000 THEN r.g + 1 ELSE r.g END FROM walked r JOIN x ON x.query_id = r.query_id AND x.position = r.position + 1),
gr AS (SELECT * FROM walked WHERE g <= 4 AND query_id IN (SELECT query_id FROM walked GROUP BY query_id HAVING max(g) > 1))"""


@R.add(f"WITH RECURSIVE {PACKED} SELECT query_id, g AS \"group\", position FROM gr")
def group_packing(spark, sf_dir):
    return I.packed(_packing_context(spark, sf_dir), 6000, 4)


@R.add(f"""WITH RECURSIVE {PACKED}, j AS (SELECT query_id, g, string_agg(content, '' ORDER BY position) AS t FROM gr GROUP BY ALL), n AS (SELECT *, max(g) OVER (PARTITION BY query_id) AS n, regexp_replace(t[1:300], '^\\s+|\\s+$', '', 'g') AS head FROM j)
SELECT query_id, g AS "group", '（第' || g || '/' || n || '部分·原文摘录）' || head || '…' AS text FROM n WHERE head <> ''""")
def group_fallback(spark, sf_dir):
    """Each group by the beginning of its own text, as there is no model to sum it up."""
    c = written(_packing_context(spark, sf_dir), "context")
    return I.group_summaries(c, I.packed(c, 6000, 4))


def _packing_context(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return retrieval_queries.keyword_hits(spark, sf_dir).join(texts, "id").select("query_id", F.col("rank").cast("long").alias("position"), "content")


# ---- memory, graph facts, versions, small measures

MEMORY = "m AS (SELECT user_id, event_type AS key, arg_max(CAST(event_id AS VARCHAR), event_id) AS value, max(event_id) AS ts FROM events GROUP BY ALL)"


def _memory(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit(" "), "event_type").alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("ts"))
    first = I.remembered(e.limit(0), e.where("ts % 2 = 0"))
    return I.remembered(first, e.where("ts % 2 = 1").unionByName(e.withColumn("value", F.lit(" ")).withColumn("ts", F.col("ts") + 1000000000)))


@R.add(f"WITH {MEMORY} SELECT * FROM m")
def memory_upsert(spark, sf_dir):
    """Events as facts of users, in two rounds; blank values are none."""
    return _memory(spark, sf_dir)


@R.add(f"WITH {MEMORY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, key) AS n FROM m WHERE key <> 'error') SELECT user_id, key, value FROM r WHERE n <= 2")
def memory_recall(spark, sf_dir):
    """The last two facts of each user after one kind is forgotten."""
    m = written(_memory(spark, sf_dir), "memory")
    return I.recalled(I.forgotten(m, m.where("key = 'error'")), 2).select("user_id", "key", "value")


@R.add(f"""WITH {data_queries.ENTITIES}, {data_queries.RELATIONS}, q AS (SELECT n_nationkey AS query_id, lower(n_name) AS t FROM nation UNION ALL SELECT 100, 'build' UNION ALL SELECT 101, 'zzzz'),
s AS (SELECT * FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name), name) AS place FROM q JOIN en ON contains(lower(name || chr(10) || description), t)) WHERE place <= 5),
e AS (SELECT source AS name, source || ' -[' || type || ']-> ' || target AS line FROM re UNION ALL SELECT target, source || ' -[' || type || ']-> ' || target FROM re),
l AS (SELECT query_id, line, min(place) AS place FROM s JOIN e USING (name) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, line) AS n FROM l)
SELECT query_id, '知识图谱' AS title, '以下是知识图谱中与问题相关的实体关系（供参考；与文档片段冲突时以文档片段为准）：' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS content FROM t WHERE n <= 10 GROUP BY query_id""")
def graph_augmented_context(spark, sf_dir):
    """Names of nations as questions, one that stands in descriptions, and one that names nothing."""
    e, rel = data_queries.graph(spark, sf_dir)
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("text"))
    q = q.unionByName(spark.createDataFrame([(100, "Build"), (101, "zzzz")], "query_id int, text string"))
    return I.graph_context(q, e, rel)


@R.add("SELECT CAST(o_custkey AS VARCHAR) AS name, o_orderstatus AS key, arg_max(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY ALL")
def entity_attributes(spark, sf_dir):
    """Orders as mentions of their customer, each with one attribute."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("seq"), F.create_map("o_orderstatus", "o_orderpriority").alias("attributes"))
    return G.merged_attributes(o).select("name", F.explode("attributes").alias("key", "value"))


@R.add(f"WITH {data_queries.CHUNKS} SELECT source AS doc, doc_id % 3 + 1 AS version, count(*) AS num_chunks, sum(length(text))::BIGINT AS total_chars FROM ch GROUP BY ALL")
def version_summaries(spark, sf_dir):
    c = data_queries.chunks(spark, sf_dir).select(F.col("source").alias("doc"), (F.col("doc_id") % 3 + 1).alias("version"), "text")
    return I.version_summary(c)


@R.add("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS date, strftime(ts + INTERVAL 8 HOUR, '%H:%M:%S') AS time, CAST(isodow(ts + INTERVAL 8 HOUR) AS INTEGER) AS weekday FROM events")
def event_local_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", I.local_time(F.col("ts")).alias("t")).select("event_id", "t.*")


@R.add("SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS failure_rate, round(1 - count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS success_rate FROM events GROUP BY user_id")
def call_rates(spark, sf_dir):
    return I.call_rates(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error")


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE event_type END AS kind, CASE WHEN event_id % 2 = 0 THEN 'x' END AS extra FROM events")
def merged_settings(spark, sf_dir):
    """Properties of events under settings that override some of them."""
    base = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("kind"), F.col("event_type")))
    over = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("kind"), F.lit("new"), F.lit("extra"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    m = table(spark, sf_dir, "events").select("event_id", I.merged_maps(base, over).alias("m"))
    return m.select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("k", "kind", "extra")])


@R.add()
def chunk_dedup(spark, sf_dir):
    """All chunks of all documents: equal ones by class, near ones in the order of ids."""
    c = data_queries.chunks(spark, sf_dir).select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("id"), "text")
    return Y.kept_chunks(c, "id", "text", 0.9)


# ---- the whole evaluation


@R.add(f"""WITH {retrieval_queries.ANSWERS}, an AS (SELECT query_id, string_agg({retrieval_queries.LINE}, chr(10) ORDER BY k) AS answer FROM kp GROUP BY query_id),
rs AS (SELECT query_id, rank, contains(d.source, w.source) AS rel FROM kw JOIN documents d ON d.doc_id = kw.id JOIN documents w ON w.doc_id = kw.query_id WHERE rank < 5),
pq AS (SELECT query_id, max(rel::INT) AS hit, sum(CASE WHEN rel THEN 1 / log2(rank + 2) ELSE 0 END) AS dcg, sum(rel::INT) AS nrel, min(CASE WHEN rel THEN rank END) AS first FROM rs GROUP BY query_id),
me AS (SELECT *, CASE WHEN nrel = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, CAST(least(5, nrel) AS BIGINT) + 1), lambda x: 1 / log2(x + 1))) END AS ndcg, coalesce(1.0 / (first + 1), 0) AS rr FROM pq),
cv AS (SELECT query_id, len(list_filter(w, lambda x: contains(lower(answer), x))) / len(w) AS coverage FROM (SELECT query_id, answer, {retrieval_queries.WORDS} AS w FROM an JOIN benchmark ON item_id = query_id)),
pr AS (SELECT query_id, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS a, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM an JOIN documents ON doc_id = query_id),
ga AS (SELECT query_id, g, count(*) AS n FROM (SELECT query_id, unnest(list_transform(range(1, length(a)), lambda i: substring(a, i, 2))) AS g FROM pr) GROUP BY ALL),
gb AS (SELECT query_id, g, count(*) AS n FROM (SELECT query_id, unnest(list_transform(range(1, length(b)), lambda i: substring(b, i, 2))) AS g FROM pr) GROUP BY ALL),
na AS (SELECT query_id, sqrt(sum(n * n)) AS s FROM ga GROUP BY query_id), nb AS (SELECT query_id, sqrt(sum(n * n)) AS s FROM gb GROUP BY query_id),
dt AS (SELECT query_id, sum(ga.n * gb.n) AS s FROM ga JOIN gb USING (query_id, g) GROUP BY query_id),
si AS (SELECT na.query_id, coalesce(dt.s, 0) / (na.s * nb.s) AS similarity FROM na JOIN nb USING (query_id) LEFT JOIN dt USING (query_id)),
cc AS (SELECT query_id, string_agg(content, chr(10) ORDER BY idx) AS c FROM cx GROUP BY query_id),
fa AS (SELECT query_id, len(list_filter(s, lambda x: contains(c, x[1:12]))) / len(s) AS faithfulness FROM (SELECT query_id, c, list_filter(list_transform(regexp_split_to_array(answer, '[。！？!?；;\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM an JOIN cc USING (query_id)) WHERE len(s) > 0),
tk AS (SELECT kp.query_id, k, regexp_extract_all(p, '[A-Za-z0-9]+|[一-鿿]') AS own, list_distinct(regexp_extract_all(regexp_replace(content, '\\s+', '', 'g'), '[A-Za-z0-9]+|[一-鿿]')) AS ref FROM kp JOIN cx ON cx.query_id = kp.query_id AND cx.idx = kp.idx),
ve AS (SELECT query_id, count(*) FILTER (WHERE len(own) > 0 AND len(ref) > 0 AND len(list_filter(own, lambda x: list_contains(ref, x))) / len(own) < 0.6) AS bad FROM tk GROUP BY query_id)
SELECT (SELECT count(*) FROM benchmark) AS samples, (SELECT round(sum(hit) / (SELECT count(*) FROM benchmark), 6) FROM me) AS retrieval_hit_rate, (SELECT round(avg(coverage), 6) FROM cv) AS avg_keyword_coverage, (SELECT round(avg(similarity), 6) FROM si) AS avg_answer_similarity,
 (SELECT round(avg(faithfulness), 6) FROM fa) AS avg_faithfulness, (SELECT round(avg(ndcg), 6) FROM me) AS ndcg_at_5, (SELECT round(avg(rr), 6) FROM me) AS mrr, (SELECT count(*) FROM ve) AS checked, (SELECT round(avg((bad = 0)::INT), 6) FROM ve) AS verified_rate""")
def evaluation_report(spark, sf_dir):
    """Questions answered from five documents: retrieval, coverage, similarity to the document of the question's number, faithfulness and verification in one report."""
    from scholia.operators import answers as A

    hits = retrieval_queries.keyword_hits(spark, sf_dir, 5)
    docs = table(spark, sf_dir, "documents")
    sources = docs.select("doc_id", "source")
    context = written(hits.join(docs.select(F.col("doc_id").alias("id"), F.replace("text", F.lit("."), F.lit("。")).alias("content")), "id").select("query_id", (F.col("rank") + 1).alias("index"), "content"), "context")
    q = retrieval_queries.questions(spark, sf_dir)
    grouped = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "content"))).alias("context"))
    answers = written(A.extractive_answers(context, q).join(grouped, "query_id").join(q, "query_id").join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("reference")), "query_id", "left"), "answers")
    rel = hits.join(sources.select(F.col("doc_id").alias("id"), F.col("source").alias("got")), "id").join(sources.select(F.col("doc_id").alias("query_id"), F.col("source").alias("want")), "query_id")
    per = V.per_query(rel.select("query_id", "rank", V.relevant(F.col("got"), F.array("want")).alias("relevant")), 5)
    return V.report(q, per, answers, keywords=T.tokens(F.col("question")))
