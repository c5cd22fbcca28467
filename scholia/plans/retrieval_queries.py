"""Retrieval, context, answers and their evaluation. Questions are the items of ``benchmark``; a document is a chunk of its source."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import answers as A
from scholia.operators import keyword_store as K
from scholia.operators import predicates as P
from scholia.operators import retrieval as S
from scholia.operators.ranks import numbered
from scholia.sources.tables import shared_folder, table, version, written

from .registry import Registry

R = Registry()

WORDS = "list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)))"
BM25 = f"""
posts AS (SELECT doc_id AS id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {WORDS} AS t FROM documents)),
stats AS (SELECT count(*) AS n, avg(len({WORDS})) AS avgdl FROM documents),
qt AS (SELECT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
bm AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM qt JOIN df USING (term) JOIN posts USING (term), stats GROUP BY query_id, id),
kw AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm) WHERE rank < 20)"""
VECTOR = """
qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
sim AS (SELECT query_id, vec_id AS id, round(list_dot_product(q, embedding::DOUBLE[]) / sqrt(list_dot_product(q, q) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 12) AS score FROM qv, embeddings),
vec AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sim) WHERE rank < 20)"""
FUSED = """
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, id) - 1 AS fusion_rank FROM (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, coalesce(1.0 / (60 + v.rank + 1), 0.0) + coalesce(0.5 / (60 + k.rank + 1), 0.0) AS fusion_score,
    coalesce(v.score, k.score / (1 + k.score)) AS score, CASE WHEN v.id IS NULL THEN 'keyword' ELSE 'vector' END AS kind FROM vec v FULL JOIN kw k ON v.query_id = k.query_id AND v.id = k.id)) WHERE fusion_rank < 10)"""
CONTEXT = """
cx AS (SELECT query_id, id, CAST(rank + 1 AS INTEGER) AS idx, replace(text, '.', '。') AS content FROM kw JOIN documents ON doc_id = id WHERE rank < 5)"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _query_terms(spark, sf_dir):
    return questions(spark, sf_dir).select("query_id", F.explode(T.tokens(F.col("question"))).alias("term"))


def saved_index(spark, sf_dir):
    """The saved keyword index of a folder's documents, built where there is none of these files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = version(docs)
    return K.ensured(docs, "doc_id", "text", f"{shared_folder(spark)}/keywords-{hashlib.sha256(f'{sf_dir} {files}'.encode()).hexdigest()[:32]}", files)


def keyword_hits(spark, sf_dir, most=20, allowed=None):
    """The best of each question: a small table, written, as most plans use it more than once."""
    return written(saved_index(spark, sf_dir).search(_query_terms(spark, sf_dir), most, allowed), "hits")


def vector_hits(spark, sf_dir, most=20):
    e = table(spark, sf_dir, "embeddings")
    q = questions(spark, sf_dir).join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    return S.vector_topk(e, q, most, "vec_id")


def fused_hits(spark, sf_dir, most=10):
    return S.fused(vector_hits(spark, sf_dir), keyword_hits(spark, sf_dir), most)


@R.add(f"SELECT count(*) AS n_docs, round(avg(len({WORDS})), 6) AS avgdl FROM documents")
def bm25_stats(spark, sf_dir):
    return S.corpus_stats(table(spark, sf_dir, "documents"), "text").select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl"))


@R.add(f"SELECT term, count(*) AS df FROM (SELECT unnest({WORDS}) AS term FROM documents) GROUP BY term")
def bm25_document_frequency(spark, sf_dir):
    return S.document_frequencies(S.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


@R.add(f"WITH {BM25} SELECT query_id, id, rank, round(score, 6) AS score FROM kw")
def bm25_search(spark, sf_dir):
    return keyword_hits(spark, sf_dir).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@R.add("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 10""")
def vector_search(spark, sf_dir):
    """Every twentieth vector as a query against all."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.vector_topk(e, q, 10, "vec_id").select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@R.add("""SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(greatest(0.0, 1 - (1 - e[1])), 6) AS cosine_score, round(1 / (1 + greatest(0.0, 1 - e[1])), 6) AS l2_score, round(1 - e[1], 6) AS ip_score,
round(e[1] / sqrt(list_dot_product(e, e)), 6) AS unit_first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def vector_scores(spark, sf_dir):
    d = 1 - F.col("embedding")[0].cast("double")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), *[F.round(S.similarity(d, k), 6).alias(f"{k}_score") for k in ("cosine", "l2", "ip")], F.round(S.unit(F.col("embedding"))[0], 6).alias("unit_first"))


@R.add(f"WITH {BM25}, {VECTOR}, {FUSED} SELECT query_id, id, fusion_rank, round(fusion_score, 9) AS fusion_score, round(score, 6) AS score, kind FROM fu")
def hybrid_search(spark, sf_dir):
    return fused_hits(spark, sf_dir).select("query_id", "id", F.col("fusion_rank").cast("long").alias("fusion_rank"), F.round("fusion_score", 9).alias("fusion_score"), F.round("score", 6).alias("score"), "kind")


@R.add(f"""WITH {BM25}, {VECTOR}, l AS (SELECT query_id, id, rank, score, 'vector' AS kind FROM vec UNION ALL SELECT query_id, id, rank, score / (1 + score), 'keyword' FROM kw),
s AS (SELECT query_id, id, sum(1.0 / (60 + rank + 1)) AS fusion_score, max(score) AS score FROM l GROUP BY ALL)
SELECT query_id, id, fusion_rank, round(fusion_score, 9) AS fusion_score, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, id) - 1 AS fusion_rank FROM s) WHERE fusion_rank < 10""")
def variant_fusion(spark, sf_dir):
    lists = vector_hits(spark, sf_dir).withColumn("kind", F.lit("vector")).unionByName(keyword_hits(spark, sf_dir).withColumn("score", F.col("score") / (1 + F.col("score"))).withColumn("kind", F.lit("keyword")))
    return S.fused_variants(lists, 10).select("query_id", "id", F.col("fusion_rank").cast("long").alias("fusion_rank"), F.round("fusion_score", 9).alias("fusion_score"), F.round("score", 6).alias("score"))


@R.add(f"""WITH {BM25}, {VECTOR}, {FUSED}, g AS (SELECT *, max(CASE WHEN kind <> 'keyword' AND id <> query_id THEN score END) OVER (PARTITION BY query_id) AS best FROM fu WHERE id <> query_id)
SELECT query_id, count(*) AS hits FROM g WHERE best >= 0.35 GROUP BY query_id""")
def min_score_gate(spark, sf_dir):
    """The query's own vector left out, as it always matches."""
    return S.gated(fused_hits(spark, sf_dir).where("id <> query_id"), 0.35, 0.6).groupBy("query_id").agg(F.count("*").alias("hits"))


@R.add(f"""WITH {BM25}, d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'draft' ELSE 'active' END AS st, lang AS acl FROM documents),
f AS (SELECT kw.* FROM kw JOIN d ON doc_id = id WHERE st = 'active' AND acl IN ('de', '*')), u AS (SELECT kw.* FROM kw JOIN d ON doc_id = id WHERE acl IN ('de', '*'))
SELECT query_id, id, false AS fallback FROM f UNION ALL SELECT query_id, id, true FROM u WHERE query_id NOT IN (SELECT query_id FROM f)""")
def status_fallback(spark, sf_dir):
    """Active German hits; for queries without any, German hits of any status."""
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "draft").otherwise("active").alias("doc_status"), F.col("lang").alias("acl"))
    hits = keyword_hits(spark, sf_dir).join(meta, "id")
    strict = hits.where(P.visible(["de", "*"])).withColumn("fallback", F.lit(False))
    loose = hits.where(P.compiled({"acl": {"$in": ["de", "*"]}})).withColumn("fallback", F.lit(True))
    return S.with_fallback(strict, loose).select("query_id", "id", "fallback")


@R.add(f"""WITH {BM25}, seen AS (SELECT doc_id AS id FROM documents WHERE lang = 'fr' AND doc_id % 10 <> 0), top AS (SELECT query_id, id FROM kw),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm WHERE id IN (SELECT id FROM seen))
SELECT r.query_id, r.id, r.rank, round(r.score, 6) AS score, top.id IS NOT NULL AS in_open_top FROM r LEFT JOIN top ON top.query_id = r.query_id AND top.id = r.id WHERE r.rank < 20""")
def keyword_search_filtered(spark, sf_dir):
    """What a user may see is ranked by itself: 20 active French documents for each question, though few or none of them are among the open top 20."""
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "draft").otherwise("active").alias("doc_status"), F.col("lang").alias("acl"))
    index, terms = saved_index(spark, sf_dir), _query_terms(spark, sf_dir)
    seen = index.search(terms, 20, meta.where(P.compiled({"$and": [{"acl": "fr"}, {"doc_status": "active"}]})).select("id"))
    top = index.search(terms, 20).select("query_id", "id", F.lit(True).alias("top"))
    out = seen.join(top, ["query_id", "id"], "left")
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.col("top").isNotNull().alias("in_open_top"))


CHANGED = BM25.replace("FROM documents", "FROM changed_documents")


@R.add(f"""WITH changed_documents AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN text || ' amended by the river' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 5),
{CHANGED} SELECT query_id, id, rank, round(score, 6) AS score FROM kw""")
def keyword_index_changes(spark, sf_dir):
    """A saved index without some documents, to which these are added, of which others are replaced and others taken out, is searched as one built anew of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    start = K.built(docs.where("doc_id % 10 <> 3"), "doc_id", "text", f"{shared_folder(spark)}/keywords-{uuid.uuid4().hex}")
    added = K.changed(start, docs.where("doc_id % 10 = 3"), "doc_id", "text")
    amended = docs.where("doc_id % 10 = 4").withColumn("text", F.concat("text", F.lit(" amended by the river")))
    index = K.changed(added, amended, "doc_id", "text", deleted=docs.where("doc_id % 10 = 5").select(F.col("doc_id").alias("id")))
    out = K.opened(spark, index.path).search(_query_terms(spark, sf_dir), 20)
    return out.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@R.add("""SELECT doc_id, (lang = 'en') AS eq, (lang <> 'en') AS ne, (lang IN ('de', 'fr')) AS isin, (lang NOT IN ('de', 'fr')) AS nin, (lang = 'en' AND source = 'src1') AS both, (lang = 'de' OR n_chars > 2000) AS either, false AS unknown FROM documents""")
def predicate_language(spark, sf_dir):
    cases = {"eq": {"lang": "en"}, "ne": {"lang": {"$ne": "en"}}, "isin": {"lang": {"$in": ["de", "fr"]}}, "nin": {"lang": {"$nin": ["de", "fr"]}}, "both": {"$and": [{"lang": "en"}, {"source": {"$eq": "src1"}}]}}
    either = P.compiled({"lang": "de"}) | (F.col("n_chars") > 2000)
    return table(spark, sf_dir, "documents").select("doc_id", *[P.compiled(w).alias(k) for k, w in cases.items()], either.alias("either"), P.compiled({"lang": {"$like": "e"}}).alias("unknown"))


CHUNKS = "ch AS (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, text FROM documents)"


def chunks(spark, sf_dir):
    """Documents as chunks of their source, in the order of ids. Only ids are numbered; texts are joined where they are asked for."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    place = written(numbered(docs.select("id", "source"), ["source"], ["id"], "chunk_index").select("id", "source", "chunk_index"), "chunks")
    return place.join(docs.select("id", "text"), "id")


@R.add(f"""WITH {BM25}, {CHUNKS}, h AS (SELECT query_id, id, source, chunk_index, score, rank FROM kw JOIN ch USING (id) WHERE rank < 5),
nb AS (SELECT DISTINCT h.query_id, c.id, c.source, c.chunk_index FROM h JOIN ch c ON c.source = h.source AND abs(c.chunk_index - h.chunk_index) = 1 WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.query_id = h.query_id AND x.id = c.id))
SELECT query_id, id, source, chunk_index, round(score, 6) AS score, false AS neighbour FROM h UNION ALL SELECT query_id, id, source, chunk_index, round((SELECT min(score) FROM h WHERE h.query_id = nb.query_id) * 0.95, 6), true FROM nb""")
def neighbour_expansion(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = keyword_hits(spark, sf_dir, 5).join(c.select("id", "source", "chunk_index"), "id").withColumnRenamed("rank", "fusion_rank")
    return S.with_neighbours(hits, c).select("query_id", "id", "source", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 6).alias("score"), "neighbour")


@R.add(f"""WITH {BM25}, {CHUNKS}, h AS (SELECT query_id, id, source, chunk_index, rank FROM kw JOIN ch USING (id) WHERE rank < 5), f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source) AS first FROM h)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_index, rank) - 1 AS position FROM f""")
def document_order(spark, sf_dir):
    hits = keyword_hits(spark, sf_dir, 5).join(chunks(spark, sf_dir).select("id", "source", "chunk_index"), "id")
    return S.in_document_order(hits).select("query_id", "id", F.col("position").cast("long").alias("position"))


@R.add(f"""WITH {BM25}, {CHUNKS}, src AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS o FROM kw JOIN ch USING (id) WHERE rank < 5 GROUP BY query_id, source),
c AS (SELECT query_id, o, chunk_index, id, length(text) AS size FROM src JOIN ch USING (source) WHERE o = 1), r AS (SELECT *, sum(size) OVER (PARTITION BY query_id ORDER BY chunk_index) AS used FROM c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_index) - 1 AS position, id FROM r WHERE used <= 40000""")
def full_text_expansion(spark, sf_dir):
    """The source of the best hit, in whole up to 40,000 characters."""
    c = chunks(spark, sf_dir)
    hits = keyword_hits(spark, sf_dir, 5).join(c.select("id", "source", "chunk_index"), "id")
    return S.whole_documents(hits, c, documents=1).select("query_id", F.col("position").cast("long").alias("position"), F.col("id").cast("long").alias("id"))


@R.add(f"""WITH {BM25}, h AS (SELECT query_id, id, rank AS position, length(text) AS s, count(*) OVER w AS n, sum(length(text)) OVER w AS total FROM kw JOIN documents ON doc_id = id WHERE rank < 8 WINDOW w AS (PARTITION BY query_id)),
a AS (SELECT *, least(s * n, 6000) AS a FROM h), b AS (SELECT *, 6000 * n - sum(a) OVER (PARTITION BY query_id) AS lo, s * n - a AS room FROM a),
c AS (SELECT *, greatest(0, least(room, lo - coalesce(sum(room) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra FROM b)
SELECT query_id, id, CAST(CASE WHEN total <= 6000 THEN s WHEN a + extra > 0 THEN greatest(1, (a + extra) // n) ELSE 0 END AS BIGINT) AS allowed FROM c""")
def budget_allocation(spark, sf_dir):
    hits = keyword_hits(spark, sf_dir, 8).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id").withColumnRenamed("rank", "position")
    return S.budgets(hits, F.length("text"), 6000).select("query_id", "id", "allowed")


@R.add(f"""WITH {BM25}, h AS (SELECT query_id, id, rank AS position, source, text, count(*) OVER w AS n, min(source) OVER w = max(source) OVER w AS one FROM kw JOIN documents ON doc_id = id WHERE rank < 5 WINDOW w AS (PARTITION BY query_id))
SELECT query_id, CAST(position + 1 AS INTEGER) AS "index", CASE WHEN one AND n >= 3 THEN source || '｜第' || (position + 1) || '/' || n || '段' ELSE source END AS title, CASE WHEN length(text) > 300 THEN text[1:299] || '…' ELSE text END AS content FROM h""")
def context_build(spark, sf_dir):
    hits = keyword_hits(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source"), "id")
    built = A.built_context(hits.withColumnRenamed("rank", "position").withColumn("title", F.col("source")).withColumn("allowed", F.lit(300)), 0)
    return built.select("query_id", "index", "title", "content")


def _context(spark, sf_dir, most=5):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("."), F.lit("。")).alias("content"))
    return keyword_hits(spark, sf_dir, most).join(docs, "id").select("query_id", (F.col("rank") + 1).alias("index"), "content")


ANSWERS = f"""{BM25}, {CONTEXT},
tm AS (SELECT item_id AS query_id, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z0-9_+.-]+'), lambda x: length(x) >= 2 OR regexp_matches(x, '^[0-9]+$')), lambda x: lower(x))) AS t FROM benchmark),
hc AS (SELECT cx.query_id, idx, content, t, len(list_filter(t, lambda x: contains(lower(content), x))) AS hits FROM cx JOIN tm USING (query_id)),
oc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, idx) AS o FROM hc WHERE hits > 0) WHERE o <= 3),
st AS (SELECT query_id, idx, o, t, list_filter(list_transform(regexp_extract_all(trim(regexp_replace(regexp_replace(content, '\\[\\d{{1,3}}\\]', '', 'g'), '\\s+', ' ', 'g')), '[^。！？!?；;\\n]+[。！？!?；;]?'),
  lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\\s*[（(][^）)]{{0,24}}[）)]\\s*', ''), '^\\s*(?:[-•·*]\\s*)+', ''), '^\\s*\\d{{1,2}}[.、．)]\\s*', ''), '^\\s*[（(][^）)]{{0,24}}[）)]\\s*', ''), '^\\s*(?:[-•·*]\\s*)+', ''), '^\\s*\\d{{1,2}}[.、．)]\\s*', ''), '^\\s*[（(][^）)]{{0,24}}[）)]\\s*', ''), '^\\s*(?:[-•·*]\\s*)+', ''), '^\\s*\\d{{1,2}}[.、．)]\\s*', ''))), lambda x: length(x) >= 8) AS s FROM oc),
se AS (SELECT query_id, idx, o, t, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM st),
sh AS (SELECT *, len(list_filter(t, lambda x: contains(lower(sentence), x))) AS h FROM se),
sa AS (SELECT *, max(h) OVER (PARTITION BY query_id, idx) AS best FROM sh),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id, idx ORDER BY h / greatest(1, len(t)) + CASE WHEN pos = 0 THEN 0.015 ELSE 0.0 END DESC, pos) AS n FROM sa WHERE best = 0 OR h > 0),
ps AS (SELECT query_id, idx, row_number() OVER (PARTITION BY query_id ORDER BY o, pos) AS k, trim(sentence[1:260]) AS p FROM sr WHERE n <= 2),
kp AS (SELECT * FROM ps a WHERE NOT EXISTS (SELECT 1 FROM ps b WHERE b.query_id = a.query_id AND b.k < a.k AND contains(lower(regexp_replace(b.p, '\\s+', '', 'g')), lower(regexp_replace(a.p, '\\s+', '', 'g')))))"""
LINE = "'- ' || CASE WHEN regexp_matches(p, '[。！？!?；;.:：]$') THEN rtrim(p[1:-2]) || ' [' || idx || ']' || p[-1:] ELSE p || ' [' || idx || ']。' END"


@R.add(f"WITH {ANSWERS} SELECT query_id, string_agg({LINE}, chr(10) ORDER BY k) AS answer FROM kp GROUP BY query_id")
def extractive_answer(spark, sf_dir):
    return A.extractive_answers(_context(spark, sf_dir), questions(spark, sf_dir))


def _answers(spark, sf_dir):
    c = written(_context(spark, sf_dir), "context")
    grouped = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "content"))).alias("context"))
    return A.extractive_answers(c, questions(spark, sf_dir)).join(grouped, "query_id")


@R.add(f"""WITH {ANSWERS}, tk AS (SELECT kp.query_id, k, regexp_extract_all(p, '[A-Za-z0-9]+|[一-鿿]') AS own, list_distinct(regexp_extract_all(regexp_replace(content, '\\s+', '', 'g'), '[A-Za-z0-9]+|[一-鿿]')) AS ref FROM kp JOIN cx ON cx.query_id = kp.query_id AND cx.idx = kp.idx),
gr AS (SELECT query_id, count(*) FILTER (WHERE len(own) > 0 AND len(ref) > 0 AND len(list_filter(own, lambda x: list_contains(ref, x))) / len(own) < 0.6) AS bad FROM tk GROUP BY query_id)
SELECT query_id, false AS refused, 1.0::DOUBLE AS cited_sentence_ratio, 0 AS n_invalid, bad AS n_ungrounded, CASE WHEN bad >= 2 THEN 'unverified' WHEN bad = 1 THEN 'partial' ELSE 'verified' END AS status FROM gr""")
def answer_verification(spark, sf_dir):
    """The check is made for scripts without spaces: words of the context are compared with white space taken out, so that spaced scripts often fail it."""
    v = A.verified(_answers(spark, sf_dir))
    return v.select("query_id", "refused", F.round("cited_sentence_ratio", 6).alias("cited_sentence_ratio"), F.size("invalid_citations").alias("n_invalid"), F.size("unsupported_sentences").cast("long").alias("n_ungrounded"), "status")


@R.add(f"""WITH {ANSWERS} SELECT query_id, CAST(idx AS INTEGER) AS "index", max(doc_id) AS doc_id FROM kp JOIN kw ON kw.query_id = kp.query_id AND kw.rank = kp.idx - 1 JOIN documents ON doc_id = kw.id GROUP BY ALL""".replace("SELECT query_id, CAST(idx", "SELECT kp.query_id AS query_id, CAST(kp.idx"))
def cited_chunks(spark, sf_dir):
    """Of each context only what the answer cites."""
    shown = _answers(spark, sf_dir).select("query_id", F.explode(A.visible_context(F.col("answer"), F.col("context"), F.lit(False))).alias("c")).select("query_id", "c.index")
    return shown.join(keyword_hits(spark, sf_dir, 5).select("query_id", (F.col("rank") + 1).alias("index"), F.col("id").alias("doc_id")), ["query_id", "index"])


@R.add(f"""WITH {BM25}, d AS (SELECT kw.*, length(text) AS n FROM kw JOIN documents ON doc_id = id), h AS (SELECT *, rank < 10 AS head, CASE WHEN rank < 10 THEN 1.0 / n END AS s FROM d)
SELECT query_id, id, rank2 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY head DESC, s DESC NULLS LAST, rank) - 1 AS rank2 FROM h) WHERE rank2 < 15""")
def rerank(spark, sf_dir):
    """A scorer that prefers short documents, over the first ten hits."""
    hits = keyword_hits(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n")), "id")
    return S.reranked(hits, F.lit(1.0) / F.col("n"), 15, candidates=10).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@R.add("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, q.label = e.label AS rel, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 12) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM s) WHERE rank < 11 AND rank > 0),
g AS (SELECT query_id, max(rel::INT) AS hit, sum(CASE WHEN rel AND rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, least(5, sum(rel::INT)) AS nrel, min(CASE WHEN rel THEN rank END) AS first FROM r GROUP BY query_id),
i AS (SELECT *, CASE WHEN nrel = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, CAST(nrel AS BIGINT) + 1), lambda x: 1 / log2(x + 1))) END AS ndcg, coalesce(1.0 / first, 0) AS rr FROM g)
SELECT count(*) AS samples, round(avg(hit), 6) AS hit_rate, round(avg(ndcg), 6) AS ndcg_at_5, round(avg(rr), 6) AS mrr FROM i""")
def retrieval_evaluation(spark, sf_dir):
    """Vectors of the query's label are relevant; the query itself is left out."""
    from scholia.operators import evaluation as V

    e = table(spark, sf_dir, "embeddings")
    labels = e.select("vec_id", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = S.vector_topk(e, q, 11, "vec_id").where("rank > 0").withColumn("rank", F.col("rank") - 1)
    hits = hits.join(labels.select(F.col("vec_id").alias("id"), F.col("label").alias("a")), "id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("b")), "query_id")
    per = V.per_query(hits.withColumn("relevant", F.col("a") == F.col("b")), 5)
    return per.agg(F.count("*").alias("samples"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_5"), F.round(F.avg("mrr"), 6).alias("mrr"))


@R.add(f"""WITH {ANSWERS}, an AS (SELECT query_id, string_agg({LINE}, chr(10) ORDER BY k) AS answer FROM kp GROUP BY query_id), b AS (SELECT query_id, answer, {WORDS} AS w FROM an JOIN benchmark ON item_id = query_id)
SELECT query_id, round(len(list_filter(w, lambda x: contains(lower(answer), x))) / len(w), 6) AS coverage FROM b""")
def keyword_coverage(spark, sf_dir):
    from scholia.operators import evaluation as V

    a = A.extractive_answers(_context(spark, sf_dir), questions(spark, sf_dir)).join(questions(spark, sf_dir), "query_id")
    return a.select("query_id", F.round(V.coverage(F.lower("answer"), T.tokens(F.col("question"))), 6).alias("coverage"))
