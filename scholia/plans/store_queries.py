"""Saved tables and indexes, and streams that go on: replaced sources, a folder's files, the inverted file of vectors, answered questions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from scholia.operators import graph as G
from scholia.operators import ingest as I
from scholia.operators import source_store as S
from scholia.operators import synthesis as Y
from scholia.operators import vector_store as V
from scholia.operators.graph_build import GraphTable
from scholia.sources.tables import shared_folder, table, version
from scholia.streaming import answers as N
from scholia.streaming.folder import FolderTable

from . import data_queries as D
from . import retrieval_queries as Q
from .registry import Registry

R = Registry()


@R.add("""SELECT source, doc_id, text FROM documents WHERE source <> 'src3' AND source <> 'src5' UNION ALL SELECT source, doc_id, 'amended ' || text FROM documents WHERE source = 'src3' AND doc_id % 40 < 20""")
def store_commit(spark, sf_dir):
    """Rows by source: one source gets other rows, one is removed, and one change is taken back because its hook fails."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    store = S.created(spark, f"{shared_folder(spark)}/sources-{uuid.uuid4().hex}", "source string, doc_id bigint, text string", buckets=8)
    store.replace(docs)
    store.replace(docs.where("source = 'src3' and doc_id % 40 < 20").withColumn("text", F.concat(F.lit("amended "), "text")))
    store.remove(docs.where("source = 'src5'").select("source"))

    def ledger_is_full() -> None:
        raise OSError("the ledger can't be written")

    try:
        store.replace(docs.where("source = 'src7'").withColumn("text", F.lit("never seen")), on_commit=ledger_is_full)
    except OSError:
        pass
    return S.opened(spark, store.folder.path).rows().select("source", "doc_id", "text")


@R.add(r"""SELECT source, sum(length(regexp_replace(text, '\s+', '', 'g'))) AS characters, count(DISTINCT doc_id) * 0 + 1 AS again FROM documents WHERE trim(regexp_replace(text, '\s+', '', 'g')) <> '' GROUP BY source""")
def folder_ingest(spark, sf_dir):
    """The documents as files of up to 500, in a folder for each source, taken by a stream and cut without overlap: all their characters are in the chunks. Nothing is left to take afterwards."""
    root = f"{shared_folder(spark)}/folder-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").option("maxRecordsPerFile", 500).text(f"{root}/files")
    taken = FolderTable(spark, f"{root}/files", f"{root}/table", overlap=0)
    taken.follow()
    left = taken.changed().count() + len(taken.forget())
    body = F.regexp_replace("text", r"\s+", "")
    of = F.regexp_extract("source", "^source=([^/]*)/", 1)
    return taken.chunks.rows().groupBy(of.alias("source")).agg(F.sum(F.length(body)).alias("characters")).withColumn("again", F.lit(1 - left).cast("long"))


def saved_vectors(spark, sf_dir):
    """The saved cells of a folder's vectors, built where there are none of these files."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    files = version(e)
    return V.ensured(e, "vec_id", "embedding", f"{shared_folder(spark)}/vectors-{hashlib.sha256(f'{sf_dir} {files}'.encode()).hexdigest()[:32]}", files)


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@R.add(Q.R.oracles["vector_search"])
def vector_search_saved(spark, sf_dir):
    """Every twentieth vector against all, from the saved cells, all of which are read."""
    hits = saved_vectors(spark, sf_dir).search(_queries(spark, sf_dir), 10, share=1.0)
    return hits.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@R.add()
def vector_search_probed(spark, sf_dir):
    """The same from each query's nearest cells only. The given vectors have hardly any neighbourhoods, so that many cells are asked for."""
    hits = saved_vectors(spark, sf_dir).search(_queries(spark, sf_dir), 10, share=0.7)
    return hits.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


STATUS = Q.R.oracles["answer_verification"]
STATUS_WITH = STATUS[STATUS.index("tk AS ") : STATUS.index("SELECT query_id, false AS refused")]


@R.add(f"""WITH {Q.ANSWERS}, {STATUS_WITH}
SELECT item_id AS query_id, 0 AS position, 'hits' AS event, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FROM kw WHERE query_id = item_id AND rank < 5), '') AS data FROM benchmark
UNION ALL SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k) AS INTEGER), 'line', {Q.LINE} FROM kp
UNION ALL SELECT item_id, CAST(coalesce((SELECT count(*) FROM kp WHERE query_id = item_id), 0) + 1 AS INTEGER), 'done', coalesce((SELECT CASE WHEN bad >= 2 THEN 'unverified' WHEN bad = 1 THEN 'partial' ELSE 'verified' END FROM gr WHERE query_id = item_id), 'refused') FROM benchmark""")
def stream_answers(spark, sf_dir):
    """The questions as a stream of four files, answered batch by batch."""
    root = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    asked = Q.questions(spark, sf_dir)
    asked.repartition(4, "query_id").write.parquet(f"{root}/questions")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("."), F.lit("。")).alias("content"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/questions")
    N.answer_stream(stream, Q.saved_index(spark, sf_dir), documents, f"{root}/events", f"{root}/progress")
    return N.events(spark, f"{root}/events")


GRAPH_HOPS = f"""{D.ENTITIES}, {D.RELATIONS}, q AS (SELECT n_nationkey AS query_id, n_name AS t FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region UNION ALL SELECT 1000 + s_suppkey, 's' || s_suppkey FROM supplier),
sd AS (SELECT * FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY length(name), name) AS place FROM q JOIN en ON contains(lower(name || chr(10) || description), lower(t))) WHERE place <= 4),
ed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source, target, type) AS n FROM (SELECT DISTINCT source, target, type, source AS name FROM re UNION SELECT DISTINCT source, target, type, target FROM re)) WHERE n <= 200),
e0 AS (SELECT query_id, name, 0 AS hop, row_number() OVER (PARTITION BY query_id ORDER BY place, name) AS place FROM sd),
c0 AS (SELECT query_id, count(*) AS have FROM e0 GROUP BY query_id),
r1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, n, source, target, type) AS place FROM (
  SELECT query_id, source, target, type, have, min({{'p': place, 'n': n}}).p AS p, min({{'p': place, 'n': n}}).n AS n FROM e0 JOIN c0 USING (query_id) JOIN ed USING (name) WHERE have < 50 GROUP BY ALL)) WHERE place <= 200),
m1 AS (SELECT query_id, name, min(place) AS first FROM (SELECT query_id, place, unnest([source, target]) AS name FROM r1) GROUP BY ALL),
e1 AS (SELECT * FROM (SELECT query_id, name, 1 AS hop, have + row_number() OVER (PARTITION BY query_id ORDER BY first, name) AS place FROM m1 JOIN c0 USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM e0 WHERE e0.query_id = m1.query_id AND e0.name = m1.name)) WHERE place <= 50),
ee AS (SELECT * FROM e0 UNION ALL SELECT * FROM e1),
c1 AS (SELECT query_id, count(*) AS have, (SELECT count(*) FROM r1 WHERE r1.query_id = ee.query_id) AS held FROM ee GROUP BY query_id),
r2 AS (SELECT * FROM (SELECT *, held + row_number() OVER (PARTITION BY query_id ORDER BY p, n, source, target, type) AS place FROM (
  SELECT query_id, source, target, type, held, min({{'p': place, 'n': n}}).p AS p, min({{'p': place, 'n': n}}).n AS n FROM e1 JOIN c1 USING (query_id) JOIN ed USING (name) WHERE have < 50 AND held < 200 GROUP BY ALL) AS x
  WHERE NOT EXISTS (SELECT 1 FROM r1 WHERE r1.query_id = x.query_id AND r1.source = x.source AND r1.target = x.target AND r1.type = x.type)) WHERE place <= 200),
m2 AS (SELECT query_id, name, min(place) AS first FROM (SELECT query_id, place, unnest([source, target]) AS name FROM r2) GROUP BY ALL),
e2 AS (SELECT * FROM (SELECT query_id, name, 2 AS hop, have + row_number() OVER (PARTITION BY query_id ORDER BY first, name) AS place FROM m2 JOIN c1 USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM ee WHERE ee.query_id = m2.query_id AND ee.name = m2.name)) WHERE place <= 50)"""


def _explored(spark, sf_dir):
    entities, relations = D.graph(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("text"))
    regions = table(spark, sf_dir, "region").select((100 + F.col("r_regionkey")).alias("query_id"), F.col("r_name").alias("text"))
    suppliers = table(spark, sf_dir, "supplier").select((1000 + F.col("s_suppkey")).alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("text"))
    return G.explored(I.seeds(nations.unionByName(regions).unionByName(suppliers), entities, 4, shortest=1), relations)


@R.add(f"""WITH {GRAPH_HOPS} SELECT query_id, name, CAST(hop AS INTEGER) AS hop, CAST(place AS INTEGER) AS place FROM (SELECT * FROM ee UNION ALL SELECT * FROM e2)""")
def graph_exploration(spark, sf_dir):
    """Nations, regions and suppliers as questions, all at once, two hops from their seeds: what each meets, 50 entities and 200 relations at most."""
    return _explored(spark, sf_dir)[0].select("query_id", "name", "hop", F.col("place").cast("int").alias("place"))


@R.add(f"""WITH {GRAPH_HOPS}, {Q.BM25},
tx AS (SELECT query_id, string_agg('[文档片段 ' || (rank + 1) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS texts FROM kw JOIN documents ON doc_id = id WHERE rank < 4 GROUP BY query_id),
rr AS (SELECT query_id, source, target, type, place FROM r1 UNION ALL SELECT query_id, source, target, type, place FROM r2),
ln AS (SELECT query_id, string_agg(source || ' -[' || type || ']-> ' || target, chr(10) ORDER BY place) AS lines FROM rr WHERE place <= 40 GROUP BY query_id)
SELECT coalesce(tx.query_id, ln.query_id) AS query_id, concat_ws(chr(10) || chr(10), texts, '[知识图谱]' || chr(10) || lines) AS context FROM tx FULL JOIN ln ON tx.query_id = ln.query_id""")
def graph_rag(spark, sf_dir):
    """The contexts of questions: the texts of their hits, and what their entities are related to."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = Q.keyword_hits(spark, sf_dir, 4).join(docs, "id").select(F.col("query_id").cast("long").alias("query_id"), "rank", "text")
    found = _explored(spark, sf_dir)[1].withColumn("query_id", F.col("query_id").cast("long"))
    return G.graph_rag_context(hits, found)


ROWS = ", ".join(f"('{i}', '{d}', '{t}')" for i, d, t in Y.TEMPLATES)


@R.add(f"""WITH sec AS (SELECT p_brand AS source, p_type AS section_title, list_sort(list_distinct(list(p_name)))[1:8] AS entities FROM part GROUP BY ALL), t(id, difficulty, form) AS (VALUES {ROWS}),
o AS (SELECT source, section_title, entities, unnest(entities) AS one FROM sec), p AS (SELECT o.*, t.*, unnest(CASE WHEN contains(form, '{{entity1}}') THEN list_filter(entities, lambda e: e <> one) ELSE [''] END) AS two FROM o, t),
m AS (SELECT source, section_title, id AS template_id, difficulty, replace(replace(replace(replace(form, '{{section_title}}', section_title), '{{entity1}}', one), '{{entity2}}', two), '{{entity}}', one) AS question FROM p),
u AS (SELECT * FROM m WHERE question NOT IN (SELECT p_name || ' 是什么？' FROM part WHERE p_partkey % 3 = 0) QUALIFY row_number() OVER (PARTITION BY question ORDER BY source, section_title, template_id) = 1)
SELECT source, section_title, template_id, difficulty, question FROM u QUALIFY row_number() OVER (PARTITION BY source, section_title, difficulty ORDER BY md5(concat_ws('|', '7', source, section_title, question)), question) <= CASE WHEN difficulty = 'easy' THEN 2 ELSE 3 END""")
def question_synthesis(spark, sf_dir):
    """Parts as entities of sections by brand and type; some questions are there already."""
    part = table(spark, sf_dir, "part")
    sections = part.groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("section_title")).agg(F.slice(F.array_sort(F.collect_set("p_name")), 1, 8).alias("entities"))
    existing = part.where("p_partkey % 3 = 0").select(F.concat("p_name", F.lit(" 是什么？")).alias("question"))
    return Y.questions(sections, 2, 3, 7, existing)


SCHEMA = {"search": {"required": ["query", "top_k"], "properties": {"query": {"type": "string"}, "top_k": {"type": "integer"}, "filters": {"type": "object"}}}, "sum": {"required": ["values"], "properties": {"values": {"type": "array"}, "scale": {"type": "number"}, "strict": {"type": "boolean"}, "note": {"type": "text"}}}}
#: A call for each order, as text: what it holds and of which type goes by the order's number.
CALL = """CASE o_orderkey % 8 WHEN 0 THEN '{"query": "' || o_orderpriority || '", "top_k": ' || o_custkey || '}' WHEN 1 THEN '{"query": ' || o_custkey || ', "top_k": 2.5, "filters": [1]}' WHEN 2 THEN '{"top_k": null, "other": 1}'
WHEN 3 THEN '{"values": [' || o_custkey || '], "scale": ' || o_custkey || '.25, "strict": true, "note": 3}' WHEN 4 THEN '{"values": {"a": 1}, "scale": "1", "strict": 0}' WHEN 5 THEN '[' || o_custkey || ']' WHEN 6 THEN 'no json {' ELSE '{}' END"""
TOOL = "CASE WHEN o_orderkey % 8 IN (3, 4) OR o_orderkey % 16 = 7 THEN 'sum' WHEN o_orderkey % 16 = 15 THEN 'unknown' ELSE 'search' END"


def _fault_sql(tool: str) -> str:
    s = SCHEMA[tool]
    kinds = {"integer": "IN ('BIGINT', 'UBIGINT')", "number": "IN ('BIGINT', 'UBIGINT', 'DOUBLE')", "string": "= 'VARCHAR'", "boolean": "= 'BOOLEAN'", "array": "= 'ARRAY'", "object": "= 'OBJECT'"}
    found = [f"CASE WHEN json_type(params, '$.{k}') IS NULL THEN '缺少必填参数：{k}' END" for k in s["required"]]
    found += [f"CASE WHEN json_type(params, '$.{k}') NOT {kinds[p['type']]} THEN '参数 {k} 应为 {p['type']}' END" if "IN" in kinds[p["type"]] else f"CASE WHEN json_type(params, '$.{k}') <> '{kinds[p['type']][3:-1]}' THEN '参数 {k} 应为 {p['type']}' END" for k, p in s["properties"].items() if p["type"] in kinds]
    return f"list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)"


@R.add(f"""WITH c AS (SELECT o_orderkey AS call_id, {TOOL} AS tool, {CALL} AS params FROM orders),
f AS (SELECT call_id, CASE WHEN NOT json_valid(params) THEN ['{Y.NO_OBJECT}'] WHEN json_type(params) <> 'OBJECT' THEN ['{Y.NO_OBJECT}'] WHEN tool = 'search' THEN {_fault_sql('search')} WHEN tool = 'sum' THEN {_fault_sql('sum')} ELSE [] END AS f FROM c)
SELECT call_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS place, unnest(f) AS violation FROM f""")
def tool_call_faults(spark, sf_dir):
    """Calls made from orders, against the schemas of two tools."""
    calls = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS call_id", f"{TOOL} AS tool", f"{CALL} AS params")
    return Y.violations(calls, SCHEMA)


@R.add("""WITH c AS (SELECT c_custkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'c' || c_custkey AS name, 'Customer' AS type, c_mktsegment AS description, (SELECT count(*) FROM c AS o WHERE o.n_name = c.n_name) AS beside FROM c UNION ALL SELECT DISTINCT n_name, 'Other', '', 0 FROM c""")
def graph_build(spark, sf_dir):
    """Customers as what was extracted from their nation's file, in fences and with a comma too many: half of the files, then all of them."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    raw = F.concat(F.lit('It says:\n```json\n{"entities": [{"name": "'), name, F.lit('", "type": "Customer", "description": "'), F.col("c_mktsegment"), F.lit('"},], "relations": [{"source": "'), name, F.lit('", "target": "'), F.col("n_name"), F.lit('", "type": "LIVES_IN"}]}\n```'))
    outputs = c.select(F.col("n_name").alias("source"), F.col("c_custkey").alias("seq"), raw.alias("raw"), "n_nationkey")
    built = GraphTable(spark, f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", 8)
    built.add(outputs.where("n_nationkey < 12").drop("n_nationkey"))
    built.add(outputs.drop("n_nationkey"))
    beside = built.relations().groupBy("target").agg(F.count("*").alias("beside"))
    ends = built.relations().select(F.col("source").alias("name"), "target").join(beside, "target").select("name", "beside")
    return built.entities().join(ends, "name", "left").select("name", "type", "description", F.coalesce("beside", F.lit(0)).alias("beside"))
