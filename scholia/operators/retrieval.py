"""Batched retrieval: keyword and vector search of many queries at once, rank fusion, gates, expansion.

Hits are rows (query_id, id, rank from 0, score, kind). Keyword statistics are tables (postings, document frequencies, one row of totals), so
they are written once and joined by each batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions import text as T
from scholia.sources.tables import written, written_path

from .ranks import cumulated

K1, B, RRF_K = 1.5, 0.75, 60
#: Scores that a task holds at once (16 MB): queries times rows of the index.
MOST_SCORES = 1 << 21


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, term): a row for each distinct term of a document; dl counts them. A document without a term is left out."""
    t = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("terms"))
    return t.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: number of documents and mean length in terms."""
    return docs.select(F.size(T.tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequencies(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class KeywordIndex:
    """Postings (id, dl, term) with one row without a term for each document, and the corpus statistics: written tables."""

    posts: DataFrame
    stats: DataFrame


def keyword_index(docs: DataFrame, id_col: str, text_col: str) -> KeywordIndex:
    """Tokenises ``docs`` once and writes what searches need. Build it once for any number of searches."""
    t = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("terms"))
    posts = written(t.select("id", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term")), "postings")
    stats = written(posts.groupBy("id").agg(F.first("dl").alias("dl"), F.count_if(F.col("term").isNull()).alias("blank")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "stats")
    return KeywordIndex(posts.where("term is not null"), stats)


def bm25(posts: DataFrame, stats: DataFrame, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of every document that shares a term with a query (query_id, term). Only postings of the queries' terms are joined; what is found is written, as document frequencies and scores
    both come from it. Each term counts once in a document, as terms are distinct. ``allowed`` (id) are the documents that may be seen: others are left out before any rank is given, but count in the
    frequencies, as the index is one for all users."""
    s = stats.first()
    n, avgdl = (s["n"] or 0), (s["avgdl"] or 1.0) or 1.0
    wanted = queries.select("term").distinct()
    found = written(posts.join(wanted, "term"), "found")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    seen = found if allowed is None else found.join(allowed.select("id").distinct(), "id", "left_semi")
    return queries.join(df, "term").join(seen, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def ranked(hits: DataFrame, most: int, score: str = "score") -> DataFrame:
    """The ``most`` best of each query with their rank from 0; ties by id."""
    w = W.partitionBy("query_id").orderBy(F.desc(score), "id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most)


def similarity(distance: Column, space: str) -> Column:
    """Score of a distance: cosine, l2 or ip."""
    if space == "cosine":
        return F.greatest(F.lit(0.0), 1 - distance)
    return 1 / (1 + F.greatest(F.lit(0.0), distance)) if space == "l2" else distance


def unit(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return T.let(norm, lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def _best(s: np.ndarray, most: int) -> np.ndarray:
    """Columns of the ``most`` largest values of each row, ties by the smaller column."""
    if s.shape[1] <= most:
        return np.argsort(-s, axis=1, kind="stable")
    at = np.argpartition(-s, most - 1, axis=1)[:, :most]
    least = np.take_along_axis(s, at, 1).min(1, keepdims=True)
    tied = np.flatnonzero((s >= least).sum(1) > most)  # more stand at the bound than fit
    if len(tied):
        at[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :most]
    at.sort(axis=1)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1, kind="stable"), 1)


def _unit_rows(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norms = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(norms == 0, 1, norms)


def best_rows(asked: Iterator[pa.RecordBatch], ids: pa.Array, vectors: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score) of the ``most`` best of the unit ``vectors`` for each query (query_id, v). ``ids`` ascend, as ties go to the smaller. At most ``MOST_SCORES`` scores are held, whatever the numbers of queries and rows."""
    step = max(1, MOST_SCORES // max(1, len(ids)))
    for whole in asked:
        for i in range(0, whole.num_rows, step):
            q = whole.slice(i, step)
            s = np.round(_unit_rows(q.column("v")) @ vectors.T, 12)
            at = _best(s, most)
            names = q.column("query_id").take(pa.array(np.repeat(np.arange(q.num_rows), at.shape[1])))
            yield pa.record_batch([names, ids.take(pa.array(at.reshape(-1))), pa.array(np.take_along_axis(s, at, 1).reshape(-1))], ["query_id", "id", "score"])


def vector_topk(index: DataFrame, queries: DataFrame, most: int, id_col: str = "id", vector_col: str = "embedding", block: int = 2048) -> DataFrame:
    """The ``most`` nearest rows by cosine for each query (query_id, embedding), exact. The queries are written to the shared folder; each task reads its part of the index once, takes the queries
    from there in blocks of at most ``block`` rows, multiplies, and keeps its best; a window keeps the best of all. Nothing goes through the driver."""
    id_type, query_type = index.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    folder = written_path(queries.select("query_id", F.col("embedding").alias("v")), "queries")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        store, root = fs.FileSystem.from_uri(folder)
        asked = dataset.dataset(root, filesystem=store, format="parquet", exclude_invalid_files=True)
        held: list[pa.RecordBatch] = []

        def best() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.sort_by(rows.column_names[0])
            ids, vectors = rows.column(0).combine_chunks(), _unit_rows(rows.column(1).combine_chunks())
            yield from best_rows(asked.to_batches(batch_size=block, batch_readahead=1, fragment_readahead=1), ids, vectors, most)

        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= 50_000:  # rows of the index held at once
                yield from best()
                held, size = [], 0
        if held:
            yield from best()

    hits = index.select(F.col(id_col).alias("id"), vector_col).mapInArrow(scored, f"query_id {query_type}, id {id_type}, score double")
    return ranked(hits, most)


def fused(vector: DataFrame, keyword: DataFrame, most: int, keyword_weight: float = 0.5) -> DataFrame:
    """Reciprocal-rank fusion of vector and keyword hits: the vector's score where there is one, else the keyword's squashed to s / (1 + s).
    The order is that of fusion; scores of the two kinds aren't comparable and never reorder it."""
    v = vector.select("query_id", "id", F.col("rank").alias("vr"), F.col("score").alias("vs"))
    k = keyword.select("query_id", "id", F.col("rank").alias("kr"), F.col("score").alias("ks"))
    both = v.join(k, ["query_id", "id"], "full_outer")
    rrf = F.coalesce(1.0 / (RRF_K + F.col("vr") + 1), F.lit(0.0)) + F.coalesce(F.lit(keyword_weight) / (RRF_K + F.col("kr") + 1), F.lit(0.0))
    both = both.select("query_id", "id", rrf.alias("fusion_score"), F.coalesce("vs", F.when(F.col("ks") > 0, F.col("ks") / (1 + F.col("ks"))).otherwise(0.0)).alias("score"), F.when(F.col("vs").isNotNull(), "vector").otherwise("keyword").alias("kind"))
    return ranked(both, most, "fusion_score").withColumnRenamed("rank", "fusion_rank")


def fused_variants(hits: DataFrame, most: int) -> DataFrame:
    """Fusion of the ranked lists of a query's variants (query_id, variant, id, rank, score, kind); a hit keeps its best score and that one's kind."""
    sums = hits.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF_K + F.col("rank") + 1)).alias("fusion_score"), F.max("score").alias("score"), F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    return ranked(sums, most, "fusion_score").withColumnRenamed("rank", "fusion_rank")


def gated(hits: DataFrame, min_score: float = 0.15, keyword_min_score: float = 0.60) -> DataFrame:
    """Only queries whose best vector score, or best keyword score where they have no vector hit, reaches its threshold; 0 turns a threshold off."""
    if min_score <= 0:
        return hits
    w = W.partitionBy("query_id")
    semantic = F.max(F.when(F.col("kind") != "keyword", F.col("score"))).over(w)
    keyword = F.max(F.when(F.col("kind") == "keyword", F.col("score"))).over(w)
    passed = F.when(semantic.isNotNull(), semantic >= min_score).otherwise((F.lit(keyword_min_score) <= 0) | (F.coalesce(keyword, F.lit(0.0)) >= keyword_min_score))
    return hits.withColumn("__passed", passed).where("__passed").drop("__passed")


def with_fallback(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """Hits under the status filter; for queries without any, those without it. Both must be under the same access filter."""
    return filtered.unionByName(unfiltered.join(filtered.select("query_id").distinct(), "query_id", "left_anti"))


def reranked(hits: DataFrame, score: Column, most: int, candidates: int = 50, min_relevance: float | None = None) -> DataFrame:
    """The first ``candidates`` of a query by ``score``, then the others in their order; ``most`` in all, with rank."""
    h = hits.withColumn("__head", F.col("rank") < candidates).withColumn("rerank_score", F.when(F.col("__head"), score))
    if min_relevance is not None:
        h = h.where(F.col("rerank_score") >= min_relevance)
    w = W.partitionBy("query_id").orderBy(F.desc("__head"), F.desc_nulls_last("rerank_score"), "rank")
    return h.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most).drop("__head")


def with_neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Hits (query_id, id, source, chunk_index, score, fusion_rank) with the chunks beside them in their source. Neighbours score at most 0.95 of the query's least hit.
    The offsets are exploded, so that the band join is an equi-join."""
    near = hits.withColumn("d", F.explode(F.array(*[F.lit(d) for d in range(-window, window + 1) if d]))).select("query_id", "source", (F.col("chunk_index") + F.col("d")).alias("chunk_index")).distinct()
    least = hits.groupBy("query_id").agg(F.min("score").alias("base"))
    extra = near.join(chunks.select("id", "source", "chunk_index"), ["source", "chunk_index"]).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").join(least, "query_id")
    extra = extra.select("query_id", "id", "source", "chunk_index", F.when(F.col("base") > 0, F.col("base") * 0.95).otherwise(F.lit(0.0)).alias("score"), F.lit(None).cast("int").alias("fusion_rank"), F.lit(True).alias("neighbour"))
    return hits.select("query_id", "id", "source", "chunk_index", "score", "fusion_rank", F.lit(False).alias("neighbour")).unionByName(extra)


def in_document_order(hits: DataFrame) -> DataFrame:
    """``position`` from 0: sources by first appearance, then chunk index; a source with a missing index keeps the order of the hits."""
    w = W.partitionBy("query_id", "source")
    h = hits.withColumn("__first", F.min("rank").over(w)).withColumn("__known", F.bool_and(F.col("chunk_index").isNotNull()).over(w))
    order = W.partitionBy("query_id").orderBy("__first", F.when(F.col("__known"), F.col("chunk_index")).otherwise(F.col("rank")), "rank")
    return h.withColumn("position", F.row_number().over(order) - 1).drop("__first", "__known")


def whole_documents(hits: DataFrame, chunks: DataFrame, documents: int = 3, characters: int = 40000) -> DataFrame:
    """The chunks of each query's first ``documents`` sources, in order, until the next would pass ``characters`` (counted over the query; a source stops at its first
    chunk that doesn't fit, and the next source goes on with what is left). Sizes are summed up along each source by ranges, so what is joined to the queries is the head of a source that fits, whatever its length."""
    sources = hits.groupBy("query_id", "source").agg(F.min("rank").alias("r"))
    sources = written(sources.withColumn("o", F.row_number().over(W.partitionBy("query_id").orderBy("r", "source"))).where(F.col("o") <= documents).select("query_id", "source", "o"), "sources")
    sized = chunks.select("id", "source", "chunk_index", F.coalesce(F.length("text"), F.lit(0)).alias("size")).join(sources.select("source").distinct(), "source", "left_semi")
    heads = cumulated(sized, ["source"], ["chunk_index", "id"], "size").withColumn("upto", F.col("before") + F.col("size")).where(F.col("upto") <= characters)
    heads = written(heads.select("id", "source", "chunk_index", "upto"), "heads")
    left = sources.select("query_id").distinct().withColumn("left", F.lit(characters).cast("long"))
    taken = None
    for o in range(1, documents + 1):
        new = written(sources.where(F.col("o") == o).join(left, "query_id").join(heads, "source").where(F.col("upto") <= F.col("left")).select("query_id", "o", "chunk_index", "id", "upto", "left"), "fitting")
        taken = new if taken is None else taken.unionByName(new)
        used = new.groupBy("query_id").agg(F.max("upto").alias("used"))
        left = left.join(used, "query_id", "left").select("query_id", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("o", "chunk_index", "id")) - 1
    return taken.select("query_id", place.alias("position"), F.col("id").cast("string").alias("id"))


def budgets(hits: DataFrame, size: Column, characters: int) -> DataFrame:
    """``allowed`` characters of each hit in the order of ``position``: all where they fit; else equal shares, with what short ones leave going to the
    first that are cut. Computed in integers of n-ths of a character."""
    w = W.partitionBy("query_id")
    h = hits.withColumn("__s", size.cast("long")).withColumn("__n", F.count("*").over(w)).withColumn("__all", F.sum("__s").over(w))
    h = h.withColumn("__a", F.least(F.col("__s") * F.col("__n"), F.lit(characters)))
    h = h.withColumn("__left", F.lit(characters) * F.col("__n") - F.sum("__a").over(w)).withColumn("__room", F.col("__s") * F.col("__n") - F.col("__a"))
    before = F.coalesce(F.sum("__room").over(w.orderBy("position").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(F.col("__room"), F.col("__left") - before))
    share = F.floor((F.col("__a") + extra) / F.col("__n"))
    allowed = F.when((F.lit(characters) <= 0) | (F.col("__all") <= characters), F.col("__s")).when(F.col("__a") + extra > 0, F.greatest(F.lit(1), share)).otherwise(0)
    return h.withColumn("allowed", allowed.cast("long")).drop("__s", "__n", "__all", "__a", "__left", "__room")
