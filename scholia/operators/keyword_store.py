"""A saved keyword index: built once, opened while it matches its collection, changed by segments, searched without reading more than the wanted terms' lists.

A folder holds segments and manifests. A segment deals its documents to shards by the hash of their id; a term has one list for each shard it stands in, of ids and lengths, shortest documents first. Lists lie in buckets by the
hash of the term, sorted by term, so that a search reads those of its terms. Beside them are the documents' own terms, the ids that the segment makes void in the segments before it, and what that takes from the terms' frequencies. A
manifest (one small file, put in place by a rename; the one of the highest number counts) lists the segments, the number of documents and of terms. So a change writes only what is new, readers of an older manifest go on
undisturbed, and a change that breaks off leaves nothing that is read.

A batch of queries is answered shard by shard: a task takes the lists of a shard and a group of queries, adds up scores in arrays over the shard's documents and returns each query's best. As each term counts once in a document, the largest
score of a list follows from its shortest document. Lists are added in the order of that bound; once the lists that are left can't lift a new document over the best so far, they are only added to the documents already
met.

Ids are unique in what is added; one that is there already is replaced. Null and empty texts are documents without terms.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.sources.tables import Folder, spread, written

from .retrieval import B, K1, ranked

#: Lists of a bucket, about, and documents of a shard, at most and (while there are few shards) at least.
BUCKET_LISTS, SHARD_MOST, SHARD_LEAST, FEW_SHARDS = 500_000, 5_000, 1_000, 64
#: As many terms of a batch of queries at most are handed to the scan as values; with more, the scan takes whole buckets.
MOST_VALUES = 5000
#: Queries that a task takes at a time.
GROUP = 256
#: Of the files; an index of another form isn't opened.
FORM = 2


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _shard(id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(shards)).cast("int")


def _part(dl: np.ndarray, avgdl: float) -> np.ndarray:
    """A term's share of a score over its idf."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * dl / avgdl))


def best_of(lists: list[tuple[np.ndarray, np.ndarray, float]], documents: int, most: int, may: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``most`` best documents of a shard (and of all that are as good as the last, to nine digits) for one query: lists of (places, scores, the largest of them). ``may``: which may be seen."""
    score, least = np.zeros(documents), 0.0
    lists = sorted(lists, key=lambda x: -x[2])
    left = float(sum(x[2] for x in lists))
    met = np.zeros(documents, bool)
    for n, (at, part, largest) in enumerate(lists):
        if left + 1e-6 < least:  # no document that hasn't been met can be among the best
            some = met[at]
            at, part = at[some], part[some]
        else:
            met[at] = True
        score[at] += part
        left -= largest
        if n + 1 < len(lists) and len(at) and left + 1e-6 < score.max():
            seen = score[met] if may is None else score[met & may]
            least = float(np.partition(seen, -most)[-most]) if len(seen) >= most else 0.0
    at = np.flatnonzero(met if may is None else met & may)
    if len(at) > most:
        r = np.round(score[at], 9)
        at = at[r >= np.partition(r, -most)[-most]]
    return at, score[at]


def _cell(avgdl: float, most: int):
    def run(key: tuple, lists: pa.Table, asks: pa.Table) -> pa.Table:
        names = pa.schema([("query_id", asks.schema.field("queries").type.value_type.field("query_id").type), ("id", lists.schema.field("ids").type.value_type), ("score", pa.float64())])
        if not lists.num_rows or not asks.num_rows:
            return names.empty_table()
        ids = lists.column("ids").combine_chunks()
        coded = ids.flatten().dictionary_encode()
        places, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        dl = lists.column("lengths").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        part, ends = _part(dl, avgdl), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
        of = {t: slice(e - k, e) for t, e, k in zip(lists.column("term").to_pylist(), ends.tolist(), ids.value_lengths().to_pylist())}
        void, seen = asks.column("void").combine_chunks()[0].values, asks.column("seen").combine_chunks()[0].values
        may = None if void is None and seen is None else np.ones(len(known), bool)
        if void is not None:
            may &= ~pc.is_in(known, value_set=void).to_numpy(zero_copy_only=False)
        if seen is not None:
            may &= pc.is_in(known, value_set=seen).to_numpy(zero_copy_only=False)
        out: list[list] = [[], [], []]
        for q in (x for column in asks.column("queries").to_pylist() for x in column):
            mine = [(places[s], t["idf"] * part[s], t["idf"] * float(part[s.start])) for t in q["terms"] if (s := of.get(t["term"])) is not None]
            at, score = best_of(mine, len(known), most, may)
            out[0] += [q["query_id"]] * len(at)
            out[1].append(at)
            out[2].append(score)
        at = np.concatenate(out[1] or [np.empty(0, np.int64)])
        return pa.table([pa.array(out[0], names.field(0).type), known.take(pa.array(at)), pa.array(np.concatenate(out[2] or [np.empty(0)]))], schema=names)

    return run


@dataclass(frozen=True)
class SavedIndex:
    spark: SparkSession
    path: str
    manifest: dict

    @property
    def documents_count(self) -> int:
        return self.manifest["documents"]

    def _segments(self, name: str) -> list[tuple[dict, DataFrame]]:
        return [(s, self.spark.read.schema(s["schemas"][name]).parquet(f"{self.path}/{s['folder']}/{name}")) for s in self.manifest["segments"] if name in s["schemas"]]

    def _all(self, name: str) -> DataFrame | None:
        parts = [df.withColumn("segment", F.lit(s["number"])) for s, df in self._segments(name)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def lists(self, terms: DataFrame) -> DataFrame:
        """The lists (term, shard, n, ids, lengths, segment) of ``terms`` (term, distinct). Only their buckets are read, and of these, where the terms are few, only the row groups that may hold them."""
        segments = self._segments("postings")
        own = [_bucket(F.col("term"), s["buckets"]).alias(f"b{i}") for i, (s, _) in enumerate(segments)]
        few = terms.select("term", *own).limit(MOST_VALUES + 1).collect()
        parts = []
        for i, (s, found) in enumerate(segments):
            if len(few) <= MOST_VALUES:
                found = found.where(F.col("bucket").isin(sorted({r[f"b{i}"] for r in few})) & F.col("term").isin([r.term for r in few]))
            else:
                buckets = [r.b for r in terms.select(own[i].alias("b")).distinct().collect()]  # no more than the segment has
                found = found.where(F.col("bucket").isin(sorted(buckets))).join(terms, "term", "left_semi")
            parts.append(found.drop("bucket").withColumn("segment", F.lit(s["number"])))
        return reduce(DataFrame.unionByName, parts)

    def frequencies(self, terms: DataFrame, lists: DataFrame | None = None) -> DataFrame:
        """(term, df) of live documents."""
        counts = (self.lists(terms) if lists is None else lists).select("term", F.col("n").cast("long").alias("n"))
        less = self._all("fewer")
        if less is not None:
            counts = counts.unionByName(less.join(terms, "term", "left_semi").select("term", (-F.col("n")).alias("n")))
        return counts.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")

    def documents(self) -> DataFrame:
        """(id, dl, terms) of live documents."""
        rows, gone = self._all("documents"), self._all("gone")
        if gone is not None:
            last = gone.groupBy("id").agg(F.max("segment").alias("__void"))
            rows = rows.join(last, "id", "left").where(F.col("__void").isNull() | (F.col("segment") >= F.col("__void"))).drop("__void")
        return rows.drop("segment")

    def _by_shard(self, ids: DataFrame, name: str, later: bool = False) -> DataFrame:
        """(segment, shard, ``name``): the ids (of later segments only) that fall into each shard of each segment; as many as a shard has documents, about."""
        parts = []
        for s in (s for s in self.manifest["segments"] if "postings" in s["schemas"]):
            mine = ids.where(F.col("segment") > s["number"]) if later else ids
            parts.append(mine.select(F.lit(s["number"]).alias("segment"), _shard(F.col("id"), s["shards"]).alias("shard"), "id"))
        return reduce(DataFrame.unionByName, parts).groupBy("segment", "shard").agg(F.collect_set("id").alias(name))

    def search(self, queries: DataFrame, most: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, rank, score) of the ``most`` best documents of each query (query_id, term), ranked by the score to nine digits and the id. ``allowed`` (id) are the documents that may be seen; frequencies are those of all."""
        q = queries.select("query_id", "term").distinct()
        n, avgdl = self.manifest["documents"], (self.manifest["terms"] / self.manifest["documents"] if self.manifest["documents"] else 0) or 1.0
        wanted = q.select("term").distinct()
        lists = self.lists(wanted)
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = q.join(self.frequencies(wanted, lists).select("term", idf.alias("idf")), "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
        groups = max(1, -(-queries.select("query_id").distinct().count() // GROUP))
        asked = written(asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")), "asked")
        grouped = asked.groupBy("group").agg(F.collect_list(F.struct("query_id", "terms")).alias("queries"))
        shards = self.spark.createDataFrame([(s["number"], s["shards"]) for s in self.manifest["segments"] if "postings" in s["schemas"]], "segment int, shards int")
        cells = grouped.crossJoin(F.broadcast(shards)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")  # a row for each of the segments, which are few
        ids = f"array<{self.manifest['id']}>"
        gone = self._all("gone")
        cells = cells.withColumn("void", F.lit(None).cast(ids)) if gone is None else cells.join(self._by_shard(gone.select("id", "segment"), "void", True), ["segment", "shard"], "left")
        # who may see nothing of a shard has an empty list there, not none
        seen = None if allowed is None else self._by_shard(allowed.select(F.col("id").cast(self.manifest["id"]).alias("id")), "seen")
        cells = cells.withColumn("seen", F.lit(None).cast(ids)) if seen is None else cells.join(seen, ["segment", "shard"], "left").withColumn("seen", F.coalesce("seen", F.array().cast(ids)))
        by = asked.select("group", F.explode("terms.term").alias("term")).distinct()
        keys = ["segment", "shard", "group"]
        dealt = lists.join(by, "term").select(*[F.col(k).alias(k) for k in keys], "term", "ids", "lengths")
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.manifest['id']}, score double"
        scores = dealt.groupBy(*keys).cogroup(cells.select(*keys, "queries", "void", "seen").groupBy(*keys)).applyInArrow(_cell(avgdl, most), schema)
        return ranked(scores.withColumn("__r", F.round("score", 9)), most, "__r").drop("__r")


def _manifests(folder: Folder) -> list[int]:
    return sorted(int(n[9:-5]) for n in folder.names() if n.startswith("manifest-") and n.endswith(".json"))


def opened(spark: SparkSession, path: str, version: str | None = None) -> SavedIndex | None:
    """The index at ``path``; None if there is none, or if it is of another ``version`` of its collection."""
    folder = Folder(spark, path)
    numbers = _manifests(folder)
    if not numbers:
        return None
    m = json.loads(folder.read(f"manifest-{numbers[-1]}.json"))
    return None if m.get("form") != FORM or (version is not None and m["version"] != version) else SavedIndex(spark, folder.path, m)


def _write(df: DataFrame, path: str, buckets: bool = False) -> str:
    (df.write.partitionBy("bucket") if buckets else df.write).parquet(path)
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _inverted(key: tuple, docs: pa.Table) -> pa.Table:
    """The lists of a shard's documents (id, dl, and ``words``: their terms in lines)."""
    docs = docs.filter(pc.greater(docs.column("dl"), 0))
    words, dl = docs.column("words").cast(pa.large_string()).combine_chunks(), docs.column("dl").to_numpy()
    terms = pc.split_pattern(words, "\n").cast(pa.large_list(pa.string()))
    coded = terms.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(docs.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
    order = np.lexsort((row, dl[row], code))
    row, sizes = row[order], np.bincount(code, minlength=len(coded.dictionary))
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    ids = pa.ListArray.from_arrays(offsets, docs.column("id").combine_chunks().take(pa.array(row)))
    lengths = pa.ListArray.from_arrays(offsets, pa.array(dl[row], pa.int32()))
    return pa.table({"term": coded.dictionary, "shard": pa.array(np.full(len(sizes), key[0].as_py()), pa.int32()), "n": pa.array(sizes, pa.int32()), "ids": ids, "lengths": lengths})


def _segment(docs: DataFrame, folder: Folder, name: str) -> tuple[dict, int, int]:
    """Writes the documents (id, terms) and their lists; what the manifest tells of them, and the numbers of documents and terms."""
    at, id_type = f"{folder.path}/{name}", docs.schema["id"].dataType.simpleString()
    schemas = {"documents": _write(docs.select("id", F.size("terms").alias("dl"), "terms"), f"{at}/documents")}
    own = docs.sparkSession.read.schema(schemas["documents"]).parquet(f"{at}/documents")
    size = own.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms")).first()
    shards = max(1, min(size.n // SHARD_LEAST, FEW_SHARDS), -(-size.n // SHARD_MOST))
    shard = _shard(F.col("id"), shards).alias("shard")
    # about as many lists as there are; they are made once, go to their buckets and are written there
    number = own.select(shard, F.explode("terms").alias("term")).agg(F.approx_count_distinct(F.xxhash64("shard", "term"), 0.02).alias("n")).first().n
    buckets = max(1, -(-number // BUCKET_LISTS))
    # a row of one string is half of a row of an array of them
    lines = own.select("id", "dl", F.array_join("terms", "\n").alias("words"), shard)
    lists = lines.groupBy("shard").applyInArrow(_inverted, f"term string, shard int, n int, ids array<{id_type}>, lengths array<int>")
    dealt = lists.withColumn("bucket", _bucket(F.col("term"), buckets)).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "term", "shard")
    schemas["postings"] = _write(dealt, f"{at}/postings", buckets=True)
    return {"folder": name, "buckets": buckets, "shards": shards, "schemas": schemas}, size.n, size.terms


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", T.tokens(F.col("text")).alias("terms"))


def _commit(folder: Folder, number: int, manifest: dict) -> SavedIndex:
    if not folder.put(f"manifest-{number}.json", json.dumps(manifest)):
        raise RuntimeError(f"manifest {number} of {folder.path} was written by another change; open the index anew and repeat this one")
    return SavedIndex(folder.spark, folder.path, manifest)


def built(docs: DataFrame, id_col: str, text_col: str, path: str, version: str = "") -> SavedIndex:
    """A new index of all ``docs`` at ``path``; one that is there is superseded."""
    folder = Folder(docs.sparkSession, path)
    name = f"segment-{uuid.uuid4().hex}"
    segment, n, terms = _segment(_named(docs, id_col, text_col), folder, name)
    manifest = {"form": FORM, "version": version, "id": docs.schema[id_col].dataType.simpleString(), "documents": n, "terms": terms, "segments": [segment | {"number": 0}]}
    return _commit(folder, (_manifests(folder) or [-1])[-1] + 1, manifest)


def ensured(docs: DataFrame, id_col: str, text_col: str, path: str, version: str) -> SavedIndex:
    """The index at ``path`` if it is of this ``version``, else a new one."""
    return opened(docs.sparkSession, path, version) or built(docs, id_col, text_col, path, version)


def changed(index: SavedIndex, docs: DataFrame | None = None, id_col: str = "id", text_col: str = "text", deleted: DataFrame | None = None, version: str = "") -> SavedIndex:
    """The index with ``docs`` added (or replaced, by id) and the ids of ``deleted`` taken out, as one more segment. What was there isn't written again."""
    folder, m = Folder(index.spark, index.path), index.manifest
    name, number = f"segment-{uuid.uuid4().hex}", m["segments"][-1]["number"] + 1
    segment, n, terms = ({"folder": name, "schemas": {}}, 0, 0) if docs is None else _segment(_named(docs, id_col, text_col), folder, name)
    schemas = segment["schemas"]
    at = f"{folder.path}/{name}"
    ids = [x for x in (None if docs is None else docs.select(F.col(id_col).alias("id")), None if deleted is None else deleted.select("id")) if x is not None]
    void = index.documents().join(reduce(DataFrame.unionByName, ids).distinct(), "id", "left_semi")
    schemas["gone"] = _write(void, f"{at}/gone")
    void = index.spark.read.schema(schemas["gone"]).parquet(f"{at}/gone")
    less = void.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms")).first()
    schemas["fewer"] = _write(void.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")), f"{at}/fewer")
    manifest = m | {"version": version or m["version"], "documents": m["documents"] + n - less.n, "terms": m["terms"] + terms - less.terms, "segments": [*m["segments"], segment | {"number": number}]}
    return _commit(folder, _manifests(folder)[-1] + 1, manifest)


def compacted(index: SavedIndex) -> SavedIndex:
    """The same index in one segment. Texts aren't needed: its documents keep their terms. Folders of older segments stay for readers that hold them (``cleaned``)."""
    folder, m = Folder(index.spark, index.path), index.manifest
    name = f"segment-{uuid.uuid4().hex}"
    segment, n, terms = _segment(index.documents(), folder, name)
    return _commit(folder, _manifests(folder)[-1] + 1, m | {"documents": n, "terms": terms, "segments": [segment | {"number": m["segments"][-1]["number"] + 1}]})


def cleaned(index: SavedIndex) -> None:
    """Deletes older manifests and the segments that ``index`` doesn't name. Nobody may be reading them."""
    folder = Folder(index.spark, index.path)
    for n in _manifests(folder)[:-1]:
        folder.delete(f"manifest-{n}.json")
    kept = {s["folder"] for s in index.manifest["segments"]}
    for name in folder.names():
        if name.startswith("segment-") and name not in kept:
            folder.delete(name)
