"""Chunk tables: upsert, replacement by source, deletion, listings, ledgers and versions. Tables are DataFrames; callers write the result to a new path or partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import predicates as P


def chunk_id(source: Column, page: Column, index: Column) -> Column:
    return F.md5(F.concat_ws("|", source, page.cast("string"), index.cast("string")))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with the rows of ``new``: by ``key``, and within ``new`` the last by ``order``."""
    last = new.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def replaced(old: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """``old`` with all rows of the sources in ``new`` exchanged for those of ``new``."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def stale(old: DataFrame, new: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Rows of ``old`` of a source in ``new`` that ``new`` no longer has."""
    return old.join(new.select(source).distinct(), source, "left_semi").join(new.select(key), key, "left_anti")


def deleted(df: DataFrame, where: dict[str, Any]) -> DataFrame:
    """``df`` without the rows of a predicate; an empty one is refused, as it would take all."""
    if not where:
        raise ValueError("a deletion needs a predicate")
    return df.where(~P.compiled(where))


def health(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Rows and the least and largest dimension per group, and whether they agree."""
    g = df.groupBy(group).agg(F.count("*").alias("rows"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"))
    return g.withColumn("healthy", F.col("min_dim") == F.col("max_dim"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of sorted chunks (source, title, text), one source after another."""
    now, told = None, None  # the source, and its title, count and hash so far
    for b in batches:
        done = []
        for source, title, text in zip(*(c.to_pylist() for c in b.columns)):
            if told is None or source != now:
                done += [(now, *told[:2], told[2].hexdigest())] if told else []
                now, told = source, [None, 0, hashlib.sha256(), False]
            told[0] = title if told[0] is None or (title is not None and title < told[0]) else told[0]
            told[1] += 1
            if text is not None:
                told[2].update((b"\n" if told[3] else b"") + text.encode("utf-8", "surrogatepass"))
                told[3] = True
        yield _records(done)
    yield _records([(now, *told[:2], told[2].hexdigest())] if told else [])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], ["source", "title", "chunk_count", "doc_hash"])


def ledger(chunks: DataFrame) -> DataFrame:
    """One record per source: title, chunk count and SHA-256 of its texts in order, joined by line feeds.

    A hash runs over a source from its first text to its last, so a task reads the sources it has one after another, a batch of sorted rows at a time; no source is held whole."""
    rows = chunks.select("source", "title", "chunk_index", "text").repartition("source").sortWithinPartitions("source", "chunk_index", "text")
    return rows.select("source", "title", "text").mapInArrow(_hashed, "source string, title string, chunk_count bigint, doc_hash string")


def reconciled(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources without a record, records without chunks, and records whose count is wrong."""
    have = chunks.groupBy("source").agg(F.count("*").alias("actual"))
    both = records.select("source", F.col("chunk_count").alias("recorded")).join(have, "source", "full_outer")
    problem = F.when(F.col("recorded").isNull(), "unregistered").when(F.col("actual").isNull(), "missing").when(F.col("recorded") != F.col("actual"), "count")
    return both.withColumn("problem", problem).where("problem is not null")


def versions(snapshots: DataFrame, key: str = "doc", order: str = "seq", content_hash: str = "doc_hash") -> DataFrame:
    """Snapshots that differ from the one before, numbered from 1."""
    w = W.partitionBy(key).orderBy(order)
    new = snapshots.withColumn("__p", F.lag(content_hash).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.col(content_hash))).drop("__p")
    return new.withColumn("version", F.row_number().over(w))


def pruned(numbered: DataFrame, keep: int, key: str = "doc") -> DataFrame:
    return numbered.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("version")))).where(F.col("__r") <= keep).drop("__r")


def registered(records: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``records`` with those of ``found`` that it lacks."""
    return records.unionByName(found.join(records.select(key), key, "left_anti"))


def cascade(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")
