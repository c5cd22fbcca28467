"""A saved inverted file of vectors: cells around centroids, of which a search reads those nearest to each query.

The centroids are fitted on a bounded sample (``sample`` rows, the smallest hashes of ids), by rounds of spherical k-means; every row is then assigned to its nearest one. A cell's rows lie in blocks, in a folder of the cell, so that a search
reads only the cells it asks for. Each query asks for as many of its nearest cells as hold ``share`` of all rows together, three at least; what is read is scored exactly. With ``share=1`` all cells are
read, and the result is that of ``retrieval.vector_topk``.

Rows with a null vector, with null or non-finite components, or with another length than the first sampled one aren't in the index; a zero vector is, with a similarity of 0 to all. Of rows of one id all are kept. An empty table makes an empty index.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.sources.tables import Folder, spread, written_path

from .retrieval import _unit_rows, best_rows, ranked

BLOCK = 2048


def _matrix(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dims)


def fitted(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows. It starts from rows spread over the sample; an empty cell takes the row that its own centroid fits worst."""
    c = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)].copy()
    for _ in range(rounds):
        s = sample @ c.T
        own = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        none = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[none] = sample[np.argsort(s.max(1), kind="stable")[: len(none)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = sums / np.where(norms == 0, 1, norms)
    return c


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = (_unit_rows(b.column("v")) @ centroids.T).argmax(1)
                yield pa.record_batch([pa.array(cell, pa.int32()), b.column("id"), b.column("v")], ["cell", "id", "v"])

    return run


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to blocks of one cell, as unit vectors."""
    held: dict[int, list[pa.RecordBatch]] = {}

    def out(cell: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held.pop(cell)).combine_chunks()
        ids, v = t.column("id").combine_chunks(), _unit_rows(t.column("v").combine_chunks())
        return pa.record_batch([pa.array([cell], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v.astype("<f8").tobytes()], pa.binary()), pa.array([len(ids)], pa.int64())], ["cell", "ids", "vectors", "n"])

    for b in batches:
        cells = b.column("cell").to_numpy(zero_copy_only=False)
        for at in np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else []:
            cell, end = int(cells[at]), int(np.searchsorted(cells, cells[at], side="right"))
            for other in [c for c in held if c != cell]:
                yield out(other)
            for i in range(int(at), end, BLOCK):
                held.setdefault(cell, []).append(b.slice(i, min(BLOCK, end - i)))
                if sum(x.num_rows for x in held[cell]) >= BLOCK:
                    yield out(cell)
    for cell in list(held):
        yield out(cell)


def _probes(centroids: np.ndarray, sizes: np.ndarray, share: float, least: int):
    """Queries to the cells they ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = np.argsort(-(_unit_rows(b.column("v")) @ centroids.T), axis=1, kind="stable")
            before = np.cumsum(sizes[near], 1) - sizes[near]
            asks = (before < share * sizes.sum()) | (np.arange(near.shape[1]) < least)
            asks &= sizes[near] > 0
            row, at = np.nonzero(asks)
            yield pa.record_batch([pa.array(near[row, at], pa.int32()), *[b.column(c).take(pa.array(row)) for c in ("query_id", "v")]], ["cell", "query_id", "v"])

    return run


def _scored(dims: int, most: int, folder: str, block: int):
    """Blocks (cell, ids, vectors) with the queries that ask for their cell, which lie in ``folder`` by cell and are read in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for i in range(b.num_rows):
                ids = b.column("ids")[i].values
                order = pa.compute.sort_indices(ids)  # ties go to the smaller id
                vectors = _matrix(b.column("vectors")[i].as_py(), dims)[order.to_numpy()]
                asked = dataset.dataset(f"{root}/cell={b.column('cell')[i].as_py()}", filesystem=store, format="parquet", exclude_invalid_files=True)
                yield from best_rows(asked.to_batches(batch_size=block, batch_readahead=1, fragment_readahead=1), ids.take(order), vectors, most)

    return run


@dataclass(frozen=True)
class SavedVectors:
    spark: SparkSession
    path: str
    manifest: dict

    def _centroids(self) -> tuple[np.ndarray, np.ndarray]:
        rows = self.spark.read.schema("cell int, centroid binary, n bigint").parquet(f"{self.path}/{self.manifest['folder']}/centroids").orderBy("cell").collect()  # at most ``cells`` of them
        return np.concatenate([_matrix(bytes(r.centroid), self.manifest["dims"]) for r in rows] or [np.empty((0, self.manifest["dims"]))]), np.array([r.n for r in rows], np.int64)

    def _blocks(self) -> DataFrame:
        return self.spark.read.schema(self.manifest["schema"]).parquet(f"{self.path}/{self.manifest['folder']}/blocks")

    def asked(self, queries: DataFrame, share: float = 0.1, least: int = 3) -> DataFrame:
        """(cell, query_id, v): the cells that each query (query_id, embedding) asks for."""
        centroids, sizes = self._centroids()
        kind = queries.schema["query_id"].dataType.simpleString()
        vector = queries.schema["embedding"].dataType.simpleString()
        queries = queries if sizes.sum() else queries.where("false")  # an empty index has no length of vectors
        return queries.select("query_id", F.col("embedding").alias("v")).mapInArrow(_probes(centroids, sizes, share, least), f"cell int, query_id {kind}, v {vector}")

    def share_read(self, queries: DataFrame, share: float = 0.1, least: int = 3) -> float:
        """The mean part of the index's rows that is scored for a query."""
        _, sizes = self._centroids()
        counts = self.asked(queries, share, least).groupBy("cell").agg(F.count("*").alias("q")).collect()
        return float(sum(int(sizes[r.cell]) * r.q for r in counts)) / max(1, queries.count() * int(sizes.sum()))

    def search(self, queries: DataFrame, most: int, share: float = 0.1, least: int = 3, group: int = 512) -> DataFrame:
        """(query_id, id, rank, score) of the ``most`` best by cosine among the cells that each query asks for. The asking queries are written by cell to the shared folder;
        a task takes them from there for each of its blocks, ``group`` at a time, so that neither is copied for the other."""
        asked = self.asked(queries, share, least)
        folder = written_path(asked, "asked", "cell")
        cells = [r.cell for r in self.spark.read.schema(asked.schema).parquet(folder).select("cell").distinct().collect()]  # no more than the index has
        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self.manifest['id']}, score double"
        blocks = spread(self._blocks().where(F.col("cell").isin(cells)).select("cell", "ids", "vectors"))
        return ranked(blocks.mapInArrow(_scored(self.manifest["dims"], most, folder, group), schema), most)


def built(df: DataFrame, id_col: str, vector_col: str, path: str, version: str = "", cells: int | None = None, sample: int = 20_000, most_cells: int = 4096) -> SavedVectors:
    """A new index at ``path``. ``cells``: about the root of the number of rows unless given, ``most_cells`` and a tenth of the sample at most."""
    spark, folder, name = df.sparkSession, Folder(df.sparkSession, path), f"cells-{uuid.uuid4().hex}"
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & (F.size("v") > 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    dims = len(taken[0].v) if taken else 1
    drawn = np.array([r.v for r in taken if len(r.v) == dims], np.float64).reshape(-1, dims)
    norms = np.linalg.norm(drawn, axis=1, keepdims=True)
    rows = rows.where(F.size("v") == dims)
    many = max(1, min(cells or int(rows.count() ** 0.5), most_cells, max(1, len(drawn) // 10)))
    centroids = fitted(drawn / np.where(norms == 0, 1, norms), many) if len(drawn) else np.zeros((1, dims))
    id_type = df.schema[id_col].dataType.simpleString()
    placed = rows.mapInArrow(_assigned(centroids), f"cell int, id {id_type}, v array<double>").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id")
    schema = f"cell int, ids array<{id_type}>, vectors binary, n bigint"
    placed.mapInArrow(_blocked, schema).write.partitionBy("cell").parquet(f"{folder.path}/{name}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{folder.path}/{name}/blocks")
    counts = {r.cell: r.n for r in blocks.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    spark.createDataFrame([(i, bytearray(c.astype("<f8").tobytes()), counts.get(i, 0)) for i, c in enumerate(centroids)], "cell int, centroid binary, n bigint").coalesce(1).write.parquet(f"{folder.path}/{name}/centroids")
    manifest = {"version": version, "dims": dims, "id": id_type, "folder": name, "schema": schema, "cells": many, "sample": len(drawn)}
    number = max([int(n[9:-5]) for n in folder.names() if n.startswith("manifest-")], default=-1) + 1
    if not folder.put(f"manifest-{number}.json", json.dumps(manifest)):
        raise RuntimeError(f"manifest {number} of {folder.path} was written by another")
    return SavedVectors(spark, folder.path, manifest)


def opened(spark: SparkSession, path: str, version: str | None = None) -> SavedVectors | None:
    folder = Folder(spark, path)
    numbers = sorted(int(n[9:-5]) for n in folder.names() if n.startswith("manifest-"))
    if not numbers:
        return None
    m = json.loads(folder.read(f"manifest-{numbers[-1]}.json"))
    return None if version is not None and m["version"] != version else SavedVectors(spark, folder.path, m)


def ensured(df: DataFrame, id_col: str, vector_col: str, path: str, version: str, **options) -> SavedVectors:
    """The index at ``path`` if it is of this ``version``, else a new one."""
    return opened(df.sparkSession, path, version) or built(df, id_col, vector_col, path, version, **options)
