"""A table of rows by source whose sources are replaced as a whole: all of a change is seen, or nothing.

Rows lie in buckets by the hash of their source; a bucket has generations, and a manifest (one small file, put in place by a rename; the one of the highest number counts) tells which generation of each is
read. A change writes new generations of the buckets that hold its sources, beside those that are read, then puts a manifest that names them, marked as pending with what was before, then calls the ``on_commit`` hook (for a ledger
elsewhere, say), and at last a manifest without the mark. If a step fails, a manifest with the generations of before is put and the new ones are deleted; the error goes on. If the process dies, whoever opens the table next finds the mark
and does the same; so there is one writer at a time. What is read is a bucket's whole generation, so readers of an older manifest go on until ``cleaned``.

The number of buckets is fixed when the table is made: a change rewrites its buckets, which should be some hundred megabytes each. Rows without a source aren't taken.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholia.sources.tables import Folder


class RestoreFailed(RuntimeError):
    """A change failed, and so did putting back what was before."""


def _numbers(folder: Folder) -> list[int]:
    return sorted(int(n[9:-5]) for n in folder.names() if n.startswith("manifest-") and n.endswith(".json"))


@dataclass
class SourceStore:
    spark: SparkSession
    folder: Folder
    number: int
    manifest: dict
    #: Buckets that were put back when the table was opened. What else was changed with them may have to be taken back too.
    restored: tuple[str, ...] = ()

    def bucket(self, source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(self.manifest["buckets"])).cast("int")

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest["schema"])

    def _read(self, buckets: list[str] | None = None) -> DataFrame:
        """Rows of the generations that are read; ``buckets``: only of these."""
        paths = [f"{self.folder.path}/{g}" for b, g in sorted(self.manifest["generations"].items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self, sources: list[str] | None = None) -> DataFrame:
        """All rows, or those of a few sources, for which only their buckets are read."""
        if sources is None:
            return self._read()
        given = self.spark.createDataFrame([(s,) for s in sources], "source string")
        return self._read([str(r.b) for r in given.select(self.bucket(F.col("source")).alias("b")).distinct().collect()]).where(F.col("source").isin(sources))

    def _put(self, generations: dict, before: dict | None = None) -> None:
        manifest = self.manifest | {"generations": generations, "before": before}
        if not self.folder.put(f"manifest-{self.number + 1}.json", json.dumps(manifest)):
            raise RuntimeError(f"manifest {self.number + 1} of {self.folder.path} was written by another change; open the table anew and repeat this one")
        self.number, self.manifest = self.number + 1, manifest

    def replace(self, rows: DataFrame, sources: DataFrame | None = None, on_commit: Callable[[], None] | None = None) -> None:
        """All rows of ``sources`` (source; those of ``rows`` unless given, and these too) exchanged for ``rows``. A source without new rows is gone afterwards. As the buckets touched are known from ``sources`` alone, ``rows`` is
        evaluated once."""
        rows = rows.select(*self.schema.names).where("source is not null")
        named = rows.select("source") if sources is None else sources.select("source").where("source is not null")
        named = named.distinct()
        before, change = self.manifest["generations"], f"change-{uuid.uuid4().hex}"
        try:
            buckets = [str(r.b) for r in named.select(self.bucket(F.col("source")).alias("b")).distinct().collect()]  # no more than the table has
            kept = self._read(buckets).join(named, "source", "left_anti").select(*self.schema.names)
            both = kept.unionByName(rows).withColumn("__bucket", self.bucket(F.col("source")))
            both.repartitionByRange("__bucket", "source").write.partitionBy("__bucket").parquet(f"{self.folder.path}/{change}")
            written = {n.split("=")[1]: f"{change}/{n}" for n in self.folder.names(change) if n.startswith("__bucket=")}
            strays = set(written) - set(buckets)
            if strays:
                raise ValueError("there are rows of sources that aren't among those to be replaced")
            self._put({b: g for b, g in before.items() if b not in buckets} | written, before)
            if on_commit is not None:
                on_commit()
            self._put(self.manifest["generations"])
        except Exception as error:
            self._restore(before, change, error)
            raise

    def _restore(self, before: dict, change: str, error: Exception) -> None:
        try:
            if self.manifest["generations"] != before:
                self._put(before)
            self.folder.delete(change)
        except Exception as other:
            raise RestoreFailed(f"the change failed ({error}), and what was before couldn't be put back ({other}); the last good manifest of {self.folder.path} is in the pending one under 'before'") from error

    def remove(self, sources: DataFrame, on_commit: Callable[[], None] | None = None) -> None:
        self.replace(self.spark.createDataFrame([], self.schema), sources, on_commit)

    def cleaned(self) -> None:
        """Deletes older manifests and generations that aren't read. Nobody may be reading them."""
        for n in _numbers(self.folder)[:-1]:
            self.folder.delete(f"manifest-{n}.json")
        read = set(self.manifest["generations"].values())
        for change in self.folder.names():
            if change.startswith("change-"):
                parts = [f"{change}/{n}" for n in self.folder.names(change) if n.startswith("__bucket=")]
                for p in parts:
                    if p not in read:
                        self.folder.delete(p)
                if not any(p in read for p in parts):
                    self.folder.delete(change)


def created(spark: SparkSession, path: str, schema: str, buckets: int = 16) -> SourceStore:
    """An empty table at ``path``; its rows have a string column ``source``."""
    folder = Folder(spark, path)
    manifest = {"buckets": buckets, "schema": json.loads(spark.createDataFrame([], schema).schema.json()), "generations": {}, "before": None}
    if not folder.put("manifest-0.json", json.dumps(manifest)):
        raise ValueError(f"there is a table at {folder.path}")
    return SourceStore(spark, folder, 0, manifest)


def opened(spark: SparkSession, path: str) -> SourceStore | None:
    """The table at ``path``; None if there is none. A change that was broken off is taken back first."""
    folder = Folder(spark, path)
    numbers = _numbers(folder)
    if not numbers:
        return None
    store = SourceStore(spark, folder, numbers[-1], json.loads(folder.read(f"manifest-{numbers[-1]}.json")))
    before, after = store.manifest["before"], store.manifest["generations"]
    if before is not None:
        store._put(before)
        store.restored = tuple(sorted(b for b in {*before, *after} if before.get(b) != after.get(b)))
    return store
