"""A folder of files kept in a table of chunks: what is new, what has changed, what is gone.

New files come by a stream, whose checkpoint remembers what it has seen; a stream never takes a file twice, so files that changed are found by comparing the folder's listing (no contents are read for it) with the ledger. Either way a batch
of files is fingerprinted, those whose fingerprint the ledger has are skipped, the others are parsed, enriched, cut into chunks and put in the place of their sources' old chunks; the ledger is changed within
the same commit. A batch that is repeated after a failure finds its fingerprints in the ledger, or puts the same rows again; where a process died between the commit of the ledger and that of the chunks, the chunks are put back when the table is
opened next, and the ledger forgets the fingerprints of their buckets, so that ``refresh`` takes their files again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import splitting as X
from scholia.functions import text as T
from scholia.operators import ingest as I
from scholia.operators import source_store as S
from scholia.operators.store import chunk_id
from scholia.sources import files as R
from scholia.sources.tables import qualified, written

CHUNKS = "id string, source string, title string, breadcrumb string, acl string, doc_status string, page int, chunk_index int, text string"
LEDGER = "source string, modified timestamp, size bigint, fingerprint string, chunks bigint"


class FolderTable:
    """The chunks of a folder's files, and the ledger of its files by their path below the folder (``source``)."""

    def __init__(self, spark: SparkSession, folder: str, path: str, buckets: int = 16, size: int = 400, overlap: int = 50):
        self.spark, self.folder, self.size, self.overlap = spark, qualified(spark, folder.rstrip("/")), size, overlap
        self.path = qualified(spark, path.rstrip("/"))
        self.chunks = S.opened(spark, f"{self.path}/chunks") or S.created(spark, f"{self.path}/chunks", CHUNKS, buckets)
        self.ledger = S.opened(spark, f"{self.path}/ledger") or S.created(spark, f"{self.path}/ledger", LEDGER, buckets)
        if self.chunks.restored:
            doubtful = self.ledger.rows().where(self.chunks.bucket(F.col("source")).cast("string").isin(list(self.chunks.restored)))
            self.ledger.replace(written(doubtful.withColumns({"modified": F.lit(None).cast("timestamp"), "fingerprint": F.lit("")}), "doubtful"))

    def _source(self, path: Column) -> Column:
        """A file's path below the folder, whether or not its scheme is written with an empty authority."""
        plain = F.regexp_replace(path, "^file:/+", "file:/")
        return F.substring(plain, len(self.folder.replace("file:///", "file:/")) + 2, 1 << 20)

    def _files(self, *paths: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths) or [self.folder])

    def listing(self) -> DataFrame:
        """(path, source, modified, size) of the files of known formats; contents aren't read."""
        found = self._files().select("path", self._source(F.col("path")).alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
        return found.where(R.extension(F.col("path")).isin([*R.PARSERS, *R.BINARY_PARSERS]))

    def put(self, files: DataFrame) -> list[str]:
        """Takes a batch of files (path, modificationTime, length, content). The sources that were new or different."""
        told = files.select("path", self._source(F.col("path")).alias("source"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", R.fingerprint(F.col("content")).alias("fingerprint"))
        told = told.where(R.extension(F.col("path")).isin([*R.PARSERS, *R.BINARY_PARSERS]))
        marks = written(told.select("path", "source", "modified", "size", "fingerprint"), "marks")
        fresh = written(marks.join(self.ledger.rows().select("source", "fingerprint"), ["source", "fingerprint"], "left_anti"), "fresh")
        again = marks.join(fresh.select("source"), "source", "left_anti")
        rows = written(self._cut(told.join(fresh.select("path"), "path", "left_semi")), "cut")
        counts = rows.groupBy("source").agg(F.count("*").alias("chunks"))
        new = fresh.join(counts, "source", "left").select("source", "modified", "size", "fingerprint", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
        touched = self.ledger.rows().select("source", "chunks").join(again.select("source", "modified", "size", "fingerprint"), "source").select("source", "modified", "size", "fingerprint", "chunks")
        ledger = written(new.unionByName(touched), "entries")
        if fresh.isEmpty():
            if not ledger.isEmpty():
                self.ledger.replace(ledger)  # times of files whose contents are the same
            return []
        self.chunks.replace(rows, fresh.select("source"), on_commit=lambda: self.ledger.replace(ledger))
        return sorted(r.source for r in fresh.select("source").collect())  # as many as a batch has files

    def _cut(self, told: DataFrame) -> DataFrame:
        raw = R.parsed_files(told).join(told.select("path", "source", "modified"), "path")
        sections = I.enriched(raw.select("source", F.col("content").alias("raw"), F.col("modified").alias("updated_at")))
        cut = sections.select("source", "title", "breadcrumb", "acl", "doc_status", "page", F.posexplode(X.chunk_column("content", "sentences", size=self.size, overlap=self.overlap)).alias("chunk_index", "text")).where(T.strip(F.col("text")) != "")
        return cut.select(chunk_id(F.col("source"), F.col("page"), F.col("chunk_index")).alias("id"), "source", "title", "breadcrumb", "acl", "doc_status", F.col("page").cast("int").alias("page"), F.col("chunk_index").cast("int").alias("chunk_index"), "text")

    def changed(self) -> DataFrame:
        """(path) of the files that the ledger knows with another time or size."""
        known = self.ledger.rows().select("source", F.col("modified").alias("__m"), F.col("size").alias("__s"))
        return self.listing().join(known, "source").where(~F.col("modified").eqNullSafe(F.col("__m")) | (F.col("size") != F.col("__s"))).select("path")

    def refresh(self, files_per_batch: int = 1000) -> list[str]:
        """Takes the files that have changed, some at a time. The sources that are different."""
        paths: Iterator[str] = (r.path for r in self.changed().toLocalIterator())
        out: list[str] = []
        while some := list(islice(paths, files_per_batch)):
            out += self.put(self._files(*some))
        return sorted(out)

    def forget(self) -> list[str]:
        """Takes out the sources whose files are gone."""
        gone = written(self.ledger.rows().select("source").join(self.listing().select("source"), "source", "left_anti"), "gone")
        if gone.isEmpty():
            return []
        self.chunks.remove(gone, on_commit=lambda: self.ledger.remove(gone))
        return sorted(r.source for r in gone.collect())

    def follow(self, files_per_batch: int = 1000, once: bool = True):
        """Takes new files by a stream whose checkpoint lies beside the table: all that are there and then no more, or (``once=False``) on and on; the running stream in that case."""
        taken: list[str] = []
        schema = self._files().schema
        stream = self.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(self.folder)
        query = stream.writeStream.option("checkpointLocation", f"{self.path}/seen").foreachBatch(lambda batch, _: taken.extend(self.put(batch)))
        if not once:
            return query.trigger(processingTime="30 seconds").start()
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(taken)
