"""A graph built from extraction outputs, source by source: what is in stays, what changed is merged anew, and a build that was broken off goes on.

Four tables of replaceable sources lie beside one another: the mentions that each source's outputs hold, the merged entities and relations (by name, and by the name they begin at), and the progress (a fingerprint of each source's
outputs). A batch takes the sources whose fingerprint is new; their mentions are replaced, and the entities and relations whose mentions were or are among them are merged from all their mentions, in the order of source and place, so that the graph is
the same in whatever order and in however many batches its sources came. All of it is one commit: each table's change is the hook of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.records import salvaged
from scholia.sources.tables import qualified, written

from . import graph as G
from . import source_store as S

OUTPUT = "entities array<struct<name:string,type:string,description:string,aliases:array<string>>>, relations array<struct<source:string,target:string,type:string,description:string,weight:double>>"
MENTIONS = "source string, place struct<source:string,seq:bigint,n:int>, name string, target string, type string, description string, aliases array<string>, weight double"
ENTITIES = "source string, type string, description string, aliases array<string>"
RELATIONS = "source string, target string, type string, description string, weight double"
PROGRESS = "source string, fingerprint string, outputs bigint, mentions bigint"


class GraphTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, most_entities: int = 20, most_relations: int = 30):
        """Opened, or made where there is none. Of an output the first ``most_entities`` and ``most_relations`` are taken."""
        self.spark, self.most_entities, self.most_relations = spark, most_entities, most_relations
        path = qualified(spark, path.rstrip("/"))
        of = lambda name, schema: S.opened(spark, f"{path}/{name}") or S.created(spark, f"{path}/{name}", schema, buckets)
        self.mentions, self._entities, self._relations, self.progress = of("mentions", MENTIONS), of("entities", ENTITIES), of("relations", RELATIONS), of("progress", PROGRESS)
        if self.mentions.restored:  # a process died: what was merged may be ahead of the mentions
            doubtful = self.progress.rows().where(self.mentions.bucket(F.col("source")).cast("string").isin(list(self.mentions.restored))).select("source")
            names = self._names(self.mentions.rows()).union(self._entities.rows().select("source")).union(self._relations.rows().select("source"))
            self._merge(written(names.distinct(), "names"), lambda: self.progress.remove(written(doubtful, "doubtful")))

    def _names(self, mentions: DataFrame) -> DataFrame:
        return mentions.select(F.col("name").alias("source")).distinct()

    def _read(self, outputs: DataFrame) -> DataFrame:
        """Mentions of outputs (source, seq, raw). What can't be read, names that are empty and relations without an end are left out."""
        j = outputs.select("source", "seq", salvaged(F.col("raw"), OUTPUT).alias("j"))
        text = lambda c: F.trim(F.coalesce(c, F.lit("")))
        place = F.struct("source", "seq", "n").alias("place")
        e = j.select("source", "seq", F.posexplode(F.slice("j.entities", 1, self.most_entities)).alias("n", "x"))
        e = e.select("source", place, text(F.col("x.name")).alias("name"), F.lit(None).cast("string").alias("target"), "x.type", "x.description", F.coalesce("x.aliases", F.array().cast("array<string>")).alias("aliases"), F.lit(None).cast("double").alias("weight"))
        r = j.select("source", "seq", F.posexplode(F.slice("j.relations", 1, self.most_relations)).alias("n", "x"))
        r = r.select("source", place, text(F.col("x.source")).alias("name"), text(F.col("x.target")).alias("target"), F.coalesce(F.nullif(text(F.col("x.type")), F.lit("")), F.lit("RELATED_TO")).alias("type"), F.coalesce("x.description", F.lit("")).alias("description"), F.lit(None).cast("array<string>").alias("aliases"), F.coalesce("x.weight", F.lit(1.0)).alias("weight"))
        return e.where("name <> ''").unionByName(r.where("name <> '' and target <> ''"))

    def add(self, outputs: DataFrame) -> list[str]:
        """Takes the outputs (source, seq, raw) of some sources, all of each. The sources that were new or different."""
        told = outputs.groupBy("source").agg(F.concat_ws("-", F.count("*"), F.sum(F.xxhash64("seq", "raw").cast("decimal(38,0)")), F.bit_xor(F.hash("seq", "raw"))).alias("fingerprint"), F.count("*").alias("outputs"))
        fresh = written(told.join(self.progress.rows().select("source", "fingerprint"), ["source", "fingerprint"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return []
        sources = fresh.select("source")
        new = written(self._read(outputs.join(sources, "source", "left_semi")), "mentions")
        old = self.mentions.rows().join(sources, "source", "left_semi")
        names = written(self._names(new).union(self._names(old)).distinct(), "names")
        counts = new.groupBy("source").agg(F.count("*").alias("mentions"))
        progress = written(fresh.join(counts, "source", "left").select("source", "fingerprint", "outputs", F.coalesce("mentions", F.lit(0)).alias("mentions")), "progress")
        self.mentions.replace(new, sources, on_commit=lambda: self._merge(names, lambda: self.progress.replace(progress)))
        return sorted(r.source for r in sources.collect())  # as many as the batch has

    def _merge(self, names: DataFrame, on_commit) -> None:
        """Merges the entities and relations of ``names`` (source) anew from all their mentions."""
        mine = self.mentions.rows().join(names.select(F.col("source").alias("name")), "name", "left_semi")
        entities = G.merged_entities(mine.where("target is null").select("name", "type", "description", "aliases", "place"), "place").withColumnRenamed("name", "source")
        relations = G.last_relations(mine.where("target is not null").select(F.col("name").alias("source"), "target", "type", "description", "weight", "place"), "place")
        entities, relations = written(entities, "merged"), written(relations, "merged")
        self._entities.replace(entities, names, on_commit=lambda: self._relations.replace(relations, names, on_commit=on_commit))

    def relations(self) -> DataFrame:
        return self._relations.rows()

    def entities(self) -> DataFrame:
        """(name, type, description), also for ends of relations that no entity was told of."""
        return G.with_endpoints(self._entities.rows().withColumnRenamed("source", "name"), self.relations())
