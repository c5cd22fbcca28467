"""Running a stream over what is there, to a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scholia.sources.tables import checkpointed


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1, in_order_of: str | None = None) -> DataFrame:
    """A table's files as a stream; with ``in_order_of``, those of a copy in the order of that time, so that no row comes after a later one of an earlier batch."""
    path = f"{sf_dir}/{name}.parquet*"  # a pattern, as a table may be a single file
    if in_order_of:
        path = _ordered(spark.read.parquet(path), in_order_of)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _ordered(df: DataFrame, by: str) -> str:
    """A copy in files of disjoint ranges of ``by``, whose times of change have the order of the ranges: a stream takes files by that time."""
    spark = df.sparkSession
    checkpointed(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/ordered-{uuid.uuid4().hex}"
    df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(path)
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f for f in store.listStatus(top) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    first = max((f.getModificationTime() for f in files), default=0) // 1000 - len(files)
    for i, f in enumerate(files):
        store.setTimes(f.getPath(), (first + i) * 1000, -1)
        if store.getFileStatus(f.getPath()).getModificationTime() != (first + i) * 1000:
            raise ValueError("the folder of spark.checkpoint.dir doesn't keep the times of files, so a stream can't take them in order")
    return path


def settled(df: DataFrame, mode: str = "complete", key: str | None = None) -> DataFrame:
    """The stream's result once all that is there has been read: the last batch in complete mode, all batches in the others, or of each ``key`` its row of the last batch that has one. Results and progress go to the shared folder, so that a
    restart goes on where it stopped."""
    spark = df.sparkSession
    checkpointed(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{'all' if mode == 'complete' else f'part={number}'}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}-progress").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if key and mode != "complete":
        parts = spark.read.schema(StructType([*df.schema, StructField("part", LongType())])).option("basePath", root).parquet(f"{root}/part=*")
        return parts.groupBy(key).agg(F.max_by(F.struct(*df.columns), "part").alias("s")).select("s.*")
    out = spark.read.schema(df.schema).parquet(f"{root}/all" if mode == "complete" else f"{root}/part=*")
    return out
