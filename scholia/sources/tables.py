"""Reading the tables of a data folder, tables written to the shared folder on the way, and folders by their whole address."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of long rows, whose work is in each row.
LONG = frozenset({"documents", "pages"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LONG else df


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Arrow batches of at most ``rows`` rows from here on: texts may be long, and a batch is held by the executor and by its Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out anew if it is scanned in fewer parts than there are cores, as one small file of long texts is: it would be worked on by one core. Columns and filters still reach the scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def version(df: DataFrame) -> str:
    """What the files behind ``df`` are told apart by: their places, sizes and times of change. No column is read."""
    of = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    r = df.select(of.alias("h")).groupBy("h").agg(F.count("*").alias("n")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.count("*").alias("files")).first()
    return f"{r.files} files, {r.n} rows, {r.s}"


def checkpointed(spark: SparkSession) -> None:
    """Makes sure of a folder for checkpoints: spark.checkpoint.dir, or where it is unset, as on one machine, a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and store. Spark takes a path without them from its default store; other readers would take it from their own machine."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, with scheme and store."""
    checkpointed(spark)
    return qualified(spark, (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()).rstrip("/"))


def written_path(df: DataFrame, name: str, *by: str) -> str:
    """Writes ``df`` as Parquet to the folder of checkpoints, which all executors share, in folders of the values of ``by``, and tells where."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.repartition(*by).write.partitionBy(*by) if by else df.write).parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, for tables that are used more than once. A lost executor loses nothing of it."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, name))


class Folder:
    """A folder of any store that Spark knows, for the small files and renames that tables of several parts need."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, qualified(spark, path)
        self.store = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(f.getPath().getName() for f in self.store.listStatus(at)) if self.store.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.store.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a small file under another name and renames it, so that it is there in whole or not at all. False if one of that name was there first."""
        other = f".{name.replace('/', '-')}-{uuid.uuid4().hex}"
        stream = self.store.create(self._at(other), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return self.moved(other, name)

    def moved(self, old: str, new: str) -> bool:
        to = self._at(new)
        if self.store.exists(to):
            return False
        self.store.mkdirs(to.getParent())
        return bool(self.store.rename(self._at(old), to))

    def exists(self, name: str) -> bool:
        return bool(self.store.exists(self._at(name)))

    def delete(self, name: str = "") -> None:
        self.store.delete(self._at(name), True)
