"""What the operators of this subpackage share: table access, the shared folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of long rows, whose work is in each row.
LONG = frozenset({"documents", "pages"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, for the queries here: they set small Arrow batches. A table of long rows that is scanned in fewer parts than there are cores, as one small file is, is dealt out anew."""
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in LONG and df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Arrow batches of at most ``rows`` rows from here on: texts may be long, and a batch is held by the executor and by its Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset (tests on one machine), a new temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return qualified(spark, found.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and store. Spark takes a path without them from its default store; pyarrow would take it from each executor's own disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage is cut, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's key of 128 bits, from its content alone, so that a recomputed task gives the same. Rows equal in id and text are one document; a null text is the empty one."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null")), F.lit("\x00"), F.coalesce(F.col(text_col), F.lit("")))))


def text_bytes(text_col: str = "text") -> Column:
    return F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long"))


def most_frequent_rows(df: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of the largest counts, ``most`` at most: those above the least bound (in steps of a twelfth) that so many rows pass. Only the few numbers
    of rows per step go to the driver."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 6)
    steps = sorted(df.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s)
    total, least = 0, None
    for r in steps:
        total += r.n
        if total > most:
            break
        least = r.s
    return df.where(F.lit(False)) if least is None else df.where(step >= least)


#: A filter of keys is never larger than this (8 MB), which is enough for some seven million keys.
MOST_BITS = 1 << 26


class KeyFilter:
    """A Bloom filter: four bits for each key among ten bits a key or more, a power of two of them."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.bits = packed, 8 * len(packed)

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Whether each of the unsigned 64-bit hashes may be a key: true for all keys and for some two in a hundred others."""
        x = np.ascontiguousarray(x, np.uint64)
        found = np.arange(len(x))
        for i in range(4):
            at = (x[found] >> np.uint64(32)) * np.uint64(i) + x[found]
            at &= np.uint64(self.bits - 1)
            found = found[(self.packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(x), bool)
        out[found] = True
        return out


def key_filter(hashes: DataFrame, most_bits: int = MOST_BITS) -> KeyFilter | None:
    """The filter of a table of one bigint column, made on the executors; None where the keys are too many for ``most_bits``. Only the set bits go to the driver."""
    name = hashes.columns[0]
    n = hashes.count()
    bits = max(1 << 10, 1 << (10 * n).bit_length())
    if bits > most_bits:
        return None
    low = F.pmod(F.col(name), F.lit(bits))
    high = F.pmod(F.shiftrightunsigned(name, 32), F.lit(bits))
    places = hashes.select(F.explode(F.array(*[F.pmod(low + i * high, F.lit(bits)) for i in range(4)])).alias("at"))
    words = places.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 32) AS int))")).alias("ones")).toPandas()
    packed = np.zeros(bits >> 5, "<u4")
    packed[words["word"].to_numpy(np.int64)] = words["ones"].to_numpy(np.int64).astype(np.uint32)
    return KeyFilter(packed.view(np.uint8))


def _held(keys: KeyFilter):
    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        return pa.array(keys.holds(h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))

    return held


def without_keys(rows: DataFrame, key: str, gone: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``gone``. Those that a filter of the keys tells at once aren't shuffled; where the keys are too many for it, all rows are."""
    keys = key_filter(gone.select(F.xxhash64(key)), most_bits)
    if keys is None:
        return rows.join(gone, key, "left_anti").select(*rows.columns)
    held = _held(keys)(F.xxhash64(key))
    return rows.where(~held).unionByName(rows.where(held).join(gone, key, "left_anti").select(*rows.columns))


def with_keys(rows: DataFrame, key: str, wanted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` joined to ``wanted`` by ``key``. Rows that a filter of the keys tells to have no partner aren't shuffled; where the keys are too many for it, all rows are."""
    keys = key_filter(wanted.select(F.xxhash64(key)), most_bits)
    return (rows if keys is None else rows.where(_held(keys)(F.xxhash64(key)))).join(wanted, key)


def with_some(rows: DataFrame, key: str, found: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` with the columns of ``found``, null where it has no row of their ``key`` (a left join). Rows that a filter of the keys tells to have none aren't shuffled; where the keys are
    too many for it, all rows are."""
    keys = key_filter(found.select(F.xxhash64(key)), most_bits)
    if keys is None:
        return rows.join(found, key, "left")
    held, more = _held(keys)(F.xxhash64(key)), [f for f in found.schema if f.name != key]
    some = rows.where(held).join(found, key, "left").select(*rows.columns, *[f.name for f in more])
    return rows.where(~held).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]).unionByName(some)
