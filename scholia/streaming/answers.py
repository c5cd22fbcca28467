"""Questions as a stream, answered from a saved index: for each question its hits, the lines of its answer one by one, and at the end how the answer stands up to a check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import answers as A
from scholia.operators.keyword_store import SavedIndex
from scholia.sources.tables import written

EVENTS = "query_id bigint, position int, event string, data string"


def answered(questions: DataFrame, index: SavedIndex, documents: DataFrame, most: int = 5, **options) -> DataFrame:
    """Events (query_id, position, event, data) of a batch of questions (query_id, question): ``hits`` with the ids found, ``line`` for each line of the answer, ``done`` with the answer's status. ``documents`` (id, content)
    are what the index was made from. A question that nothing answers has no lines and is ``refused``. Rows that repeat a question count once."""
    q = written(questions.select("query_id", "question").dropDuplicates(["query_id"]), "questions")
    terms = q.select("query_id", F.explode(T.tokens(F.col("question"))).alias("term"))
    hits = written(index.search(terms, most), "hits")
    context = written(hits.join(documents.select("id", "content"), "id").select("query_id", (F.col("rank") + 1).alias("index"), "content"), "context")
    lines = written(A.passages(context, q, **options).select("query_id", "o", A.cited(F.col("passage"), F.col("index")).alias("line")), "lines")
    told = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("answer"))
    shown = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("index", "content"))).alias("context"))  # ``most`` a question
    none = F.array().cast(shown.schema["context"].dataType)
    checked = A.verified(q.select("query_id").join(told, "query_id", "left").join(shown, "query_id", "left").withColumn("context", F.coalesce("context", none)))
    found = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("data"))
    first = q.select("query_id").join(found, "query_id", "left").select("query_id", F.lit(0).alias("position"), F.lit("hits").alias("event"), F.coalesce("data", F.lit("")).alias("data"))
    then = lines.select("query_id", (F.col("o") + 1).cast("int").alias("position"), F.lit("line").alias("event"), F.col("line").alias("data"))
    size = lines.groupBy("query_id").agg((F.count("*") + 1).cast("int").alias("position"))
    last = checked.join(size, "query_id", "left").select("query_id", F.coalesce("position", F.lit(1)).alias("position"), F.lit("done").alias("event"), F.col("status").alias("data"))
    return first.unionByName(then).unionByName(last)


def answer_stream(questions: DataFrame, index: SavedIndex, documents: DataFrame, sink: str, checkpoint: str, once: bool = True, **options):
    """Answers a stream of questions batch by batch into ``sink``, a folder with a part for each batch. A batch that is run again overwrites its own part, so a replay changes nothing. The query, which has ended when ``once``."""

    def put(batch: DataFrame, number: int) -> None:
        answered(batch, index, documents, **options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = questions.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
    if once:
        query.awaitTermination()
    return query


def events(spark: SparkSession, sink: str, id_type: str = "bigint") -> DataFrame:
    """What a stream has answered so far."""
    return spark.read.schema(EVENTS.replace("bigint", id_type, 1) + ", batch bigint").option("basePath", sink).parquet(f"{sink}/batch=*").drop("batch")
