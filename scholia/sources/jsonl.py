"""JSON lines: evaluation sets, exports of feedback and of collections. A set is a folder of part files, read with a schema that is stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVALUATION = "question string, reference_answer string, expected_sources array<string>, expected_keywords array<string>, difficulty string, source string"


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a row; null fields are left out. Each task writes its own part."""
    df.write.mode(mode).json(path)


def read_lines(spark: SparkSession, path: str, schema: str = EVALUATION) -> DataFrame:
    """Objects of a file or folder; blank lines are skipped, fields that a line lacks are null, and a line that is no object stops the reading, as half an evaluation set is worse than none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def feedback_items(feedback: DataFrame, only_with_correction: bool = True) -> DataFrame:
    """Evaluation items of what users found not helpful and nobody has dealt with: (id, question, reference_answer, source). ``feedback`` has id, query, rating, correction, resolved."""
    bad = feedback.where((F.col("rating") == "not_helpful") & ~F.col("resolved"))
    if only_with_correction:
        bad = bad.where(F.coalesce("correction", F.lit("")) != "")
    return bad.select("id", F.col("query").alias("question"), F.coalesce("correction", F.lit("")).alias("reference_answer"), F.concat(F.lit("feedback:"), F.col("id").cast("string")).alias("source"))


def export_feedback(feedback: DataFrame, path: str, only_with_correction: bool = True) -> DataFrame:
    """Writes the items and returns ``feedback`` with those resolved, so that each goes into one set only."""
    items = feedback_items(feedback, only_with_correction)
    write_lines(items.drop("id"), path)
    done = items.select("id", F.lit(True).alias("__done"))
    return feedback.join(done, "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("__done", F.lit(False))).drop("__done")


def feedback_text(query: Column, answer: Column, correction: Column, most: int = 1500) -> Column:
    """Question, answer and correction of a feedback as one text, without the parts that are empty."""
    part = lambda label, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(label), c))
    cut = lambda c: F.substring(F.trim(c), 1, most)
    return F.concat_ws("\n", part("原问题：", F.trim(query)), part("当时的回答：", cut(answer)), part("用户认为应该是：", cut(correction)))
