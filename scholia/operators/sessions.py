"""Conversations: previews, windows of history, budgets, titles; and sessions and rates of event streams in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.functions import text as T


def last_message(turns: DataFrame, key: str = "conv_id", order: str = "turn", characters: int = 80) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, order, "role", T.preview(F.col("text"), characters).alias("preview"))


def history(turns: DataFrame, rounds: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last ``rounds`` rounds (two messages each)."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= 2 * rounds).drop("__n")


def within_budget(turns: DataFrame, tokens: int, size: Column, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, kept turns): from the newest back, each message that still fits; one that doesn't is passed over, and the newest always stays. What is taken
    depends on what was taken, so it is a fold over one conversation's messages."""
    listed = turns.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("s"))))).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        skip = (F.size(a["kept"]) > 0) & (a["used"] + x["s"] > tokens)
        return F.struct(F.when(skip, a["used"]).otherwise(a["used"] + x["s"]).alias("used"), F.when(skip, a["kept"]).otherwise(F.concat(a["kept"], F.array(x["o"].cast("long")))).alias("kept"))

    return listed.select(key, F.aggregate("m", start, step).alias("r")).select(key, F.array_sort("r.kept").alias("kept"), F.col("r.used").alias("tokens"))


def titled(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each conversation's title, from its first message of the user."""
    first = turns.groupBy(key).agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col(order))).alias("t"))
    return first.select(key, T.auto_title(F.col("t")).alias("title"))


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, width: str = "1 minute") -> DataFrame:
    """(key, window start, n, rejected): requests in fixed windows, and those over ``limit``."""
    g = events.groupBy(key, F.window(ts, width)["start"].alias("window_start")).agg(F.count("*").alias("n"))
    return g.withColumn("rejected", F.greatest(F.lit(0), F.col("n") - limit))


def gap_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, n): a new session after ``gap_seconds`` without an event."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy(ts)
    new = (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w)) >= gap_seconds * 1_000_000).cast("int")
    s = events.withColumn("session", F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
