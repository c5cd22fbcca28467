"""Operational measures: counters, histograms, percentiles, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.sources.tables import written

from .ranks import cumulated

#: Upper bounds of the latency buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def endpoint(path: Column) -> Column:
    """A path with ids made alike: numbers, 36 characters, or with a hyphen."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.when(p.rlike(r"^\d+$") | (F.length(p) == 36) | F.contains(p, F.lit("-")), "{id}").otherwise(p)), "/")


def histogram(df: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts per bucket, with +Inf; one pass, as each row knows its first bucket."""
    first = F.coalesce(*[F.when(F.col(value) <= b, F.lit(i)) for i, b in enumerate(bounds)], F.lit(len(bounds)))
    counts = df.groupBy(*by, first.alias("i")).agg(F.count("*").alias("n"))
    per = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
    le = F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf")))
    out = per.select(*by, "m", F.posexplode(le).alias("i", "le"))
    upto = F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("long"), lambda a, j: a + F.coalesce(F.try_element_at("m", j), F.lit(0)))
    return out.select(*by, "le", upto.alias("count"))


def nearest_rank(df: DataFrame, value: str, by: list[str], p: float) -> DataFrame:
    """The value at position int(n * p) from 0 of the sorted values. Equal values are counted first; running counts go over ranges, so that no task sorts a whole group."""
    counts = df.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    ranged = written(cumulated(counts, by, ["value"], "n"), "ranks")
    total = ranged.groupBy(*by).agg(F.sum("n").alias("__all"))
    place = F.least(F.floor(F.col("__all") * p), F.col("__all") - 1)
    return ranged.join(total, by).where((F.col("before") <= place) & (place < F.col("before") + F.col("n"))).select(*by, "value")


def feedback(df: DataFrame, rating: str, kind: str, resolved: str) -> DataFrame:
    """One row: totals, helpful and not, share of bad ones to four places, and bad ones without an answer."""
    bad = F.col(rating) == "not_helpful"
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(rating) == "helpful").alias("helpful"), F.count_if(bad).alias("not_helpful"), F.round(F.coalesce(F.try_divide(F.count_if(bad), F.count("*")), F.lit(0.0)), 4).alias("bad_rate"), F.count_if(bad & ~F.col(resolved)).alias("unresolved"))


def bad_by_kind(df: DataFrame, rating: str, kind: str) -> DataFrame:
    return df.where(F.col(rating) == "not_helpful").groupBy(F.coalesce(kind, F.lit("未分类")).alias("kind")).agg(F.count("*").alias("n"))


def latest(df: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The last ``most`` samples of each group."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")
