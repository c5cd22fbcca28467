"""Running sums and numbers within groups of any size: no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scholia.sources.tables import written


def cumulated(df: DataFrame, by: list[str], order: list[str], amount: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` (the number of rows without) over the rows of its group that come before in ``order``. Rows are dealt by ranges of group and order, so that a large group
    lies in many parts; a part's own running sum is added to the sum of the parts before it. ``order`` must tell the rows of a group apart."""
    size = F.col(amount) if amount else F.lit(1)
    dealt = df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()).withColumn("__size", size.cast("long"))
    dealt = written(dealt, "ranges")
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__size").alias("__sum"))
    w = W.partitionBy(*by).orderBy("__part")
    ahead = parts.select(*by, "__part", (F.sum("__sum").over(w) - F.col("__sum")).alias("__ahead"))
    own = F.sum("__size").over(W.partitionBy(*by, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__size")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__part"]]
    both = dealt.withColumn("__own", own).alias("a").join(ahead.alias("b"), same)
    return both.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a.__own") + F.col("b.__ahead")).alias(name))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``df`` with the place of each row in its group, from 0. Send keys through here and join the rest afterwards."""
    return cumulated(df, by, order, None, name)
