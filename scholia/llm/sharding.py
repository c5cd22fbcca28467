"""Sharding by Karmarkar-Karp differencing over indivisible groups of equal texts.

A partial partition is the list of the parts' byte sums. Differencing takes the two of largest spread and joins them in
opposite order, until one is left. Groups are dealt by hash into bundles of a bounded number; each bundle is differenced
by itself, the resulting partial partitions are dealt into bundles again, and so on until one is left: the same rule at
each level of a tree, with no task over ``bundle`` items. Labels are then followed from the root to each group.

Defined cases: a null text has size 1, as an empty one, but is another group; all rows of one text go to one shard, whatever their
number; fewer groups than shards leave shards empty; ties go to the earlier item in the order of hashes; repeated rows each have
their own slot; very long texts are a size as any other; an empty table gives an empty result. Columns of the input but the text are returned as they are, whatever their names; names that
start with two underscores are the operator's own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored


def differenced(rows: list[list[int]], m: int) -> list[list[int]]:
    """For each partial partition (m sums), the final label of each of its m parts."""
    sums, orders = [], []
    for r in rows:
        order = sorted(range(m), key=lambda j: -r[j])
        orders.append(order)
        sums.append([r[j] for j in order])
    up: list[tuple[int, list[int]]] = [(-1, [])] * len(sums)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        joined = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(range(m), key=joined.__getitem__, reverse=True)
        place = [0] * m
        for new, old in enumerate(order):
            place[old] = new
        up[a], up[b] = (len(sums), place), (len(sums), place[::-1])
        sums[a] = sums[b] = None
        sums.append([joined[j] for j in order])
        up.append((-1, []))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    final: list[list[int]] = [[]] * len(sums)
    for i in range(len(sums) - 1, -1, -1):
        parent, place = up[i]
        final[i] = list(range(m)) if parent < 0 else [final[parent][p] for p in place]
    out = []
    for i, order in enumerate(orders):
        label = [0] * m
        for sorted_at, j in enumerate(order):
            label[j] = final[i][sorted_at]
        out.append(label)
    return out


def _labels(groups: DataFrame, m: int, bundle: int) -> DataFrame:
    """(g, shard) of ``groups`` (g, size)."""

    def leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g", ignore_index=True)
        got = differenced([[int(s)] + [0] * (m - 1) for s in pdf["size"]], m)
        return pdf.assign(label=np.array([x[0] for x in got], np.int32))

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", ignore_index=True)
        return pd.DataFrame({"part": pdf["part"], "node": pdf["node"], "sums": pdf["sums"], "places": differenced([[int(x) for x in s] for s in pdf["sums"]], m)})

    many = max(1, -(-groups.count() // bundle))
    leaves = groups.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(many))).groupBy("part").applyInPandas(leaf, "g bigint, size bigint, part bigint, label int")
    labels = stored(leaves, "labels")
    sums = labels.groupBy("part", "label").agg(F.sum("size").alias("size"))
    labels = labels.select("g", "part", "label")
    while many > 1:
        vectors = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("label", "size"))).alias("by")).select("part", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.coalesce(F.try_element_at("by", j), F.lit(0).cast("long"))).alias("sums"))
        many = -(-many // bundle)
        nodes = stored(vectors.withColumn("node", F.pmod(F.xxhash64("part"), F.lit(many))).groupBy("node").applyInPandas(inner, "part bigint, node bigint, sums array<bigint>, places array<int>"), "nodes")
        labels = labels.join(nodes.select("part", "node", "places"), "part").select("g", F.col("node").alias("part"), F.element_at("places", F.col("label") + 1).alias("label"))
        sums = nodes.select(F.col("node").alias("part"), F.explode(F.arrays_zip("places", "sums")).alias("x")).groupBy("part", F.col("x.places").alias("label")).agg(F.sum("x.sums").alias("size"))
    return labels.select("g", F.col("label").alias("shard"))


def sharded(docs: DataFrame, text_col: str = "text", shards: int = 16, bundle: int = 2000, rows_per_slot_bucket: int = 1000) -> DataFrame:
    """``docs`` without its text, with __size, __crc, __shard and __slot (gapless from 0 within a shard)."""
    text, rest = F.col(text_col), [c for c in docs.columns if c != text_col]
    slim = docs.withColumns({
        "__size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1, "__crc": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
        "__g": F.when(text.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text)), "__u": F.monotonically_increasing_id(),
    }).drop(text_col)
    slim = stored(slim, "sizes")
    groups = slim.groupBy(F.col("__g").alias("g")).agg(F.sum("__size").alias("size"))
    placed = slim.join(_labels(stored(groups, "groups"), shards, bundle).select(F.col("g").alias("__g"), F.col("shard").alias("__shard")), "__g")
    buckets = max(1, -(-slim.count() // (shards * rows_per_slot_bucket)))
    placed = stored(placed.withColumn("__bucket", F.pmod(F.xxhash64("__u"), F.lit(buckets))), "placed")
    counts = placed.groupBy("__shard", "__bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("__shard", "__bucket", (F.sum("n").over(W.partitionBy("__shard").orderBy("__bucket")) - F.col("n")).alias("__offset"))
    slot = F.row_number().over(W.partitionBy("__shard", "__bucket").orderBy("__u")) - 1
    return placed.withColumn("__in", slot).join(offsets, ["__shard", "__bucket"]).withColumn("__slot", F.col("__offset") + F.col("__in")).select(*rest, "__size", "__crc", "__shard", "__slot")
