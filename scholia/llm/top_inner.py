"""Exact top-k by inner product: columnar branch-and-bound.

Vectors lie in blocks of rows in vertical layout: for every group of dimensions one matrix whose rows are dimensions. Dimensions are ordered by their mass (the sum of squares
over all vectors), and blocks by the length of their vectors, longest first. A query adds up a block group by group. After each group the best that a candidate can still reach is its sum so far plus the
product of what remains of both lengths (Cauchy-Schwarz); candidates that stay below the query's k-th best score are dropped, and the survivors' columns are compacted.

Blocks are dealt to tasks by (strip of blocks, group of queries), in rounds: strip 0, then 1 and 2, then 3 to 6, and so on. Each round starts from the k-th best
scores of all rounds before, so it can return about as many rows as a query keeps, and only some log2(strips) rounds are needed. Bounds are taken with some room for rounding; scores are whole numbers,
summed without error.

Defined cases: null vectors and those with null or non-finite components take no part; of vectors of different lengths the missing components count as 0; each row is a candidate of every other row, also of one that repeats it, and each row whose id
is divisible has ranks of its own, so that a repeated query is returned as often as it stands there; ties go to the smaller id, rows without an id last; with fewer candidates than ``k`` all are returned; an empty table
gives an empty result. Columns besides id and vector play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, stored
from .vectors import takes_part, whole

GROUP = 8
BLOCK = "strip int, row array<bigint>, id array<bigint>, parts array<binary>, rest binary"


def _as_block(strip: int, rows: list, ids: list, x: np.ndarray) -> list:
    """One block of vectors (a row each in ``x``), its dimensions in their order."""
    groups = [x[:, i : i + GROUP] for i in range(0, x.shape[1], GROUP)]
    mass = np.stack([(g.astype(np.float64) ** 2).sum(1) for g in groups] or [np.zeros(len(x))])
    rest = np.sqrt(np.cumsum(mass[::-1], 0)[::-1])
    return [strip, rows, ids, [np.ascontiguousarray(g.T, "<i4").tobytes() for g in groups], rest.astype("<f8").tobytes()]


def _blocks(order: np.ndarray, size: int):
    dims = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, xs, strip = [], [], [], 0

        def out() -> pa.RecordBatch:
            x = np.zeros((len(xs), dims), np.int64)
            for i, v in enumerate(xs):
                x[i, : len(v)] = v
            block = _as_block(strip, rows, ids, x[:, order])
            return pa.record_batch([pa.array([c], t) for c, t in zip(block, (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()))], ["strip", "row", "id", "parts", "rest"])

        for b in batches:
            for r in b.to_pylist():
                if r["strip"] != strip and rows:
                    yield out()
                    rows, ids, xs = [], [], []
                strip = r["strip"]
                rows.append(r["row"])
                ids.append(r["id"])
                xs.append(r["x"])
                if len(rows) == size:
                    yield out()
                    rows, ids, xs = [], [], []
        if rows:
            yield out()

    return run


class Block:
    def __init__(self, row, ids, parts, rest):
        self.row, self.id = np.array(row, np.int64), np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        self.none = np.array([i is None for i in ids], bool)
        n = len(self.row)
        self.parts = [np.frombuffer(p, "<i4").reshape(-1, n) for p in parts]
        self.rest = np.frombuffer(rest, "<f8").reshape(-1, n)

    def as_numbers(self, kind) -> list[np.ndarray]:
        return [p.astype(kind) for p in self.parts]


def best_of(block: Block, parts: list[np.ndarray], query: list[np.ndarray], rest: np.ndarray, row: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The places and scores of at most ``k`` of the block's vectors with a score of ``least`` or more, none of them of row ``row``; and no other vector of the block belongs before them."""
    at = np.flatnonzero((block.row != row) & (block.rest[0] * rest[0] * (1 + 1e-9) + 1e-3 >= least))
    if len(at) > 4 * k and least == -np.inf:  # the longest few tell a first bound
        _, head = best_of_all(parts, query, at[: 4 * k])
        least = np.sort(head)[-k]
    total = np.zeros(len(at), parts[0].dtype if parts else np.int64)
    dense = len(at) == len(block.row)
    for i, p in enumerate(parts):
        total = total + query[i] @ (p if dense else p[:, at])
        if i + 1 < len(parts):
            keep = total + block.rest[i + 1][at] * (rest[i + 1] * (1 + 1e-9)) + 1e-3 >= least
            if keep.sum() < 0.8 * len(at):
                at, total, dense = at[keep], total[keep], False
            if not len(at):
                break
    keep = total >= least
    at, total = at[keep], total[keep].astype(np.int64)
    first = np.lexsort((block.none[at], block.id[at], -total))[:k]
    return at[first], total[first]


def best_of_all(parts: list[np.ndarray], query: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at, sum(q @ p[:, at] for q, p in zip(query, parts))


def _cells(k: int):
    """Rows with an index block and a group of queries to the group's best of the block."""
    names = ["query_row", "query_id", "row", "id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                block, queries = Block(r["row"], r["id"], r["parts"], r["rest"]), Block(r["q_row"], r["q_id"], r["q_parts"], r["q_rest"])
                most = max((float(np.abs(p).max(initial=0)) for p in block.parts), default=0) * max((float(np.abs(p).max(initial=0)) for p in queries.parts), default=0) * GROUP * len(block.parts)
                if most >= 2.0**63:
                    raise OverflowError("scores might not fit 64 bits")
                kind = np.float64 if most < 2.0**53 else np.int64  # both are exact there
                parts, wanted = block.as_numbers(kind), queries.as_numbers(kind)
                least = dict(r["least"] or [])
                out = [[] for _ in names]
                for j in range(len(queries.row)):
                    at, score = best_of(block, parts, [np.ascontiguousarray(w[:, j]) for w in wanted], queries.rest[:, j], int(queries.row[j]), k, least.get(r["q_row"][j], -np.inf))
                    for values, new in zip(out, ([r["q_row"][j]] * len(at), [r["q_id"][j]] * len(at), block.row[at].tolist(), [r["id"][a] for a in at], score.tolist())):
                        values += new
                yield pa.record_batch([pa.array(v, pa.int64()) for v in out], names)

    return run


def mass_order(vectors: DataFrame) -> np.ndarray:
    """Dimensions by descending sum of squares. One number for each dimension goes to the driver."""
    sums = {r.d: r.s for r in vectors.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("double") ** 2).alias("s")).collect()}
    return np.array(sorted(sums, key=lambda d: (-sums[d], d)), np.int64)


def top_inner(df: DataFrame, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = 2048, strip: int = 8192, group: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each row whose id is divisible by ``query_every``."""
    x = whole(F.col(vector_col))
    vectors = df.where(takes_part(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), x.alias("x")).withColumn("row", F.monotonically_increasing_id())
    vectors = stored(vectors, "vectors")
    order = mass_order(vectors)
    size = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    rows = vectors.count()
    strips = max(1, -(-rows // strip))
    ranged = vectors.withColumn("size", size).repartitionByRange(strips, F.desc("size"), F.xxhash64("row"), "row").withColumn("strip", F.spark_partition_id())
    index = stored(ranged.select("strip", "row", "id", "x").mapInArrow(_blocks(order, block), BLOCK), "vertical")
    asked = vectors.where(F.col("id") % query_every == 0)
    groups = max(1, -(-asked.count() // group))
    asked = asked.withColumn("strip", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).repartition(groups, "strip").sortWithinPartitions("strip", "row")
    asked = asked.select("strip", "row", "id", "x").mapInArrow(_blocks(order, group), BLOCK).select(F.col("strip").alias("group"), *[F.col(c).alias(f"q_{c}") for c in ("row", "id", "parts", "rest")])
    asked = stored(asked, "asked")
    strips = index.agg(F.max("strip")).first()[0]
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row"))
    best, low, width = None, 0, 1
    while strips is not None and low <= strips:
        high = min(low + width - 1, strips)
        queries = asked.withColumn("least", F.lit(None).cast("map<bigint,bigint>")) if best is None else _with_least(asked, best, groups, k)
        pairs = index.where(F.col("strip").between(low, high)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        asks = queries.withColumn("strip", F.explode(F.sequence(F.lit(low), F.lit(high))))
        found = pairs.join(asks, ["strip", "group"]).select("row", "id", "parts", "rest", "q_row", "q_id", "q_parts", "q_rest", "least").mapInArrow(_cells(k), "query_row bigint, query_id bigint, row bigint, id bigint, score bigint")
        both = found if best is None else found.unionByName(best)
        new = stored(both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_row", "query_id", "row", "id", "score"), "best")
        if best is not None:
            discard(best)
        best, low, width = new, high + 1, 2 * width
    if best is None:
        best = df.sparkSession.createDataFrame([], "query_row bigint, query_id bigint, row bigint, id bigint, score bigint")
    return best.withColumn("rank", rank).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _with_least(asked: DataFrame, best: DataFrame, groups: int, k: int) -> DataFrame:
    """The groups of queries with each query's k-th best score so far."""
    bounds = best.groupBy("query_row").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k)
    bounds = bounds.groupBy(F.pmod(F.xxhash64("query_row"), F.lit(groups)).cast("int").alias("group")).agg(F.map_from_entries(F.collect_list(F.struct("query_row", "score"))).alias("least"))
    return asked.join(bounds, "group", "left")
