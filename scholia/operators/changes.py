"""Changes between versions of documents, chunk by chunk."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("added", "removed", "modified", "unchanged")


def _steps(old: list, new: list) -> list[tuple]:
    return difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()


def _counts(old: list, new: list) -> dict[str, int]:
    out = dict.fromkeys(KINDS, 0)
    for tag, a, b, c, d in _steps(old, new):
        if tag == "insert":
            out["added"] += d - c
        else:
            out[{"equal": "unchanged", "delete": "removed", "replace": "modified"}[tag]] += b - a
    return out


def _similarity(old: list, new: list) -> float | None:
    pairs = [(old[i], new[c + i - a] if c + i - a < d else "") for tag, a, b, c, d in _steps(old, new) if tag == "replace" for i in range(a, b)]
    return sum(difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in pairs) / len(pairs) if pairs else None


def _counted(old: Column, new: Column) -> Column:
    @F.arrow_udf("struct<added:bigint,removed:bigint,modified:bigint,unchanged:bigint>")
    def udf(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist())
        return pa.array([None if x is None else _counts(x, y) for x, y in pairs], pa.struct([(k, pa.int64()) for k in KINDS]))

    return udf(old, new)


def _similar(old: Column, new: Column) -> Column:
    @F.arrow_udf("double")
    def udf(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist())
        return pa.array([None if x is None else _similarity(x, y) for x, y in pairs], pa.float64())

    return udf(old, new)


def chunk_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per document of (doc, chunk_pos, text): chunks added, removed, modified and unchanged, and the mean similarity of modified ones. Chunks are told apart by 128 bits; those of a document, which are few,
    meet in one row. Only documents with a change are compared outside the JVM, many in a batch; texts are taken along only where the similarity is asked for."""
    side = lambda df, name: df.select(F.col("doc").cast("string").alias("doc"), "chunk_pos", "text", F.unhex(F.md5("text")).alias("h"), F.lit(name).alias("side"))

    def listed(name: str, field: str) -> Column:
        row = F.struct("chunk_pos", "h") if field == "h" else F.struct("chunk_pos", "h", "text")
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == name, row))), lambda x: x[field]).alias(f"{name}_{field}")

    docs = side(old, "old").unionByName(side(new, "new")).groupBy("doc").agg(*[listed(n, f) for f in ("h", "text") for n in ("old", "new")])
    same = F.col("old_h") == F.col("new_h")
    other = lambda c: F.when(~same, F.col(c))
    n = docs.withColumns({"n": _counted(other("old_h"), other("new_h")), "similarity": _similar(other("old_text"), other("new_text"))})
    whole = {k: F.when(same, F.size("old_h") if k == "unchanged" else F.lit(0)).otherwise(F.col(f"n.{k}")).cast("bigint").alias(k) for k in KINDS}
    return n.select("doc", *whole.values(), "similarity")
