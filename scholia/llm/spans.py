"""Repeated sentence spans across documents.

A text is cut into sentences after . ! ? (with closing marks) and at line ends; sentences of over 24 words are cut again after
commas, semicolons and colons, and pieces that are still over 40 words after words that their own hash selects (one in eight), so that an
edit moves only the cuts beside it.

A span is any run of consecutive sentences, ``least_sentences`` at least, that hold ``least_words`` words together. Spans are compared by hash without regard to case, outer
punctuation and spacing. Only the spans are hashed that hold no shorter one from their first sentence or to their last: each sentence of a longer span that repeats lies in one of those,
and they repeat with it, so the outcome is that of hashing every span. The first place of a span is that of the smallest (id, text hash, sentence); at all other places, also in the same document, the sentences it
covers are removed. With ``within=False`` the first document of a span keeps all its places, and a span that only one document holds is left alone.

Hashes of spans go through the join, and of the texts only those that lose something. Spans are told apart by 128 bits (two hashes over different hashes of their words): of 10^12 different spans, two share theirs with a chance of about
10^-15. Rows are told apart by 128 bits too.

Defined cases: null texts stay null; texts without a span stay as they are; a text that holds only repeated spans becomes '';
a null id comes after all ids; rows equal in id and text are one document; very long texts are cut whole; ties don't occur, as rows equal in id and text hash are one
document; an empty table gives an empty result. Other columns, whatever their names, are returned as they are; names that start with two underscores are the operator's own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, row_key, stored, with_some

SENTENCE = re.compile(r"[^\n.!?。！？]*(?:[.!?。！？]+[\"'”’»)\]]*(?:\s+|$)|[.!?。！？]+|\n+|$)")
WORD = re.compile(r"\w+")


CLAUSE = re.compile(r"[^,;:，；：、]*(?:[,;:，；：、]\s*|$)")
TOKEN = re.compile(r"\S+\s*")


def _cut(sentence: str) -> list[str]:
    if sentence.count(" ") < 24:
        return [sentence]
    out: list[str] = []
    for clause in CLAUSE.findall(sentence):
        if clause.count(" ") < 40:
            out.append(clause)
            continue
        held: list[str] = []
        head = clause[: len(clause) - len(clause.lstrip())]
        for token in TOKEN.findall(clause):
            held.append(token)
            if zlib.crc32(token.strip().lower().encode("utf-8", "surrogatepass")) % 8 == 0:
                out.append(head + "".join(held))
                head, held = "", []
        out.append(head + "".join(held))
    return [x for x in out if x]


def sentences_of(text: str) -> list[str]:
    """The sentences of ``text``, each with the white space after it; joined they are the text."""
    return [piece for s in SENTENCE.findall(text) if s for piece in _cut(s)]


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def runs_of(sentences: list[str], least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, number of sentences, and the two hashes of each span. Sentences without a word belong to the span around them and count as none."""
    words = [WORD.findall(s.lower()) for s in sentences]
    full = np.array([i for i, w in enumerate(words) if w], np.int64)
    n = len(full)
    none = np.empty(0, np.int64)
    if n < least_sentences:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    ends = np.concatenate([[0], np.cumsum([len(words[i]) for i in full])])  # words before each sentence
    pairs = b"".join(xxhash.xxh3_128_digest(" ".join(words[i])) for i in full)
    starts = np.arange(n)
    stop = np.maximum(starts + least_sentences, np.searchsorted(ends, ends[:-1] + least_words))  # the shortest from each sentence
    begin = np.minimum(starts + 1 - least_sentences, np.searchsorted(ends, ends[1:] - least_words, side="right") - 1)  # the shortest to each sentence
    a, b = np.concatenate([starts[stop <= n], begin[begin >= 0]]), np.concatenate([stop[stop <= n], starts[begin >= 0] + 1])
    both = np.unique(a * (n + 1) + b)
    a, b = both // (n + 1), both % (n + 1)
    halves = []
    for h in np.frombuffer(pairs, ">u8").reshape(-1, 2).T.astype(np.uint64):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)])
        x = (sums[b] - sums[a]) * _powers(_INVERSE, n)[a] + (b - a).astype(np.uint64)  # alike wherever the span stands
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        halves.append(x ^ (x >> np.uint64(29)))
    return full[a], full[b - 1] - full[a] + 1, *halves


def _runs(least_sentences: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [runs_of(sentences_of(t or ""), least_sentences, least_words) for t in part.column(2).to_pylist()]
                first, many, h, g = (np.concatenate(x) for x in zip(*found))
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows), pa.array(first, pa.int32()), pa.array(many, pa.int32()), pa.array(h.astype(np.int64)), pa.array(g.astype(np.int64))], ["k", "id", "first", "many", "hash", "more"])

    return run


def _without():
    @F.arrow_udf("struct<text:string,n_sentences:int,n_removed:int,spans:array<struct<start:int,end:int>>>")
    def _without_udf(texts: pa.Array, covered: pa.Array) -> pa.Array:
        out = []
        for t, gone in zip(texts.to_pylist(), covered.to_pylist()):
            if t is None:
                out.append({"text": None, "n_sentences": 0, "n_removed": 0, "spans": []})
                continue
            sentences = sentences_of(t)
            drop = np.zeros(len(sentences) + 1, bool)
            for g in gone or ():
                drop[g["first"] : g["first"] + g["many"]] = True
            spans, kept, at = [], [], 0
            for s, d in zip(sentences, drop):
                if not d:
                    kept.append(s)
                elif spans and spans[-1]["end"] == at:
                    spans[-1]["end"] = at + len(s)
                else:
                    spans.append({"start": at, "end": at + len(s)})
                at += len(s)
            out.append({"text": "".join(kept).strip() if spans else t, "n_sentences": len(sentences), "n_removed": int(drop.sum()), "spans": spans})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_sentences", pa.int32()), ("n_removed", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    return _without_udf


def without_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_sentences: int = 2, least_words: int = 20, within: bool = True) -> DataFrame:
    """``docs`` with ``__clean``: the text without repeated spans, counts of its sentences and of those removed, and the spans removed (character offsets)."""
    keyed = docs.withColumn("__k", row_key(id_col, text_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    runs = stored(keyed.select(F.col("__k").alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(_runs(least_sentences, least_words), f"k binary, id {id_type}, first int, many int, hash bigint, more bigint"), "runs")
    place = F.struct(F.col("id").isNull(), "id", "k", "first")
    repeated = F.col("n") > 1 if within else F.col("k") < F.col("last")
    origin = runs.groupBy("hash", "more").agg(F.min(place).alias("origin"), F.count("*").alias("n"), F.min("k").alias("k"), F.max("k").alias("last")).where(repeated).select("hash", "more", F.col("origin.k").alias("ok"), F.col("origin.first").alias("ofirst"))
    origin = stored(origin, "origins")  # so that the join is one of two plain shuffles, in which a very common span can be split
    elsewhere = F.col("k") != F.col("ok")
    again = runs.join(origin, ["hash", "more"]).where(elsewhere | (F.col("first") != F.col("ofirst")) if within else elsewhere)
    # a document has no more spans than twice its sentences
    covered = stored(again.groupBy("k").agg(F.array_distinct(F.collect_list(F.struct("first", "many"))).alias("__covered")).withColumnRenamed("k", "__k"), "covered")
    discard(runs)
    out = with_some(keyed, "__k", covered)
    return out.withColumn("__clean", _without()(text_col, "__covered")).drop("__k", "__covered")
