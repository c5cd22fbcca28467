"""Token counts by distinct pre-tokens of a SentencePiece model.

The model must escape white space, add a leading space and change nothing else, and no piece may hold a space after
another character (``independent`` checks this). Then no merge crosses the start of a run of spaces, and a text's pieces
are those of its pre-tokens: each is a run of spaces with what follows it up to the next space. Pre-tokens are counted per partition and summed; the pieces
of each distinct one are counted once. The most frequent ones (a bounded list) go to every task, which sums them per document;
the others are joined by the pre-token to each document's frequencies. No ids are made.

Defined cases: null and empty texts have no token; very long texts are counted whole, and very long pre-tokens are one key as any other; pre-tokens equally frequent are sent or joined alike; repeated rows
(also without an id) each get their count; an empty table gives an empty result; columns besides the id and the text, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import most_frequent_rows, stored

#: Where a pre-token starts: at a space that follows another character.
SPACES = re.compile("[ ▁]")
RUNS = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")


def independent(model_file: str) -> bool:
    """Whether pieces never cross the start of a run of spaces and the model normalises nothing but spaces."""
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = (m.id_to_piece(i) for i in range(m.get_piece_size()))
    probe = "▁a  b Ａﬁ \t\n　c "
    return not any("▁" in p.lstrip("▁") for p in pieces) and m.decode(m.encode(probe)) == probe.replace("▁", " ")


def pre_tokens(text: str | None) -> list[str]:
    """With the leading space that the model adds left out of the first."""
    if not text:
        return []
    if "  " in text or "▁" in text or text[-1] == " " or text[0] == " ":
        return RUNS.findall(" " + text.replace("▁", " "))
    first, *others = text.split(" ")
    return [f" {first}", *[f" {x}" for x in others]]


def _counted(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
            seen.clear()
            return b

        for b in batches:
            for at in range(0, b.num_rows, 200):
                for t in b.column(0).slice(at, 200).to_pylist():
                    seen.update(pre_tokens(t))
                if len(seen) > flush:
                    yield out()
        if seen:
            yield out()

    return run


_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _pieces(model_file: str):
    @F.arrow_udf("int")
    def udf(pre: pa.Array) -> pa.Array:
        if model_file not in _models:
            _models[model_file] = sentencepiece.SentencePieceProcessor(model_file=model_file)
        m = _models[model_file]
        # the model itself puts a space before what it is given; given nothing, it gives nothing, but one space is one piece
        return pa.array([len(x) or 1 for x in m.encode([p[1:] for p in pre.to_pylist()], num_threads=1)], pa.int32())

    return udf


def _summed(known: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, get = TaskContext.get().partitionId() << 33, known.get
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                uids, heads, of, words, times, sizes = [], [], [], [], [], []
                for t in part.column(1).to_pylist():
                    pres = pre_tokens(t)
                    found = list(map(get, pres))
                    heads.append(sum(x for x in found if x is not None))
                    uids.append(row)
                    sizes.append(len(t.encode()) if t else 0)
                    if None in found:
                        rest = Counter(p for p, x in zip(pres, found) if x is None)
                        of += [row] * len(rest)
                        words += rest.keys()
                        times += rest.values()
                    row += 1
                k = len(uids)
                yield pa.record_batch([pa.array(uids, pa.int64()), part.column(0), pa.array(sizes, pa.int64()), pa.array(heads, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], NAMES)
                if of:
                    k = len(of)
                    none = pa.nulls(k, pa.int64())
                    yield pa.record_batch([pa.array(of, pa.int64()), pa.nulls(k, part.column(0).type), none, none, pa.array(words, pa.string()), pa.array(times, pa.int64())], NAMES)

    return run


NAMES = ["row", "id", "n_bytes", "known", "piece", "n"]


def token_counts(docs: DataFrame, model_file: str, text_col: str = "text", id_col: str = "doc_id", most_sent: int = 200_000, flush: int = 200_000) -> DataFrame:
    """(id, n_bytes, n_tokens) for each row of ``docs``. ``most_sent`` bounds the pre-tokens whose counts go to every task."""
    if not independent(model_file):
        raise ValueError("this model's pieces don't follow from pre-tokens; encode whole texts instead")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    seen = texts.select("t").mapInArrow(_counted(flush), "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    vocabulary = stored(seen.withColumn("tokens", _pieces(model_file)("piece")), "vocabulary")
    top = most_frequent_rows(vocabulary.where(F.length("piece") <= 40), "n", most_sent).select("piece", "tokens").toPandas()
    known = dict(zip(top["piece"], top["tokens"].tolist()))
    id_type = docs.schema[id_col].dataType.simpleString()
    parts = stored(texts.mapInArrow(_summed(known), f"row bigint, id {id_type}, n_bytes bigint, known bigint, piece string, n bigint"), "frequencies")
    rest = parts.where("piece is not null").select("row", "piece", "n").join(vocabulary.select("piece", "tokens"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("rest"))
    rows = parts.where("piece is null").select("row", "id", "n_bytes", "known")
    return rows.join(rest, "row", "left").select(F.col("id").alias(id_col), "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
