"""Phrases whose words stand together more often than their parts would have it, by weighted automata of counts.

1. Words are counted over all texts, per language.
2. Every task counts the phrases of two and three words of some million words at a time and makes a weighted acyclic automaton of each range of prefixes from them (``automata``). A prefix is the first two words; where these are
   both among the most common words of all (by definition a bounded list), the third belongs to it, so that no range is filled by one prefix. Words are ordered by bytes, prefixes dealt to ranges by their hash.
3. Per language and range, the automata are united and counts summed; phrases that are too rare go.
4. The two-word parts of what is left are asked for in automata of their own, which are composed with the counts of the range they belong to; one-word parts are joined to the words.

Scores and comparisons are exact (38 decimal digits). Defined cases: null and empty texts hold no words; a null language is ``und``; rows that repeat count each; very long texts are taken whole, in slices that end where pieces end; an
empty table gives an empty result; columns besides text and language play no part. Ranks of equal score and count go by the phrase's bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .automata import Phrases, build, composed, phrases, summed, union
from .common import stored

END = b"\xff"  # no byte of UTF-8
FORM = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + END * 10 + b" ")
SLICE = 1 << 22


def word_runs(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, with ``END`` after each piece, in lists of some million bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FORM)
    at = 0
    while at < len(raw):
        cut = len(raw) if len(raw) - at <= SLICE else raw.find(END, at + SLICE)
        cut = len(raw) if cut < 0 else cut
        yield (raw[at:cut].replace(END, b" \xff ") + b" \xff").split()
        at = cut


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[tuple[str, str | None]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _counted_words(most: int):
    """Counts of words by language, let go when ``most`` different ones are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[bytes]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in seen.items():
                c.pop(END, None)
                yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array([w.decode("utf-8", "surrogatepass") for w in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            seen.clear()

        for lang, text in _texts(batches):
            for words in word_runs(text):
                seen.setdefault(lang, Counter()).update(words)
            if sum(map(len, seen.values())) > most:
                yield from out()
        yield from out()

    return run


class _Numbers(dict):
    """Words by their order of appearance, from 1; ``END`` is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def phrases_of(ids: np.ndarray, words: list[bytes]) -> Phrases:
    """The phrases of a run of words. ``ids`` are places in ``words`` (sorted), below 0 at the end of a piece."""
    n = max(1, len(words))
    inner = ids >= 0
    two = inner[:-1] & inner[1:]
    pairs, counts, place = summed((ids[:-1] * n + ids[1:])[two])
    of = np.full(max(0, len(ids) - 1), -1, np.int64)
    of[two] = place
    three = two[:-1] & inner[2:]
    codes, three_counts, _ = summed((of[:-1] * n + ids[2:])[three])
    return Phrases(words, pairs // n, pairs % n, counts, codes // n, codes % n, three_counts)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def ranges_of(hashes: np.ndarray, common: np.ndarray, p: Phrases, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each phrase of two words, and of each of three. ``common``: which words are among the most common."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    key = _mixed(hashes[p.first] * odd + hashes[p.second])
    own = key[p.pair]
    both = common[p.first[p.pair]] & common[p.second[p.pair]]
    own = np.where(both, _mixed(own * odd + hashes[p.third]), own)
    return (key % np.uint64(ranges)).astype(np.int64), (own % np.uint64(ranges)).astype(np.int64)


def by_range(p: Phrases, two: np.ndarray, three: np.ndarray) -> Iterator[tuple[int, Phrases]]:
    """The phrases of each range. A phrase of two words whose range is another's but begins one of three here is here with a count of 0."""
    order2, order3 = np.argsort(two, kind="stable"), np.argsort(three, kind="stable")
    sorted2, sorted3, here = two[order2], three[order3], np.zeros(len(two), bool)
    for r in np.union1d(sorted2, sorted3).tolist():
        own, longer = order2[slice(*np.searchsorted(sorted2, (r, r + 1)))], order3[slice(*np.searchsorted(sorted3, (r, r + 1)))]
        begins = p.pair[longer]
        here[own] = here[begins] = True
        pairs = np.flatnonzero(here) if len(own) + len(begins) > len(here) // 8 else np.unique(np.concatenate([own, begins]))
        here[pairs] = False
        counts = np.where(two[pairs] == r, p.pair_count[pairs], 0)
        yield r, Phrases(p.words, p.first[pairs], p.second[pairs], counts, np.searchsorted(pairs, begins), p.third[longer], p.count[longer])


def _automata(common: dict[str, frozenset[bytes]], ranges: int, most: int):
    """Automata by language and range, of ``most`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, runs, held = _Numbers({END: 0}), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            every = list(numbers)
            order = sorted(range(1, len(every)), key=every.__getitem__)
            sorted_words = [every[i] for i in order]
            place = np.full(len(every), -1, np.int64)
            place[order] = np.arange(len(order))
            hashes = word_hashes(sorted_words)
            for lang, parts in runs.items():
                p = phrases_of(place[np.concatenate(parts)], sorted_words)
                mark = np.zeros(len(sorted_words), bool)
                mark[[place[numbers[w]] for w in common.get(lang, ()) if w in numbers]] = True
                for r, own in by_range(p, *ranges_of(hashes, mark, p, ranges)):
                    yield pa.record_batch([pa.array([lang], pa.string()), pa.array([r], pa.int64()), pa.array([build(own.slim())], pa.binary())], ["lang", "range", "counts"])

        for lang, text in _texts(batches):
            for words in word_runs(text):
                runs.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                held += len(words)
            if held > most:
                yield from out()
                numbers, runs, held = _Numbers({END: 0}), {}, 0
        if held:
            yield from out()

    return run


def _united(least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        p = union(x.as_py() for x in table.column("counts")).kept(least)
        return pa.table({"lang": [key[0].as_py()], "range": [key[1].as_py()], "counts": [build(p)]}, pa.schema([("lang", pa.string()), ("range", pa.int64()), ("counts", pa.binary())]))

    return run


def _spelled(least: int):
    """Candidates: the phrases that the united automata spell, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, data in zip(b.column("lang").to_pylist(), b.column("counts")):
                p = phrases(data.as_py())
                text = [w.decode("utf-8", "surrogatepass") for w in p.words]
                first, second = p.first.tolist(), p.second.tolist()
                words = [[text[i], text[j]] for i, j, n in zip(first, second, p.pair_count.tolist()) if n >= least]
                words += [[text[first[b2]], text[second[b2]], text[k]] for b2, k in zip(p.pair.tolist(), p.third.tolist())]
                a = np.concatenate([p.pair_count[p.pair_count >= least], p.count])
                for at in range(0, len(words), 5000):
                    part = words[at : at + 5000]
                    yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.list_(pa.string())), pa.array(a[at : at + 5000], pa.int64())], ["lang", "words", "a"])

    return run


def _asked(ranges: int):
    """Of each united automaton the two-word parts of its three-word phrases, as automata by the range where they are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, data in zip(b.column("lang").to_pylist(), b.column("counts")):
                p = phrases(data.as_py())
                n = max(1, len(p.words))
                codes = np.unique(np.concatenate([p.first[p.pair] * n + p.second[p.pair], p.second[p.pair] * n + p.third]))
                none = np.empty(0, np.int64)
                asked = Phrases(p.words, codes // n, codes % n, np.ones(len(codes), np.int64), none, none, none)
                two, three = ranges_of(word_hashes(p.words), np.zeros(n, bool), asked, ranges)
                for r, own in by_range(asked, two, three):
                    yield pa.record_batch([pa.array([lang], pa.string()), pa.array([r], pa.int64()), pa.array([build(own.slim())], pa.binary())], ["lang", "range", "asked"])

    return run


def _told(key: tuple, counts: pa.Table, asked: pa.Table) -> pa.Table:
    """Counts of the parts that are asked for in a range."""
    wanted = union(x.as_py() for x in asked.column("asked")) if asked.num_rows else None
    known = phrases(counts.column("counts")[0].as_py()) if counts.num_rows else None
    schema = pa.schema([("lang", pa.string()), ("part", pa.string()), ("f", pa.int64())])
    if wanted is None or known is None:
        return schema.empty_table()
    p = composed(wanted, known)
    text = [w.decode("utf-8", "surrogatepass") for w in p.words]
    return pa.table({"lang": [key[0].as_py()] * len(p.first), "part": [f"{text[i]} {text[j]}" for i, j in zip(p.first.tolist(), p.second.tolist())], "f": p.pair_count}, schema)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, share: int = 50, top: int = 2000, words_a_range: int = 4_000_000, words_held: int = 3_000_000, most_common: int = 4000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two and three words that stand ``least`` times or more, without those of which ``share`` in a hundred or
    more lie in a longer one. A word is common when it is one of ``most_common`` parts of all words or more, so that there are no more than ``most_common`` of them."""
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = stored(texts.mapInArrow(_counted_words(words_held // 6), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    common: dict[str, set[bytes]] = {}
    for r in words.where(F.col("f") * most_common >= total).collect():
        common.setdefault(r.lang, set()).add(r.word.encode("utf-8", "surrogatepass"))
    ranges = max(1, -(-total // words_a_range))
    made = texts.mapInArrow(_automata({k: frozenset(v) for k, v in common.items()}, ranges, words_held), "lang string, range bigint, counts binary")
    united = stored(made.groupBy("lang", "range").applyInArrow(_united(least), "lang string, range bigint, counts binary"), "united")
    spelled = stored(united.mapInArrow(_spelled(least), "lang string, words array<string>, a bigint").withColumn("phrase", F.array_join("words", " ")), "spelled")
    asked = united.mapInArrow(_asked(ranges), "lang string, range bigint, asked binary")
    told = united.groupBy("lang", "range").cogroup(asked.groupBy("lang", "range")).applyInArrow(_told, "lang string, part string, f bigint")
    parts = stored(told.unionByName(words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f")), "parts")
    longer = spelled.where(F.size("words") > 2).select("lang", "a", F.explode(F.array_distinct(F.array(*[F.array_join(F.slice("words", i, 2), " ") for i in (1, 2)]))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = spelled.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.lit(3)), " ").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    big = "decimal(19,0)"
    scored = cuts.withColumn("score", F.expr(f"(cast(a AS {big}) * cast(a AS {big}) * 1000000BD) div (cast(l AS {big}) * cast(r AS {big}))"))
    lowest = stored(scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score"), "lowest")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(ranges))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
