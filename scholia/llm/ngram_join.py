"""Similarity join of documents on word shingles by a size-aware heavy-light join.

Each distinct word sequence is a class. A pair of classes of Jaccard similarity t or more shares at least
ceil(t * larger size) shingles, so when both order their shingles alike, their prefixes of ``size - ceil(t * size) + k``
shingles share k of them. Small sets (up to a size chosen by cost) are found by all 2-subsets of such a prefix; large sets
by the inverted lists of their single prefix shingles; small sets that may match a large one are in those lists too. The
order is rarest first: shingles that repeat within any partition of the input are counted over the whole input, and the
most frequent of them (a bounded list) go last; which order is used changes the cost, never the result.

Candidates are checked against the full sets in two rounds. First, each member of a list with two other members: the one with the fewest rarer shingles ahead
of the list's, and one drawn by hash. This links large groups of near copies with a few pairs per member. Then all pairs of a list whose classes are still in different
components and whose places in the list leave room for enough shared shingles, so that no link between components is missed. Links
inside one component that neither round checks can't change a component.

Defined cases: null, empty and blank texts have an empty set and link with nothing; rows equal in words are one class;
rows without an id take part, and a component's id is the smallest id that isn't null; fewer words than a shingle make one
shingle of the whole sequence; very long texts are cut into shingles whole; rows that are equal, also in their id, are one class, and of them the first by (id, row key) stays; an empty table gives an
empty result. Columns besides the id and the text, whatever their names, play no part in the join and are returned by ``first_of_each``; names that start with two underscores are its own. Shingles and
classes are held by 64-bit hashes (of 3 * 10^10 texts some 25 share a class by chance), rows by 128-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, most_frequent_rows, row_key, stored, with_keys, without_keys
from .components import connected_components


class _Hashes(dict):
    """Hashes of words; remembers the first 120,000."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 120_000:
            self[word] = h
        return h


_WORDS = _Hashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of other than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles_of(words: list[bytes], n: int) -> np.ndarray:
    """The sorted set of hashes of the ``n``-word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _ODD + h[i : len(h) - k + 1 + i]
    return np.unique(_mixed(out))


def class_of(words: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(words))).astype(np.int64)) if words else 0


def least_overlap(size: int, percent: int) -> int:
    return -(-percent * size // 100)


def postings_of(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray, light_to: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which the set ``s`` is listed, and for each the position of its (first) shingle in the order."""
    n = len(s)
    if n == 0:
        return s, np.empty(0, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        seen = np.where(frequent[at] == s, counts[at], 0)
        if seen.any():
            s = s[np.argsort(seen, kind="stable")]
    free = n - least_overlap(n, percent)
    single = s[: free + 1]
    if n > light_to or least_overlap(n, percent) < 2:
        return single, np.arange(len(single))
    p = s[: free + 2]
    i, j = np.triu_indices(len(p), 1)
    a, b = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
    pairs = _mixed(a * _ODD + b)
    return (np.concatenate([pairs, single]), np.concatenate([i, np.arange(len(single))])) if n * 100 >= percent * (light_to + 1) else (pairs, i)


def signature_of(s: np.ndarray) -> bytes:
    """Counts of the set's shingles by their low bits, about one count for four shingles (a power of two, 8 at least)."""
    width = 1 << max(3, (len(s) >> 2).bit_length())
    counts = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return counts.astype("<u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """No less than the number of shingles that two sets of ``n`` and ``m`` share: the sum over low bits of the smaller count."""
    sides = []
    for b, k in ((x, n), (y, m)):
        width = 1 << max(3, (k >> 2).bit_length())
        sides.append(np.frombuffer(b, "<u1" if len(b) == width else "<u4").astype(np.int64))
    width = min(map(len, sides))
    a, b = (c.reshape(-1, width).sum(0) for c in sides)
    return int(np.minimum(a, b).sum())


def _surveyed(shingle: int, flush: int = 1_500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def repeated() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            keep = c > 1
            total = int(c.sum())
            held.clear()
            k = int(keep.sum())
            none = pa.nulls(k + 1, pa.int64())
            return pa.record_batch([pa.array([False] * (k + 1)), pa.nulls(k + 1, pa.binary()), pa.nulls(k + 1, id_type), none, pa.nulls(k + 1, pa.int32()), pa.array(np.append(h[keep].astype(np.int64), 0)), pa.array(np.append(c[keep], -total)), pa.nulls(k + 1, pa.binary())], names)

        names, size, id_type = ["is_doc", "k", "id", "cid", "n", "key", "count", "sig"], 0, pa.null()
        for b in batches:
            cids, ns, sigs, id_type = [], [], [], b.column(1).type
            for t in b.column(2).to_pylist():
                w = words_of(t)
                c = class_of(w)
                s = shingles_of(w, shingle)
                cids.append(c)
                ns.append(len(s))
                sigs.append(signature_of(s))
                if c not in seen and len(s):
                    seen.add(c)
                    held.append(s)
                    size += len(s)
                    if size > flush:
                        yield repeated()
                        size = 0
            none = pa.nulls(len(cids), pa.int64())
            yield pa.record_batch([pa.array([True] * len(cids)), b.column(0), b.column(1), pa.array(cids, pa.int64()), pa.array(ns, pa.int32()), none, none, pa.array(sigs, pa.binary())], names)
        if seen:
            yield repeated()
        _WORDS.clear()  # a worker outlives its task

    return run


def _posted(shingle: int, frequent: np.ndarray, counts: np.ndarray, light_to: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = b.column(0)
            for at in range(0, len(texts), 500):
                keys, places, cids = [], [], []
                for t in texts[at : at + 500].to_pylist():
                    w = words_of(t)
                    c = class_of(w)
                    if c in seen or not w:
                        continue
                    seen.add(c)
                    s = shingles_of(w, shingle)
                    key, place = postings_of(s, frequent, counts, light_to, percent)
                    keys.append(key)
                    places.append(place)
                    cids.append(c)
                if keys:
                    sizes = [len(x) for x in keys]
                    yield pa.record_batch([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.repeat(np.array(cids, np.int64), sizes)), pa.array(np.concatenate(places).astype(np.int32))], ["key", "cid", "pos"])
        _WORDS.clear()

    return run


def _set_column(shingle: int):
    @F.arrow_udf("binary")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([shingles_of(words_of(t), shingle).tobytes() for t in texts.to_pylist()], pa.binary())

    return udf


def _may_be_similar(percent: int):
    @F.arrow_udf("boolean")
    def udf(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        out = []
        for a, b, k, j in zip(x.to_pylist(), y.to_pylist(), n.to_pylist(), m.to_pylist()):
            both = most_shared(a, b, k, j)
            out.append(100 * both >= percent * (k + j - both))
        return pa.array(out, pa.bool_())

    return udf


def _similar(percent: int):
    @F.arrow_udf("boolean")
    def udf(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return udf


def _boundary(met: float, percent: int, check: float = 20.0, most: int = 200) -> int:
    """The largest size for which the 2-subsets of a prefix cost no more than its single shingles: a listed key costs 1, and for
    single shingles each other set met in a list costs a check of a pair, ``check`` keys' worth."""
    size = 1
    while size < most:
        free = size + 1 - least_overlap(size + 1, percent)
        if (free + 2) * (free + 1) / 2 > (free + 1) * (1 + check * met):
            break
        size += 1
    return size


def _may_share(n, i, m, j, percent: int):
    """Whether sets of ``n`` and ``m`` whose first common shingle stands at ``i`` and ``j`` can be similar: they share no more than what is left from there."""
    return F.least(n - i, m - j) * (100 + percent) >= (n + m) * percent


def _spread(listed: DataFrame, percent: int) -> DataFrame:
    """Two partners for each member of a list: the one whose place leaves most of its set, which in a group of near copies is the one nearest to what all
    were made from, and one drawn by hash, alike in all lists."""
    drawn = listed.withColumns({"h": F.xxhash64("cid"), "ahead": F.col("pos") / F.col("n")})
    nearest, any_one = F.min(F.struct("ahead", "h", "cid", "n", "pos")), F.min(F.struct("h", "ahead", "cid", "n", "pos"))
    kind = "struct<cid:bigint,n:int,pos:int>"
    partners = drawn.groupBy("key").agg(nearest.alias("a"), any_one.alias("b")).select("key", F.array(*[F.struct(f"{c}.cid", f"{c}.n", f"{c}.pos").cast(kind) for c in "ab"]).alias("xs"))
    out = drawn.join(stored(partners, "partners"), "key").withColumn("x", F.explode("xs"))
    out = out.where((F.col("cid") != F.col("x.cid")) & _may_share(F.col("n"), F.col("pos"), F.col("x.n"), F.col("x.pos"), percent))
    return out.select(F.least("cid", "x.cid").alias("u"), F.greatest("cid", "x.cid").alias("v"))


def _crossing(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list's members that are in different components and can be similar by their sizes and places in the list."""
    a = members.select("key", F.col("cid").alias("u"), F.col("n").alias("n"), F.col("pos").alias("i"), F.col("component").alias("p"))
    b = members.select("key", F.col("cid").alias("v"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("component").alias("q"))
    both = a.join(b, "key").where((F.col("p") < F.col("q")) & _may_share(F.col("n"), F.col("i"), F.col("m"), F.col("j"), percent))
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def similarity_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80, most_frequent: int = 200_000, frequent_from: int = 8) -> DataFrame:
    """Per row of ``docs``: ``k`` (row key), the id, ``n_shingles``, ``cid`` (class, null without words) and ``component`` (the
    smallest class of those linked, null without words). ``most_frequent`` bounds the list of frequent shingles that is sent to every task."""
    keyed = docs.select(row_key(id_col, text_col).alias("k"), F.col(text_col).alias("t"), F.col(id_col).alias("id"))
    found = stored(keyed.select("k", "id", "t").mapInArrow(_surveyed(shingle), f"is_doc boolean, k binary, id {keyed.schema['id'].dataType.simpleString()}, cid bigint, n int, key bigint, count bigint, sig binary"), "survey")
    rows = found.where("is_doc").select("k", "id", F.when(F.col("n") > 0, F.col("cid")).alias("cid"), "n")
    repeated = stored(found.where("not is_doc and count > 0").groupBy("key").agg(F.sum("count").alias("count")), "repeated")
    total = -(found.where("not is_doc and count < 0").agg(F.sum("count")).first()[0] or 0)
    rare = repeated.where(F.col("count") < frequent_from).agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    met = ((rare[1] or 0) - (rare[0] or 0)) / max(1, total)  # other sets in the list of a shingle that isn't frequent, on the mean
    light_to = _boundary(met, percent)
    top = most_frequent_rows(repeated.where(F.col("count") >= frequent_from), "count", most_frequent).toPandas()
    frequent = top["key"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(frequent)
    frequent, counts = frequent[order], top["count"].to_numpy(np.int64)[order]

    postings = stored(keyed.select("t").mapInArrow(_posted(shingle, frequent, counts, light_to, percent), "key bigint, cid bigint, pos int"), "postings")
    lists = postings.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("last")).where("least <> last").select("key")
    shared = stored(postings.join(stored(lists, "lists"), "key"), "shared")  # stored, so that long lists can be split in the join
    discard(postings)
    classes = stored(found.where("is_doc and n > 0").groupBy("cid").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` that are similar: first by an upper bound from small signatures, then by the full sets."""
        left, right = (classes.select(F.col("cid").alias(c), F.col("n").alias(n), F.col("sig").alias(x), F.col("k").alias(k)) for c, n, x, k in (("u", "n", "x", "p"), ("v", "m", "y", "q")))
        near = stored(pairs.join(left, "u").join(right, "v").where(_may_be_similar(percent)("x", "y", "n", "m")).select("u", "v", "p", "q"), "near")
        wanted = near.select(F.col("u").alias("cid"), F.col("p").alias("k")).union(near.select(F.col("v").alias("cid"), F.col("q").alias("k"))).distinct()
        sets = stored(with_keys(keyed.select("k", "t"), "k", stored(wanted, "wanted")).select("cid", _set_column(shingle)("t").alias("s")), "sets")
        left, right = sets.select(F.col("cid").alias("u"), F.col("s").alias("x")), sets.select(F.col("cid").alias("v"), F.col("s").alias("y"))
        return near.select("u", "v").join(left, "u").join(right, "v").where(_similar(percent)("x", "y")).select("u", "v").distinct()

    listed = stored(shared.distinct().join(classes.select("cid", "n"), "cid"), "listed")
    tried = stored(_spread(listed, percent).distinct(), "pairs")
    links = stored(linked(tried), "links")
    known = stored(connected_components(links), "components")
    members = listed.join(known.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    members = stored(members, "members")
    mixed = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.min("n").alias("low")).where("a <> b").select("key", "low")
    members = members.join(stored(mixed, "mixed"), "key").where(_may_share(F.col("n"), F.col("pos"), F.greatest("low", F.col("n") - F.col("pos")), F.lit(0), percent)).drop("low")  # the best partner that a list may hold
    pairs = stored(_crossing(stored(members, "members"), percent).distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
    more = stored(linked(pairs), "links")
    if not more.isEmpty():
        known = connected_components(links.union(more))
    whole = rows.join(known.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    return whole.select("k", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "cid", "component")


def first_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """Of each component the row of the smallest id (then of the smallest row key); rows without words stay as they are. All columns stay."""
    found = stored(similarity_components(docs, text_col, id_col, **options), "found").where("component is not null")
    key = "__row_key"
    firsts = found.groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "k")).alias("first")).select(F.col("first.k").alias("k"))
    rest = found.select("k").distinct().join(firsts, "k", "left_anti").withColumnRenamed("k", key)
    kept = without_keys(docs.withColumn(key, row_key(id_col, text_col)), key, stored(rest, "rest"))
    repeats = stored(found.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").join(firsts, "k").select(F.col("k").alias(key)), "repeats")
    if not repeats.isEmpty():
        kept = kept.join(repeats, key, "left_anti").unionByName(kept.join(repeats, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)
