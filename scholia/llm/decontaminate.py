"""Benchmark decontamination by template canonicalisation.

A text becomes typed tokens. Numbers (whatever begins with digits and goes on with digits and marks between them, as times and dates do; number words, also hyphenated), units beside a number ("5 km", "5km", "10-km", "20 km/h", "20°C"), names (words in capitals among words that aren't, and words with a
capital first and small letters after it, whatever stands between them; a run of them inside a sentence is one) and the opening of a
sentence (its first word if it has a capital, with the names that follow it) turn into placeholders and keep their spelling as the slot's value; other words are lower-cased without outer
punctuation. Windows of ``window`` typed tokens of the benchmark are joined by hash to those of the documents: hashes and places first; the values of slots are
fetched for matches alone. Joined windows on one diagonal (document place minus item place) are one alignment. Its slots must be consistent: one item value
maps to one document value and the reverse. Windows that hold a slot against this don't count, unless all their values are word for word the item's. So a copied question is found, and so is one whose
numbers, names or units were changed throughout. A document is contaminated when windows of consistent alignments cover ``min_cover`` of an item's windows.

An item's first word also counts as it would inside a sentence, as a copy may stand anywhere. Windows with fewer plain words than half of their tokens tell nothing and are left out;
items without others, or with fewer than ``min_tokens`` tokens or ``min_words`` plain words, are compared word for word instead, by windows of ``window`` words (or their whole
length, ``min_exact`` words at least; shorter items are ignored).

Defined cases: null, empty and blank texts are clean; very long texts are cut into windows whole; two equal values of an item that become different ones are inconsistent, as are two that become
one; repeated items and rows are treated alike; of several contaminating items all are reported; an empty benchmark leaves all clean; an empty table gives an empty result. Rows
equal in id and text are one document. Other columns, whatever their names, are returned as they are; names that start with two underscores are the operator's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, key_filter, row_key, stored, with_keys, without_keys

#: Units of measure and of quantity that stand for one another in a question, beside a number.
UNITS = frozenset(
    "mm cm m km inch inches ft foot feet yd yard yards mile miles mg g kg gram grams t ton tons tonne tonnes lb lbs oz ounce ounces ml cl l liter liters litre litres gallon gallons pint pints cup cups s ms sec secs second seconds min mins minute minutes h hr hrs hour hours "
    "day days week weeks month months year years decade decades century centuries % percent usd eur gbp jpy chf dollar dollars euro euros pound pounds cent cents yen mph kmh kph knots hz khz mhz ghz w kw mw kwh v kv a ma n kn j kj cal kcal pa kpa bar psi rpm k c f "
    "degree degrees celsius fahrenheit kelvin meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters kilogram kilograms milligram milligrams milliliter milliliters watt watts volt volts acre acres hectare hectares kb mb gb tb byte bytes".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
#: Digits, with marks between them (fractions, times, dates, ranges, products), and what may stand around them.
NUMBER = re.compile(r"[$€£¥]?[+\-−±~]?\d[\d,.]*(?:[:/\-–−x×^]\d[\d,.]*)*(?:%|st|nd|rd|th|s|am|pm)?", re.I)
GLUED = re.compile(r"([$€£¥]?[+\-−]?\d[\d,.]*(?:[:/]\d+)*)-?([A-Za-zµμ°%][A-Za-zµμ°²³/]*)")
#: Units by form: a degree, one unit for each of another, a power.
UNIT_FORM = re.compile(r"°[A-Za-z]?|[A-Za-zµμ]{1,6}(?:/[A-Za-z]{1,6}[²³]?)+|[a-zµμ]{1,3}[²³]")
#: A name: a capital first, small letters after it, and between them other capitals, apostrophes and hyphens.
NAME_FORM = re.compile(r"(?=.*[^\W\d_A-Z])[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))*")
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…*#$&%_-"
PLAIN, NUMERAL, UNIT, NAME, OPENING, CAPITALS = range(6)
_KINDS = np.array([0, *[xxhash.xxh3_64_intdigest(f"\x00{k}") for k in ("number", "unit", "name", "opening")]], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LINE = "\x02"


class _Words:
    """What is known of words, by number: kind (-1: end of a line, -2: nothing), hash of the plain word, whether a sentence ends after it, whether a mark follows it, and the number of the unit
    glued to it or -1. The first ``remember`` words are kept, until ``forget``: a worker outlives its task."""

    def __init__(self, remember: int = 100_000):
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros(1 << 14, [("kind", "i1"), ("plain", "u8"), ("ends", "?"), ("mark", "?"), ("glued", "i4")])

    def _row(self, word: str) -> tuple:
        core = word.strip(EDGE)
        low, kind = core.lower(), PLAIN
        end = word.rstrip("\"')]”’»")[-1:]
        ends, mark = end in (".", "!", "?"), end in tuple(".,;:!?")
        name = core[:1].isupper() and not core.isupper()
        if core.isalpha():
            if low in NUMBER_WORDS:
                kind = NUMERAL
            elif low in UNITS:
                kind = UNIT
            elif name:
                kind = NAME
            elif len(core) > 1 and core.isupper():
                kind = CAPITALS
            return kind, xxhash.xxh3_64_intdigest(low), ends, mark, ""
        if word == _LINE or not word:
            return -1 if word else -2, 0, True, False, ""
        bare = word.rstrip(".,;:!?")
        inner = bare.lstrip("(\"'“‘").rstrip(")\"'”’")
        parts = GLUED.fullmatch(inner)
        if NUMBER.fullmatch(bare) or NUMBER.fullmatch(core) or NUMBER.fullmatch(inner) or ("-" in core and all(x in NUMBER_WORDS for x in low.split("-"))):
            return NUMERAL, xxhash.xxh3_64_intdigest(low or word), ends, mark, ""
        if parts and (parts[2].lower() in UNITS or UNIT_FORM.fullmatch(parts[2])):
            return NUMERAL, xxhash.xxh3_64_intdigest(parts[1]), ends, mark, parts[2] + word[len(bare) :]
        if word in ("%", "$", "€", "£") or UNIT_FORM.fullmatch(core):
            kind = UNIT
        elif name and (core[1:].islower() or NAME_FORM.fullmatch(core)):
            kind = NAME
        return kind, xxhash.xxh3_64_intdigest(low or word), ends, mark, ""

    def numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each of the distinct ``words``, and the table."""
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            rows = list(map(self._row, new))
            units = [r[4] for r in rows if r[4] and r[4] not in known]
            if units:
                self.numbers(list(dict.fromkeys(units)))
                new = [w for w in words if w not in known]
                rows = list(map(self._row, new))
            start = len(known)
            while start + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            part = self.table[start : start + len(new)]
            for name, column in zip(part.dtype.names, zip(*rows)):
                part[name] = [known[u] if u else -1 for u in column] if name == "glued" else column
            known.update(zip(new, range(start, start + len(new))))
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > self.remember:
            for w in new:
                del known[w]
        return out, self.table


_WORDS = _Words()


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each word, the text it is of, and the table."""
    cut = pc.utf8_split_whitespace(texts)
    words = cut.flatten().dictionary_encode()
    distinct = words.dictionary
    # words hold no space, so that one string carries them all
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py().split(" ") if len(distinct) else []
    numbers, table = _WORDS.numbers(joined)
    at, doc = numbers[words.indices.to_numpy()], np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    keep = table["kind"][at] > -2
    return at[keep], doc[keep], table


def typed_many(texts: pa.Array, first_inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the typed tokens of all texts, their values (0: none), their kinds, and where each text's tokens start, with the end. With ``first_inside`` a text's first word is
    typed as inside a sentence."""
    texts = texts.fill_null("")
    at, doc, table = _split(pc.replace_substring(texts, "\n", f" {_LINE} "))
    glued = table["glued"][at]
    first_part = np.zeros(len(at), bool)
    if (glued >= 0).any():
        where = np.flatnonzero(glued >= 0)
        at, doc = np.insert(at, where + 1, glued[where]), np.insert(doc, where + 1, doc[where])
        first_part = np.zeros(len(at), bool)
        first_part[where + np.arange(len(where))] = True
    row = table[at]
    k, h = row["kind"].copy(), row["plain"].copy()
    e, m = row["ends"] & ~first_part, row["mark"] & ~first_part
    begins = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    opens = np.where(begins, not first_inside, np.concatenate([[False], e])[: len(e)])
    keep = k >= 0  # line ends are no tokens
    k, h, e, m, opens, doc = k[keep], h[keep], e[keep], m[keep], opens[keep], doc[keep]
    if len(k):
        begins = np.concatenate([[True], doc[1:] != doc[:-1]])
        # a word in capitals among others is a name; where its neighbour is in capitals too, so is the text
        beside = np.concatenate([[False], (k[1:] == CAPITALS) & (k[:-1] == CAPITALS)])
        beside[:-1] |= beside[1:]
        k[k == CAPITALS] = np.where(beside[k == CAPITALS], PLAIN, NAME)
        after_number = np.concatenate([[False], (k[:-1] == NUMERAL) & ~e[:-1]]) & ~begins
        k[(k == UNIT) & ~after_number] = PLAIN
        k[opens & (k == NAME)] = OPENING
        # a run of names, or of an opening and the names after it, is one token
        joins = np.concatenate([[False], (k[1:] == NAME) & ((k[:-1] == NAME) | (k[:-1] == OPENING)) & ~m[:-1]]) & ~begins
        if joins.any():
            starts = np.flatnonzero(~joins)
            place = np.arange(len(k)) - np.maximum.accumulate(np.where(joins, 0, np.arange(len(k))))
            single = np.diff(np.append(starts, len(k))) == 1
            h = np.where(single, h[starts], np.add.reduceat(_mixed(h + place.astype(np.uint64) * _ODD), starts))
            k, doc = k[starts], doc[starts]
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    return np.where(k == PLAIN, h, _KINDS[k]), np.where(k == PLAIN, np.uint64(0), h), k, edges


def typed(text: str | None, first_inside: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return typed_many(pa.array([text], pa.string()), first_inside)[:3]


def plain_many(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without types, and where each text's start, with the end."""
    at, doc, table = _split(texts.fill_null(""))
    return table["plain"][at], np.searchsorted(doc, np.arange(len(texts) + 1))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def windows_of(h: np.ndarray, window: int, channel: int = 0) -> np.ndarray:
    """Hashes of windows of ``window`` tokens; none where there are fewer tokens. Windows of different length or channel differ."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - window + 1, 2 * window + channel, np.uint64)
    for i in range(window):
        out = out * _ODD + h[i : len(h) - window + 1 + i]
    return _mixed(out)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64())


def _slots(values: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """The values of ``width`` tokens from each place of ``at``; 0 where there is no slot."""
    flat = values[(at[:, None] + np.arange(width)).reshape(-1)] if len(at) else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), _signed(flat))


def item_windows(text: str | None, window: int, min_tokens: int, min_words: int, min_exact: int) -> tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Channel (0: typed, 1: word for word), width, [(places, hashes, values of all tokens)], and the number of windows that count."""
    out, places = [], set()
    for first_inside in (False, True):
        h, values, kinds = typed(text, first_inside)
        width = min(window, len(h))
        plain = kinds == PLAIN
        if len(h) < min_tokens or int(plain.sum()) < min_words:
            continue
        counts = np.convolve(plain, np.ones(width, int), "valid")
        at = np.flatnonzero(2 * counts >= width)
        if first_inside:
            at = at[at == 0]  # the other windows are the same
        if len(at):
            out.append((at, windows_of(h, width)[at], values))
            places.update(at.tolist())
    if places:
        return 0, width, out, len(places)
    h = plain_many(pa.array([text], pa.string()))[0]
    width = min(window, len(h))
    if width < min_exact:
        return 1, 0, [], 0
    at = np.arange(len(h) - width + 1)
    return 1, width, [(at, windows_of(h, width, 1), np.zeros(len(h), np.uint64))], len(at)


def _items(window: int, min_tokens: int, min_words: int, min_exact: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                channel, width, found, n = item_windows(t, window, min_tokens, min_words, min_exact)
                for at, h, values in found:
                    k = len(at)
                    yield pa.record_batch([b.column(0).take(pa.array([i] * k, pa.int64())), _signed(h), pa.array(at, pa.int32()), _slots(values, at, width), pa.array([channel] * k, pa.int32()), pa.array([width] * k, pa.int32()), pa.array([n] * k, pa.int32())], ["item", "hash", "item_pos", "item_slots", "channel", "width", "n_windows"])

    return run


def _places(kinds: list[tuple[int, int]], wanted: KeyFilter | None):
    """Hash and place of the documents' windows, of every channel and width in the benchmark; without those that ``wanted`` tells to match nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 200):
                b = whole_batch.slice(start, 200)
                tokens = {c: typed_many(b.column(1))[::3] if c == 0 else plain_many(b.column(1)) for c in {c for c, _ in kinds}}
                for channel, width in kinds:
                    h, edges = tokens[channel]
                    x = windows_of(h, width, channel)
                    at = np.flatnonzero(wanted.holds(x)) if wanted is not None else np.arange(len(x))
                    row = np.searchsorted(edges, at, side="right") - 1
                    whole = at + width <= edges[row + 1]  # windows that lie in one text
                    at, row = at[whole], row[whole]
                    if len(at):
                        yield pa.record_batch([b.column(0).take(pa.array(row)), _signed(x[at]), pa.array(at - edges[row], pa.int32())], ["k", "hash", "pos"])
        _WORDS.forget()
        pa.default_memory_pool().release_unused()

    return run


def _values():
    """Slot values of the windows that matched: each of ``at`` is (place, width, channel)."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("width", pa.int32()), ("channel", pa.int32()), ("doc_slots", pa.list_(pa.int64()))]))

    @F.arrow_udf("array<struct<pos:int,width:int,channel:int,doc_slots:array<bigint>>>")
    def udf(texts: pa.Array, at: pa.Array) -> pa.Array:
        _, flat, _, edges = typed_many(texts)
        out = []
        for start, end, places in zip(edges, edges[1:], at.to_pylist()):
            values = flat[start:end].astype(np.int64)
            out.append([p | {"doc_slots": values[p["pos"] : p["pos"] + p["width"]].tolist() if p["channel"] == 0 else [0] * p["width"]} for p in places])
        return pa.array(out, kind)

    return udf


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", window: int = 8, min_tokens: int = 8, min_words: int = 5, min_cover: float = 0.5, min_exact: int = 4, most_sent: int = 2_000_000) -> DataFrame:
    """Rows (k, item, cover, exact) of contaminated documents, by ``row_key``: cover is the share of the item's windows in
    consistent alignments, exact whether all their slots kept their values. A filter of up to ``most_sent`` hashes of the benchmark (within ``MOST_BITS``) spares windows
    that match nothing; with more hashes all windows go the same way, as hashes and places."""
    item_type = benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.select(F.col(item_id), F.col(item_text)).mapInArrow(_items(window, min_tokens, min_words, min_exact), f"item {item_type}, hash bigint, item_pos int, item_slots array<bigint>, channel int, width int, n_windows int")
    items = stored(items.distinct(), "items")
    kinds = [(r.channel, r.width) for r in items.select("channel", "width").distinct().orderBy("channel", "width").collect()]  # two channels, ``window`` widths at most
    hashes = stored(items.select("hash").distinct(), "hashes")
    wanted = key_filter(hashes) if hashes.limit(most_sent + 1).count() <= most_sent else None
    keyed = docs.select(row_key(id_col, text_col).alias("k"), F.col(text_col).alias("t"))
    matched = stored(keyed.mapInArrow(_places(kinds, wanted), "k binary, hash bigint, pos int").join(hashes, "hash").distinct(), "matched")
    which = items.select("hash", "width", "channel").distinct()
    at = matched.join(which, "hash").groupBy("k").agg(F.collect_set(F.struct("pos", "width", "channel")).alias("at"))  # no more than a document has words
    valued = with_keys(keyed, "k", stored(at, "places")).dropDuplicates(["k"]).select("k", F.explode(_values()("t", "at")).alias("v")).select("k", "v.*")
    joined = matched.join(items, "hash").join(stored(valued, "values"), ["k", "pos", "width", "channel"])
    joined = joined.withColumn("slots", F.expr("filter(arrays_zip(item_slots, doc_slots), x -> x.item_slots <> 0 or x.doc_slots <> 0)"))
    # an alignment has no more windows than its item
    lines = joined.groupBy("k", "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_list(F.struct("item_pos", "slots")).alias("at"), F.max("n_windows").alias("n_windows"))
    pairs = F.expr("array_distinct(flatten(transform(at, w -> w.slots)))")
    lines = lines.withColumn("p", pairs)
    once = "size(filter(p, y -> y.item_slots = x.item_slots)) = 1 and size(filter(p, y -> y.doc_slots = x.doc_slots)) = 1"
    good = F.expr(f"filter(at, w -> forall(w.slots, x -> x.item_slots = x.doc_slots) or forall(w.slots, x -> {once}))")
    lines = lines.select("k", "item", "n_windows", good.alias("at")).where(F.size("at") > 0)
    exact = F.expr("forall(at, w -> forall(w.slots, x -> x.item_slots = x.doc_slots))")
    found = lines.withColumn("exact", exact).groupBy("k", "item").agg((F.size(F.array_distinct(F.flatten(F.collect_list(F.expr("transform(at, w -> w.item_pos)"))))) / F.max("n_windows")).alias("cover"), F.min("exact").alias("exact"))
    return found.where(F.col("cover") >= min_cover)


def clean_documents(docs: DataFrame, found: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those in ``found``; all columns stay."""
    key = "__row_key"
    gone = stored(found.select(F.col("k").alias(key)).distinct(), "gone")
    return without_keys(docs.withColumn(key, row_key(id_col, text_col)), key, gone).select(*docs.columns)
