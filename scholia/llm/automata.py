"""Weighted acyclic automata over words: counts of phrases of up to three words.

A path of labels spells a phrase; the arc that ends it carries its count (0 where only longer phrases are counted). States are made from sorted phrases, and a state is frozen as soon as the next phrase
leaves its prefix: of the states frozen together, equal ones (the same labels with the same counts to the same states) are one. Labels are the words' places in a list of words that each automaton holds.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import zstandard


@dataclass
class Phrases:
    """Sorted phrases of two words (``first``, ``second``, ``pair_count``), and of three: the place of their first two, ``third``, ``count``. Words are places in ``words``, which is sorted."""

    words: list[bytes]
    first: np.ndarray
    second: np.ndarray
    pair_count: np.ndarray
    pair: np.ndarray
    third: np.ndarray
    count: np.ndarray

    def kept(self, least: int) -> Phrases:
        """Those counted ``least`` times or more; pairs that others of them begin with stay."""
        three = self.count >= least
        two = self.pair_count >= least
        two[self.pair[three]] = True
        place = np.cumsum(two) - 1
        return Phrases(self.words, self.first[two], self.second[two], self.pair_count[two], place[self.pair[three]], self.third[three], self.count[three]).slim()

    def slim(self) -> Phrases:
        """The same with no words that aren't used."""
        used = np.zeros(len(self.words), bool)
        for a in (self.first, self.second, self.third):
            used[a] = True
        place = np.cumsum(used) - 1
        return Phrases([self.words[i] for i in np.flatnonzero(used).tolist()], place[self.first], place[self.second], self.pair_count, self.pair, place[self.third], self.count)


def summed(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct codes, the sums of their counts (each 1 where none are given), and each code's place among them."""
    order = np.argsort(codes)
    arranged = codes[order]
    starts = _starts(arranged)
    place = np.empty(len(codes), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    if counts is None:
        return arranged[starts], np.diff(np.append(starts, len(codes))), place
    return arranged[starts], np.add.reduceat(counts[order], starts) if len(codes) else counts, place


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each row of the columns, equal for equal rows."""
    out = columns[0]
    for c in columns[1:]:
        _, _, out = summed(out)
        out = out * (int(c.max(initial=0)) + 1) + c
    return summed(out)[2]


class Register:
    """Frozen states of one depth, equal ones once: the columns of their arcs (label, count, target) in a row."""

    def __init__(self, width: int) -> None:
        self.parts: list[list[np.ndarray]] = [[] for _ in range(width)]
        self.lengths: list[np.ndarray] = []
        self.states = 0

    def freeze(self, starts: np.ndarray, *arcs: np.ndarray) -> np.ndarray:
        """The numbers of the states whose arcs are the rows from each start to the next. States are told apart arc by arc: those that are equal up to an arc get one number, and so on to their ends."""
        lengths = np.diff(np.append(starts, len(arcs[0])))
        arc = _numbered(*arcs)
        number = lengths.copy()
        most = int(lengths.max(initial=0))
        longer, size = np.arange(len(starts)), int(arc.max(initial=0)) + 1
        seen = most + 1
        for j in range(most):
            longer = longer[lengths[longer] > j]
            if not len(longer):
                break
            distinct, alike, place = summed(number[longer] * size + arc[starts[longer] + j])
            number[longer] = seen + place  # above those of states that have ended
            seen += len(distinct)
            longer = longer[alike[place] > 1]  # a state that is like no other needn't be looked at to its end
        _, first, which = np.unique(number, return_index=True, return_inverse=True)
        self.lengths.append(lengths[first])
        at = spread(starts[first], lengths[first])
        for part, a in zip(self.parts, arcs):
            part.append(a[at])
        self.states += len(first)
        return which + (self.states - len(first))

    def columns(self) -> tuple[np.ndarray, ...]:
        none = np.empty(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (self.lengths, *self.parts))


def build(p: Phrases, step: int = 1 << 20) -> bytes:
    """The automaton of sorted phrases as bytes. Pairs are taken ``step`` or more at a time, up to the end of a first word, and their states frozen. Its words are those of ``p``."""
    thirds, seconds, firsts, states, begin = Register(2), Register(3), [], [], 0
    while begin < len(p.first):
        end = min(begin + step, len(p.first))
        end = int(np.searchsorted(p.first, p.first[end - 1], side="right"))
        lo, hi = np.searchsorted(p.pair, (begin, end))
        target = np.zeros(end - begin, np.int64)  # 0 is none
        starts = _starts(p.pair[lo:hi])
        target[p.pair[lo:hi][starts] - begin] = thirds.freeze(starts, p.third[lo:hi], p.count[lo:hi]) + 1
        starts = _starts(p.first[begin:end])
        states.append(seconds.freeze(starts, p.second[begin:end], p.pair_count[begin:end], target))
        firsts.append(p.first[begin:end][starts])
        begin = end
    none = np.empty(0, np.int64)
    root = [np.concatenate(x) if x else none for x in (firsts, states)]
    numbers = [np.fromiter(map(len, p.words), np.int64, len(p.words)), *root, *seconds.columns(), *thirds.columns()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(_packed, numbers)) + b"".join(p.words))


def _packed(a: np.ndarray) -> bytes:
    """Length, width and values, in as few bytes a value as the largest needs."""
    width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << (8 * w - (w == 8)))
    return len(a).to_bytes(8, "little") + width.to_bytes(1, "little") + a.astype(f"<u{width}").tobytes()


def phrases(data: bytes) -> Phrases:
    """The phrases that an automaton spells, in order."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, arrays = 0, []
    for _ in range(10):
        n, width = int.from_bytes(raw[at : at + 8], "little"), raw[at + 8]
        arrays.append(np.frombuffer(raw, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + n * width
    lengths, first, state, n2, second, pair_count, target, n3, third, count = arrays
    ends = at + np.cumsum(lengths)
    words = [raw[e - k : e] for k, e in zip(lengths.tolist(), ends.tolist())]
    from2, from3 = np.cumsum(n2) - n2, np.append(0, np.cumsum(n3))[:-1]
    arcs2 = spread(from2[state], n2[state])
    target = target[arcs2] - 1
    has = np.flatnonzero(target >= 0)
    arcs3 = spread(from3[target[has]], n3[target[has]])
    return Phrases(words, np.repeat(first, n2[state]), second[arcs2], pair_count[arcs2], np.repeat(has, n3[target[has]]), third[arcs3], count[arcs3])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its length."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def union(automata: Iterable[bytes], at_once: int = 64) -> Phrases:
    """The phrases of all automata with the sums of their counts. ``at_once`` of them are held besides the sum so far."""
    out, some = None, []
    for a in automata:
        some.append(phrases(a))
        if len(some) >= at_once:
            out, some = _joined([*([out] if out else []), *some]), []
    return _joined([*([out] if out else []), *some])


def _joined(parts: list[Phrases]) -> Phrases:
    words = sorted(set().union(*(p.words for p in parts)))
    place = {w: i for i, w in enumerate(words)}
    maps = [np.fromiter(map(place.__getitem__, p.words), np.int64, len(p.words)) for p in parts]
    n = max(1, len(words))
    codes = np.concatenate([m[p.first] * n + m[p.second] for m, p in zip(maps, parts)] or [np.empty(0, np.int64)])
    pairs, counts, where = summed(codes, np.concatenate([p.pair_count for p in parts] or [np.empty(0, np.int64)]))
    at, threes = 0, []
    for m, p in zip(maps, parts):
        threes.append(where[at : at + len(p.first)][p.pair] * n + m[p.third])
        at += len(p.first)
    codes, three_counts, _ = summed(np.concatenate(threes or [np.empty(0, np.int64)]), np.concatenate([p.count for p in parts] or [np.empty(0, np.int64)]))
    return Phrases(words, pairs // n, pairs % n, counts, codes // n, codes % n, three_counts)


def composed(asked: Phrases, counts: Phrases) -> Phrases:
    """The pairs of ``asked`` that ``counts`` spells, with its counts: both are walked along equal words, first the first ones, then the second."""
    place = {w: i for i, w in enumerate(counts.words)}
    to = np.fromiter((place.get(w, -1) for w in asked.words), np.int64, len(asked.words))
    n = max(1, len(counts.words))
    known, codes = counts.first * n + counts.second, to[asked.first] * n + to[asked.second]
    there = (to[asked.first] >= 0) & (to[asked.second] >= 0)
    at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
    hit = there & (known[at] == codes) if len(known) else np.zeros(len(codes), bool)
    none = np.empty(0, np.int64)
    return Phrases(asked.words, asked.first[hit], asked.second[hit], counts.pair_count[at[hit]] if len(known) else none, none, none, none)
